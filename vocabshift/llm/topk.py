"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, grouped by length into logarithmic *buckets* and packed into *blocks* of at most
``BLOCK`` rows of one bucket, where they are read: no shuffle, and a hot vector only makes more blocks.  Buckets are
searched from the longest vectors down, in two rounds:

1. every query block meets the blocks of the longest buckets that together hold ``SEED_ROWS`` rows; the k-th best
   score is a lower bound ``theta`` for the query;
2. every query block meets the other buckets whose upper length can still reach a query's ``theta``.

For a query and a block, ``theta / (|q| * longest)`` is the *local cosine threshold*.  Over 1, the block is skipped.
At ``COORDINATE`` or more the block's unit vectors are filtered by the range that their value at the query's largest
coordinates must have at this angle; below, by length alone.  What is left is verified by exact integer products
(doubles where all sums stay under 2**53, Python integers beyond).

Blocks meet by an equi-join on (bucket, salt): a bucket gets one salt for every ``BLOCKS_PER_SALT`` of its blocks and a
query block is sent once to each salt, so a bucket with most of the rows is spread over the cluster.  Bucket counts
(at most a few hundred rows, whatever the data) are all that reaches the driver.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null id, take no
part; vectors of different lengths are compared over their common coordinates; an empty vector scores 0; ties
go to the smaller id; rows that repeat id and vector count once; a row with the query's id is the query's own;
components beyond 64 bits are held at the limit and scores too; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocabshift.llm.common import map_rows, stored

K = 5
SCALE = 256
EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 512
SEED_ROWS = 8192
BLOCKS_PER_SALT = 4
BUCKETS_PER_DOUBLING = 8
COORDINATE = 0.6
FOCUS = 3
TILE = 1 << 20
SLACK = 1e-9
LIMIT = float(1 << 62)

BLOCK_SCHEMA = "bucket int, block string, n int, dim int, longest double, ids binary, matrix binary"
PAIR_SCHEMA = "query_id long, vec_id long, score long"


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, held at the limits."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _norms(matrix: np.ndarray) -> np.ndarray:
    m = matrix.astype(np.float64)
    return np.sqrt((m * m).sum(axis=1))


def _packed(rows: int, with_queries_only: bool):
    """Partition function: (id, vector) rows to blocks by length bucket."""

    def pack(bucket: int, dim: int, held: dict, seq: int) -> dict:
        ids = np.fromiter((i for i, _ in held), np.int64)
        matrix = np.frombuffer(b"".join(v for _, v in held), np.int64).reshape(len(held), dim)
        norms = _norms(matrix)
        order = np.lexsort((ids, -norms))
        context = TaskContext.get()
        name = f"{context.partitionId() if context else 0}-{seq}"
        return {
            "bucket": bucket,
            "block": name,
            "n": len(ids),
            "dim": dim,
            "longest": float(norms.max()),
            "ids": ids[order].tobytes(),
            "matrix": np.ascontiguousarray(matrix[order]).tobytes(),
        }

    def run(batches):
        held: dict[tuple[int, int], dict] = {}
        seq = 0
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            finite = np.concatenate([[0], np.cumsum(~np.isfinite(values.astype(np.float64)))])
            for k, end in enumerate(ends.tolist()):
                start = int(ends[k - 1]) if k else 0
                if finite[end] != finite[start] or (with_queries_only and ids[k] % EVERY):
                    continue
                vector = integers(values[start:end])
                norm = float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
                bucket = int(np.floor(np.log2(norm) * BUCKETS_PER_DOUBLING)) if norm else -1
                key = (bucket, len(vector))
                own = held.setdefault(key, {})
                own[(int(ids[k]), vector.tobytes())] = None
                if len(own) >= rows:
                    yield batch_of([pack(*key, held.pop(key), seq)])
                    seq += 1
        rest = []
        for key in sorted(held):
            rest.append(pack(*key, held[key], seq))
            seq += 1
            if len(rest) >= 16:
                yield batch_of(rest)
                rest = []
        yield batch_of(rest)

    return run


def blocks(vectors: DataFrame, rows: int, queries: bool, name: str) -> DataFrame:
    """Stored blocks of the vectors that take part (of those among them that are queries)."""
    usable = vectors.where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull())
    ).select(F.col("vec_id").cast("long"), "embedding")
    if queries:
        usable = usable.where(F.col("vec_id") % EVERY == 0)
    return stored(map_rows(usable, _packed(rows, queries), BLOCK_SCHEMA), name)


def _read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}matrix"], np.int64).reshape(len(ids), row[f"{prefix}dim"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``, held at 64 bits."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def candidate_mask(q: np.ndarray, c: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(queries x candidates) whether a candidate can reach the query's ``theta`` (-inf: all can).

    Length pruning where the block's local cosine threshold is low, coordinate pruning where it is high.
    """
    q_norm, c_norm = _norms(q), _norms(c)
    longest = c_norm.max(initial=0.0)
    bounded = theta > 0
    need = np.where(bounded, theta, 0.0)
    mask = (q_norm[:, None] * c_norm[None, :]) * (1 + SLACK) >= need[:, None]
    mask[~bounded] = True
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(bounded & (q_norm > 0), need / (q_norm * longest), 0.0)
    angled = np.flatnonzero((t >= COORDINATE) & (t <= 1))
    if len(angled) and q.shape[1] and longest:
        unit_c = c / np.maximum(c_norm, 1e-300)[:, None]
        unit_q = q[angled] / q_norm[angled][:, None]
        focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
        alpha = np.arccos(np.clip(t[angled] * (1 - SLACK), -1, 1))
        for f in range(focus.shape[1]):
            beta = np.arccos(np.clip(np.take_along_axis(unit_q, focus[:, f : f + 1], axis=1)[:, 0], -1, 1))
            low = np.cos(np.minimum(beta + alpha, np.pi)) - SLACK
            high = np.cos(np.maximum(beta - alpha, 0)) + SLACK
            value = unit_c[:, focus[:, f]].T
            mask[angled] &= (value >= low[:, None]) & (value <= high[:, None])
    return mask


def _best(q_ids, q, c_ids, c, theta, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its k best candidates of a block: (query ids, candidate ids, scores)."""
    dim = min(q.shape[1], c.shape[1])
    mask = candidate_mask(q, c, theta) & (q_ids[:, None] != c_ids[None, :])
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    scores = _products(q[rows][:, :dim], c[cols][:, :dim])
    mask = mask[np.ix_(rows, cols)] & (scores >= theta[rows][:, None])
    if len(cols) > k:
        low = np.iinfo(np.int64).min
        kth = np.partition(np.where(mask, scores, low), len(cols) - k, axis=1)[:, len(cols) - k]
        mask &= scores >= kth[:, None]
    at, of = np.nonzero(mask)
    score, cand = scores[at, of], c_ids[cols[of]]
    order = np.lexsort((cand, -score, at))
    at, score, cand = at[order], score[order], cand[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    keep = rank < k
    return q_ids[rows[at[keep]]], cand[keep], score[keep]


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _read(row, "q_")
                c_ids, c = _read(row, "c_")
                theta = np.frombuffer(row["q_theta"], np.float64) if row["q_theta"] else np.full(len(q_ids), -np.inf)
                step = max(1, TILE // max(1, len(c_ids)))
                for a in range(0, len(q_ids), step):
                    z = slice(a, a + step)
                    found = _best(q_ids[z], q[z], c_ids, c, theta[z], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"]
                    )

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(query_blocks: DataFrame, cand_blocks: DataFrame, salts: dict[int, int], reach: bool, k: int) -> DataFrame:
    """k best of every (query block, candidate block) pair whose bucket is in ``salts``.

    With ``reach`` only buckets whose upper length can reach a block's least ``theta / |q|`` are met.
    """
    n_salts = F.create_map(*[F.lit(x) for item in sorted(salts.items()) for x in item])
    c = cand_blocks.where(F.col("bucket").isin(*salts)).select(
        "bucket",
        F.pmod(F.xxhash64("block"), n_salts[F.col("bucket")]).cast("int").alias("salt"),
        *[F.col(x).alias(f"c_{x}") for x in ("dim", "ids", "matrix")],
    )
    # every salt of every bucket: (bucket, count) pairs spelled out by Spark, not by the driver
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("n")) for b, n in sorted(salts.items())])
    salts_of = lambda e: F.transform(
        F.sequence(F.lit(0), e["n"] - 1), lambda s: F.struct(e["bucket"].alias("bucket"), s.alias("salt"))
    )
    target = F.flatten(F.transform(each, salts_of))
    if reach:
        upper = lambda b: F.pow(F.lit(2.0), (b + 1) / float(BUCKETS_PER_DOUBLING)) * (1 + SLACK)
        target = F.filter(target, lambda p: (upper(p["bucket"]) >= F.col("ratio")) | F.col("ratio").isNull())
    q = query_blocks.withColumn("p", F.explode(target)).select(
        F.col("p.bucket").alias("bucket"),
        F.col("p.salt").alias("salt"),
        *[F.col(x).alias(f"q_{x}") for x in ("dim", "ids", "matrix", "theta")],
    )
    return map_rows(c.join(q, ["bucket", "salt"]).drop("bucket", "salt"), _search(k), PAIR_SCHEMA)


def _with_theta(query_blocks: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th best seed score of every query and the least ratio to the query's length."""
    bound = seeds.where(F.col("rank") == k).select("query_id", "score")
    ids = map_rows(
        query_blocks.select("bucket", "block", "ids"), _exploded_ids, "bucket int, block string, at int, query_id long"
    )
    known = ids.join(bound, "query_id", "left").groupBy("bucket", "block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", F.coalesce("score", F.lit(-(2**63))).alias("score")))),
            lambda x: x["score"],
        ).alias("bounds")
    )
    joined = query_blocks.drop("theta", "ratio").join(known, ["bucket", "block"])

    def add(batches):
        for batch in batches:
            rows = batch.to_pylist()
            thetas, ratios = [], []
            for r in rows:
                _, q = _read(r, "")
                theta = np.array([-np.inf if s == -(2**63) else float(s) for s in r["bounds"]])
                norm = _norms(q)
                ratio = float(np.min(np.where(norm > 0, theta / np.maximum(norm, 1e-300), -np.inf)))
                thetas.append(theta.tobytes())
                ratios.append(max(ratio, -1.0))
            keep = batch.select([c for c in batch.schema.names if c != "bounds"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(thetas, pa.binary()), pa.array(ratios, pa.float64())],
                [*keep.schema.names, "theta", "ratio"],
            )

    names = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "bounds"]
    return map_rows(joined, add, ", ".join([*names, "theta binary", "ratio double"]))


def _exploded_ids(batches):
    for batch in batches:
        buckets, names, at, ids = [], [], [], []
        for r in batch.to_pylist():
            own = np.frombuffer(r["ids"], np.int64).tolist()
            buckets += [r["bucket"]] * len(own)
            names += [r["block"]] * len(own)
            at += range(len(own))
            ids += own
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(names), pa.array(at, pa.int32()), pa.array(ids, pa.int64())],
            ["bucket", "block", "at", "query_id"],
        )


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score."""
    cand = blocks(vectors, BLOCK, False, "vectors")
    query = blocks(vectors, QUERY_BLOCK, True, "queries")
    sizes = {r["bucket"]: (r["n"], r["b"]) for r in cand.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("b")).collect()}
    salts = {bucket: -(-b // BLOCKS_PER_SALT) for bucket, (_, b) in sizes.items()}
    seeds, seen = {}, 0
    for bucket in sorted(sizes, reverse=True):
        if seen >= SEED_ROWS:
            break
        seeds[bucket] = salts[bucket]
        seen += sizes[bucket][0]
    rest = {b: s for b, s in salts.items() if b not in seeds}
    unbounded = query.withColumns({"theta": F.lit(None).cast("binary"), "ratio": F.lit(None).cast("double")})
    empty = vectors.sparkSession.createDataFrame([], PAIR_SCHEMA)
    first = _top(_meet(unbounded, cand, seeds, False, k) if seeds else empty, k)
    if not rest:
        return first
    first = stored(first, "seeds")
    more = _meet(_with_theta(query, first, k), cand, rest, True, k)
    return _top(first.drop("rank").unionByName(more), k)


def report(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of every query's best candidates."""
    return top_k(vectors).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
