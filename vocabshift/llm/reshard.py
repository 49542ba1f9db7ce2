"""Resharding by minimum-cost flow: new shards of near-equal bytes, moving as few bytes as possible.

The old layout is ``old_shards`` shards by a hash of the id; the new one has ``new_shards`` shards of equal byte
capacity; shard numbers that both have stay in place.

1. Every row gets a number in a stored table of (id, size, checksum, old shard); rows form *blocks* of about
   ``BLOCK_ROWS`` by a hash of their number, so equal ids or texts spread over blocks.
2. Rows larger than ``1 / LARGE`` of a new shard are placed one by one, largest first: in their old shard while
   it has room, else in the least filled shard.  There are at most ``new_shards * LARGE`` of them.
3. The remaining bytes of the old shards and the remaining capacities (the level at which all shards end equally
   full) make a transport network; a byte that changes shard costs 1.  Successive shortest paths solve it on
   ``old_shards * new_shards`` edges, whatever the number of rows.
4. The flow gives every old shard a few byte intervals, one for each target.  Running sums of block sizes, then of row
   sizes in a block, say in which interval the middle of a row lies.
5. Slots number the rows of a shard from 0 without gaps, by counts of (shard, block) and row numbers in a block.

``rewrite`` then writes the files of the shards that gained or lost rows.

Defined cases: a null text has size 8 and the checksum of no bytes; a null id hashes like an empty one; repeated
rows are rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabshift.llm.common import stored

OLD_SHARDS = 16
NEW_SHARDS = 24
BLOCK_ROWS = 1024
LARGE = 64
ROW_OVERHEAD = 8


def min_cost_flow(supply: list[int], capacity: list[int], same: list[int | None]) -> dict[tuple[int, int], int]:
    """Bytes from every source to every target at least cost; ``same[i]`` is the target that costs source i nothing.

    Successive shortest paths in the residual network; the capacities must take the whole supply.
    """
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    cost = lambda i, j: 0 if same[i] == j else 1
    while any(left):
        # shortest residual distance from any source with supply: sources are 0..n-1, targets n..n+m-1
        dist: list[float] = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        via: list[int | None] = [None] * (n + m)
        todo = deque(i for i in range(n) if left[i])
        while todo:
            a = todo.popleft()
            if a < n:
                steps = [(n + j, cost(a, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, a - n)) for i in range(n) if flow.get((i, a - n))]
            for b, c in steps:
                if dist[a] + c < dist[b]:
                    dist[b], via[b] = dist[a] + c, a
                    if b not in todo:
                        todo.append(b)
        end = min((n + j for j in range(m) if room[j]), key=lambda b: (dist[b], b))
        path = [end]
        while via[path[-1]] is not None:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[(b, a - n)])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + amount
            else:
                flow[(b, a - n)] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {edge: f for edge, f in flow.items() if f}


def level_capacities(placed: list[int], rest: int) -> list[int]:
    """Room of every shard so that ``rest`` more bytes fill all shards to one level where possible."""
    loads = sorted(placed)
    level, shards = 0, len(loads)
    for k in range(1, shards + 1):
        level = -(-(rest + sum(loads[:k])) // k)
        if k == shards or level <= loads[k]:
            break
    room = [max(0, level - p) for p in placed]
    extra = sum(room) - rest
    for j in sorted(range(shards), key=lambda j: -room[j]):
        cut = min(extra, 1 if room[j] else 0)
        room[j] -= cut
        extra -= cut
    return room


def place_large(rows: list[tuple[int, int, int]], shards: int, target: int) -> tuple[dict[int, int], list[int]]:
    """(shard of every large row, bytes placed per shard) for (row, old shard, size) rows."""
    load = [0] * shards
    where: dict[int, int] = {}
    for row, old, size in sorted(rows, key=lambda r: (-r[2], r[0])):
        j = old if old < shards and load[old] + size <= target else min(range(shards), key=lambda j: (load[j], j))
        where[row] = j
        load[j] += size
    return where, load


def numbered(documents: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    """The stored table (row, doc_id, size, text_crc32, old_shard) with a number for every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    id_crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return stored(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.length(raw) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.pmod(id_crc, F.lit(old_shards)).cast("int").alias("old_shard"),
        ),
        "rows",
    )


def _interval(old: Column, middle: Column, flow: dict[tuple[int, int], int], sources: int) -> Column:
    """The target of a row whose middle byte lies at ``middle`` of its old shard's small rows."""
    out = F.lit(None).cast("int")
    for i in range(sources):
        pieces = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        out = F.when(old == i, _nested(pieces, flow, i, middle)).otherwise(out)
    return out


def _nested(pieces: list[int], flow: dict[tuple[int, int], int], i: int, middle: Column) -> Column:
    """The first piece whose end lies beyond ``middle``."""
    out, upto = None, 0
    for j in pieces[:-1]:
        upto += flow[(i, j)]
        out = F.when(middle < upto, j) if out is None else out.when(middle < upto, j)
    last = F.lit(pieces[-1] if pieces else 0)
    return last if out is None else out.otherwise(last)


def assign(rows: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """``rows`` (of ``numbered``) + shard and slot."""
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n_blocks = max(1, -(-total["n"] // (old_shards * BLOCK_ROWS)))
    target = (total["bytes"] or 0) // new_shards
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    large = F.col("size") > target // LARGE
    big = [(r["row"], r["old_shard"], r["size"]) for r in rows.where(large).collect()] if total["n"] else []
    where, placed = place_large(big, new_shards, target)
    per_block = blocked.groupBy("old_shard", "block").agg(F.sum(F.when(~large, F.col("size")).otherwise(0)).alias("s"))
    supply = [0] * old_shards
    for r in per_block.groupBy("old_shard").agg(F.sum("s").alias("s")).collect():
        supply[r["old_shard"]] = r["s"]
    same = [i if i < new_shards else None for i in range(old_shards)]
    flow = min_cost_flow(supply, level_capacities(placed, sum(supply)), same)

    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("old_shard", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("old_shard", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    small_size = F.when(large, 0).otherwise(F.col("size"))
    placed_small = blocked.join(offsets, ["old_shard", "block"])
    middle = F.col("offset") + F.sum(small_size).over(within) - small_size / 2
    by_flow = placed_small.withColumn("middle", middle)
    fixed = spark.createDataFrame([*where.items()], "row long, large_shard int")
    shard = F.coalesce("large_shard", _interval(F.col("old_shard"), F.col("middle"), flow, old_shards))
    sharded = by_flow.join(F.broadcast(fixed), "row", "left").withColumn("shard", shard)
    done = stored(sharded.select("row", "doc_id", "size", "text_crc32", "old_shard", "block", "shard"), "sharded")

    key = ["shard", "old_shard", "block"]
    counts = done.groupBy(*key).count()
    earlier = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*key, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy(*key).orderBy("row")) - 1
    return done.join(first, key).withColumn("slot", slot.cast("long"))


def report(documents: DataFrame) -> DataFrame:
    """Shard and slot of every document under the ``bytes`` law."""
    found = assign(numbered(documents))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def rewrite(documents: DataFrame, assigned: DataFrame, path: str) -> list[int]:
    """Writes the files of the shards that gained or lost rows under ``path``; returns these shards.

    Every row is written once: rows of equal id, size and checksum (nulls equal) are numbered on both sides and matched by
    that number too, in one task for each such group.  Files of other shards under ``path`` stay, and a shard that lost
    all its rows loses its files.
    """
    moved = assigned.where(F.col("shard") != F.col("old_shard"))
    ends = moved.select("shard").union(moved.select("old_shard")).distinct().collect()
    affected = sorted(r[0] for r in ends)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    mine = documents.select(
        F.struct(*documents.columns).alias("document"),
        F.col("doc_id").alias("id"),
        (F.length(raw) + F.lit(ROW_OVERHEAD)).cast("long").alias("n"),
        F.crc32(raw).alias("crc"),
    )
    same = Window.partitionBy("id", "n", "crc")
    mine = mine.withColumn("copy", F.row_number().over(same.orderBy("crc")))
    theirs = assigned.select(
        F.col("doc_id").alias("p_id"), F.col("size").alias("p_n"), F.col("text_crc32").alias("p_crc"), "shard", "slot", "row"
    )
    place = theirs.withColumn("p_copy", F.row_number().over(Window.partitionBy("p_id", "p_n", "p_crc").orderBy("row")))
    place = place.where(F.col("shard").isin(affected)).select(
        "p_id", "p_n", "p_crc", "p_copy", F.col("shard").alias("p_shard"), F.col("slot").alias("p_slot")
    )
    equal = F.col("id").eqNullSafe(F.col("p_id"))
    for c in ("n", "crc", "copy"):
        equal &= F.col(c) == F.col(f"p_{c}")
    kept = [F.col("document")[c].alias(c) for c in documents.columns if c not in ("shard", "slot")]
    content = mine.join(place, equal).select(*kept, F.col("p_slot").alias("slot"), F.col("p_shard").alias("shard"))
    spread = content.withColumn("__part", F.floor(F.col("slot") / 100_000)).repartition("shard", "__part")
    out = spread.sortWithinPartitions("shard", "slot").drop("__part").write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    filled = {r[0] for r in assigned.where(F.col("shard").isin(affected)).select("shard").distinct().collect()}
    spark = documents.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in sorted(set(affected) - filled):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"shard={shard}"), True)
    return affected
