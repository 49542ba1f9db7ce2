"""Trie of conversation prefixes with totals of all subtrees, by a depth-band rollup.

A node is a distinct sequence of first turns (role, text); the root is the empty one.  The rollup adds values (childless nodes,
tokens that a shared prefix saves) over each node's subtree:

1. *Node ids*: turns are numbered in their conversation (``ranked``, no task holds a conversation) and grouped by bands of
   ``BAND`` turns.  A band's turns are chained by a 128-bit hash; the ids of a band's nodes are its chain hashed with the id of
   what comes before.  That id is found the same way from the bands' last hashes, ``BAND`` bands at a time, so a
   conversation of any length needs rounds by the logarithm of its length and groups of at most ``BAND`` rows.
2. *Bands*: each node explodes to its ancestors inside its band and to the node above the band, at most ``BAND`` rows, which
   are summed map-side first.  Every node then has the total of its own band, and every node above a band that of the band below.
3. *Rollup*: the nodes between bands, with what lies in the band below each, form a trie of their own with a ``BAND``-th of the
   depth, which is totalled by the same steps.  Completed totals then explode once more to the ancestors inside the band above.

The members that end in a node are gathered in blocks of ids, so a node's list is put together from sorted blocks.

Rebuilt conversations: conversation ``c`` takes the first ``h`` turns of conversation ``c - c % 100`` in place of its own first
``h``, with ``h = crc32(c) % 6``.

Defined cases: turns are ordered by turn (nulls first), then role and text; null roles and texts are empty; rows without a
conversation id are left out; repeated rows are turns of their own; a conversation without turns is a member of the root;
an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import many_to_one, map_rows
from vocabshift.operators.rank import ranked
from vocabshift.staging import Staging

BAND = 32
SPAN = 100  # conversations that share the first turns of one
MOST_HEAD = 5
BLOCK = 4_096
ROOT = b""
NO_IDS = "array<binary>"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


# -- rebuilt conversations -----------------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame, staging: Staging) -> DataFrame:
    """(conv, turn_hash, chars, pos): each turn's place in its conversation, its hash and the code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")
    )
    hashed = _digest(F.length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    kept = ("conv", hashed.alias("turn_hash"), F.length("text").cast("long").alias("chars"))
    return ranked(turns, [F.col("turn").asc_nulls_first(), "role", "text"], staging, "pos", ["conv"], kept)


def rebuilt(turns: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """(conv, i, turn_hash, chars, size) of the rebuilt turns, and (conv, size) of all conversations."""
    turns = staging.put(turns, "turns")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % SPAN)
    heads = own.where("conv = base").select("base", F.least("n", F.lit(MOST_HEAD).cast("long")).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = own.withColumn("h", head).join(heads, "base", "left").select("conv", "base", "n", "h", taken.alias("taken"))
    convs = staging.put(convs.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    first = turns.where((F.col("conv") % SPAN == 0) & (F.col("pos") <= MOST_HEAD)).withColumnRenamed("conv", "base")
    shared = convs.join(first, "base").where("pos <= taken").select("conv", F.col("pos").alias("i"), "turn_hash", "chars", "size")
    rest = many_to_one(turns, convs.where("n > h"), ["conv"], "n").where("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("i"), "turn_hash", "chars", "size")
    return staging.put(shared.unionByName(rest), "rebuilt"), convs.select("conv", "size")


# -- bands -----------------------------------------------------------------------------------------------------------


def _banded(sequences: DataFrame, *columns: str) -> DataFrame:
    """(conv, band, items): at most ``BAND`` consecutive items (i and the columns), in order."""
    band = F.floor((F.col("i") - 1) / BAND).cast("long").alias("band")
    items = F.array_sort(F.collect_list(F.struct("i", *columns)))
    return sequences.groupBy("conv", band).agg(items.alias("items"))


def _chained(items: Column, name: str) -> Column:
    """Running hash of the items' hashes."""
    step = lambda acc, x: F.concat(acc, F.array(_digest(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(ROOT)), x[name])))
    return F.aggregate(items, F.array().cast(NO_IDS), step)


def prefix_ids(sequences: DataFrame, name: str, staging: Staging, *columns: str) -> DataFrame:
    """(conv, band, items, ids): ``ids`` name the prefixes that end at each item of the bands of ``sequences``."""
    bands = _banded(sequences, name, *columns).withColumn("chain", _chained(F.col("items"), name))
    first = bands.where("band = 0").withColumn("ids", F.col("chain"))
    if not sequences.where(F.col("i") > BAND).limit(1).count():
        return first.drop("chain")
    bands = staging.put(bands, "bands")
    first = bands.where("band = 0").withColumn("ids", F.col("chain"))
    totals = bands.where(F.size("chain") == BAND).select("conv", (F.col("band") + 1).alias("i"), F.element_at("chain", -1).alias("total"))
    before = staging.put(_rows_of(prefix_ids(staging.put(totals, "totals"), "total", staging)), "before")
    deep = bands.where("band > 0").join(before.select("conv", F.col("i").alias("band"), F.col("id").alias("up")), ["conv", "band"])
    ids = F.transform("chain", lambda x: _digest(F.col("up"), x))
    return first.unionByName(deep.withColumn("ids", ids).drop("up")).drop("chain")


def _rows_of(bands: DataFrame) -> DataFrame:
    """(conv, i, id) of banded ids."""
    rows = bands.select("conv", F.explode(F.arrays_zip("items", "ids")).alias("x"))
    return rows.select("conv", F.col("x.items.i").alias("i"), F.col("x.ids").alias("id"))


def with_ancestors(bands: DataFrame, *columns: str) -> DataFrame:
    """(conv, i, id, inside, above, columns) of banded ids: the ancestors in the band, nearest last, and the node above it."""
    above = bands.where(F.size("ids") == BAND).select("conv", (F.col("band") + 1).alias("band"), F.element_at("ids", -1).alias("above"))
    rows = bands.where("band > 0").join(above, ["conv", "band"]).unionByName(bands.where("band = 0").withColumn("above", F.lit(ROOT)))
    x = F.posexplode(F.arrays_zip("items", "ids")).alias("k", "x")
    rows = rows.select("conv", "ids", "above", x)
    return rows.select(
        "conv", F.col("x.items.i").alias("i"), F.col("x.ids").alias("id"), F.slice("ids", F.lit(1), F.col("k")).alias("inside"), "above",
        *[F.col(f"x.items.{c}").alias(c) for c in columns],
    )


# -- rollup ----------------------------------------------------------------------------------------------------------


def rollup(nodes: DataFrame, paths: DataFrame, staging: Staging) -> DataFrame:
    """(id, leaves, saved): totals of ``nodes`` (id, i, inside, above, leaves, saved) over all subtrees.

    ``paths`` are the banded ids that the nodes come from.  The root's row has what lies below it.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    target = lambda ids, below: F.transform(ids, lambda x: F.struct(x.alias("id"), F.lit(below).alias("below")))
    inside = F.concat(target(F.col("inside"), False), target(F.array("id"), False), target(F.array("above"), True))
    own = nodes.select(F.explode(inside).alias("to"), "leaves", "saved").groupBy("to.id", "to.below").agg(*sums)
    own = staging.put(own, "band-totals")
    within = own.where("not below").drop("below")
    between = own.where("below").drop("below")  # per node above a band: what its band holds
    if not nodes.where(F.col("i") > BAND).limit(1).count():
        return within.unionByName(between.where(F.col("id") == ROOT))
    ends = paths.where(F.size("ids") == BAND).select("conv", (F.col("band") + 1).alias("i"), F.element_at("ids", -1).alias("id"))
    upper = staging.put(_banded(ends, "id").withColumn("ids", F.col("items.id")), "ends")
    joints = with_ancestors(upper).groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("i", "inside", "above")])
    joints = joints.join(between, "id", "left").fillna(0, ["leaves", "saved"])
    done = rollup(staging.put(joints, "joints"), upper, staging)
    # the root's band hangs below no joint; its own sum and the joints' totals make the root's
    done = done.unionByName(between.where(F.col("id") == ROOT)).groupBy("id").agg(*sums)
    done = staging.put(done, "joint-totals")
    joint = nodes.where(F.col("i") % BAND == 0).select("id", F.concat("inside", F.array("id")).alias("to")).join(done, "id")
    carried = joint.select(F.explode("to").alias("id"), "leaves", "saved")
    return within.unionByName(carried).unionByName(done.where(F.col("id") == ROOT)).groupBy("id").agg(*sums)


# -- trie ------------------------------------------------------------------------------------------------------------


def _ends(members: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes in which conversations (id, conv) end: their ids ascending, comma-joined.

    Ids are sorted in blocks of ``BLOCK`` neighbouring numbers; a node's blocks are hashed one after the other.
    """
    block = F.floor(F.col("conv") / BLOCK).alias("block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = members.groupBy("id", block).agg(text.alias("part"))

    def run(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == at:
                    state.update(f",{part}".encode())
                    continue
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(part.encode())
            yield _ended(done)
        if state is not None:
            yield _ended([(at, state.hexdigest())])

    sorted_blocks = blocks.repartition("id").sortWithinPartitions("id", "block").select("id", "part")
    return map_rows(sorted_blocks, run, "id binary, ends_sha256 string")


def _ended(rows: list) -> pa.RecordBatch:
    ids, digests = [r[0] for r in rows], [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], names=["id", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes: id, parent_id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    staging = Staging(conversations.sparkSession, "trie")
    turns, convs = rebuilt(numbered_turns(conversations, staging), staging)
    paths = staging.put(prefix_ids(turns, "turn_hash", staging, "chars", "size"), "paths")
    steps = with_ancestors(paths, "chars", "size")
    parent = F.coalesce(F.try_element_at("inside", F.lit(-1)), F.col("above"))
    nodes = steps.groupBy("id").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.any_value(c).alias(c) for c in ("i", "inside", "above", "chars")],
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = staging.put(nodes.withColumn("parent", parent), "nodes")
    kids = staging.put(nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")), "children")

    known = ["id", "conv_id", "n_convs", "i", "chars", "parent"]
    top = root.select(F.lit(ROOT).alias("id"), "conv_id", "n_convs", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("binary").alias("parent"))
    every = nodes.select(*known).unionByName(top).join(kids, "id", "left").fillna(0, ["n_children"])
    every = staging.put(every, "every")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    valued = nodes.select("id", "inside", "above").join(every.where("i > 0").select("id", "i", leaf.alias("leaves"), saved.alias("saved")), "id")
    totals = rollup(staging.put(valued, "valued"), paths, staging)

    ended = paths.select("conv", F.element_at("items", -1).alias("last"), F.element_at("ids", -1).alias("id")).where("last.i = last.size")
    ends = _ends(ended.select("id", "conv").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("id"), "conv")))
    parents = every.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    placed = many_to_one(nodes.select("id", "parent"), staging.put(parents, "parents"), ["parent"], "n_children")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = (
        every.join(placed.select("id", "parent_conv_id"), "id", "left")
        .join(totals, "id", "left")
        .join(ends, "id", "left")
        .select(
            "id", F.col("parent").alias("parent_id"), "conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),  # a root without turns below is childless
            F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
    result = staging.put(out, "trie")
    staging.drop_all_but(result)
    return result


def report(trie: DataFrame) -> DataFrame:
    """The digest columns of ``prefix_trie``."""
    return trie.drop("id", "parent_id")


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base FROM turns GROUP BY conv_id
), crc_table AS (  -- crc32 of the decimal id, by its table of 256 values
  SELECT list(v ORDER BY b) AS v FROM (
    SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END) AS v FROM range(256) t(b))
), heads AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
         list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
         lambda c, x: xor(c // 256, crc_table.v[xor(c % 256, x) + 1])), CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM convs, crc_table
), taken AS (
  SELECT h.conv_id, t.pos AS i, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
), rest AS (
  SELECT t.conv_id, t.pos - h.h + (SELECT count(*) FROM taken k WHERE k.conv_id = t.conv_id) AS i, t.role, t.text
  FROM turns t JOIN heads h USING (conv_id) WHERE t.pos > h.h
), rebuilt AS (SELECT * FROM taken UNION ALL SELECT * FROM rest
), members AS (
  SELECT conv_id, 0 AS depth, CAST([] AS VARCHAR[]) AS path, 0 AS chars FROM convs
  UNION ALL
  SELECT conv_id, i, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY i), length(text) FROM rebuilt
), sizes AS (SELECT conv_id, max(depth) AS size FROM members GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM members JOIN sizes USING (conv_id) GROUP BY path, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
), totals AS (
  SELECT a.path, a.depth, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM linked) d JOIN linked a ON a.depth = d.up AND a.path = d.path[:d.up]
  GROUP BY a.path, a.depth
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN totals USING (path, depth)
"""
