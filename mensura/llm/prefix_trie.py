"""The trie of conversation prefixes, with totals of each node's subtree.

A turn's place in its conversation and its content give two 64-bit hashes; the exclusive or of a prefix's hashes names its
node (128 bits), whatever partition its rows are in. So positions and names come from a scan of ranges of (conversation,
turn): each range is numbered by itself, and only the conversation that reaches into a range takes on what stood before (one
row a range). A conversation of any length is dealt over many ranges.

Subtree totals go up in bands of `height` depths. The smallest member of a node has all the node's ancestors on its own
path, so nodes and path meet by (conversation, band): no more than `height` rows on each side, and no key is hot. Within a
band each node gives its values to its ancestors there. The roots of bands form a trie of a height-th of the depth, whose
totals are made the same way; a completed band root then gives its total to its ancestors in the band above. That takes
log(depth) rounds and at most `height` rows for each node.

Defined results: rows without conv_id belong to no conversation and count nowhere. A null role or text is empty, a null turn
comes first; equal turns are ordered by a digest of role and text, repeated rows all stay (each is a turn). Conversations
with no turn left are members of the root. An empty table gives no nodes. Other columns aren't read; texts are digested whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import WORD, settled, with_rows, written

NODE = ["depth", "x1", "x2"]
SUMS = ["n_leaves", "saved_tokens"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _ranged(df: DataFrame, *order) -> DataFrame:
    """df in ranges of conv_id and order, each row with its range's number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, "conv_id", *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, total, together, none) -> DataFrame:
    """For each range, the conversation that it begins with (_conv), and what together() makes of total over that conversation's rows in earlier
    ranges (_total). One row a range."""
    each = rows.groupBy("_range", "conv_id").agg(total.alias("_total"))
    ends = each.groupBy("_range").agg(F.min("conv_id").alias("_conv"), F.max("conv_id").alias("_last"), F.max_by("_total", "conv_id").alias("_total"))
    upto = ends.withColumn("_upto", together("_total").over(Window.partitionBy("_last").orderBy("_range")))
    before = Window.orderBy("_range")
    same = F.lag("_last").over(before) == F.col("_conv")
    return upto.select("_range", "_conv", F.when(same, F.lag("_upto").over(before)).otherwise(none).alias("_total"))


def _placed(rows: DataFrame, *order) -> DataFrame:
    """rows (of _ranged) with pos, from 1 in each conversation."""
    before = _carried(rows, F.count("*"), F.sum, F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy(*order))
    first = F.when(F.col("conv_id") == F.col("_conv"), F.col("_total")).otherwise(0)
    return rows.join(F.broadcast(before), "_range").withColumn("pos", (within + first).cast("long")).drop("_conv", "_total")


def _named(rows: DataFrame) -> DataFrame:
    """rows (of _placed) with x1 and x2, the name of the prefix that ends here, and y1 and y2, the turn's own hashes."""
    rows = rows.withColumns({"y1": F.xxhash64("pos", "digest"), "y2": F.xxhash64("digest", F.lit(1), "pos")})
    for x, y in (("x1", "y1"), ("x2", "y2")):
        before = _carried(rows, F.bit_xor(y), F.bit_xor, F.lit(0).cast("long"))
        within = F.bit_xor(y).over(Window.partitionBy("_range", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        first = F.when(F.col("conv_id") == F.col("_conv"), F.col("_total")).otherwise(F.lit(0).cast("long"))
        rows = rows.join(F.broadcast(before), "_range").withColumn(x, within.bitwiseXOR(first)).drop("_conv", "_total")
    return rows


def rebuilt(conversations: DataFrame, heads: int = 4, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like their base (the last id before them that is a multiple of `every`), and the ids of all: the first
    crc32(id) mod heads turns are the base's. The turns: conv_id, pos, words, x1, x2, y1, y2."""
    table, row = with_rows(conversations.select("conv_id", "turn", "role", "text"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = table.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), *row)
    order = [F.asc_nulls_first("turn"), "digest", *row]
    own = written(_placed(_ranged(turns, *order), *order).select("conv_id", "pos", "digest", "words"), "turns")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    ids = own.filter("pos = 1").select("conv_id")
    base = own.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    lent = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base").filter(F.col("pos") <= head)
    parts = lent.select("conv_id", F.lit(0).alias("part"), "pos", "digest", "words").unionByName(own.filter(F.col("pos") > head).withColumn("part", F.lit(1)))
    parts = parts.withColumnRenamed("pos", "_pos")
    return written(_named(_placed(_ranged(parts, "part", "_pos"), "part", "_pos")).select("conv_id", "pos", "words", "x1", "x2", "y1", "y2"), "paths"), ids


def _totals(values: DataFrame, paths: DataFrame, deepest: int, height: int) -> DataFrame:
    """NODE and SUMS over each node's subtree. values: conv_id (the smallest member), level (from 0), NODE and SUMS of each node itself; paths:
    conv_id, level and NODE of each conversation's nodes."""
    band = F.expr(f"level div {height}")
    path = paths.select("conv_id", band.alias("band"), F.col("level").alias("_at"), *NODE)
    sums = [F.sum(x).alias(x) for x in SUMS]
    inside = values.select("conv_id", band.alias("band"), "level", *SUMS).join(path, ["conv_id", "band"]).filter("_at <= level").groupBy(*NODE).agg(*sums)
    if deepest < height:
        return inside
    inside = written(inside, "bands")
    level = F.expr(f"level div {height}").alias("level")
    roots = values.filter(F.col("level") % height == 0).select("conv_id", level, *NODE).join(inside, NODE)
    whole = _totals(roots, paths.filter(F.col("level") % height == 0).select("conv_id", level, *NODE), deepest // height, height)
    done = roots.select("conv_id", "level", *NODE).join(whole, NODE).filter("level > 0").select("conv_id", (F.col("level") - 1).alias("band"), *SUMS)
    across = done.join(path, ["conv_id", "band"]).select(*NODE, *SUMS)
    return written(inside.select(*NODE, *SUMS).unionByName(across).groupBy(*NODE).agg(*sums), "totals")


def _digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256: the digest of the node's conv_ids (ends: NODE, conv_id), in order. Ids are joined range by range; a node whose ids
    lie in several ranges (one at most for each border) has the ranges' pieces hashed one after the other, as they come."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ends.repartitionByRange(n, *NODE, "conv_id").withColumn("_range", F.spark_partition_id())
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = written(ranges.groupBy("_range", *NODE).agg(F.min("conv_id").alias("_first"), joined.alias("piece")), "ends")
    several = pieces.groupBy(*NODE).count().filter("count > 1").select(*NODE)
    whole = pieces.join(F.broadcast(several), NODE, "left_anti").select(*NODE, F.sha2("piece", 256).alias("ends_sha256"))

    def run(batches):
        node, state = None, hashlib.sha256()

        def told():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[x] for x in NODE)
                if key != node:
                    if node:
                        yield told()
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["piece"].encode())
        if node:
            yield told()

    parted = pieces.join(F.broadcast(several), NODE).repartition(*NODE).sortWithinPartitions(*NODE, "_first")
    return whole.unionByName(parted.select(*NODE, "piece").mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, height: int = 8) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations (see rebuilt)."""
    return settled(conversations.sparkSession, lambda: _trie(conversations, height), "trie")


def _trie(conversations: DataFrame, height: int) -> DataFrame:
    paths, ids = rebuilt(conversations)
    paths = paths.withColumnRenamed("pos", "depth")
    below = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("y1").alias("y1"), F.max("y2").alias("y2"))
    below = below.select("conv_id", "n_convs", "words", *NODE, *(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}")).alias(f"p{k}") for k in (1, 2)))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select("conv_id", "n_convs", zero.alias("words"), *(zero.alias(x) for x in NODE), *(F.lit(None).cast("long").alias(f"p{k}") for k in (1, 2)))
    nodes = written(below.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    valued = written(valued.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "valued")

    inner = valued.filter("depth > 0")
    level = (F.col("depth") - 1).alias("level")
    deepest, many = valued.agg(F.max("depth"), F.count("*")).first()
    totals = _totals(inner.select("conv_id", level, *NODE, *SUMS), paths.select("conv_id", level, *NODE), (deepest or 0) - 1, height)
    top = valued.agg(*[F.sum(x).alias(x) for x in SUMS]).filter("n_leaves is not null").select(*(zero.alias(x) for x in NODE), *SUMS)  # the root's are all nodes' own
    totals = totals.select(*NODE, *SUMS).unionByName(top)

    last = paths.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"end.{x}", zero).alias(x) for x in NODE))

    parent = valued.select(*(F.col(x).alias(f"_{x}") for x in NODE), F.col("conv_id").alias("parent_conv_id"), "n_children")
    is_parent = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_x1")) & (F.col("p2") == F.col("_x2"))
    large = max(1000, (many or 0) // 1000)  # no more than a thousand nodes have so many children
    heavy, light = parent.filter(F.col("n_children") > large).drop("n_children"), parent.filter(F.col("n_children") <= large).drop("n_children")
    found = inner.join(F.broadcast(heavy), is_parent).unionByName(inner.join(F.broadcast(heavy), is_parent, "left_anti").join(light, is_parent))
    whole = found.drop("_depth", "_x1", "_x2").unionByName(valued.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = whole.drop(*SUMS).join(totals, NODE).join(_digests(ends), NODE, "left").fillna(EMPTY, ["ends_sha256"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
