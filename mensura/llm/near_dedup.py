"""Near-duplicate groups from bottom-k sketches of one hash function.

1. One pass over the texts gives each document's number of distinct word shingles, a digest of the whole set, and the
   `keep` smallest hashes of it (its bottom-k sketch). Documents with the same set are one class from here on, so a
   group of exact copies, of whatever size, is one row.
2. The `listed` smallest values of each class may be entries of inverted lists. Each of the smallest values of the union of
   two sets of similarity J is in both with probability J, independently, so of `listed` retained values two linked
   classes share a least number but for a chance of one in a million (small sets are retained whole, and share J of
   their size for certain). So, with the values ordered by the number of classes that retain them, two linked classes share one of
   their rarest `listed` - least number + 1 values, and only those are entered. A line or a passage that very many
   documents share is common, so it is entered only by documents that consist mostly of shared text.
3. Lists give candidates in three rounds. First each list's members meet its most typical member only: the one whose retained
   values most classes retain, which is the least edited of a group of copies. What that links is one
   component, whose members need not meet again; so a group of near copies costs as many pairs as it has members. In
   lists that still hold several components, the members meet one that is chosen by hash, another one in each list. In
   what is still mixed, members of different components meet: all of them in lists of at most `direct` members; in longer
   ones, those outside the largest component meet all others, which leaves out no pair of different components. A pair that
   shares several lists meets in the first of them only, and once. No list is cut, so no link is lost but by the chance of step 2. Two bounds that hold for every linked pair are part of this join's
   condition: enough common bits of the retained values' bitmaps, and few enough different bits of the sets' parity
   bitmaps (each bit tells whether an odd number of hashes falls on it, so sets that differ in x hashes differ in x
   bits at most). So chance meetings and copies just below the threshold give no rows.
4. A pair's similarity is estimated from the union of both sketches; pairs clearly below the threshold (five standard
   errors) go. The others are confirmed on the full sets, which are computed anew for the documents that need them.
5. Links become components by alternating large-star and small-star steps, each one aggregation and one join.

Each row is a node of its own, named by its place in the table. Defined results: null and empty texts and texts without words
have no shingles, link with nothing and stay; rows that repeat a doc_id or have none are rows like others (the smallest doc_id
of a group is that of its rows that have one, null if none has); equal texts with one doc_id are all marked kept, and one of
them stays in drop_near_copies(). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import among, settled, with_rows, written
from ._words import buffers, pieces, shingles, word_hashes


def _sets(batch: pa.RecordBatch, width: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A batch's rows piece by piece, of about `size` bytes of text, with the sorted distinct shingle hashes of each row's text: sets take more room
    than their texts, so no more than a piece's are held at once."""
    data, offsets = buffers(batch.column("text"))
    for i, j in pieces(offsets, size):
        found, begin = shingles(*word_hashes(data, offsets[i : j + 1]), width)
        yield batch.slice(i, j - i), [np.unique(found[begin[k] : begin[k + 1]]).view(np.int64) for k in range(j - i)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


RETAINED_BITS, PARITY_BITS = 256, 512


def _bitmap(hashes: np.ndarray, bits: int, parity: bool) -> np.ndarray:
    """A bit for each value of the hashes' low bits: whether any has it, or an odd number has it."""
    counts = np.bincount((hashes & np.int64(bits - 1)), minlength=bits)
    return np.packbits(counts & 1 if parity else counts > 0).view(np.int64)


def sketches(docs: DataFrame, width: int, keep: int, listed: int, row: list[str]) -> DataFrame:
    """doc_id, row, n_shingles, digest of the set (null if empty), sketch (the smallest `keep` hashes), bits (bitmap of the
    smallest `listed` ones, then the parity bitmap of all) of docs (doc_id, text, row: two columns that name a row)."""

    def run(batches):
        own = ["doc_id", *row]
        for piece, sets in (x for batch in batches for x in _sets(batch, width)):
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bits = [np.concatenate([_bitmap(s[:listed], RETAINED_BITS, False), _bitmap(s, PARITY_BITS, True)]) for s in sets]
            least = [s[:keep] for s in sets]  # np.unique sorts
            yield pa.RecordBatch.from_arrays(
                [*map(piece.column, own), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), _lists(least), _lists(bits)], [*own, "n_shingles", "digest", "sketch", "bits"]
            )

    schema = f"doc_id long, {row[0]} long, {row[1]} long, n_shingles long, digest binary, sketch array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text", *row).mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and members of docs (id, text)."""

    def run(batches):
        for piece, sets in (x for batch in batches for x in _sets(batch, width)):
            yield pa.RecordBatch.from_arrays([piece.column("id"), _lists(sets)], ["id", "members"])

    return docs.select("id", "text").mapInArrow(run, "id long, members array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every node of edges (a, b). Least neighbours are written before they are
    joined, so that Spark can split the join where one node has very many edges."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # a node has few smaller neighbours here, as many as the lists that it is entered in
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def busy(pairs: DataFrame, most: int = 1000) -> DataFrame | None:
    """id and ways of the members of more than `most` pairs (a, b): into how many parts these are split in split_join; None if
    there are none."""
    hot = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(f"count > {most}")
    hot = written(hot.select("id", F.ceil(F.col("count") / most).cast("int").alias("ways")), "busy")
    return None if hot.isEmpty() else hot


def split_join(pairs: DataFrame, key: str, side: DataFrame, hot: DataFrame | None) -> DataFrame:
    """pairs (a, b) joined with side (one row a key) on key. The pairs of a busy key are split into parts, each of which gets its copy
    of the side's row."""
    if hot is None:
        return pairs.join(side, key)
    ways, hot = F.coalesce("_ways", F.lit(1)), hot.select(F.col("id").alias(key), F.col("ways").alias("_ways"))
    pairs = pairs.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64("a", "b"), ways).cast("int")).drop("_ways")
    side = side.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return pairs.join(side, [key, "_part"]).drop("_part")


class _Linker:
    """docs: row, text; classes: id, n, sketch and row of its representative."""

    def __init__(self, docs: DataFrame, classes: DataFrame, row: list[str], width: int, percent: int, keep: int):
        self.docs, self.classes, self.row, self.width, self.percent = docs, classes, row, width, percent
        j = percent / 100
        self.least = j - 5 * sqrt(j * (1 - j) / keep)
        self.keep = keep
        self.roots: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (with id), and the component of each as label."""
        if self.roots is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(self.roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")

    def link(self, pairs: DataFrame, name: str) -> None:
        """Confirms pairs (a, b, na, nb) and joins what they link."""
        pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "met")
        side = lambda x: self.classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
        hot = busy(pairs)  # of the confirmed pairs below, these are enough parts
        both = split_join(split_join(pairs, "a", side("a"), hot), "b", side("b"), hot)
        # sketches are sorted as unsigned; so are their unions, after the sign bit is flipped
        flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63))))
        both = both.withColumn("union", F.slice(F.array_sort(flip(F.array_union("sa", "sb"))), 1, self.keep))
        shared = F.size(F.array_intersect("union", flip(F.array_intersect("sa", "sb"))))
        pairs = written(both.where(shared >= F.size("union") * F.lit(self.least)).select("a", "b"), f"pairs-{name}")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = written(ids.join(self.classes.select("id", *self.row), "id"), "ids")
        if ids.isEmpty():
            return
        sets = written(full_sets(among(self.docs, ids, self.row), self.width), "sets")
        side = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}"))
        shared = F.size(F.array_intersect("ma", "mb"))
        joint = split_join(split_join(pairs, "a", side("a"), hot), "b", side("b"), hot)
        joint = joint.select("a", "b", shared.alias("i"), (F.size("ma") + F.size("mb") - shared).alias("u"))
        found = joint.where(F.col("i") * 100 >= F.col("u") * self.percent).select("a", "b")
        # what was linked before goes on as stars
        self.roots = components(found if self.roots is None else found.union(self.roots))


def least_shared(percent: int, values: int, risk: float = 1e-6) -> int:
    """The largest m such that of `values` values, each shared with the given probability, fewer than m are shared with a
    probability of at most risk."""
    j, total, m = percent / 100, 0.0, 0
    while (total := total + comb(values, m) * j**m * (1 - j) ** (values - m)) <= risk:
        m += 1
    return m


def entries(classes: DataFrame, percent: int, listed: int) -> DataFrame:
    """id, n, typical (how many classes retain its values, summed) and key: the inverted lists' entries, without values that only one class retains."""
    values = classes.select("id", "n", F.explode(F.slice("sketch", 1, listed)).alias("key"))
    many = written(values.groupBy("key").count().where("count > 1"), "values")
    shared = values.join(many, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("shared"))  # at most `listed`
    retained = F.least("n", F.lit(listed))
    # a set whose partners are all retained whole shares percent of its size; of larger ones the retained values share enough
    whole = F.col("n") * 100 <= F.lit(listed * percent)
    least = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(least_shared(percent, listed))
    alone = retained - F.size("shared")  # values of no other class are the rarest
    entered = F.slice("shared", F.lit(1), F.greatest(F.lit(0), retained - least + 1 - alone).cast("int"))
    typical = F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["count"])
    return shared.select("id", "n", typical.alias("typical"), F.explode(entered).alias("entry")).select("id", "n", "typical", F.col("entry.key").alias("key"))


def _pairs(a: DataFrame, b: DataFrame, also=None, blocks: list[str] = []) -> DataFrame:
    """Pairs of rows (key, id, n, label) of one key, and of one of each of blocks, and different labels; also: a further
    condition on columns that end in a and b."""
    on = ["key", *blocks]
    a, b = (rows.select(*on, F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in rows.columns if c not in (*on, "id")]) for x, rows in (("a", a), ("b", b)))
    met = (F.col("labela") != F.col("labelb")) & (F.col("a") != F.col("b"))
    for c in on:
        met = (a[c] == b[c]) & met
    return a.join(b, met if also is None else met & also).select("a", "b", F.col("na"), F.col("nb"))


def _blocks(rows: DataFrame, own: str, other: str, block: int) -> DataFrame:
    """rows (key, id, size of the key's list, ...), each in its own block of about `block` members of the list, once for
    each block of the other side: a long list is met block by block, in as many tasks."""
    ways = F.ceil(F.col("size") / block).cast("int")
    return rows.withColumn(own, F.pmod(F.xxhash64("id"), ways).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), ways - 1))).drop("size")


def _linkable(percent: int, listed: int):
    """What holds for every linked pair of classes a and b, by their bitmaps."""
    first = RETAINED_BITS // 64
    count = lambda op, ks: sum((F.bit_count(op(F.col("bitsa")[k], F.col("bitsb")[k])) for k in ks), F.lit(0))
    held = lambda x: F.least(f"n{x}", F.lit(listed))
    # values of one class on a bit that another has, too, are missing among the common bits
    double = lambda x: held(x) - sum((F.bit_count(F.col(f"bits{x}")[k]) for k in range(first)), F.lit(0))
    whole = F.greatest("na", "nb") * 100 <= listed * percent
    shared = F.when(whole, F.ceil(F.greatest("na", "nb") * percent / 100)).otherwise(least_shared(percent, listed))
    differ = count(lambda x, y: x.bitwiseXOR(y), range(first, first + PARITY_BITS // 64))
    return (
        (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        & (count(lambda x, y: x.bitwiseAND(y), range(first)) >= shared - F.least(double("a"), double("b")))
        & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    )


def _once():
    """Whether the classes a and b meet here: of the lists that both are in, in the first one, and from the side whose members all meet."""
    first = F.array_min(F.array_intersect("keysa", "keysb"))
    return ((F.col("a") < F.col("b")) | ~F.col("outsideb")) & (first == F.col("firsta"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text): documents whose sets of `width`-word
    shingles have 100 * intersection >= percent * union are linked."""
    named, row = with_rows(docs)
    found = settled(docs.sparkSession, lambda: _groups(named, row, width, percent, **how), "groups")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(docs: DataFrame, row: list[str], width: int, percent: int, keep: int = 64, listed: int = 32, direct: int = 32, block: int = 512) -> DataFrame:
    """doc_id, row, n_shingles, component_id, and stays: whether it is the row of its component that stays."""
    every = written(sketches(docs, width, keep, listed, row).withColumn("node", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    one = F.min_by(F.struct("node", *row, "n_shingles", "sketch", "bits"), "node").alias("one")
    classes = every.where("digest is not null").groupBy("digest").agg(first, one)
    classes = written(classes.select("digest", "first", F.col("one.node").alias("id"), *[f"one.{x}" for x in row], F.col("one.n_shingles").alias("n"), "one.sketch", "one.bits"), "classes")
    linker = _Linker(docs.select("text", *row), classes, row, width, percent, keep)
    rows = written(entries(classes, percent, listed).withColumn("label", F.col("id")), "entries")
    for chosen in (-F.col("typical"), F.xxhash64("id", "key")):
        centre = rows.groupBy("key").agg(F.min_by(F.struct("id", "n", "label"), F.struct(chosen, "id")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
        centre = written(centre.select("key", "c.*"), "centres")
        linker.link(_pairs(centre, rows.select("key", "id", "n", "label")), "star")
        rows = linker.labelled(rows.drop("label"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        rows = written(rows.join(written(mixed, "keys"), "key"), "mixed")
        if rows.isEmpty():
            break
    else:
        counts = rows.groupBy("key", "label").count()
        lists = counts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.sum("count").alias("size"))
        within = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most `listed`
        rows = rows.join(written(lists, "lists"), "key").join(within, "id").join(classes.select("id", "bits"), "id")
        outside = (F.col("size") <= direct) | (F.col("label") != F.col("largest"))
        rows = written(rows.select("key", "id", "n", "label", "bits", "size", "keys", outside.alias("outside"), F.col("key").alias("first")), "lists")
        a, b = _blocks(rows.where("outside"), "_i", "_j", block), _blocks(rows, "_j", "_i", block)
        linker.link(_pairs(a, b, _linkable(percent, listed) & _once(), ["_i", "_j"]), "across")
    ids = classes.select("digest", "first", "id")
    if linker.roots is None:
        ids = ids.select("digest", "first")
    else:
        ids = linker.labelled(ids)
        least = written(ids.groupBy("label").agg(F.min("first").alias("first")), "components")
        ids = ids.drop("first").join(least, "label").select("digest", "first")
    linked = every.where("digest is not null").join(written(ids, "found"), "digest")
    linked = linked.select("doc_id", *row, "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("node") == F.col("first.node")).alias("stays"))
    alone = every.where("digest is null").select("doc_id", *row, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionByName(alone)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, **how) -> DataFrame:
    """One row of each group of docs, all columns: the one with the smallest doc_id, null ids last."""
    named, row = with_rows(docs)
    gone = settled(docs.sparkSession, lambda: _groups(named, row, width, percent, **how).where("not stays").select(*row), "gone")
    return named.join(gone, row, "left_anti").select(docs.columns)
