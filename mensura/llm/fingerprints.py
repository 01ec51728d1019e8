"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once; the hash's high bits choose one of `bins` bins and the bin keeps its smallest hash. An
empty bin is filled by optimal densification: it takes the value of the first bin that isn't empty in its own random order
of all bins, the same order for every document. Of each bin's value, hashed once more with the number of the bin, the `bits`
low bits are packed into the fingerprint.
Bins of different values still agree by chance with probability C = 2**-bits, so the share m of equal bins is corrected to
the similarity (m - C) / (1 - C), with a standard error of 0.02 at most for 1024 bins of 2 bits (256 bytes).

Defined results: null texts count as empty; a text without words has the fingerprint of zeros, and likeness 1 to another
such text, 0 to any other; fewer words than a shingle has form one shingle. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written
from ._words import buffers, mix, pieces, shingles, word_hashes

BINS, BITS, WIDTH = 1024, 2, 5
_FEW = 64


@lru_cache(maxsize=2)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Row j: the j-th bin that each bin asks. Column n of the second: when each bin asks bin n."""
    keys = mix(np.arange(bins * bins, dtype=np.uint64), 5).reshape(bins, bins)
    asked = np.argsort(keys, axis=1)
    return np.ascontiguousarray(asked.T), np.argsort(asked, axis=1).astype(np.int16)


def signatures(texts: pa.Array, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A row of `bins` values below 2**bits for each text, and which texts have any shingle."""
    data, offsets = buffers(texts)
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    shift, low = np.uint64(64 - (bins - 1).bit_length()), np.uint64(2**bits - 1)
    asked, when = _orders(bins)
    salt = mix(np.arange(bins, dtype=np.uint64), 7)
    for i, j in pieces(offsets):
        found, begin = shingles(*word_hashes(data, offsets[i : j + 1]), width)
        row = np.repeat(np.arange(j - i), np.diff(begin))
        cell = row * bins + (found >> shift).astype(np.int64)
        order = np.lexsort((found, cell))
        cell = cell[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        least = np.zeros((j - i) * bins, np.uint64)
        full = np.zeros((j - i) * bins, bool)
        least[cell[first]] = found[order[first]]
        full[cell[first]] = True
        least, full = least.reshape(-1, bins), full.reshape(-1, bins)
        many = full.sum(1)
        for k in np.flatnonzero((many > 0) & (many <= _FEW)):
            own = np.flatnonzero(full[k])
            least[k] = np.where(full[k], least[k], least[k, own[when[:, own].argmin(1)]])
        r, b = np.nonzero(~full & (many > _FEW)[:, None])
        attempt = 0
        while len(r):
            source = asked[attempt, b]
            ok = full[r, source]
            least[r[ok], b[ok]] = least[r[ok], source[ok]]
            r, b, attempt = r[~ok], b[~ok], attempt + 1
        # each bin's bits come from its own hash of the value, so bins that took the same value don't agree by one chance
        out[i:j] = np.where((many > 0)[:, None], mix(least ^ salt) & low, 0)
        some[i:j] = many > 0
    return out, some


def packed(signature: np.ndarray, bits: int = BITS) -> list[bytes]:
    flat = np.unpackbits(signature[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(signature), -1)
    return [x.tobytes() for x in np.packbits(flat, axis=1)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of each pair of rows, from 0 to 1."""
    chance = 2.0**-bits
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (binary) of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = packed(signatures(batch.column("text"), bins, bits, width)[0], bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """The rows of _OUT, nexts being the texts of the next documents."""
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + n[:h] for t, h, n in zip(texts, half, nexts)]
    (own, a), (new, b), (following, c) = (signatures(pa.array(x, pa.large_string())) for x in (texts, edited, nexts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([x.hex() for x in packed(own)]),
            pa.array([x.hex() for x in packed(new)]),
            pa.array(likeness(own, a, new, b)),
            pa.array(likeness(own, a, following, c)),
        ],
        [x.split()[0] for x in _OUT.split(", ")],
    )


def _inner(batches):
    """Of partitions sorted by part: every row but the last of its part, with the row after it."""
    before: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        _, offsets = buffers(batch.column("text"))
        for i, j in pieces(offsets, 1 << 21):
            rows = batch.slice(i, j - i)
            parts, ids = before[0] + rows.column("part").to_pylist(), before[1] + rows.column("doc_id").to_pylist()
            texts = before[2] + [t or "" for t in rows.column("text").to_pylist()]
            at = [k for k in range(len(ids) - 1) if parts[k] == parts[k + 1]]
            if at:
                yield _compared([ids[k] for k in at], [texts[k] for k in at], [texts[k + 1] for k in at])
            before = parts[-1:], ids[-1:], texts[-1:]


def _outer(batches):
    """Of partitions' last rows: each with the text of the row after it."""
    for batch in batches:
        for x in batch.to_pylist():
            yield _compared([x["doc_id"]], [x["text"]], [x["next_text"]])


def _part(id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most id; 0 without an id. Found in two steps: first the run of cuts, then the place in it."""
    size = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    upto = lambda values: F.size(F.filter(values, lambda x: x <= id))
    list_of = lambda values: F.array(*[F.lit(x) for x in values]).cast("array<bigint>")
    run = F.greatest(upto(list_of([r[0] for r in runs])) - 1, F.lit(0))
    place = upto(F.get(F.array(*[list_of(r) for r in runs]), run))
    return F.when(id.isNull(), 0).otherwise(run * size + place).cast("int")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, the one of its edited text (the last half of its characters
    replaced by as many of the next document's first ones), and the likeness to both. Next is by (doc_id, text), nulls
    first.

    Ranges of doc_id (parts) are set by cuts that are computed once, as many numbers as there are shuffle partitions. Texts are shuffled once,
    by part, and each row meets the next one of its part. A part's last row meets the next part's first one: which ids these have is an
    aggregation of ids, and their texts are read for these ids only. So nothing depends on how an exchange is sampled or reused."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shares = [k / n for k in range(1, n)] or [0.5]
    cuts = sorted({x for x in docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).first().cuts or []})
    parts = docs.withColumn("part", _part(F.col("doc_id"), cuts) if cuts else F.lit(0))
    order = ["part", "doc_id", F.coalesce("text", F.lit(""))]
    inner = parts.repartitionByRange(n, "part").sortWithinPartitions(*order).select("part", "doc_id", "text").mapInArrow(_inner, _OUT)
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    ends = written(parts.groupBy("part").agg(F.min(key)["doc_id"].alias("low"), F.max(key)["doc_id"].alias("high")), "ends")  # a row a part
    text = F.coalesce("text", F.lit(""))
    at_ends = parts.join(F.broadcast(ends), "part").where(F.col("doc_id").eqNullSafe(F.col("low")) | F.col("doc_id").eqNullSafe(F.col("high")))
    first, last = (F.when(F.col("doc_id").eqNullSafe(F.col(x)), text) for x in ("low", "high"))
    told = written(at_ends.groupBy("part").agg(F.min(first).alias("first"), F.max(last).alias("last")).join(ends.select("part", "high"), "part"), "end_texts")
    every, by = Window.partitionBy(), Window.orderBy("part")
    after = told.select("part").select("part", F.coalesce(F.lead("part").over(by), F.min("part").over(every)).alias("next"))
    met = told.join(after, "part").join(told.select(F.col("part").alias("next"), F.col("first").alias("next_text")), "next")
    outer = met.select(F.col("high").alias("doc_id"), F.col("last").alias("text"), "next_text")
    return inner.unionByName(outer.mapInArrow(_outer, _OUT))
