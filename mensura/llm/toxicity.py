"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A text's features are its distinct words (of letters and digits, A-Z lower-cased), hashed into 2**`bits` buckets, with the
value log2(1 + occurrences). One vector of weights w is shared by all thresholds
t1 < t2 < ...: P(grade >= k) = sigmoid(w.x - tk). It is fitted by likelihood with an L1 penalty, so that few words keep a
weight and long texts don't add up noise. The result is the expected grade, the sum of P(grade >= k) over k.

Fitting is on the driver over a bounded sample: at most `sample` labelled documents of each label value (those with the least
hashes) with at most `most` features in all; these are collected, not texts. Scoring is a map over all documents with one array of weights.

The label table tells toxic from not toxic, so severity here is one of wording: that among toxic texts is graded by how many of the words are typical of
toxic texts in the sample (on at least `typical` times the share of toxic documents than of others, and on ten of them): up to the
median is grade 1, above it grade 2. With a table that has grades of its own, fit() takes these.

Defined results: null texts and texts without words have no features and get the grade that the thresholds alone give;
documents labelled twice count with their highest label; labels without a document or without a value are left out; without labels of
two values there is no model, and severity is 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._words import WORD_SIGNS, buffers, mix, pieces, word_hashes


def features(texts: pa.Array, bits: int):
    """Of each piece of texts: its first row, its number of rows, and the rows, buckets and values of the distinct words."""
    data, offsets = buffers(texts)
    for i, j in pieces(offsets):
        words, first = word_hashes(data, offsets[i : j + 1], WORD_SIGNS)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(first))
        key, times = np.unique(row << np.uint64(bits) | mix(words, 3) >> np.uint64(64 - bits), return_counts=True)
        yield i, j - i, (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64(2**bits - 1)).astype(np.int64), np.log2(1 + times)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray  # of each bucket
    thresholds: np.ndarray  # ascending

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def above(self, score: np.ndarray) -> np.ndarray:
        """(thresholds, rows): P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(score[None, :] - self.thresholds[:, None])


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, bits: int, penalty: float = 2e-4, choice: float = 1e-3, rounds: int = 300) -> Model:
    """rows, values: the distinct buckets of each text and their values; grades: 0, 1, ..., all of which occur. A first fit with
    the penalty `choice` chooses the words; a second one with the lower `penalty` weighs these alone, which the first makes too
    light."""
    chosen = descend(rows, values, grades, bits, choice, rounds).weights != 0
    if chosen.any():
        values = [v[chosen[r]] for r, v in zip(rows, values)]
        rows = [r[chosen[r]] for r in rows]
    return descend(rows, values, grades, bits, penalty, rounds)


def descend(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, bits: int, penalty: float, rounds: int, rate: float = 0.3) -> Model:
    """Proximal AdaGrad on all rows at once, see fit()."""
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    used, column = np.unique(flat, return_inverse=True)
    column = column.astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    common = np.bincount(column, minlength=len(used)) >= 3
    value = np.concatenate([np.zeros(0), *values])[common[column]]
    column, row = column[common[column]], row[common[column]]
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-8)
    top = int(grades.max())
    share = [(grades >= k).mean() for k in range(1, top + 1)]
    start = np.array([np.log((1 - s) / s) for s in share])
    # the first threshold, and the logarithms of the distances to the next ones, so that they stay ordered
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    gt = np.full(len(t), 1e-8)
    edge = lambda t: np.concatenate([[-np.inf], t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]), [np.inf]])
    n = len(rows)
    for _ in range(rounds):
        score = np.bincount(row, w[column] * value, n)
        e = edge(t)
        low, high = e[grades] - score, e[grades + 1] - score  # grade y: low < noise <= high
        a, b = _sigmoid(low), _sigmoid(high)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        dscore = (db - da) / n  # of the negative logarithm of the likelihood
        g = np.bincount(column, dscore[row] * value, len(used))
        dedge = (np.bincount(grades, da, top + 1)[1:] - np.bincount(grades, db, top + 1)[:-1]) / n
        tail = np.cumsum(dedge[::-1])[::-1]
        dt = tail * np.concatenate([[1], np.exp(t[1:])])
        gw += g * g
        gt += dt * dt
        step = rate / np.sqrt(gw)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t -= rate / np.sqrt(gt) * dt
    weights = np.zeros(2**bits, np.float32)
    weights[used] = w
    return Model(weights, edge(t)[1:-1])


def graded(rows: list[np.ndarray], toxic: np.ndarray, bits: int, typical: float) -> np.ndarray:
    """Grades 0, 1 and 2 from two labels; see above."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, t in zip(rows, toxic) if t == v)]), minlength=2**bits) for v in (0, 1)]
    share = [c / max(1, (toxic == v).sum()) for v, c in enumerate(counts)]
    words = (counts[1] >= 10) & (share[1] >= typical * (share[0] + 0.5 / max(1, (toxic == 0).sum())))
    hits = np.array([words[r].sum() for r in rows])
    grades = np.where(toxic == 1, np.where(hits > np.median(hits[toxic == 1]), 2, 1), 0)
    return grades if (grades == 2).any() else (toxic == 1).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, value: str, sample: int, bits: int, most: int = 8_000_000) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Features and label values of at most `sample` documents of each value, and of ten times as many in all, in equal parts
    for the values; of these, of each value the first whose features are at most its part of `most` (8 bytes each). More
    values than that are an error. A value's documents are ranked in `ways` ranges of their hash, which share its part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(F.col(value).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(10 * sample + 1).collect()}
    if len(counts) > 10 * sample:
        raise ValueError(f"more than {10 * sample} label values")
    if len(counts) < 2:
        return [], [], np.zeros(0, np.int64)
    parts, sample = 1_000_003, min(sample, 10 * sample // len(counts))
    ways = min(16, sample)
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, parts if n <= sample else min(parts, 4 * sample * parts // n + 1))])
    all_ = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, n <= sample)])
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(parts))
    rows = known.where(F.col("y").isin(list(counts))).withColumn("order", hashed).where(F.col("order") < share[F.col("y")])
    way = F.pmod(F.xxhash64("doc_id"), F.lit(ways))
    rank = F.row_number().over(Window.partitionBy("y", way).orderBy("order", "doc_id"))
    few = rows.withColumn("rank", rank).where(all_[F.col("y")] | (F.col("rank") <= sample // ways)).select("doc_id", "y", "order", way.alias("way"))

    def run(batches):
        for batch in batches:
            words, values = [np.zeros(0, np.int64)] * len(batch), [np.zeros(0)] * len(batch)
            for i, n, row, bucket, value in features(batch.column("text"), bits):
                cuts = np.searchsorted(row, np.arange(n + 1))
                words[i : i + n] = [bucket[cuts[k] : cuts[k + 1]] for k in range(n)]
                values[i : i + n] = [value[cuts[k] : cuts[k + 1]] for k in range(n)]
            arrays = pa.array([x.astype(np.int32) for x in words], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in values], pa.list_(pa.float32()))
            own = ["doc_id", "y", "order", "way"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *arrays], [*own, "words", "values"])

    # at most a row for each of the sample; a doc_id on several rows gives several
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")
    found = joined.select("doc_id", "text", "y", "order", "way").mapInArrow(run, "doc_id long, y int, order long, way long, words array<int>, values array<float>")
    so_far = Window.partitionBy("y", "way").orderBy("order", "doc_id", "words").rowsBetween(Window.unboundedPreceding, 0)
    bounded = found.withColumn("so_far", F.sum(F.size("words")).over(so_far)).where(F.col("so_far") <= most // (len(counts) * ways))
    table = bounded.select("doc_id", "y", "words", "values").toArrow().combine_chunks()
    table = table.take(pc.sort_indices(table.append_column("n", pc.list_value_length(table["words"])), [("doc_id", "ascending"), ("n", "ascending")]))
    words, values = ([x.values.to_numpy() for x in table.column(c)] for c in ("words", "values"))
    return words, values, table.column("y").to_numpy()


def train(docs: DataFrame, labels: DataFrame, value: str = "toxic", sample: int = 4000, bits: int = 18, typical: float = 8.0) -> Model | None:
    rows, values, y = labelled(docs, labels, value, sample, bits)
    if len(set(y.tolist())) < 2:
        return None
    grades = graded(rows, y, bits, typical) if set(y.tolist()) == {0, 1} else np.unique(y, return_inverse=True)[1]
    return fit(rows, values, grades, bits)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (P(grade >= 1)), grade (the likeliest) and toxic (p_toxic over a half) of
    every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            total = np.zeros(n)
            above = np.zeros((1, n))
            if model is not None:
                for i, m, row, bucket, value in features(batch.column("text"), model.bits):
                    total[i : i + m] = np.bincount(row, model.weights[bucket] * value, m)
                above = model.above(total)
            each = np.concatenate([np.ones((1, n)), above]) - np.concatenate([above, np.zeros((1, n))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(0)), pa.array(above[0]), pa.array(each.argmax(0).astype(np.int32)), pa.array(above[0] > 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
