"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a window in both directions and labels every byte position with a probability for each
language; a document's score is the mean of its positions' probabilities. Whole texts are read: a text is cut into windows
of `window` bytes that follow each other, each read from a zero state, so that windows of all documents of a batch run side
by side. Gates use the piecewise linear sigmoid clip(x, 0, 1) and the candidate state clip(x, -1, 1), whose slopes are 0 or
1, in training and in use.

Training is backpropagation through time in numpy, on the driver, over a bounded sample: at most `sample` labelled documents
(those whose hash is least, in equal parts for each language; the bound is a parameter), and from each one window of
`learn_window` bytes at a random place of the whole text for each pass. Prediction is a map over all documents with the weights (a few
kilobytes, with the letter pairs at most 4 MB) in the task.

The network gives every text one of the languages learnt; where others are to be told (in keep_identified), the letter pairs
of the same sample say which texts are unlike all of them.

Defined results: null texts and texts without a letter (signs such as ² and Ⅷ are none) are `und` with score 0; the score is the pooled probability of the
language given. Without any labelled document, all are `und`. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._words import buffers

_LETTER = re.compile(r"[^\W\d_]")  # letters, and signs such as ² and Ⅷ


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def is_held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Fixed value: bytes as letters of one case; all others as a blank.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.int64)


def pairs(text: np.ndarray) -> np.ndarray:
    """The numbers of a text's byte pairs that have a letter."""
    x = _LETTERS[text]
    found = x[:-1] * 256 + x[1:]
    return found[found != 32 * 257]


@dataclass
class Fit:
    """Whether texts are like those learnt, which the network can't tell, as its label probabilities sum to one: the mean
    logarithm of letter pairs' probabilities in the likeliest language. likely: by language and pair; usual: the median of
    labelled texts left out of likely, of `long` pairs or more; far: how far the farthest of them is below it; spare: the bits
    that a text may lack besides, as for two strings of 16 letters that are no words (a key, an address)."""

    likely: np.ndarray
    usual: float = 0
    far: float = 0
    spare: float = 256
    long: int = 64

    @classmethod
    def new(cls, texts: list[list[bytes]], y: np.ndarray, labels: int, seed: int, least: int = 20, floor: float = 0.75, tables: int = 16) -> Fit | None:
        """A fifth of the texts is left out of likely; None if these are fewer than `least`. far is `floor` bits at least, for
        a few words of its own are in many a text."""
        left_out = np.random.default_rng(seed).permutation(len(texts)) % 5 == 0
        if left_out.sum() < least:
            return None
        each = [np.concatenate([pairs(np.frombuffer(t, np.uint8)) for t in parts]) for parts in texts]
        labels = min(labels, tables)  # beyond this, languages share tables, which are sent to the tasks
        counts = np.full((labels, 65536), 0.02)
        for k in np.flatnonzero(~left_out):
            counts[y[k] % labels] += np.bincount(each[k], minlength=65536)
        counts = counts.reshape(labels, 256, 256)
        found = cls(np.log2(counts / counts.sum(2, keepdims=True)).reshape(labels, 65536).astype(np.float32))
        tried = [each[k] for k in np.flatnonzero(left_out) if len(each[k])]
        if not tried:
            return None
        whole = [found.mean(x) for x in tried if len(x) >= found.long] or [found.mean(x) for x in tried]
        found.usual = float(np.median(whole))
        found.far = max(floor, found.usual - min(whole))
        return found

    def mean(self, x: np.ndarray) -> float:
        if len(x) > 65536:
            return float((self.likely @ np.bincount(x, minlength=65536)).max() / len(x))
        return float(self.likely[:, x].mean(1).max())

    def like(self, text: np.ndarray) -> bool:
        """Whether a text, but for the spare bits, is at most twice as far below the usual as labelled texts are."""
        x = pairs(text)
        return not len(x) or self.mean(x) >= self.usual - 2 * self.far - self.spare / len(x)


@dataclass
class Network:
    """Of each direction: E (embedding, 256 rows), W (update and reset gate, candidate from input, candidate from state; over
    embedding, state and a constant); V: the labels from both states and a constant."""

    labels: list[str]
    state: int
    E: list[np.ndarray]
    W: list[np.ndarray]
    V: np.ndarray
    fit: Fit | None = None

    @classmethod
    def new(cls, labels: list[str], state: int, embedding: int, seed: int) -> Network:
        rng, rows = np.random.default_rng(seed), embedding + state + 1
        E, W = [], []
        for _ in range(2):
            w = rng.normal(0, 0.4 / np.sqrt(rows), (4 * state, rows))
            w[2 * state : 3 * state, embedding : embedding + state] = 0  # candidate from input
            w[3 * state :, :embedding] = 0  # candidate from state
            w[: 2 * state, -1] = 0.5  # gates half open
            E.append(rng.normal(0, 1, (embedding, 256)).astype(np.float32))
            W.append(w.astype(np.float32))
        return cls(labels, state, E, W, rng.normal(0, 0.1, (len(labels), 2 * state + 1)).astype(np.float32))

    def states(self, x: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """States (steps, state, windows) of windows x (steps, windows) of bytes; keep: gets what each step needs to go back."""
        E, W, h = self.E[direction], self.W[direction], self.state
        e, (steps, n) = E.shape[0], x.shape
        z, g = np.ones((e + h + 1, n), np.float32), np.empty((4 * h, n), np.float32)
        z[e : e + h] = 0
        out = np.empty((steps, h, n), np.float32)
        for t in range(steps)[:: -1 if direction else 1]:
            np.take(E, x[t], axis=1, out=z[:e], mode="clip")
            np.matmul(W, z, out=g)
            if keep is not None:
                keep.append((t, z.copy(), g.copy()))
            gates, candidate, now = g[: 2 * h], g[2 * h : 3 * h], z[e : e + h]
            np.clip(gates, 0, 1, out=gates)
            g[3 * h :] *= g[h : 2 * h]
            candidate += g[3 * h :]
            np.clip(candidate, -1, 1, out=candidate)
            now -= candidate
            now *= g[:h]
            now += candidate
            out[t] = now
        return out

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(steps, labels, windows): each position's label probabilities."""
        h = self.state
        found = np.matmul(self.V[:, :h], forward)
        found += np.matmul(self.V[:, h : 2 * h], backward)
        found += self.V[:, 2 * h :]
        found -= found.max(1, keepdims=True)
        np.exp(found, out=found)
        found /= found.sum(1, keepdims=True)
        return found

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of windows x with labels y, and its gradients by V, E and W."""
        h, e, (steps, n) = self.state, self.E[0].shape[0], x.shape
        kept: tuple[list, list] = ([], [])
        both = [self.states(x, d, kept[d]) for d in (0, 1)]
        p = self.probabilities(*both)
        loss = -np.log(np.maximum(p[:, y, np.arange(n)], 1e-9)).mean()
        p[:, y, np.arange(n)] -= 1
        p /= steps * n
        dV = np.concatenate([np.einsum("tln,thn->lh", p, s, optimize=True) for s in both] + [p.sum((0, 2))[:, None]], axis=1)
        found = [dV]
        for d in (0, 1):
            W, dW, dE = self.W[d], np.zeros_like(self.W[d]), np.zeros_like(self.E[d])
            above = np.matmul(self.V[:, d * h : (d + 1) * h].T, p)
            dh, dg = np.zeros((h, n), np.float32), np.empty((4 * h, n), np.float32)
            for t, z, g in reversed(kept[d]):
                dh += above[t]
                before, u, r = z[e : e + h], np.clip(g[:h], 0, 1), np.clip(g[h : 2 * h], 0, 1)
                raw = g[2 * h : 3 * h] + r * g[3 * h :]
                c = np.clip(raw, -1, 1)
                dc = dh * (1 - u) * (np.abs(raw) < 1)
                dg[:h] = dh * (before - c) * ((g[:h] > 0) & (g[:h] < 1))
                dg[h : 2 * h] = dc * g[3 * h :] * ((g[h : 2 * h] > 0) & (g[h : 2 * h] < 1))
                dg[2 * h : 3 * h] = dc
                dg[3 * h :] = dc * r
                dW += dg @ z.T
                dz = W.T @ dg
                for k in range(e):
                    dE[k] += np.bincount(x[t], dz[k], 256).astype(np.float32)
                dh = dh * u + dz[e : e + h]
            dW[2 * h : 3 * h, e : e + h] = 0
            dW[3 * h :, :e] = 0
            dW[3 * h :, -1] = 0
            found += [dE, dW]
        return float(loss), found

    def learn(self, texts: list[list[bytes]], y: np.ndarray, window: int, passes: int, batch: int, rate: float, seed: int) -> None:
        """Adam with a falling rate. texts: the parts of each, of which every pass takes one."""
        rng, values = np.random.default_rng(seed), [self.V, self.E[0], self.W[0], self.E[1], self.W[1]]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        total = passes * max(1, -(-len(texts) // batch))
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                x = np.zeros((window, len(part)), np.int64)
                for k, j in enumerate(part):
                    text = texts[j][rng.integers(len(texts[j]))]
                    text = text * (window // max(1, len(text)) + 1) if len(text) < window else text
                    at = rng.integers(0, len(text) - window + 1)
                    x[:, k] = np.frombuffer(text, np.uint8, window, at)
                _, grads = self.gradients(x, y[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                now = rate * (1 - step / (total + 1))
                for v, m, s, g in zip(values, first, second, grads):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def pooled(self, data: np.ndarray, offsets: np.ndarray, window: int, side_by_side: int = 2048) -> np.ndarray:
        """(rows, labels): the mean of the probabilities at all positions of each text."""
        sums = np.zeros((len(offsets) - 1, len(self.labels)))
        size = np.diff(offsets)
        parts = -(-size // window)
        row = np.repeat(np.arange(len(size)), parts)
        begin = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
        length = np.minimum(begin + window, offsets[1:][row]) - begin
        order = np.argsort(length, kind="stable")  # windows that end early stand together
        for i in range(0, len(order), side_by_side):
            part = order[i : i + side_by_side]
            steps = int(length[part].max())
            place = np.arange(steps)[:, None]
            inside = place < length[part]
            x = data[np.where(inside, begin[part] + place, 0)].astype(np.int64)
            forward = self.states(x, 0)
            # to read backwards, a shorter window is moved to the end, so that its first step is its last byte
            shift = steps - length[part]
            moved = np.where(place >= shift, begin[part] + place - shift, 0)
            backward = self.states(data[moved].astype(np.int64), 1)
            if shift.any():
                back = np.minimum(place + shift, steps - 1)
                backward = np.take_along_axis(backward, back[:, None, :], axis=0)
            p = self.probabilities(forward, backward)
            p *= inside[:, None, :]
            np.add.at(sums, row[part], p.sum(0).T)
        return sums / np.maximum(size, 1)[:, None]


def draw(rows: DataFrame, window: int, passes: int, seed: int) -> DataFrame:
    """lang, hash and parts of rows (lang, hash, text): the whole text if it has at most passes * window bytes, else as many
    windows at random places of the whole text. So what a text sends to the driver is bounded."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            parts = []
            for k, h in enumerate(batch.column("hash").to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if b - a <= window * passes:
                    parts.append([data[a:b].tobytes()])
                else:
                    at = np.random.default_rng([seed, h & (2**63 - 1)]).integers(a, b - window + 1, passes)
                    parts.append([data[i : i + window].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(parts, pa.list_(pa.binary()))], ["lang", "hash", "parts"])

    return rows.mapInArrow(run, "lang string, hash long, parts array<binary>")


def sample_of(docs: DataFrame, counts: dict[str, int], sample: int, window: int, passes: int, seed: int) -> DataFrame:
    """lang, hash and parts (see draw) of at most `sample` labelled documents, in equal parts for the languages in counts (with their rows): all
    of a language with no more than its part, else those with the least hashes. Of the others, four times as many as asked
    for pass a threshold of their language first, on the map side; only those are ranked, in `ways` ranges of the hash that
    share a language's part."""
    each, parts = max(1, sample // len(counts)), 1_000_003
    ways = min(16, each)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, parts if n <= each else min(parts, 4 * each * parts // n + 1))])
    few = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, n <= each)])
    labelled = docs.where(F.col("lang").isin(list(counts)) & F.col("text").isNotNull() & ~is_held_out())
    hashed = F.xxhash64("doc_id", "text", F.lit("sample"))
    rows = labelled.select("lang", "text", hashed.alias("hash")).where(F.pmod("hash", F.lit(parts)) < share[F.col("lang")])
    drawn = draw(rows.select("lang", "hash", "text"), window, passes, seed)
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod("hash", F.lit(ways))).orderBy(F.pmod("hash", F.lit(parts)), "hash"))
    return drawn.withColumn("rank", rank).where(few[F.col("lang")] | (F.col("rank") <= each // ways)).select("lang", "hash", "parts")


def train(docs: DataFrame, sample: int = 1200, state: int = 8, embedding: int = 4, learn_window: int = 64, passes: int = 40, seed: int = 11) -> Network | None:
    """The network learnt from the labelled documents that aren't held out. What reaches the driver is bounded: `sample`
    texts of at most passes * learn_window bytes each, longer ones as windows drawn from the whole text. Every value of lang
    is learnt; more values than `sample` are an error."""
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.limit(sample + 1).collect()}
    if len(counts) > sample:
        raise ValueError(f"more than {sample} languages, the bound of the sample")
    labels = sorted(counts)
    if not labels:
        return None
    drawn = sample_of(docs, counts, sample, learn_window, passes, seed).collect()
    rows = sorted((r["hash"], r["lang"], [bytes(x) for x in r["parts"]]) for r in drawn if any(r["parts"]))
    if not rows:
        return None
    network = Network.new(labels, state, embedding, seed)
    texts, y = [r[2] for r in rows], np.array([labels.index(r[1]) for r in rows])
    network.learn(texts, y, learn_window, passes, 128, 0.02, seed)
    network.fit = Fit.new(texts, y, len(labels), seed)
    return network


def predicted(texts: pa.Array, network: Network | None, window: int, reject: bool) -> tuple[np.ndarray, np.ndarray]:
    """The language of each text and its score."""
    n = len(texts)
    letters = np.array([has_letter(t.as_py()) for t in texts], bool)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    if network is not None and n:
        data, offsets = buffers(texts)
        for i in range(0, n, 1024):
            j = min(i + 1024, n)
            pooled = network.pooled(data, offsets[i : j + 1], window)
            best[i:j], score[i:j] = pooled.argmax(1), pooled.max(1)
        if reject and network.fit is not None:
            letters &= [network.fit.like(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    known = letters & (network is not None)
    labels = np.array(network.labels if network is not None else ["und"], object)
    return np.where(known, labels[best], "und"), np.where(known, np.clip(score, 0, 1), 0.0)


def _slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows that predicted() reads at once, so that what it gives for them and their copy without some are no larger."""
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def identify(docs: DataFrame, network: Network | None, window: int = 128, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text). Reads text alone for the prediction. reject:
    texts unlike those learnt (see Fit) are `und` with score 0, too."""

    def run(batches):
        for batch in (x for batch in batches for x in _slices(batch)):
            lang, score = predicted(batch.column("text"), network, window, reject)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", is_held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, **how) -> DataFrame:
    return identify(docs, train(docs, **how))


def keep_identified(docs: DataFrame, least: float = 0.3, window: int = 128) -> DataFrame:
    """docs without those whose language isn't found: `und`, as noise and texts in an unlearned language are, or a score below
    `least`. All columns stay; each row is decided by itself, so null and repeated doc_ids are like others."""
    network = train(docs)

    def run(batches):
        for batch in (x for batch in batches for x in _slices(batch)):
            lang, score = predicted(batch.column("text"), network, window, True)
            yield batch.filter(pa.array((lang != "und") & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
