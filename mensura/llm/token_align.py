"""Alignment of two tokenizers' tokens by their bytes, and how often each pair of tokens meets in the corpus.

Both tokenizers cover the same bytes, so the offsets where a token of each ends cut a text into groups: the smallest runs of
tokens that cover the same bytes. All texts of a batch are merged in lockstep: one state vector holds, for each text, a
pointer into its A tokens and one into its B tokens; each step compares where the two tokens end, emits a cut where both
do, and advances whichever ends first. A long text enters as several lanes of `lane` bytes, each beginning at the first
tokens that end behind its start, so a batch takes as many steps as a lane has borders and finished lanes leave the vector.
The tokens between two cuts are one group, and each of its A tokens is linked with each of its B tokens.

How many documents hold a pair linked is counted over the whole corpus. The pairs that stand in most documents are joined
back by a broadcast of at most `most` rows (no more pairs than that can reach the threshold), all others by a shuffle.

Defined results: a null or empty text has no tokens, and neither has one whose tokens of either side don't spell a blank
and the text (such as texts with U+2581); their numbers are 0 and their digest is ''. Each row is aligned for itself: null
and repeated doc_ids and repeated rows are told apart by file and place, and each row counts as a document. An empty table
gives no rows. Other columns aren't read. Texts are encoded in parts of about `part` characters, cut at a blank between two small
letters, where neither tokenizer can join; that holds if no token has a blank behind a small letter, else texts stay whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import with_rows, written

SEPARATORS = (b",", b"|", b";", b"")
COMMA, BAR, END, NONE = range(4)


def byte_signs() -> dict[str, int]:
    """Which byte a sign of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how a byte-level vocabulary of this kind splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """The two tokenizers, with each token's bytes."""

    def __init__(self, a: str, b: bytes, part: int):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        whole, self.b = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b)
        signs, file = byte_signs(), json.loads(a)
        vocabulary = {i: s for s, i in whole.get_vocab().items()}
        special = {x["id"] for x in file["added_tokens"]}
        a_bytes = [s.encode() if i in special else bytes(signs[c] for c in s) for i, s in sorted(vocabulary.items())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
        self.a_begin, self.b_begin = (np.cumsum(n) - n for n in (self.a_size, self.b_size))
        self.a_data, self.b_data = (np.frombuffer(b"".join(t), np.uint8) for t in (a_bytes, b_bytes))
        self.numbers = [b"%d%s" % (i, s) for i in range(max(len(a_bytes), len(b_bytes))) for s in SEPARATORS]
        across = any(re.search(rb"[a-z] ", x) for t in (a_bytes, b_bytes) for x in t)
        self.cut = None if across else re.compile(rf"(?s).{{{part}}}.*?[a-z](?= [a-z])")
        merges = [file["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        words = file["pre_tokenizer"]
        if words["type"] == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"] and not file["normalizer"] and merges == sorted(merges):
            # merges in the order of their ids: the same vocabulary as ranks, in a library that is three times as fast
            import tiktoken

            ranks = {x: i for i, x in enumerate(a_bytes) if i not in special}
            fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        else:
            whole.encode_special_tokens = True
            self.encode_a = lambda text: np.array(whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cut and (found := self.cut.match(text, at)):
            out.append(text[at : found.end()])
            at = found.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each text's ids on both sides; none where they don't spell a blank and the text."""
        a, b = [], []
        for text in texts:
            parts = self.parts(text) if text else []
            # a part after the first begins with the blank that B would put there itself
            x = [self.encode_a(p if k else f" {p}") for k, p in enumerate(parts)]
            y = [np.array(self.b.encode(p[1:] if k else p, num_threads=1), np.int64) for k, p in enumerate(parts)]
            x, y = (np.concatenate(z) if parts else np.zeros(0, np.int64) for z in (x, y))
            raw = np.frombuffer(f" {text}".encode(), np.uint8)
            spelled = np.array_equal(spell(x, self.a_size, self.a_begin, self.a_data), raw) and np.array_equal(spell(y, self.b_size, self.b_begin, self.b_data), raw)
            for out, z in ((a, x), (b, y)):
                out.append(z if spelled else z[:0])
        return a, b


def spell(ids: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The bytes of the tokens, one after the other. size, begin: of each token's bytes in data, the bytes of all tokens by id."""
    n = size[ids]
    return data[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end, where tokens end on each side; bounds: where the texts begin, and the end of the last. Which A and B tokens end
    together, in order."""
    size = np.diff(bounds)
    count = -(-size // lane)
    low = np.repeat(bounds[:-1], count) + lane * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    high = np.minimum(low + lane, np.repeat(bounds[1:], count))
    i, j = (np.searchsorted(ends, low, side="right") for ends in (a_ends, b_ends))
    never = np.iinfo(np.int64).max
    a_ends, b_ends = (np.append(ends, never) for ends in (a_ends, b_ends))
    cuts_a, cuts_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        ea, eb = a_ends[i], b_ends[j]
        live = np.minimum(ea, eb) <= high
        if not live.all():
            i, j, high, ea, eb = i[live], j[live], high[live], ea[live], eb[live]
        both = ea == eb
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        i, j = i + (ea <= eb), j + (eb <= ea)
    i, j = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(i)
    return i[order], j[order]


def linked(a: np.ndarray, b: np.ndarray, a_many: np.ndarray, b_many: np.ndarray, doc: np.ndarray, width: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, A id * width + B id) of all links, and how often each occurs. a, b: ids, group after group; a_many, b_many: how many each
    group has; doc: each group's document. Groups are unrolled `step` links at a time; a larger one by its distinct ids."""
    links = a_many * b_many
    a_at, b_at = np.cumsum(a_many) - a_many, np.cumsum(b_many) - b_many
    found = []

    def add(d: np.ndarray, code: np.ndarray, times: np.ndarray) -> None:
        order = np.lexsort((code, d))
        d, code, times = d[order], code[order], times[order]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (code[1:] != code[:-1])))
        found.append((d[new], code[new], np.add.reduceat(times, new)))

    small = np.flatnonzero(links <= step)
    ends = np.cumsum(links[small])
    i = 0
    while i < len(small):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - links[small[i]] + step, side="right")))
        g = small[i:j]
        n = links[g]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b_many[g], n)
        code = a[np.repeat(a_at[g], n) + place // wide] * width + b[np.repeat(b_at[g], n) + place % wide]
        add(np.repeat(doc[g], n), code, np.ones(len(code), np.int64))
        i = j
    for g in np.flatnonzero(links > step):
        x, times_x = np.unique(a[a_at[g] : a_at[g] + a_many[g]], return_counts=True)
        y, times_y = np.unique(b[b_at[g] : b_at[g] + b_many[g]], return_counts=True)
        add(np.full(len(x) * len(y), doc[g]), np.add.outer(x * width, y).ravel(), np.multiply.outer(times_x, times_y).ravel())
    if len(found) > 1:
        d, code, times = map(np.concatenate, zip(*found))
        found.clear()
        add(d, code, times)
    return found[0] if found else (np.zeros(0, np.int64),) * 3


def merged(pair: Pair, texts: list[str], keep: bool) -> list[pa.Array]:
    """The columns of some texts, as in _SCHEMA."""
    a_ids, b_ids = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    a_first, b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    bounds = np.concatenate([[0], a_ends])[a_first]
    cut_a, cut_b = lockstep(a_ends, b_ends, bounds)
    doc = np.searchsorted(a_first, cut_a, side="right") - 1
    a_many, b_many = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    group_first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n_links = np.add.reduceat(np.append(a_many * b_many, 0), np.minimum(group_first[:-1], len(doc))) * (np.diff(group_first) > 0)
    of, code, times = linked(a, b, a_many, b_many, doc, len(pair.b_size))
    first = np.searchsorted(of, np.arange(len(texts) + 1))

    # each group's A ids, then its B ids, with the separators
    signs_a, signs_b = np.full(len(a), COMMA), np.full(len(b), COMMA)
    signs_a[cut_a], signs_b[cut_b] = BAR, END
    signs_b[b_first[1:][n_b > 0] - 1] = NONE
    line = np.empty(len(a) + len(b), np.int64)
    group = np.arange(len(doc))
    line[np.arange(len(a)) + np.repeat(np.cumsum(b_many) - b_many, a_many)] = a * len(SEPARATORS) + signs_a
    line[np.arange(len(b)) + np.repeat(np.cumsum(a_many), b_many)] = b * len(SEPARATORS) + signs_b
    ends = (a_first + b_first)[1:]
    digests = [hashlib.sha256(b"".join(map(pair.numbers.__getitem__, line[e - n : e].tolist()))).hexdigest() if n else "" for e, n in zip(ends, n_a + n_b)]

    def lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, kind))

    out = [pa.array(x, pa.int64()) for x in (n_a, n_b, np.diff(group_first), n_links)]
    out += [pa.array(digests), lists(code, first, pa.int64()), lists(times, first, pa.int64())]
    if keep:
        out += [lists(a, a_first, pa.int32()), lists(b, b_first, pa.int32())]
        out += [lists(cut - at[doc] + 1, group_first, pa.int32()) for cut, at in ((cut_a, a_first), (cut_b, b_first))]
    return out


_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_KEPT = ", a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
_pairs: dict[tuple, Pair] = {}


def _pair(a: str, b: bytes, part: int) -> Pair:
    """One pair of tokenizers for each Python worker."""
    key = hashlib.sha256(a.encode()).digest(), hashlib.sha256(b).digest(), part
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(a, b, part)
    return _pairs[key]


def aligned(docs: DataFrame, a: str, b: bytes, keep: bool = False, part: int = 1 << 20) -> DataFrame:
    """docs' doc_id, how many tokens, groups and links each text has, the digest of its groups, and the pairs of ids that it has linked (A id * B's
    number of tokens + B id) with the times. a: the text of A's JSON file, b: the content of B's model file. keep: also the ids of both sides, and
    for each group how many tokens of each side there are up to its end."""

    def run(batches):
        pair = _pair(a, b, part)
        for batch in batches:
            texts = batch.column("text")
            i, n = 0, len(texts)
            while i < n:  # a few megabytes at a time
                some, size = [], 0
                while i + len(some) < n and size < 1 << 21:
                    some.append(texts[i + len(some)].as_py() or "")
                    size += len(some[-1])
                rest = [batch.column(k).slice(i, len(some)) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *merged(pair, some, keep)], [*batch.schema.names[1:], *names])
                i += len(some)

    schema = _SCHEMA + _KEPT * keep
    names = [x.split()[0] for x in schema.split(", ")]
    read = docs.select("text", *[c for c in docs.columns if c != "text"])
    return read.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in read.dtypes[1:]) + ", " + schema)


def align(docs: DataFrame, a: str, b: bytes, most: int = 500_000) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    docs, row = with_rows(docs.select("doc_id", "text"))
    found = written(aligned(docs, a, b), "aligned")
    width = _pair(a, b, 1 << 20).b.vocab_size()
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "pairs")
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("count").alias("most"))  # at most a row for each token of A
    ranked = counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = -(-total // most)  # so many documents, or more, can hold no more than `most` pairs
    often, seldom = ranked.filter(F.col("count") >= least), ranked.filter(F.col("count") < least)
    each = found.select(*row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*row, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    met = each.join(F.broadcast(often), "pair").groupBy(*row).agg(*sums)
    rest = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair").groupBy(*row).agg(*sums)
    both = met.unionByName(rest).groupBy(*row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(both, row, "left").fillna(0, ["n_best", "count_sum"]).drop(*row)
