"""SentencePiece (BPE) encoding and decoding by a table of each prefix's last token.

Let enc(s) be the tokens of s. A row of tokens is enc of its text exactly when each pair of neighbours a, b is enc(a + b):
merges inside the tokens go on in the same order in the pair and in the whole text, and the first merge across a border
would also be made in that pair alone. So enc(prefix) ends in the one token t that ends the prefix, and for which the last
token of the prefix before t is compatible with t. An automaton over the vocabulary lists the tokens that end at each
place; the first compatible one is the prefix's last token; and walking back from the end over the table gives the ids.

A text is cut where no token can reach across: before each run of the blank sign that follows another character (no token
has the sign behind another character; that is checked on loading), and around line feeds when the vocabulary lacks them.
Such segments recur, so each task keeps a bounded table of those it has seen; a text of any length takes linear time.

Encoding adds the end id only. Decoding restores what the library's decode(ids) gives: the text, with U+2581 as a blank.
Defined results: a null text counts as empty, and is encoded as the end id alone. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
#: Where texts may be cut, the finest first: runs of letters, or of other signs, each after blank signs or none. The first that holds every token of the vocabulary whole is used, so no token reaches across a cut.
SEGMENTS = (
    rf"{BLANK}*(?:[^\W\d_²³¹{BLANK}]+|(?:[^{BLANK}\w]|[\d_²³¹])+)|{BLANK}+",
    rf"{BLANK}+[^{BLANK}]*|[^{BLANK}]+",
)


class Codec:
    """Encoder and decoder of one model file, with bounded memory: at most `segments` and `pairs` are remembered."""

    def __init__(self, model: bytes, segments: int = 150_000, pairs: int = 300_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is expected")
        self.piece = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.order = {i: -m.pieces[i].score for i in self.id.values()}  # a higher score merges first
        self.byte = [next(i for i, p in enumerate(m.pieces) if p.type == BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: b for b, i in enumerate(self.byte)}
        self.end = m.trainer_spec.eos_id
        self.id_of_a = [self.id["a"]]  # put first, it keeps a later blank sign from counting as the dummy prefix
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a token has the blank sign behind another character")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.segment = next(r for r in map(re.compile, SEGMENTS) if all(r.fullmatch(p) for p in self.id))
        self.known: dict[str, tuple[str, int, str]] = {}
        self.before: dict[str, tuple[str, int, str]] = {}  # the last full table: what is seen again moves to the new one
        self.fits: dict[int, bool] = {}
        self.made: dict[int, tuple[list[float], list[str], list[str]]] = {}  # at most one for each token
        self.most = segments, pairs

    def history(self, token: int) -> tuple[list[float], list[str], list[str]]:
        """The merges that make a token from its characters, the best first and the leftmost if equal: their ranks, and the
        first and last symbol before each and after the last. A token that merging doesn't reach has no end rank (-1)."""
        found = self.made.get(token)
        if found is None:
            parts, ranks = list(self.piece[token]), []
            firsts, lasts = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                able = [(self.order[i], k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None]
                if not able:
                    ranks = [-1.0]
                    break
                rank, k = min(able)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                ranks.append(rank)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            found = self.made[token] = ranks, firsts, lasts
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether enc(left + right) is left, right. left is -1 at the start, and -2 after a character outside the
        vocabulary, which never merges. Each side goes through its own merges; whichever is next in rank is made, and no
        merge across the border may come first (at equal rank the leftmost does) or remain at the end."""
        key = (left + 2) << 20 | right
        found = self.fits.get(key)
        if found is not None:
            return found
        if len(self.fits) >= self.most[1]:
            self.fits.clear()
        ranks, firsts, _ = self.history(right)
        found = -1.0 not in ranks
        if found and left >= 0:
            before, _, lasts = self.history(left)
            i = j = 0
            while True:
                across = self.id.get(lasts[i] + firsts[j])
                a = before[i] if i < len(before) else inf
                b = ranks[j] if j < len(ranks) else inf
                if across is not None and self.order[across] < a and self.order[across] <= b:
                    found = False
                    break
                if a == b == inf:
                    break
                if a <= b:
                    i += 1
                else:
                    j += 1
        self.fits[key] = found
        return found

    def ids(self, segment: str) -> list[int]:
        last, size = [-2] * len(segment), [1] * len(segment)  # of the prefix that ends here: its last token and its length
        fits, done = self.fits, -1
        for end, (token, n) in self.automaton.iter(segment):  # by end, longest first
            if end != done:
                left = last[end - n] if end >= n else -1
                ok = fits.get((left + 2) << 20 | token)
                if self.compatible(left, token) if ok is None else ok:
                    last[end], size[end], done = token, n, end
        out, k = [], len(segment) - 1
        while k >= 0:
            token = last[k]
            if token >= 0:
                out.append(token)
            else:
                out += [self.byte[b] for b in reversed(segment[k].encode())]
            k -= size[k]
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode(ids) returns."""
        out, raw, start = [], bytearray(), True

        def flush() -> None:
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()

        for i in ids:
            if self.kind[i] == BYTE:
                raw.append(self.value[i])
                start = False
                continue
            flush()
            if self.kind[i] == CONTROL:
                continue
            piece = self.piece[i]
            out.append((piece[1:] if start and piece.startswith(BLANK) else piece).replace(BLANK, " "))
            start = False
        flush()
        return "".join(out)

    def look(self, segment: str) -> tuple[str, int, str]:
        """Of a segment: ids joined by blanks, their number, and their text (with a blank for each blank sign)."""
        found = self.before.get(segment)
        if found is None:
            ids = self.ids(segment)
            text = "".join([self.piece[i] for i in ids])
            if "<0x" in text:  # bytes, or signs that look like one
                text = self.decode([*self.id_of_a, *ids])[1:]
            found = " ".join(map(str, ids)), len(ids), text.replace(BLANK, " ")
        if len(segment) <= 64:
            if len(self.known) >= self.most[0]:
                self.before, self.known = self.known, {}
            self.known[segment] = found
        return found

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids joined by blanks (the end id too), their number, and the decoded text."""
        if not text:
            return str(self.end), 1, ""
        known, look = self.known, self.look
        found = [known.get(s) or look(s) for s in self.segment.findall(BLANK + text.replace(" ", BLANK))]
        ids, counts, texts = zip(*found)
        return f"{' '.join(ids)} {self.end}", sum(counts) + 1, "".join(texts)[1:]


_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec for each Python worker, so that its tables serve task after task."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def round_trip(docs: DataFrame, model: bytes, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text); with keep_ids also ids
    (array<int>) and decoded (string). model: the content of the model file (half a megabyte), sent with the task."""

    def run(batches):
        codec, hexed = _codec(model), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for text in batch.column("text"):
                joined, n, decoded = codec.encode(text.as_py() or "")
                row = [n, hexed(joined), hexed(decoded)]
                rows.append([*row, [int(x) for x in joined.split(" ")], decoded] if keep_ids else row)
            columns = list(zip(*rows)) if rows else [[]] * (5 if keep_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
