"""The operators of the third round against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from mensura.llm import token_align
from mensura.llm.prefix_trie import prefix_trie
from mensura.llm.sharding import assign
from mensura.llm.token_align import align, aligned, linked, lockstep

SMALL = "/root/testdata/sf0.001"
A = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
B = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


# ---- token alignment


def plain_groups(text):
    """Groups of (A ids, B ids), token by token, with the libraries' own encodings of the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = plain_groups.__dict__.setdefault("both", (Tokenizer.from_str(A), SentencePieceProcessor(model_proto=B)))
    a.encode_special_tokens = True
    if not text:
        return []
    signs = token_align.byte_signs()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    spelled_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    spelled_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
        return []
    groups, x, y, at_a, at_b = [], [], [], 0, 0
    left_a, left_b = list(zip(ids_a, spelled_a)), list(zip(ids_b, spelled_b))
    while left_a or left_b:
        if at_a <= at_b and left_a:
            i, s = left_a.pop(0)
            x.append(i)
            at_a += len(s)
        else:
            i, s = left_b.pop(0)
            y.append(i)
            at_b += len(s)
        if at_a == at_b:
            groups.append((x, y))
            x, y = [], []
    return groups


def plain_alignment(rows):
    every = [plain_groups(text) for _, text in rows]
    pairs = [Counter((i, j) for x, y in groups for i in x for j in y) for groups in every]
    docs = Counter(p for found in pairs for p in found)
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), groups, found in zip(rows, every, pairs):
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(found.values()), sum(n for p, n in found.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in found.items()), hashlib.sha256(joined.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_lockstep_is_the_intersection_of_ends():
    rng = np.random.default_rng(3)
    for lane in (1, 3, 16, 1024):
        sizes = rng.integers(0, 60, 40)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = []
        for _ in range(2):
            some = [np.unique(np.append(rng.integers(s + 1, e + 1, max(1, (e - s) // 2)), e)) for s, e in zip(bounds[:-1], bounds[1:]) if e > s]
            ends.append(np.concatenate(some))
        i, j = lockstep(*ends, bounds, lane)
        assert (ends[0][i] == np.intersect1d(*ends)).all() and (ends[1][j] == np.intersect1d(*ends)).all()


@pytest.mark.parametrize("step", [1, 7, 1 << 21])
def test_links_of_large_groups(step):
    rng = np.random.default_rng(4)
    a_many, b_many = rng.integers(1, 9, 30), rng.integers(1, 9, 30)
    a, b, doc = rng.integers(0, 5, a_many.sum()), rng.integers(0, 7, b_many.sum()), np.sort(rng.integers(0, 6, 30))
    want = Counter()
    for g, (x, y) in enumerate(zip(np.split(a, np.cumsum(a_many)[:-1]), np.split(b, np.cumsum(b_many)[:-1]))):
        want.update((int(doc[g]), int(p * 100 + q)) for p in x for q in y)
    d, code, times = linked(a, b, a_many, b_many, doc, 100, step)
    assert dict(zip(zip(d.tolist(), code.tolist()), times.tolist())) == want and len(d) == len(want)


def test_alignment_equals_a_plain_walk(spark, odd_docs):
    rng = random.Random(5)
    signs = ["the ", "Überlänge ", "日本語", " ", "\n", "<|endoftext|>", "</s>", "<0x41>", "▁", "é", "é", "🙂", "aaaaaaaa", "1234", "\t", " ", "don't ", "=" * 70]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(0, 60)))) for i in range(80)] + [(5, "the the the"), (5, "the the the"), (None, "the"), (81, None), (82, ""), (83, "A few words, " * 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (500_000, 40):  # few or many pairs join by a shuffle
        assert sorted((tuple(r[c] for c in COLUMNS) for r in align(docs, A, B, most).collect()), key=str) == plain_alignment(rows)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in align(odd_docs, A, B).collect()), key=str) == plain_alignment(rows)


def test_alignment_of_parts_and_its_groups(spark):
    text = "some words here and 12 there; naïve\n\nend " * 60
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole, parted = aligned(docs, A, B, keep=True).first(), aligned(docs, A, B, keep=True, part=50).first()
    assert whole == parted and len(token_align._pair(A, B, 50).parts(text)) > 20
    starts = lambda cuts: [0, *cuts][: len(cuts)]
    groups = [(whole.a_ids[i:k], whole.b_ids[j:m]) for i, k, j, m in zip(starts(whole.a_cuts), whole.a_cuts, starts(whole.b_cuts), whole.b_cuts)]
    assert groups == plain_groups(text)


def test_alignment_of_nothing(spark, no_docs):
    found = align(no_docs, A, B)
    assert found.count() == 0 and set(found.columns) == set(COLUMNS)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_alignment_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in align(docs, A, B).collect()), key=str) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


# ---- shards


def lawful(found, docs, shards):
    """Every row once, sizes and checks right, counts at most one apart, slots without gaps."""
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in found) == want
    by = defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def whole_groups(found, docs):
    """How many groups of equal texts lie in how many shards: (size, shards)."""
    places, at = defaultdict(set), {r.doc_id: r.shard for r in found}
    sizes = Counter(t or "" for _, t in docs)
    for i, t in docs:
        places[t or ""].add(at[i])
    return [(n, len(places[t])) for t, n in sizes.items() if n > 1]


def test_shards_keep_groups_whole(spark):
    rng = random.Random(7)
    rows = [(i, f"text {rng.random()}") for i in range(1500)]
    rows += [(2000 + k, f"copy {k // n} of {n}") for n in (2, 3, 9, 30) for k in range(n * 10 * 100, n * 10 * 100 + n * 10)]
    rows += [(90_000 + k, "a third of all rows") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = assign(docs, shards=40).collect()
    lawful(found, rows, 40)
    quota = -(-len(rows) // 40)
    for n, shards in whole_groups(found, rows):
        assert shards == 1 if n <= quota else shards <= n // quota + 3


def test_shards_when_all_rows_are_linked(spark):
    rows = [(i, f"{i // 4 % 130}" if i < 600 else f"{i // 2}") for i in range(700)]
    found = assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    lawful(found, rows, 10)
    assert sum(shards == 1 for _, shards in whole_groups(found, rows)) >= 100


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    lawful(assign(odd_docs, shards=4).collect(), rows, 4)
    lawful(assign(odd_docs, shards=40).collect(), rows, 40)
    assert assign(no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_shards_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = assign(docs).collect()
    lawful(found, rows, 40)
    assert all(shards == 1 for n, shards in whole_groups(found, rows) if n <= 5)
    assert {(r.doc_id, r.shard, r.slot) for r in assign(docs).collect()} == {(r.doc_id, r.shard, r.slot) for r in found}


# ---- conversation prefixes


def plain_trie(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(found) - 1) * words
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(paths[c]) == len(node))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def test_trie_equals_a_plain_one(spark):
    rng = random.Random(11)
    rows = []
    for c in range(300):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 20])):
            rows.append((c * rng.choice([1, 1, 1, 3]), t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", ""]) if t < 6 else rng.choice(["x", "y z"]), 1, "clash"))
    rows += [(c, t, "user", f"same {t}", 1, "clash") for c in range(4000, 4400) for t in range(4)]  # a group of copies, in several ranges
    rows += [(c, t, "user", "deep" if t % 3 else "deeper still", 1, "clash") for c in (5000, 5001, 5007) for t in range(700)]  # over many bands
    rows += [(None, 1, "user", "nobody's", 1, "clash"), (6000, None, None, None, 1, "clash"), (6000, None, "user", "later", 1, "clash"), (6000, 3, None, " \t", 1, "clash"), (6001, 2, "user", "tie", 1, "clash"), (6001, 2, "user", "tie", 1, "clash"), (6001, 2, "assistant", "tie", 1, "clash"), (-5, 0, "user", "below zero", 1, "clash"), (6002, 0, "user", "w " * 30000, 1, "clash")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_trie([r[:4] for r in rows])
    assert trie_rows(prefix_trie(df)) == want
    assert trie_rows(prefix_trie(df, height=3)) == want


def test_trie_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(none).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "c")], SCHEMA)).count() == 0
    for rows in ([(7, 0, "user", "x", 1, "c")], [(c, 0, "u", "x", 1, "c") for c in range(40)]):  # some have no turn left
        assert trie_rows(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie([r[:4] for r in rows])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_trie_of_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert trie_rows(prefix_trie(table)) == plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


# ---- words and fingerprints


def test_words_built_by_doubling_differ(spark):
    """A Thue-Morse word and its complement collide under any polynomial modulo 2**64."""
    from mensura.llm import fingerprints as fp
    from mensura.llm.near_dedup import near_groups

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_groups(docs, width=3, percent=85).collect()} == {(1, 1), (2, 2), (3, 1)}
    found = {r.doc_id: bytes(r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert found[1] == found[3] != found[2]


def test_edited_likeness_without_exchange_reuse(spark):
    from mensura.llm import fingerprints as fp

    rng = random.Random(8)
    rows = [(rng.choice([i, i, i % 9, None]), rng.choice(["", None, "x y z", f"text {i} " * rng.randint(1, 30)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        for n in (1, 4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fp.edited_likeness(docs).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- pages


def test_pages_of_data_keep_their_text_whatever_their_ids(spark):
    from mensura.llm.html_extract import extract

    menu = '<div class="top"><a href="/">Home page</a> <a href="/map">Map of stations</a></div>'
    page = lambda k: f'<html><body>{menu}<div class="report">Station {k} of the river. Temperature {k * 7 % 40} degrees</div><div class="foot">All rights reserved</div></body></html>'
    rows = [(None if k % 3 == 0 else k // 2, f"http://data.example/{k}", page(k)) for k in range(40)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {(r.page_id, r.url, r.text) for r in found} == {(i, u, f"Station {k} of the river. Temperature {k * 7 % 40} degrees") for k, (i, u, _) in enumerate(rows)} and len(found) == 40
