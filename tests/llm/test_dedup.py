import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from mensura.llm import near_dedup
from mensura.llm.exact_dedup import deduplicate, exact_groups
from mensura.llm.near_dedup import _sets, busy, components, drop_near_copies, least_shared, near_groups, split_join


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_matches_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = exact_groups(odd_docs)
    assert Counter(tuple(r) for r in found.collect()) == plain_exact(rows)


def test_exact_hot_and_cold(spark):
    """A group over the support takes the broadcast way, the others the shuffle."""
    rows = [(i, "hot" if i % 3 == 0 else f"cold {i // 2}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in exact_groups(docs, support=0.1).collect()) == plain_exact(rows)
    plan = exact_groups(docs, support=0.1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_empty_and_filter(odd_docs, no_docs):
    assert exact_groups(no_docs).count() == 0
    kept = deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(set(texts)) == sorted({norm(r.text) for r in odd_docs.collect()})
    assert len(texts) == len(set(texts))


ROWS = "doc_id long, text string, note string"


def test_deduplicate_works_on_rows(spark):
    """A doc_id that is null or stands on several rows loses no text and keeps no second copy."""
    cases = [
        [(3, "unique words"), (3, "dup"), (1, "dup")],
        [(3, "x"), (3, "y"), (5, "x"), (6, "y")],
        [(None, "a"), (None, "a"), (None, "b"), (2, "b")],
        [(1, "x"), (1, "x"), (1, "x ")],
    ]
    wants = [[(1, "dup"), (3, "unique words")], [(3, "x"), (3, "y")], [(2, "b"), (None, "a")], [(1, "x"), (1, "x ")]]
    for rows, want in zip(cases, wants):
        docs = spark.createDataFrame([(i, t, "n") for i, t in rows], ROWS).repartition(2)
        kept = sorted(((r.doc_id, r.text) for r in deduplicate(docs).collect()), key=lambda r: (r[0] is None, r))
        assert kept == want, rows


def test_near_works_on_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "unique words of this text here"), (3, long), (1, long + " more"), (None, long + " end"), (None, "alone in its ways for ever"), (7, "same text of several words"), (7, "same text of several words")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], ROWS).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    for df in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = sorted(((r.doc_id or 0, r.text) for r in drop_near_copies(df).collect()))
        assert kept == [(0, rows[4][1]), (1, rows[2][1]), (3, rows[0][1]), (7, rows[5][1])]
        found = Counter((r.doc_id, r.component_id, r.kept) for r in near_groups(df).collect())
        assert found == Counter([(3, 3, True), (3, 1, False), (1, 1, True), (None, 1, False), (None, None, True), (7, 7, True), (7, 7, True)])


def test_near_recall_above_the_threshold(spark):
    """Of 300 pairs just above 85 %, a link may be lost with a chance of one in a million each."""
    rng = random.Random(11)
    rows = []
    for k in range(300):
        n = rng.choice([60, 200, 600])
        own = [f"{k}x{i}" for i in range(n)]
        new = int((n - 2) * 0.15 / 1.85) - 2  # two shingles more than new words are of one side only
        other = own[: n - new] + [f"{k}y{i}" for i in range(new)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    links = 0
    by = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    for k in range(300):
        a, b = (shingle_set(rows[2 * k + x][1], 3) for x in (0, 1))
        if 100 * len(a & b) >= 85 * len(a | b):
            links += 1
            assert by[2 * k + 1] == 2 * k, k
    assert links == 300


def test_split_join(spark):
    pairs = spark.createDataFrame([(1, b) for b in range(10, 60)] + [(2, 10), (3, 11)], "a long, b long")
    side = spark.createDataFrame([(k, k * 10) for k in range(4)], "a long, v long")
    for most in (1, 7, 1000):
        assert sorted(map(tuple, split_join(pairs, "a", side, busy(pairs, most)).select("a", "b", "v").collect())) == sorted((r.a, r.b, r.a * 10) for r in pairs.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def shingle_set(t, width):
    w = words(t)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_near(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5):
    """Near copies at and around the threshold, a large group of them, a line and a passage that many share, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line, passage = " ".join(word() for _ in range(9)), " ".join(word() for _ in range(60))
    texts = []
    for _ in range(120):
        t = [word() for _ in range(rng.choice([12, 40, 150, 400]))]
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 2])):
            u = list(t)
            for _ in range(rng.choice([1, 1, 2, 4, 8])):
                u[rng.randrange(len(u))] = word()
            texts.append(" ".join(u))
    base = [word() for _ in range(200)]
    for _ in range(90):
        u = list(base)
        for _ in range(rng.randint(1, 6)):
            u[rng.randrange(len(u))] = word()
        texts.append(" ".join(u))
    texts += [f"{line} {' '.join(word() for _ in range(rng.choice([3, 6, 30])))}" for _ in range(80)]
    texts += [f"{' '.join(word() for _ in range(rng.choice([8, 20, 60])))} {passage}" for _ in range(80)]
    return list(enumerate(texts + texts[:10] + [t.upper() for t in texts[10:14]]))


def test_near_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width, percent, direct, block in ((3, 85, 32, 512), (3, 85, 2, 3), (5, 80, 4, 7)):
        found = near_groups(docs, width=width, percent=percent, direct=direct, block=block)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == plain_near(rows, width, percent), (width, percent, direct)


def test_near_odd_rows(odd_docs, no_docs):
    assert near_groups(no_docs).count() == 0
    found = near_groups(odd_docs, width=3, percent=85).collect()
    assert len(found) == odd_docs.count()
    by = {r.doc_id: r for r in found}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0
    assert by[0].kept and by[1].kept and by[2].kept and by[None].kept and by[None].component_id is None
    assert by[5].component_id == 4 and by[8].component_id == 7 and by[12].component_id == 11 and not by[12].kept
    assert drop_near_copies(odd_docs).columns == odd_docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 7), (200, 201), (5, 5)]
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == i // 20 * 20 for i in range(60) if i % 20) and found[100] == 0 and found[201] == 200


def test_least_shared():
    assert least_shared(85, 32) == 16 and least_shared(80, 32) == 13


def test_sets_come_piece_by_piece():
    """The sets of a whole batch are never held together, and are the same as those of each text alone."""
    texts = [" ".join(f"w{(i * k) % 997}" for k in range(400 * (i % 5))) for i in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    found = [(piece.column("id").to_pylist(), sets) for piece, sets in _sets(batch, 5, 1 << 14)]
    assert len(found) > 10 and [i for ids, _ in found for i in ids] == list(range(len(texts)))
    alone = [sets[0] for i in range(len(texts)) for _, sets in _sets(batch.slice(i, 1), 5)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip((s for _, sets in found for s in sets), alone, strict=True))


def test_near_pairs_meet_once(spark, monkeypatch):
    """Copies around the threshold share many lists; in the last round each pair of them is one row, not one for each list and side."""
    rng, made = random.Random(3), []
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(90):
        at = dict.fromkeys(rng.sample(range(300), rng.randint(3, 9)))
        rows.append((k, " ".join(f"{w}x{k}" if i in at else w for i, w in enumerate(base))))
    plain = near_dedup._pairs

    def pairs(a, b, also=None, *blocks):
        met = plain(a, b, also, *blocks)
        if also is not None:
            made.extend((min(r.a, r.b), max(r.a, r.b)) for r in met.collect())
        return met

    monkeypatch.setattr(near_dedup, "_pairs", pairs)
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, direct=8)
    assert made and len(made) == len(set(made))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == plain_near(rows, 3, 85)
