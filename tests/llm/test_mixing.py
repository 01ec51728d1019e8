import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from mensura.llm._tables import numbered
from mensura.llm.mixing import mix, mixed, sainte_lague


def plain_seats(votes, seats):
    given = {k: 0 for k in votes}
    for _ in range(seats):
        best = min(votes, key=lambda k: (-votes[k] / (2 * given[k] + 1), k))
        given[best] += 1
    return given


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(1)
    for n, seats in ((5, 23), (40, 17), (40, 400), (3, 1), (12, 1000)):
        votes = {k: float(rng.randint(1, 1000)) ** rng.choice([1, 2]) for k in range(n)}
        df = spark.createDataFrame(list(votes.items()), "k int, v double")
        assert {r.k: r.seats for r in sainte_lague(df, "v", seats, ["k"]).collect()} == plain_seats(votes, seats)
    ties = spark.createDataFrame([(k, 10.0) for k in range(7)], "k int, v double")
    assert {r.k: r.seats for r in sainte_lague(ties, "v", 10, ["k"]).collect()} == plain_seats({k: 10.0 for k in range(7)}, 10)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        new = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not new:
            return target
        capped |= new


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        source = rng.choice(["hot"] * 6 + ["a", "b", "tiny", None])
        rows.append((i, "w " * rng.choice([0, 1, 5, 30] if source != "tiny" else [0, 0, 1]), source, "clash"))
    rows.append((999, None, "empty", "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    found = mix(docs, shard_tokens=500).collect()
    assert len(found) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["size"] == len(re.findall(r"\S+", next(t for i, t, *_ in rows if i == r.doc_id) or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    for r in found:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 + 8 * (sizes[s] // 500 + 1) ** 0.5, s
    again = {r.doc_id: r.taken for r in mix(docs.repartition(2), shard_tokens=500).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_mix_odd_rows(odd_docs, no_docs):
    assert mix(no_docs).count() == 0 and mixed(no_docs).count() == 0
    assert mix(odd_docs).count() == odd_docs.count()
    assert mixed(odd_docs).columns == odd_docs.columns


def test_mixed_works_on_rows(spark):
    """Rows without a doc_id, and rows that repeat one, are taken like others."""
    rows = [(None, f"w {i} x", "a") for i in range(30)] + [(7, "y " * (i + 1), "b") for i in range(10)] + [(i, "z z", "c") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixed(docs, block=1, shard_tokens=20)
    assert found.columns == docs.columns
    out = [tuple(r) for r in found.collect()]
    size = lambda r: len(r[1].split())
    sizes = {s: sum(size(r) for r in rows if r[2] == s) for s in "abc"}
    want = plain_targets(sizes)
    for s in "abc":
        assert abs(sum(size(r) for r in out if r[2] == s) - want[s]) <= 0.25 * want[s] + 10, s
    assert set(out) <= set(rows) and len({r for r in out if r[0] is None}) > 3
    taken = lambda df: sorted((r["size"], r.taken) for r in mix(df, block=1, shard_tokens=20).collect())
    assert taken(docs) == taken(docs.repartition(2))


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id")
    assert all(r.number == r.x + 1 for r in numbered(df, F.asc("x")).collect())
