"""Page geometry, pairing by value and expiring streams against plain versions and planted cases."""

import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mensura.operators import layout, quality
from mensura.operators.rows import page_boxes, page_rows
from mensura.streaming import expiry, stateful

WORDS = "page_id long, word_id long, text string, x0 double, y0 double, x1 double, y1 double"


def _table(spark, pages):
    """pages: page -> rows of (text, x0, x1)."""
    rows = [(p, k, t, float(a), 20.0 * y, float(b), 20.0 * y + 10) for p, lines in pages.items() for y, line in enumerate(lines) for k, (t, a, b) in enumerate(line)]
    return {k: [(r.row_index, r.cells) for r in sorted(v, key=lambda r: r.row_index)] for k, v in _by_page(page_rows(spark.createDataFrame(rows, WORDS))).items()}


def _by_page(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page_id].append(r)
    return out


def _line(tag, shift=0, third=160):
    return [(f"{tag}{k}", a, a + 40) for k, a in enumerate((10, 110, 170, 310 + shift, 410 + shift, 310 + shift + third))]


def test_tables_side_by_side(spark):
    found = _table(
        spark,
        {
            1: [_line("a"), _line("b", 5)],
            2: [_line("a")],  # one row says nothing
            3: [_line("a", third=175), _line("b", third=175)],  # not mirrored
            4: [[("heading over both", 10, 500)], _line("a"), _line("b")],
            5: [_line("a"), _line("b"), [("only left", 10, 60)], [("only right", 320, 360)]],
            6: [_line("a"), _line("b", 60)],  # borders at two places
            7: [_line("a"), _line("b"), [(t, a + 4, b) for t, a, b in _line("c")], [(f"d{k}", a, a + 20) for k, a in enumerate((10, 60, 110, 170, 310, 410, 470))]],
            None: [_line("n"), _line("m")],
        },
    )
    halves = lambda t: [[f"{t}0", f"{t}1", f"{t}2"], [f"{t}3", f"{t}4", f"{t}5"]]
    whole = lambda t: [[f"{t}{k}" for k in range(6)]]
    cells = {p: [c for _, c in rows] for p, rows in found.items()}
    assert all([i for i, _ in rows] == list(range(len(rows))) for rows in found.values())
    assert cells[1] == halves("a") + halves("b") and cells[None] == halves("n") + halves("m")
    assert cells[2] == whole("a") and cells[3] == whole("a") + whole("b") and cells[6] == whole("a") + whole("b")
    assert cells[4] == [["heading over both"], *whole("a"), *whole("b")]
    assert cells[5] == halves("a") + halves("b") + [["only left"], ["only right"]]
    assert cells[7][-2:] == [["d0", "d1", "d2", "d3"], ["d4", "d5", "d6"]]  # the border divides every row of six cells or more
    none = spark.createDataFrame([], WORDS)
    assert page_rows(none).count() == 0 and page_boxes(none).count() == 0


def test_planted_tilt_is_found(spark):
    rng = random.Random(3)
    rows, planted = [], {}
    for page in range(20):
        planted[page] = rng.uniform(-3, 3)
        for line in range(30):
            angle = planted[page] if line % 4 else rng.uniform(-20, 20)  # a quarter of the lines are wrong
            for k in range(rng.choice([1, 2, 3, 8])):
                x = 50 + 100.0 * k
                y = 30 * line + x * math.tan(math.radians(angle)) + rng.uniform(-0.05, 0.05)
                rows.append((page, line, "w", x - 20, y - 5, x + 20, y + 5))
    rows += [(99, 1, "w", 0.0, 10.0 * k, 10.0, 10.0 * k + 5) for k in range(4)] + [(98, 1, " ", 10.0 * k, 0.0, 10.0, 5.0) for k in range(4)]
    words = spark.createDataFrame(rows, WORDS.replace("word_id", "line_id"))
    found = {r.page_id: r.degrees for r in layout.tilt(words).collect()}
    assert set(found) == set(planted) and all(abs(found[p] - planted[p]) < 0.1 for p in planted)


def test_phrases_end_at_gaps(spark):
    at = [(1, 0, "Iron", 0.0, 0.0, 30.0, 10.0), (1, 0, "level", 41.0, 1.0, 60.0, 11.0), (1, 0, "7,5", 72.0, 0.0, 90.0, 10.0), (1, 0, "|Hlava", 102.0, 0.0, 120.0, 10.0), (1, 0, "  ", 130.0, 0.0, 140.0, 10.0), (1, 1, "flat", 0.0, 5.0, 10.0, 5.0), (1, 1, "line", 33.0, 5.0, 40.0, 5.0), (1, 1, None, 50.0, 5.0, 60.0, 5.0)]
    found = sorted((r.line_id, r.phrase, r.text, r.x0, r.y0, r.x1, r.y1) for r in layout.phrases(spark.createDataFrame(at, WORDS.replace("word_id", "line_id"))).collect())
    assert found == [(0, 0, "Iron level", 0.0, 0.0, 60.0, 10.0), (0, 1, "7,5", 72.0, 0.0, 90.0, 10.0), (0, 2, "Hlava", 102.0, 0.0, 120.0, 10.0), (1, 0, "flat line", 0.0, 5.0, 40.0, 5.0)]


def test_words_under_boxes_equal_a_plain_join(spark):
    rng = random.Random(9)

    def box(wide):
        x, y = rng.uniform(-300, 900), rng.uniform(0, 900)
        return x, y, x + rng.uniform(0, wide), y + rng.uniform(0, wide)

    words = [(rng.choice([1, 2, None]), i, "w", *box(90)) for i in range(400)]
    words += [(3, 1000 + i, "crowd", 10.0, 10.0, 12.0, 12.0) for i in range(700)] + [(3, 2000, "far", 500.0, 500.0, 510.0, 510.0), (1, 3000, "flat", 5.0, 5.0, 5.0, 9.0), (1, 3001, "no edge", None, 5.0, 9.0, 9.0)]
    hits = [(rng.choice([1, 2, None]), *box(160)) for _ in range(25)] + [(3, 9.0, 9.0, 11.0, 11.0)] * 40 + [(2, None, 1.0, 2.0, 3.0), (4, 0.0, 0.0, 9.0, 9.0)]
    want = {(p, i) for p, i, _, *w in words for q, *h in hits if p == q and None not in w + h and w[0] < h[2] and h[0] < w[2] and w[1] < h[3] and h[1] < w[3] and w[0] < w[2] and w[1] < w[3] and h[0] < h[2] and h[1] < h[3]}
    w, h = spark.createDataFrame(words, WORDS), spark.createDataFrame(hits, "page_id long, x0 double, y0 double, x1 double, y1 double")
    for cell, crowd in ((64.0, 512), (7.0, 3), (5000.0, 50)):
        found = layout.under(w, h, cell, crowd).collect()
        assert {(r.page_id, r.word_id) for r in found} == want and len(found) == len(want)


def test_identity_is_gone_from_words(spark):
    texts = {1: [(1, "Jan"), (2, "Nový"), (3, "glukóza 5,4"), (4, "Nový, Jan"), (5, "Janovy"), (6, "č. 850101/1234"), (7, "8501011234"), (8, None)], 2: [(1, "Jan"), (2, "Nový")]}
    words = spark.createDataFrame([(p, i, t, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for p, ws in texts.items() for i, t in ws], WORDS)
    hits = spark.createDataFrame([(1, 12.0, 1.0, 25.0, 5.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    needles = spark.createDataFrame([(1, "JAN NOVY"), (1, "Nový, Jan"), (1, "850101/1234"), (1, " - "), (1, None)], "page_id long, needle string")
    assert {(r.page_id, r.needle) for r in layout.surviving(words, needles).collect()} == {(1, "JAN NOVY"), (1, "Nový, Jan"), (1, "850101/1234")}
    left = layout.without_boxes(words, hits, needles)
    assert {(r.page_id, r.word_id) for r in left.collect()} == {(1, 3), (1, 5), (1, 7), (1, 8), (2, 1), (2, 2)}
    assert layout.surviving(left, needles).count() == 0


def test_pairs_prefer_equal_values(spark):
    rng = random.Random(2)
    schema = "name string, ord int, value string"
    make = lambda: [(rng.choice(["a", "b", None]), i, rng.choice(["1", "2", "3", None])) for i in range(60)]
    truth, arm = make(), make()[:45] + [("only arm", 1, "1")]
    found = quality.paired_by_value(spark.createDataFrame(truth, schema), spark.createDataFrame(arm, schema), ["name"]).collect()
    assert sorted((r.name or "", r.truth_ord) for r in found if r.truth_ord is not None) == sorted((n or "", o) for n, o, _ in truth)
    assert sorted((r.name or "", r.arm_ord) for r in found if r.arm_ord is not None) == sorted((n or "", o) for n, o, _ in arm)
    count = lambda rows: Counter((n, v) for n, _, v in rows)
    assert sum(r.verdict == "matched" for r in found) == sum((count(truth) & count(arm)).values())
    names = lambda rows: Counter(n for n, _, _ in rows)
    assert sum(r.verdict in ("matched", "mismatch") for r in found) == sum((names(truth) & names(arm)).values())
    swapped = quality.paired_by_value(spark.createDataFrame([("a", 1, "5"), ("a", 2, "7"), ("a", 3, "9")], schema), spark.createDataFrame([("a", 1, "7"), ("a", 2, "5"), ("a", 3, "8")], schema), ["name"])
    assert sorted((r.truth_ord, r.arm_ord, r.verdict) for r in swapped.collect()) == [(1, 2, "matched"), (2, 1, "matched"), (3, 3, "mismatch")]


# ---- streams


def _events(spark, tmp_path, rows, files):
    """The rows as a stream of so many files, in the order of their times."""
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, cents long")
    path = f"{tmp_path}/{files}"
    step = -(-len(rows) // files)
    for k in range(files):
        df.where((F.col("event_id") >= k * step) & (F.col("event_id") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(path)
        os.utime(next(f"{path}/{f}" for f in sorted(os.listdir(path), key=lambda f: os.path.getmtime(f"{path}/{f}"))[::-1] if f.endswith(".parquet")), (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def hits():
    rng, at, rows = random.Random(6), datetime(2024, 1, 30), []
    for i in range(240):
        at += timedelta(minutes=rng.choice([1, 5, 30, 240]))
        rows.append((i, at, rng.choice([1, 1, 2, None]), rng.choice([None, 100, 900])))
    return rows


@pytest.mark.parametrize("files", [1, 6])
def test_expiring_streams_in_any_batches(spark, tmp_path, hits, files):
    stream = _events(spark, tmp_path, hits, files)
    found = {(r.key, r.id): r.limited for r in expiry.run_to_end(expiry.limited(stream, F.col("user_id"), "ts", "event_id", {"hour": (3600, 2), "day": (86400, 5)}, "1 hour"), f"{tmp_path}/limits{files}").collect()}
    for i, at, user, _ in hits:
        mine = [t for _, t, u, _ in hits if u == user and t <= at]
        assert found[user, i] == (sum(at - t <= timedelta(hours=1) for t in mine) > 2 or sum(at - t <= timedelta(days=1) for t in mine) > 5)
    alerts = expiry.run_to_end(expiry.month_alerts(stream, "ts", "event_id", F.col("cents"), {"80 %": 8000, "100 %": 10000}, "1 hour"), f"{tmp_path}/alerts{files}").collect()
    want, total = {}, Counter()
    for i, at, _, cents in hits:
        month = at.strftime("%Y-%m")
        total[month] += cents or 0
        for name, least in (("80 %", 8000), ("100 %", 10000)):
            if total[month] >= least:
                want.setdefault((month, name), (i, total[month]))
    assert {(r.key, r.alert): (r.id, r.total) for r in alerts} == want and len(alerts) == len(want) > 2
    seen, new = {}, set()
    for i, at, user, _ in hits:
        if user not in seen or at - seen[user] > timedelta(hours=2):
            new.add((user, i))
        seen[user] = at
    assert {(r.key, r.id) for r in expiry.run_to_end(expiry.fresh(stream, F.col("user_id"), "ts", "event_id", 7200, "1 hour"), f"{tmp_path}/fresh{files}").collect()} == new


def test_state_goes_with_its_window(spark, tmp_path):
    """A thousand users that come once and one that stays: in the end the state has those of the last window only."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), 10_000 + i, 1) for i in range(600)]
    stream = _events(spark, tmp_path, rows, 6)
    folder = f"{tmp_path}/state-test"
    expiry.run_to_end(expiry.limited(stream, F.col("user_id"), "ts", "event_id", {"hour": (3600, 2)}, "1 minute"), folder)
    left = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "state").load()
    assert 60 <= left.count() <= 170  # a window, and what came in the last batch


def test_too_long_events_are_told(spark, tmp_path):
    said = ['{"a": 1}', '{"b": "' + "x" * 500 + '"}', '{"c": 3}']
    text = "".join(f"data: {x}\n\n" for x in said)
    parts = [("s", i, text[i : i + 7]) for i in range(0, len(text), 7)]
    spark.createDataFrame(parts, "stream_id string, seq long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream_id string, seq long, text string").parquet(f"{tmp_path}/in")
    found = stateful.run_to_end(stateful.frames(stream, most=100), f"{tmp_path}/frames").orderBy("n").collect()
    assert [(r.n, r.event) for r in found] == [(0, said[0]), (1, None), (2, said[2])]
    lines = "".join(f"{x}\n" for x in said)
    spark.createDataFrame([("s", i, lines[i : i + 9]) for i in range(0, len(lines), 9)], "stream_id string, seq long, text string").coalesce(1).write.parquet(f"{tmp_path}/in2")
    stream = spark.readStream.schema("stream_id string, seq long, text string").parquet(f"{tmp_path}/in2")
    found = stateful.run_to_end(stateful.response_lines(stream, most=100), f"{tmp_path}/lines").orderBy("n").collect()
    assert [(r.n, r.kind, r.line) for r in found] == [(0, "row", said[0]), (1, "too long", None), (2, "row", said[2])]
