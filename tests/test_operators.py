import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mensura.operators import documents, ledger, matching, quality, reading, series
from mensura.sources import tables
from mensura.streaming import stateful

D = dt.date


def pts(spark, rows):
    schema = "patient string, series string, seq int, date date, value double, flag string, ref_low double, ref_high double, unit string"
    return spark.createDataFrame([(p, s, i, D(2024, 1, 1) + dt.timedelta(days=i), v, f, 1.0, 10.0, u) for p, s, i, v, f, u in rows], schema)


@pytest.fixture(scope="module")
def points(spark):
    rows = [("p", "a", i, v, f, "") for i, (v, f) in enumerate([(12.0, "high"), (5.0, "normal"), (0.5, "low"), (11.0, "high")])]
    rows += [("p", "b", 0, 5.0, "normal", ""), ("q", "a", 0, None, "unknown", ""), ("q", "c", 0, 0.0, "low", ""), ("q", "c", 3, 4.0, "normal", ""), ("q", "c", 5, 4.01, "normal", "")]
    return pts(spark, rows)


def test_series(points):
    s = {(r.patient, r.series): r for r in series.summaries(points, ["patient", "series"], ["date", "seq"]).collect()}
    assert s["p", "b"].direction == "single" and s["p", "b"].delta is None and s["p", "a"].delta == 10.5 and s["q", "c"].direction == "stable" and ("q", "a") not in s
    shape = {(r.patient, r.series): r for r in series.shapes(points, ["patient", "series"], ["date", "seq"]).collect()}
    assert shape["p", "a"].out_streak == 2 and not shape["p", "a"].monotone and not shape["p", "a"].newly_out and shape["q", "c"].rel_change is None and shape["q", "c"].monotone and ("p", "b") not in shape
    watch = series.watch_list(points, ["patient"], "series", ["date", "seq"]).collect()
    assert [(r.patient, r.series, r.beyond, r.out_streak) for r in watch] == [("p", "a", 0.1, 2)]


def test_permutations_give_the_same(points):
    keys, order = ["patient", "series"], ["date", "seq"]
    rows = points.collect()
    random.Random(1).shuffle(rows)
    other = points.sparkSession.createDataFrame(rows, points.schema).repartition(3)
    for f in (series.summaries, series.shapes, series.out_streaks):
        assert sorted(map(str, f(points, keys, order).collect())) == sorted(map(str, f(other, keys, order).collect()))


def test_units(spark):
    rows = [("p", "a", 0, 1.0, "normal", "g/l"), ("p", "a", 1, 5.0, "normal", "mg / L"), ("p", "a", 2, 6.0, "normal", "odd"), ("p", "a", 3, 7.0, "normal", None), ("p", "z", 0, 1.0, "normal", "x"), ("p", "z", 1, 2.0, "normal", "y"), ("p", "z", 2, 3.0, "normal", "Y"), ("p", "z", 3, 3.0, "normal", "X")]
    units = spark.createDataFrame([("a", "mg/l", 1.0, "mg/l"), ("a", "g/l", 1000.0, "mg/l")], "series string, unit_key string, factor double, canonical_unit string")
    kept, other = series.canonical_series(pts(spark, rows), ["patient", "series"], ["date", "seq"], units)
    assert sorted((r.series, r.value, r.unit) for r in kept.collect()) == [("a", 5.0, "mg/l"), ("a", 7.0, "mg/l"), ("a", 1000.0, "mg/l"), ("z", 1.0, "x"), ("z", 3.0, "x")]
    assert {(r.series, r.unit, r.n) for r in other.collect()} == {("a", "odd", 1), ("z", "y", 1), ("z", "Y", 1)}


def test_derived_same_report_only(spark):
    rows = spark.createDataFrame([("p", s, r, i, D(2024, 1, r), v) for i, (s, r, v) in enumerate([("a", 1, 6.0), ("b", 1, 3.0), ("a", 2, 8.0), ("b", 3, 2.0), ("a", 4, 9.0), ("a", 4, 4.0), ("b", 4, 2.0), ("a", 5, 1.0), ("b", 5, 0.0)])], "patient string, series string, report int, seq int, date date, value double")
    found = series.derived(rows, ["patient"], "series", "report", ["a", "b"], lambda a, b: F.try_divide(a, b), ["seq"]).collect()
    assert {(r.report, r.value, r.usable, r.skipped) for r in found} == {(1, 2.0, 2, 1), (4, 2.0, 2, 1), (5, None, 2, 1)}


def test_upper_median(spark):
    df = pts(spark, [("p", "a", i, float(v), "normal", "") for i, v in enumerate([4, 1, 3, 2])] + [("p", "b", 0, 7.0, "normal", "")])
    assert {r.series: r.median_value for r in series.observed(df, "series").collect()} == {"a": 3.0, "b": 7.0}


def test_lookup_rules_and_scopes(spark):
    cat = spark.createDataFrame([("iron", "železo", ["FE"], 0), ("urea", "urea", [], 1), ("mcv", "objem", ["MCV"], 2), ("mcv2", "other", ["objem"], 3)], "canonical_id string, display_name string, synonyms array<string>, ord int")
    index = matching.name_index(cat)
    rows = spark.createDataFrame([("L", n, "g") for n in ("S_Urea", "střed [MCV]", "URE urea", "FE železo", "HDL urea", "objem", "nothing")], "lab string, raw_name string, unit_raw string")
    assert {r.raw_name: (r.rule, r.id) for r in matching.lookup(rows, "raw_name", index).collect()} == {"S_Urea": (1, "urea"), "střed [MCV]": (2, "mcv"), "URE urea": (3, "urea"), "FE železo": (4, "iron"), "HDL urea": (None, None), "objem": (1, "mcv2"), "nothing": (None, None)}
    aliases = spark.createDataFrame([(" l", "urea", None, None), (None, "nothing", "G", "iron")], "alias_lab string, alias_name string, alias_unit string, target string")
    materials = spark.createDataFrame([("mcv2", "s")], "canonical_id string, material string")
    more = spark.createDataFrame([("M", "U_objem", "g"), ("M", "P_objem", "g")], rows.schema)
    found = {r.raw_name: (r.canonical_id, r.via) for r in matching.resolve(rows.union(more), index, aliases, materials=materials).collect()}
    assert found["S_Urea"] == (None, "lab") and found["nothing"] == ("iron", "unit") and found["U_objem"] == (None, None) and found["P_objem"] == ("mcv2", "catalogue")
    assert {r.key for r in matching.collisions(cat).collect()} == {"objem"}


def test_ranges_compatible(spark):
    df = spark.createDataFrame([(5.0, 15.0, 202.0, 417.0), (1.0, 2.0, 1.1, 2.2), (1.0, None, 1.0, 2.0), (0.0, 10.0, 8.0, 20.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(matching.ranges_compatible(*[F.col(x) for x in "abcd"])).collect()] == [False, True, None, False]


def reads(spark, rows):
    return spark.createDataFrame([("pg", *r) for r in rows], "page_id string, reader string, ord int, raw_name string, value_raw string, unit_raw string, ref_range_raw string, row_index int")


def test_reconcile(spark):
    a = [("a", 0, "S_Na", "7,4 !", "mmol/l", "1-5", None), ("a", 1, "K", "1", "g", "1-5", None), ("a", 2, "Cl", "< 1,0", "g", "1-5", None), ("a", 3, "Mg", "1", "g", "1-5", None), ("a", 4, "Ca", "1", "g", "1-5", None), ("a", 5, "X", "1", "g", "", 5), ("a", 6, "X", "2", "g", "", 6)]
    b = [("b", 0, "Na", "7,4", "mmol / L", "1 - 5", None), ("b", 1, "K", "2", "g", "1-5", None), ("b", 2, "Cl", "<1,0", "kg", "1-5", None), ("b", 4, "Ca", "1", "g", "1-6", None), ("b", 5, "X", "1", "g", "", 5), ("b", 6, "X", "2", "g", "", 6)]
    found = {r.key: (r.disagreement, r.raw_name) for r in reading.reconcile(reads(spark, a + b)).collect()}
    assert found == {"na": (None, "S_Na"), "k": ("values differ", "K"), "cl": ("units differ", "Cl"), "mg": ("seen by one reading", "Mg"), "ca": ("ranges differ", "Ca"), "x#5": (None, "X"), "x#6": (None, "X")}
    assert {r.disagreement for r in reading.reconcile(reads(spark, a), expected=2).collect()} == {"a reading failed"}


def test_orphans(spark):
    rows = [("a", 0, "urea", "5", "g", "", 1), ("b", 0, "URE urea x", "5", "g", "", 1), ("a", 1, "p", "7", "g", "", None), ("b", 1, "q", "7", "g", "", None), ("a", 2, "r", "9", "g", "", None), ("b", 2, "s", "9", "g", "", None), ("b", 3, "t", "9", "g", "", None)]
    assert {(r.kept, r.merged, r.by) for r in reading.orphan_pairs(reads(spark, rows)).collect()} == {("urea", "ure urea x", "row"), ("p", "q", "value")}


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Příliš žluťoučký kůň"), (2, "nic"), (3, "x" * 300 + " KUN " + "y" * 300), (4, None)], "doc_id long, text string")
    found = {r.doc_id: (r.at, r.excerpt) for r in documents.search(docs, "kůň", around=5).collect()}
    assert found == {1: (18, "…učký kůň"), 3: (302, "…xxxx KUN yyyy…")}
    red = documents.redacted(spark.createDataFrame([(1, "a.b@c.org 10.0.0.1 +1 (980) 555-6268 560101/1234"), (2, None)], "doc_id long, text string")).collect()
    assert red[0].redacted == "[email] [ip] [phone] [number]" and red[0].surviving == 0 and red[1].redacted == ""
    rows = spark.createDataFrame([(1, True, "s"), (2, False, None), (3, True, None), (4, False, None)], "n int, h boolean, m string").withColumn("g", F.lit(1))
    assert [r.heading for r in documents.nearest_heading(rows, "g", "n", F.col("h"), F.col("m")).orderBy("n").collect()] == ["s", "s", None, None]


def test_replay_and_first_writer(spark):
    rows = spark.createDataFrame([("k", 0, "a", 0, 1.0), ("k", 1, "b", 1, 2.0), ("k", 2, "a", 1, 3.0), ("k", 3, "a", 1, 4.0), ("j", 0, "z", 7, 5.0)], "key string, seq int, owner string, expected_rev int, value double").repartition(3)
    found = {r.key: tuple(r)[1:] for r in ledger.replay(rows, "key", "key string, rev long, owner string, value double, conflicts long").collect()}
    assert found == {"k": (2, "a", 3.0, 2), "j": (1, "z", 5.0, 0)}
    assert {(r.key, r.value, r.writes) for r in ledger.first_writer(rows, ["key"], "owner", ["seq"]).collect()} == {("k", 4.0, 3), ("j", 5.0, 1)}


def test_alerts_and_scores(spark):
    spend = spark.createDataFrame([("m", i, 30.0) for i in range(5)], "month string, seq int, usd double")
    assert {(r.alert, r["at"].seq) for r in ledger.once_per(spend, ["month"], ["seq"], "usd", {"80%": 80, "100%": 100, "never": 1000}).collect()} == {("80%", 2), ("100%", 3)}
    truth = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "k string, ord int, value int")
    arm = spark.createDataFrame([("a", 0, 1), ("a", 1, 9), ("c", 0, 3)], "k string, ord int, value int")
    assert sorted(r.verdict for r in quality.scored(truth, arm, ["k"]).collect()) == ["extra", "matched", "mismatch", "missing"]


def test_reports_round_trip(spark, tmp_path):
    m = {"raw_analyte_name": "S_Na", "value_raw": "1,5", "unit_raw": "g", "ref_range_raw": "1-2", "confidence": "high", "bbox": [0.0, 1.0]}
    import json

    (tmp_path / "a.json").write_text(json.dumps({"id": "r1", "patient_id": "p", "report_date": "2024-01-02", "measurements": [m, m], "pages": [{"page_num": 1, "image_width": -3, "image_height": 4}]}))
    reports = tables.read_reports(spark, str(tmp_path))
    assert [(r.report_id, r.ord, r.value_raw) for r in tables.measurements(reports).collect()] == [("r1", 0, "1,5"), ("r1", 1, "1,5")]
    tables.write_reports(reports, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    clean = tables.sanitised(reports).first()
    assert clean.patient_id is None and clean.source_file == "2024-01-02.pdf" and clean.pages[0].image_width == 0
    with pytest.raises(Exception, match="unknown patient_id"):
        tables.require_known(reports, spark.createDataFrame([("other",)], "patient_id string"), "patient_id").collect()


def run_stream(spark, tmp_path, rows, schema, op, batches):
    folder = tmp_path / f"in{batches}-{op.__name__}"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] if batches == 1 else rows[len(rows) * k // batches : len(rows) * (k + 1) // batches], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return sorted(tuple(r) for r in stateful.run_to_end(op(stream), f"file://{tmp_path}/work{batches}-{op.__name__}").collect())


def test_streams(spark, tmp_path):
    text = '{"measurements": ['
    body = '[{"a": "x}{\\"", "b": {"c": 1}}, {"a": 2}, {"open": '
    rows = [("s", i, body[i * 7 : i * 7 + 7]) for i in range(9)]
    assert text
    want = [("s", 0, 29, '{"a": "x}{\\"", "b": {"c": 1}}'), ("s", 1, 8, '{"a": 2}')]
    assert run_stream(spark, tmp_path, rows, "stream_id string, seq long, text string", stateful.scan_rows, 3) == want
    events = [
        ("u", 0, "report", "r0", "Jan Novák"), ("u", 1, "report", "r1", None), ("u", 2, "report", "r2", "eva"), ("u", 3, "report", "r3", "MUDr. NOVAK, Jan"), ("u", 4, "report", "r4", None), ("u", 5, "report", "r4", "novak jan"),
        ("u", 6, "done", None, None), ("u", 7, "report", "r5", "Eva"), ("u", 8, "discard", "r1", None), ("u", 9, "report", "r1", "jan novak"), ("u", 10, "replace", "r2", None), ("v", 0, "report", "r0", None), ("v", 1, "report", "r1", "jan"), ("v", 2, "keep", "r1", None), ("v", 3, "report", "r2", "jan"),
    ]
    schema = "session string, seq long, kind string, report_id string, identity string"
    want = sorted(
        [("u", "r0", "admitted"), ("u", "r2", "mismatch"), ("u", "r3", "admitted"), ("u", "r4", "admitted"), ("u", "r1", "unverifiable"), ("u", "r5", "mismatch"), ("u", "r1", "discarded"), ("u", "r0", "dismissed"), ("u", "r3", "dismissed"), ("u", "r4", "dismissed")]
        + [("u", "r2", "admitted"), ("u", "r5", "admitted"), ("v", "r0", "admitted"), ("v", "r1", "admitted"), ("v", "r2", "admitted")]
    )
    assert run_stream(spark, tmp_path, events, schema, stateful.admit, 2) == want

    def gated(stream):
        return stateful.gate(stream, "<END>")

    assert "".join(t[2] for t in run_stream(spark, tmp_path, [("s", 0, "ab<E"), ("s", 1, "x<"), ("s", 2, "END>no")], "stream_id string, seq long, text string", gated, 3)) == "ab<Ex"
