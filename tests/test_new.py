import datetime as dt

import pytest
from pyspark.sql import functions as F

from mensura.functions import names, printing
from mensura.operators import charts, citations, codes, documents, ledger, matching, normal, patients, prose
from mensura.operators import rows as page_rows
from mensura.sources import tables
from mensura.streaming import stateful

from .test_operators import run_stream


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_normalised_rows(spark):
    rows = [("5,3", "g/l", "1 - 6", "high"), ("1,2,3", "g/l", "1 - 6", "high"), ("> 7", None, "1 - 6", "high"), ("negativní", "", None, None), (None, None, None, None), ("", "-", "", "low")]
    got = normal.normalised(spark.createDataFrame(rows, "value_raw string, unit_raw string, ref_range_raw string, confidence string"))
    got = got.withColumn("flagged", normal.is_flagged(None)).collect()
    assert [(r.value, r.flag, r.confidence, r.flagged) for r in got] == [(5.3, "normal", "high", False), (None, "unknown", "low", True), (None, "high", "high", True), (None, "unknown", None, False), (None, "unknown", None, False), (None, "unknown", "low", True)]
    assert [r.unit for r in got] == ["g/l", "g/l", None, "", None, ""] and got[0].ref_range_low == 1.0


def test_reports_and_windows(spark):
    rows = [(1, None, None), (2, "2024-01-01", "order"), (3, "2031-01-01", None), (4, "junk", None), (5, "1985-01-01", None), (6, "2024-05-05", None)]
    got = normal.for_trends(spark.createDataFrame(rows, "id int, report_date string, date_doubt string"), F.lit("2024-06-01").cast("date")).collect()
    assert [(r.id, r.report_date_doubt) for r in got] == [(1, None), (2, "order"), (5, "before 1990"), (6, None)]
    days = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (1, 2, 3)], "d date")
    assert days.where(normal.in_window(F.col("d"), F.lit("2024-01-02").cast("date"), F.lit(None).cast("date"))).count() == 2 and days.where(normal.in_window(F.col("d"), None, None)).count() == 3


def test_name_keys_and_names(spark):
    keys = lambda x: one(spark, x, names.name_keys(F.col("x")))
    assert keys("NA (Sodium)") == ["na sodium", "na", "sodium"] and keys("ALP - alkalická fosfatasa") == ["alp alkalicka fosfatasa", "alp", "alkalicka fosfatasa"]
    assert keys(None) == [] and keys("  ") == [] and keys("S_Glukóza") == ["glukoza"]
    friendly = lambda x: one(spark, x, names.friendly_name(F.col("x")))
    assert friendly("Apo AII (S; konc. [x] [g/l])") == "Apo AII" and friendly("x (a (b; c) d)") == "x" and friendly("(S; g)") == "(S; g)" and friendly("x (a)") == "x (a)" and friendly(None) == ""
    materials = lambda x: one(spark, x, names.materials_of(F.col("x")), "array<string>")
    assert materials(["S_a", "P_a", "S_b"]) == "s,p" and materials(["xxx_a", "b"]) is None and materials([]) is None


def test_codes(spark):
    score = lambda u: one(spark, u, codes.unit_score(F.lit("g/l"), F.lit("MCnc"), F.col("x")))
    assert [score(u) for u in ("g / l", "mg/dl", "mmol/l", None, "odd", "%")] == [2, 1, 0, 1, 1, 0]
    material = lambda m, c: one(spark, c, codes.material_score(F.lit(m), F.col("x")))
    assert [material("s", c) for c in ("s", "p", "u", None, "x", "sp")] == [2, 1, -1, 0, 0, 2] and material("u", None) == -1
    table = spark.createDataFrame([("c1", "Glukóza", "mmol/l", "SCnc", "s", None), ("c2", "Glukóza", "mmol/l", "SCnc", "p", None), ("c3", "Glukóza", "mmol/l", "SCnc", "u", None)], "id string, label string, unit string, prop string, material string, method string")
    asked = spark.createDataFrame([("S_Glukóza", "mmol/l", None), ("S_Glukóza", "mmol/l", None), ("nic", None, None), (None, None, None)], "name string, unit string, material string")
    assert [(r.id, r.rank) for r in codes.code_lookup(asked, table).orderBy("rank").collect()] == [("c1", 1), ("c2", 2)]
    found = codes.mapped_by_codes(asked, table, spark.createDataFrame([("c1", "glucose")], "code string, canonical_id string")).collect()
    assert {(r.name, r.code, r.canonical_id, r.confidence) for r in found} == {("S_Glukóza", "c1", "glucose", "high"), ("nic", None, None, None), (None, None, None, None)}
    assert codes.code_lookup(asked.where("false"), table).count() == 0


def test_charts(spark):
    points = spark.createDataFrame([(1, s, s.upper(), u, dt.date(2024, 1, k), v) for s, u in (("a", "g"), ("b", "g"), ("c", "mol")) for k, v in ((1, 1.0), (2, 2.0), (3, None if s == "c" else 3.0))], "p int, series string, display_name string, unit string, date date, value double")
    ask = lambda *specs: charts.resolved_charts(charts.parsed_specs(spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(specs)], "p int, spec_id int, spec string")), points, "p").orderBy("spec_id", "chart").collect()
    got = ask((1, '{"parameters": ["A", "b", "a", "zz", 5], "type": "bar"}'), (1, '{"parameters": ["c"], "from": "2024-01-02"}'), (1, "no json"), (1, None), (2, '{"parameters": ["a"]}'), (1, '{"parameters": ["a", "c"], "to": ""}'), (1, '{"parameters": ["a"], "to": "soon"}'))
    assert [(r.spec_id, r.status, r.unit, r.series, r.points) for r in got] == [
        (0, "ok", "g", "a,b", 6), (1, "too few", None, None, None), (2, "invalid", None, None, None), (3, "invalid", None, None, None), (4, "no data", None, None, None), (5, "ok", "g", "a", 3), (5, "ok", "mol", "c", 2), (6, "invalid", None, None, None),
    ]
    assert got[0].missing == "zz, 5" and got[0].type == "bar" and got[1].dropped == "C" and got[5].missing == ""


def test_citations(spark):
    reports = spark.createDataFrame([(1, 10, dt.date(2024, 1, 1)), (1, 11, dt.date(2024, 1, 1)), (2, 12, None)], "owner int, report_id int, date date")
    points = spark.createDataFrame([(1, 11, dt.date(2024, 1, 1)), (1, None, dt.date(2024, 1, 1)), (1, 99, dt.date(2024, 1, 2)), (2, 10, None), (None, None, None)], "owner int, report_id int, date date")
    assert [(r.found_report, r.via) for r in citations.report_of_point(points, reports, "owner", ["report_id"]).orderBy("report_id").collect()] == [(10, "date"), (None, None), (None, None), (11, "id"), (None, None)]
    asked = lambda x: one(spark, x, citations.followups(F.col("x")))
    assert asked('x ["A?", " a? ", 5, "", "B", "C", "D"] y') == ["A?", "B", "C"] and asked('["open') == [] and asked(None) == [] and asked("[1, 2]") == [] and asked('{"a": []}') == []
    scrub = lambda x: one(spark, x, citations.scrubbed(F.col("x"), F.array(F.lit("p-novak"), F.lit(""))))
    assert scrub("see p-novak and p-eva-88 but p-vlna") == "see and but p-vlna" and scrub(None) is None


def test_identity_in_texts(spark):
    text = "Pacient: Jan Novák  Narozen: 1. 2. 1980\nRodné číslo: 800101/0006\tDatum odběru: 3.4.2020\nPodepsán NOVÁK, 8001010006 Nováková 🙂 Jan"
    rows = [(1, text), (2, None), (3, "nothing"), (4, "Jméno:\tDatum odběru: 1.1.2000"), (5, "🙂 Jméno: Eva Malá\n🙂 eva 🙂malá"), (6, "tel. 800 101 000, č. 800101/0006"), (7, "word " * 30_000 + "\nklient: Q Xeno")]
    got = {r.doc_id: r for r in documents.without_identity(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].redacted == "Pacient: █████████  Narozen: ██████████\nRodné číslo: ███████████\tDatum odběru: 3.4.2020\nPodepsán █████, ██████████ Nováková 🙂 ███"
    assert got[2].redacted == "" and got[3].redacted == "nothing" and got[4].redacted == rows[3][1] and got[5].redacted == "🙂 Jméno: ████████\n🙂 ███ 🙂████"
    assert got[6].redacted == "tel. 800 101 000, č. ███████████" and got[7].redacted.endswith("klient: ██████") and len(got[7].redacted) == len(rows[6][1])
    assert all(r.surviving == 0 for r in got.values())
    kept = spark.createDataFrame([("Novák was here",)], "x string").select(documents.surviving(F.col("x"), F.array(F.lit("novak"), F.lit("eva")))).first()[0]
    assert kept == ["novak"]


def test_printed(spark):
    span = lambda a, b: one(spark, a, printing.printed_span(F.to_date("x"), F.lit(b).cast("date")))
    assert span("2020-01-31", "2024-03-30") == "4 roky a 1 měsíc" and span("2024-01-01", "2024-01-03") == "2 dny" and span("2024-01-01", "2023-01-01") is None and span("2019-05-05", "2024-05-05") == "5 let" and span(None, "2024-01-01") is None
    assert one(spark, 1234567.5, printing.printed_money(F.col("x")), "double") == "1\u00a0234\u00a0567,50" and one(spark, 5.0, printing.printed_money(F.col("x")), "double") == "5"
    assert one(spark, "5,30 !", printing.printed_exact(F.lit(5.3), F.col("x"))) == "5,30" and one(spark, "", printing.printed_exact(F.lit(5.0), F.col("x"))) == "5"
    assert one(spark, ">2,0 mg", printing.converted_text(F.col("x"), F.lit(None).cast("double"), F.lit(10.0))) == ">20mg" and one(spark, "none", printing.converted_text(F.col("x"), F.lit(None).cast("double"), F.lit(10.0))) == "none"
    assert one(spark, "Odběr: 40.1.2024\nodebráno 5. 6. 24", printing.draw_date(F.col("x"))) == "2024-06-05" and one(spark, "odběr\n1.1.2024", printing.draw_date(F.col("x"))) is None


def test_twice_taught_alias_and_null_places(spark):
    rows = spark.createDataFrame([("Lab1", "Na", "g"), (None, "Na", None), ("Lab1", None, "g")], "lab string, raw_name string, unit_raw string")
    aliases = spark.createDataFrame([("Lab1 ", "Na", None, "x"), ("lab1", "na", None, "x")], "alias_lab string, alias_name string, alias_unit string, target string")
    index = spark.createDataFrame([("na", "sodium")], "key string, id string")
    got = matching.resolve(rows, index, aliases).collect()
    assert sorted((r.lab or "", r.raw_name or "", r.canonical_id or "") for r in got) == [("", "Na", "sodium"), ("Lab1", "", ""), ("Lab1", "Na", "x")]


def test_rows_without_a_key_are_one_history(spark):
    rows = spark.createDataFrame([(None, 0, "a", 0, "u"), (None, 1, "a", 1, "v"), (2**60 + 1, 0, "b", 0, "w")], "k long, seq int, owner string, expected_rev int, value string")
    got = {(r.k, r.rev, r.value) for r in ledger.replay(rows, "k", "k long, rev long, owner string, value string, conflicts long").collect()}
    assert {g for g in got if g[0] is None} == {(None, 2, "v")} and len(got) == 2
    words = spark.createDataFrame([(None, "a", 0.0, 0.0, 5.0, 10.0), (None, "b", 9.0, 0.0, 15.0, 10.0)], "page_id long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.cells for r in page_rows.page_rows(words).collect()] == [["a", "b"]]


def test_sources(spark, tmp_path):
    reports = spark.createDataFrame([("1", "p1", "f"), ("2", "p2", "f")], "id string, patient_id string, source_file string")
    folder = f"file://{tmp_path}/reports"
    tables.write_reports(reports, folder)
    tables.write_reports(spark.createDataFrame([("3", "p2", "f")], reports.schema), folder)
    assert sorted((r.id, r.patient_id) for r in spark.read.json(folder).collect()) == [(1, "p1"), (3, "p2")] or sorted((r.id, r.patient_id) for r in spark.read.json(folder).collect()) == [("1", "p1"), ("3", "p2")]
    session = tables.SessionSource(spark, [(1, 7, "2024-01-01", "na", 1.0), (2, 7, "2024-01-02", "na", None)], "report_id int, patient_id int, report_date string, canonical_id string, value double", 7)
    assert [tuple(r) for r in session.list_analytes().collect()] == [("na", 1, "2024-01-02")] and session.get_trend("na").count() == 2 and session.reports().count() == 2
    rows = session.rows.withColumn("patient_id", F.lit(8))
    with pytest.raises(Exception, match="unknown patient_id"):
        tables.TableSource(rows, spark.createDataFrame([(9,)], "patient_id int"), 8).reports().collect()


def test_tools_answer(spark):
    points = spark.createDataFrame([(1, "a", "A", "g", dt.date(2024, 1, k), float(k), "normal", 0.0, 9.0, k) for k in (1, 2)], "patient_id int, series string, display_name string, unit string, date date, value double, flag string, ref_low double, ref_high double, seq int")
    people = spark.createDataFrame([(1, "Eva Malá", 1980), (2, "Jan Malý", 1990)], "patient_id int, name string, birth_year int")
    docs = spark.createDataFrame([(5, 1, dt.date(2024, 1, 1), "note", "T", "a text"), (6, 2, dt.date(2024, 1, 1), "note", "T", "a text")], "doc_id int, owner int, doc_date date, kind string, title string, text string")
    perf = points.select("patient_id", F.lit("vo2").alias("metric"), F.col("date").alias("day"), "value")
    run = patients.patient_tools({"points": points, "patients": people, "documents": docs, "performance": perf}, ["date", "seq"]).run
    assert [r.patient_id for r in run("find_patient", query="mala").collect()] == [1] and run("find_patient", query="mal", birth_year=1990).count() == 1
    assert run("list_analytes", patient=1).first().n == 2 and run("get_trend", patient=1, series_id="a").count() == 2 and run("get_trend", patient=2, series_id="a").count() == 0
    assert run("get_document", patient=1, id=6).count() == 0 and run("get_document", patient=1).count() == 1 and run("search_documents", patient=1, query="TEXT").count() == 1
    assert run("get_perf_trend", patient=1).first().n == 2 and run("get_perf_trend", patient=1, metric="vo2").count() == 2
    assert run("summarize_changes", patient=1).first().direction == "rising" and run("cohort_query", series_id="a", direction="rising").count() == 1
    assert run("propose_chart", patient=1, spec='{"parameters": ["a"]}').first().status == "ok"
    assert run("computed_values", patient=1, inputs=["a"], formula=lambda a: a * 2).count() == 2


def test_long_objects_are_skipped_whole(spark, tmp_path):
    body = '[{"a": "' + "x" * 60 + '", "b": {"c": "}"}}, {"d": 1}, {bad}, {"e": 2}'
    rows = [("s", i, body[i * 11 : i * 11 + 11]) for i in range(12)]

    def short(stream):
        return stateful.scan_rows(stream, most=40)

    got = run_stream(spark, tmp_path, rows, "stream_id string, seq long, text string", short, 3)
    assert [(n, size, row) for _, n, size, row in got] == [(0, 86, None), (1, 8, '{"d": 1}'), (2, 5, None), (3, 8, '{"e": 2}')]


def test_split_streams(spark, tmp_path):
    text = "data: {\"a\": 1}\n\n: ping\n\ndata: {\"b\n\nevent: x\ndata: {\"c\": 2}\n\ndata: open"
    rows = [("s", i, text[i * 5 : i * 5 + 5]) for i in range(15)]
    got = run_stream(spark, tmp_path, rows, "stream_id string, seq long, text string", stateful.frames, 3)
    assert [(n, e) for _, n, e in got] == [(0, '{"a": 1}'), (3, '{"c": 2}')]

    def pieces(stream):
        return stateful.split_pieces(stream, "--", most=8)

    text = "ab--" + "x" * 30 + "--cd--" + "y" * 9 + "-"
    rows = [("s", i, text[i * 3 : i * 3 + 3]) for i in range(18)] + [("s", 18, "-e"), ("s", 19, "--")]
    assert [(n, p) for _, n, p in run_stream(spark, tmp_path, rows, "stream_id string, seq long, text string", pieces, 2)] == [(0, "ab"), (1, None), (2, "cd"), (3, None), (4, "e")]


def test_sentences(spark):
    day = lambda k: dt.date(2024, k, 5)
    rows = [(1, "alt", day(k), v, "high", None) for k, v in ((1, 0.61), (2, 0.8), (3, 1.02))] + [(1, "na", day(k), 140.0, "normal", None) for k in (1, 3)]
    rows += [(1, "crp", day(1), 9.0, "high", None), (1, "crp", day(3), 3.0, "normal", None), (1, "k", day(3), 44.5, "high", "impossible")]
    rows += [(2, "na", day(1), 140.0, "normal", None), (3, "na", day(1), None, "unknown", None), (3, "na", day(2), 150.0, "high", None)]
    points = spark.createDataFrame(rows, "owner int, series string, date date, value double, flag string, suspect string")
    names_ = spark.createDataFrame([("alt", "ALT", "µkat/l"), ("crp", "CRP", None), ("k", "Draslík", "mmol/l"), ("na", "Sodík", "mmol/l")], "series string, name string, unit string")
    got = {r.owner: r.sentences for r in prose.sentences(points, ["owner"], "series", ["date"], names_, "suspect").collect()}
    assert got[1] == [
        "Mimo referenční rozmezí k poslednímu odběru 5. 3. 2024: ALT (3 odběry po sobě). 1 hodnota k ověření: Draslík.",
        "Nárůst napříč celou sérií, ne jen mezi posledními dvěma odběry: ALT +67 % (0,61 → 1,02 µkat/l).",
        "Zpět v referenčním rozmezí oproti prvnímu odběru: CRP −67 % (9 → 3).",
    ]
    assert got[2] == ["K poslednímu odběru 5. 1. 2024 žádná hodnota mimo referenční rozmezí.", "Zatím jediný odběr: popis vývoje až od druhého."]
    assert got[3] == ["Mimo referenční rozmezí k poslednímu odběru 5. 2. 2024: Sodík.", "Zatím žádný parametr se dvěma porovnatelnými měřeními."]
