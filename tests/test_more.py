import datetime as dt

import pytest
from pyspark.sql import functions as F

from mensura.functions import printing
from mensura.operators import ledger, mapping, matching, patients
from mensura.operators import rows as page_rows


def test_printing(spark):
    df = spark.createDataFrame([(123.45,), (5.0,), (0.5,), (1.25,), (0.1234,), (None,), (100.0,)], "x double")
    assert [r[0] for r in df.select(printing.printed_number(F.col("x"))).collect()][1:] == ["5", "0,5", "1,25", "0,123", "—", "100"]
    ranges = spark.createDataFrame([(1.0, 2.5), (None, 4.14), (3.2, None), (None, None)], "a double, b double")
    assert [r[0] for r in ranges.select(printing.printed_range(F.col("a"), F.col("b"))).collect()] == ["1–2,5", "0–4,14", "> 3,2", "—"]
    units = spark.createDataFrame([("10^9/l",), ("g/l",), ("10^12/l",)], "u string")
    assert [r[0] for r in units.select(printing.printed_unit(F.col("u"))).collect()] == ["10⁹/l", "g/l", "10¹²/l"]


def test_corrections_and_dates(spark):
    df = spark.createDataFrame([("",), ("<1,0",), ("Negativní",), ("-5",), ("5,3",), ("abc",), ("> 7",)], "x string")
    assert [r[0] for r in df.select(printing.correction_check(F.col("x"), ["negativ"])).collect()] == ["reject", "ok", "ok", "warn", "ok", "reject", "ok"]
    lines = spark.createDataFrame([("Datum odběru: 3. 4. 2024",), ("odebráno 13.2.24 8:00",), ("odběr 32.1.2024",), ("tisk 1.1.2024",), (None,)], "x string")
    assert [r[0] for r in lines.select(printing.draw_date(F.col("x"))).collect()] == ["2024-04-03", "2024-02-13", None, None, None]
    routes = spark.createDataFrame([("/api/reports/123/pages",), ("/api/x/deadbeef01",), ("/api/list",)], "x string")
    assert [r[0] for r in routes.select(printing.masked_route(F.col("x"))).collect()] == ["/api/reports/:id/pages", "/api/x/:id", "/api/list"]
    steps = spark.createDataFrame([(10.0,), (7.0,), (0.9,), (120.0,)], "x double")
    assert [round(r[0], 6) for r in steps.select(printing.nice_step(F.col("x"))).collect()] == [2.0, 2.0, 0.2, 25.0]


def test_sheet_score(spark):
    sheet = "Výsledek Jednotky\nGlukóza 5,4 mmol/l 3,9-5,6\nUrea 7,1 mmol / l 2,8 - 8,0\nLeukocyty 6,1 10^9/l 4-10"
    found = spark.createDataFrame([(sheet,), ("Dear Sir",), ("",)], "x string").select(printing.sheet_score(F.col("x"))).collect()
    assert found[0][0] == 2 * 1.5 + 3 * 0.5 + 2 + 3 * 0.25 and found[1][0] == 0 and found[2][0] == 0 and found[0][0] >= printing.SHEET_LEAST


def test_unmapped(spark):
    rows = spark.createDataFrame([(1, 0, dt.date(2024, 1, 1), None, "a", "g", 1.0, None, 5.0, None), (2, 0, dt.date(2024, 1, 2), None, "a", "kg", None, 1.0, 2.0, "s"), (3, 0, None, None, "a", "g", 3.0, 8.0, 9.0, "u"), (1, 1, None, "id", "b", "g", 1.0, 1.0, 2.0, None)], "report_id int, ord int, date date, canonical_id string, raw_name string, unit_raw string, value double, ref_low double, ref_high double, material string")
    found = mapping.unmapped(rows).collect()
    assert [tuple(r) for r in found] == [("a", "g", 1.0, 2.0, "s", 3, 2, 2, 2.0)]


def test_verdicts_are_three_valued(spark):
    df = spark.createDataFrame([(False, True, None, None, None), (False, None, None, None, None), (False, True, False, True, True), (True, True, None, None, None)], "w boolean, u boolean, r boolean, v boolean, m boolean")
    cols = [F.col(x) for x in "wurvm"]
    assert [r[0] for r in df.select(mapping.verdict(*cols)).collect()] == ["recommended", "possible", "contradicted", "contradicted"]
    assert [r[0] for r in df.select(mapping.verdict(*cols, named_by_model=True)).collect()][3] == "recommended"
    assert [r[0] for r in df.select(mapping.may_apply(*cols[1:])).collect()] == [True, False, False, True]


def test_answers(spark):
    cat = spark.createDataFrame([("na",), ("k",)], "canonical_id string")
    answers = spark.createDataFrame([(0, '"S_Na"', "na", "high"), (1, "S_Na", "k", "high"), (2, "x", "na", "high"), (3, "K", "none", "high"), (4, "K", "k", "low")], "ord int, name string, canonical_id string, confidence string")
    asked = spark.createDataFrame([("S_Na",), ("K",)], "name string")
    taken = mapping.accepted_answers(answers, asked, cat)
    assert {(r.name, r.canonical_id) for r in taken.collect()} == {("S_Na", "na"), ("K", "k")}
    evidence = spark.createDataFrame([("S_Na", "na", True, None, True, None), ("K", "k", True, None, None, None)], "name string, canonical_id string, unit_match boolean, range_match boolean, value_ok boolean, material_match boolean")
    assert {(r.name, r.decision) for r in mapping.gated(taken, evidence).collect()} == {("S_Na", "apply"), ("K", "ask")}


def test_catalogue_changes(spark):
    index = spark.createDataFrame([("na", "sodium"), ("k", "potassium")], "key string, id string")
    taught = spark.createDataFrame([("Natrium", "sodium"), ("Kalium", "potassium"), ("Na", "other")], "name string, id string")
    out = mapping.overlaid(index, taught, spark.createDataFrame([("Kalium",), ("K",)], "name string"), spark.createDataFrame([("potassium",)], "id string"))
    assert {(r.key, r.id) for r in out.collect()} == {("na", "other"), ("natrium", "sodium")}
    ids = mapping.founded_ids(spark.createDataFrame([("Můj test", 0), ("muj  test", 1), ("new", 2)], "name string, ord int"), spark.createDataFrame([("muj_test",)], "canonical_id string"))
    assert {(r.ord, r.canonical_id) for r in ids.collect()} == {(0, "muj_test_2"), (1, "muj_test_3"), (2, "new")}
    codes = spark.createDataFrame([("1", ["11"], ["L1"]), ("2", [], ["11", "L2"])], "id string, methods array<string>, loinc array<string>")
    assert {(r.code, r.id) for r in mapping.by_code(spark.createDataFrame([("11",), ("L2",), ("2",), ("x",)], "code string"), codes).collect()} == {("11", "1"), ("L2", "2"), ("2", "2"), ("x", None)}
    rows = spark.createDataFrame([("S_Na", None), ("S_Na", "old"), ("S_K", "stay")], "raw_name string, canonical_id string")
    new = mapping.rematched(rows, index, spark.createDataFrame([("sodium", "old")], "canonical_id string, split_from string"))
    assert sorted((r.raw_name, r.canonical_id, r.changed) for r in new.collect()) == [("S_K", "stay", False), ("S_Na", "sodium", True), ("S_Na", "sodium", True)]
    assert matching.name_index is not None


def test_page_rows(spark):
    words = [(1, "b", 50.0, 10.0, 60.0, 20.0), (1, "a", 5.0, 12.0, 20.0, 22.0), (1, " ", 0.0, 11.0, 1.0, 21.0), (1, "c", 5.0, 40.0, 9.0, 50.0), (1, "d", 30.0, 44.0, 39.0, 54.0), (2, "z", 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(words, "page_id long, text string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    found = {(r.page_id, r.row_index): r.cells for r in page_rows.page_rows(df).collect()}
    assert found == {(1, 0): ["a", "b"], (1, 1): ["c", "d"], (2, 0): ["z"]}


def test_printed_and_repaired(spark):
    pages = spark.createDataFrame([(1, 0, ["S_Na", "5", ",4 !", "g"]), (1, 1, ["K", "4,1"]), (1, 2, ["Cl", "9,9"]), (1, 3, ["Note"])], "page_id int, row_index int, cells array<string>")
    one = pages.where("row_index = 0")
    assert [one.select(page_rows.printed_on_row(F.lit(v), F.col("cells"))).first()[0] for v in ("5,4", "5", "54", "a,4", "")] == [True, True, False, False, False]
    rows = spark.createDataFrame([(1, 0, "K", "4,1", 1), (1, 1, "Cl", "9,9", 1), (1, 2, "X", "9,9", 1), (1, 3, "Mg", "7", 2)], "page_id int, ord int, raw_name string, value_raw string, row_index int")
    found = {r.ord: (r.row_index, r.repaired, r.broken) for r in page_rows.repaired(rows, pages).collect()}
    assert found == {0: (1, False, False), 1: (2, True, False), 2: (1, False, True), 3: (2, False, True)}
    claimed = spark.createDataFrame([(1, 1)], "page_id int, row_index int")
    assert sorted(r.row_index for r in page_rows.unclaimed(pages, claimed).collect()) == [0, 2]
    assert {r.ord: r.found_row for r in page_rows.best_prefix(rows.drop("row_index"), pages).collect()} == {0: 1, 1: 2, 2: None, 3: None}


def test_identity(spark):
    loaded = spark.createDataFrame([("s", "7103192745", "Jan Novák"), ("t", None, "Eva Malá"), ("u", None, None)], "session string, person_id string, person_name string")
    new = [("s", "a", "710319/2745", "X"), ("s", "b", None, "Novák Jan"), ("s", "c", "xx", "Petr"), ("s", "d", None, None), ("t", "e", "7103192745", "Eva Mala"), ("v", "f", None, "Q"), ("u", "g", None, "Q")]
    found = patients.identity_check(spark.createDataFrame(new, "session string, report_id string, person_id string, person_name string"), loaded, "session")
    assert {r.report_id: r.verdict for r in found.collect()} == {"a": "ok", "b": "ok", "c": "mismatch", "d": "unverifiable", "e": "ok", "f": "ok", "g": "unverifiable"}


def test_folds(spark):
    rows = spark.createDataFrame([("k", 0, "claim"), ("k", 1, "claim"), ("k", 2, "claim"), ("k", 3, "release"), ("k", 4, "claim"), ("j", 0, "release")], "key string, seq int, kind string")
    assert {tuple(r) for r in ledger.allowance(rows, "key", "key string, used long, refused long", 2).collect()} == {("k", 2, 1), ("j", 0, 0)}
    bought = spark.createDataFrame([("u", "e1", 5), ("u", "e1", 5), ("u", "e2", 3)], "user string, event string, credit int")
    assert [tuple(r) for r in ledger.credited_once(bought, "user", "event", "credit").collect()] == [("u", 8, 2)]
    left = ledger.cascade(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int"), {"pages": (spark.createDataFrame([(1, 7), (2, 8)], "report int, page int"), "report")}, "id")
    assert [r.page for r in left["pages"].collect()] == [8] and left["parents"].count() == 1


def test_tools(spark):
    tools = patients.Tools()
    tools.add("all", lambda n: spark.range(n), "n")
    assert tools.run("all", n=3).count() == 3
    with pytest.raises(KeyError, match="no tool"):
        tools.run("none")
    with pytest.raises(TypeError, match="has no x"):
        tools.run("all", x=1)


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 0, "L", "S_Na", "g", "na"), (2, 0, "l ", "Na", "G", "na"), (2, 1, "L", "K", "g", None), (3, 0, "M", "Cl", "g", "gone")], "report_id int, ord int, lab string, raw_name string, unit_raw string, canonical_id string")
    aliases = spark.createDataFrame([("L", "K", None, None), (None, "Cl", "mg", "x")], "alias_lab string, alias_name string, alias_unit string, target string")
    learnt = spark.createDataFrame([("Na", "na"), ("Mg", "mg"), ("K", "k")], "name string, id string")
    assert [tuple(r) for r in mapping.name_decisions(aliases, learnt, rows).collect()] == [("L", "K", None, "alias"), (None, "Na", "na", "learnt")]
    assert [(r.raw_name, r.n) for r in mapping.rows_under(rows, "na").collect()] == [("S_Na", 2)]
    assert sorted(r.raw_name for r in mapping.unrecognised(rows, spark.createDataFrame([("na",)], "canonical_id string")).collect()) == ["Cl", "K"]
    assert [r.name for r in mapping.still_to_ask(learnt, spark.createDataFrame([("Na",), ("K",)], "name string")).collect()] == ["Mg"]
    slots = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8), None), (2, dt.datetime(2024, 1, 1, 11, 30), None), (3, dt.datetime(2024, 1, 1, 8), 1)], "id int, ts timestamp, ended int")
    assert [r.id for r in ledger.stale(slots, "ts", F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()] == [1]
