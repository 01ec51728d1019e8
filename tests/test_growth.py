"""Work that must grow with the rows, not with the pairs of rows of one group."""

import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.functions import names
from mensura.operators import mapping, pages, patients, quality, reading
from mensura.operators import rows as rows_of
from mensura.plans import queries as plans
from mensura.sources.shared import shared_folder
from mensura.streaming import expiry, stateful


def _joins(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_identities_of_a_large_session(spark):
    """20000 reports against 20000 loaded identities in one session."""
    rows = spark.range(20_000).select(F.lit("s").alias("session"), F.col("id").cast("string").alias("report_id"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("x"))
    name = lambda way: rows.select("session", "report_id", F.lit(None).cast("string").alias("person_id"), way.alias("person_name"))
    begun = time.perf_counter()
    found = patients.identity_check(name(F.concat(F.upper("x"), F.lit(" Éva"))), name(F.concat(F.lit("Eva "), "x")).where("report_id % 2 = 0"), "session")
    assert {tuple(r) for r in found.groupBy("verdict").count().collect()} == {("ok", 10_000), ("mismatch", 10_000)}
    assert time.perf_counter() - begun < 60


def test_identities_by_number_and_name(spark):
    """Numbers decide where both have one, names where one has none."""
    columns = "session string, report_id string, person_id string, person_name string"
    loaded = spark.createDataFrame([("s", "x", "8551011238", "Eva Nová"), ("s", "y", None, "Jan Malý"), ("t", "z", None, None)], columns)
    a, b = "8551011238", "7501010000"
    new = [("s", "1", a, "Other"), ("s", "2", b, "Eva Nová"), ("s", "3", None, "nova eva"), ("s", "4", b, "Jan Malý"), ("s", "5", b, None), ("s", "6", None, None), ("t", "7", a, "Eva"), ("u", "8", a, None), (None, "9", a, "Eva")]
    found = {r.report_id: r.verdict for r in patients.identity_check(spark.createDataFrame(new, columns), loaded, "session").collect()}
    assert found == {"1": "ok", "2": "mismatch", "3": "ok", "4": "ok", "5": "mismatch", "6": "unverifiable", "7": "unverifiable", "8": "ok", "9": "ok"}


def test_printed_rows_are_spelt_once(spark):
    """no pattern is matched where values meet the rows of their page."""
    pages = spark.createDataFrame([(1, ["Látka", "5 ,", "4 !", "g/l"]), (1, []), (2, None)], "page_id long, cells array<string>")
    rows = spark.createDataFrame([(1, 1, "5,4", "kg"), (1, 2, "5,5", "g / l"), (2, 1, "5,4", " "), (1, 3, "!", None)], "page_id long, ord int, value string, unit string")
    found = quality.fabricated(rows, pages, ["value", "unit"])
    assert {tuple(r) for r in found.collect()} == {(1, 1, "unit", "kg"), (1, 2, "value", "5,5"), (2, 1, "value", "5,4"), (1, 3, "value", "!")}
    joins = _joins(found)
    assert joins and not any("regexp" in j for j in joins)


def test_admissions_of_a_long_session(spark, tmp_path):
    """4000 reports of one session, half of which wait for an end that doesn't come."""
    n = 4000
    rows = pd.DataFrame({"session": "s", "seq": range(n), "kind": "report", "report_id": [f"r{i}" for i in range(n)], "identity": [None if i % 2 else ("a" if i % 4 else "b") for i in range(n)]})
    spark.createDataFrame(rows, "session string, seq long, kind string, report_id string, identity string").write.parquet(f"{tmp_path}/in")
    begun = time.perf_counter()
    stream = spark.readStream.schema("session string, seq long, kind string, report_id string, identity string").parquet(f"{tmp_path}/in")
    found = stateful.run_to_end(stateful.admit(stream), shared_folder(spark, "long"))
    assert {tuple(r) for r in found.groupBy("decision").count().collect()} == {("admitted", 1000), ("mismatch", 1000)}
    assert time.perf_counter() - begun < 60


@pytest.mark.parametrize("name", ["trend_canonical_unit", "unit_misfits"])
def test_units_of_odd_series(spark, tmp_path, name):
    """nothing measured in another unit, and a series whose points all carry an unknown unit, which is then its own."""
    events = [(3, 1, "click", 7.0), (8, 1, "click", 8.0), (2, 2, "click", 0.0), (7, 2, "click", 0.12345), (13, 2, "click", 5.0), (4, 3, "view", 1.0), (18, 3, "view", 2.0)]
    rows = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), u, t, v, None) for i, u, t, v in events], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    given = plans.QUERIES[name](spark, str(tmp_path)).drop("ts")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        wanted = db.sql(f"SELECT {', '.join(given.columns)} FROM ({plans.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, given.collect())) == sorted(wanted)
    assert len(wanted) == (5 if name == "trend_canonical_unit" else 2)


def test_a_name_is_computed_once(spark):
    """however many keys a printed name has, the expression that prints it stands in the plan once."""
    rows = spark.createDataFrame([("P-ALT (enzym) – jaterní",), ("ALT alanin",), (None,)], "n string")
    found = rows.select(names.name_keys(F.soundex("n")).alias("k"), names.name_keys(F.col("n")).alias("keys"))
    assert [r.keys for r in found.collect()] == [["alt enzym jaterni", "alt enzym", "jaterni"], ["alt alanin", "alanin"], []]
    assert found.select("k")._jdf.queryExecution().optimizedPlan().toString().count("soundex(") == 1


def test_month_alerts_hold_few_rows(spark):
    """the rows behind the highest threshold are summed, not held; the answers and the state are those of all rows."""

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def listTimers(self):
            return []

        def registerTimer(self, at):
            self.at = at

    parts = [pd.DataFrame({"us": [(7 * i + k) % 1000 for i in range(50)], "id": [50 * k + i for i in range(50)], "amount": [float(i % 9) if i % 5 else None for i in range(50)], "until": 10**6}) for k in range(40)]
    told = {}
    for refunds in (True, False):
        run = expiry._Alerts({"a": 50, "b": 90}, refunds)
        run.handle, run.state = Handle(), State()
        rows = []
        for batch in (parts[:30], parts[30:]):
            rows += pd.concat(run.handleInputRows(("m",), iter(batch), None)).values.tolist()
        told[refunds] = rows, run.state.value, run.handle.at
    assert told[True] == told[False] and len(told[True][0]) == 2
    with pytest.raises(ValueError):
        list(run.handleInputRows(("m",), iter([parts[0].assign(amount=-1.0)]), None))


READ = "page_id long, reader string, ord int, raw_name string, value_raw string, unit_raw string, ref_range_raw string, row_index int"


def test_readings_are_spelt_once(spark):
    """Names, units and intervals that recur are worked out once each, so no pattern but the value's is matched for every reading; NULLs are kept."""
    rows = [(1, "a", 1, "Urea", "5 !", "mmol/l", "1 - 5", 1), (1, "b", 1, "S_urea", "5", "mmol / L", "1–5", 1), (2, "a", 1, None, "7", None, None, None), (2, "b", 1, None, "7", None, None, None), (None, "a", 1, "Urea", None, "g/l", "x", 1)]
    found = reading.compared(spark.createDataFrame(rows, READ).withColumn("name", F.lit("another")))
    got = {(r.page_id, r.reader): (r.key, r.value_key, r.unit_k, r.range_key) for r in found.collect()}
    assert got == {(1, "a"): ("urea", "5", "mmol/l", "1.0|5.0"), (1, "b"): ("urea", "5", "mmol/l", "1.0|5.0"), (2, "a"): ("", "7", "", None), (2, "b"): ("", "7", "", None), (None, "a"): ("urea", "", "g/l", None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1


def test_rows_go_on_only_where_they_are_asked_for(spark):
    """of 2000 rows only those that have the first characters of a value of their page are shuffled again, once for each of these."""
    told = spark.range(2000).select(F.col("id").alias("page_id"), F.lit(0).alias("row_index"), F.array(F.lit("Glukóza"), F.concat(F.col("id").cast("string"), F.lit(" ,5"))).alias("cells"))
    asked = spark.createDataFrame([(7, "7,5"), (7, "7,6"), (8, "a7"), (9, " "), (1234, "1234,5"), (5000, "1")], "page_id long, value string")
    found = pages.printed_somewhere(asked, told)
    assert {tuple(r) for r in found.collect()} == {(7, "7,5"), (1234, "1234,5")}
    made = [n for n in _nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
    assert [n.metrics().apply("numOutputRows").value() for n in made] == [2]


def _nodes(plan) -> list:
    """The nodes of a plan that has run."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(n for p in inner for n in _nodes(p))]


def test_rows_of_pages_are_made_once(spark):
    """words go to Python once and boxes are joined with nothing, whatever looks for borders; pages that begin in one batch and end in another stay whole."""
    words = spark.range(60_000).select((F.col("id") % 5).alias("page_id"), F.concat(F.lit(" w"), "id").alias("text"), F.lit(10.0).alias("x0"), (F.floor(F.col("id") / 5) * 20.0).alias("y0"), F.lit(50.0).alias("x1"), (F.floor(F.col("id") / 5) * 20.0 + 10).alias("y1"))
    found = rows_of.page_rows(words)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and not _joins(found)
    told = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last"), F.count_if(F.get("cells", F.lit(0)) == F.concat(F.lit("w"), (F.col("row_index") * 5 + F.col("page_id")).cast("string"))).alias("right"))
    assert sorted(map(tuple, told.collect())) == [(k, 12_000, 11_999, 12_000) for k in range(5)]


def test_only_values_that_are_asked_for_meet_reads(spark):
    """of a row's values those that its page's reads can't have go no further; a name may lack a letter, or the blank between its tokens."""
    rows = [(1, 0, "S_Kreatinin  5 ,3 ! g/l"), (1, 1, "Na 1 2 3"), (1, 2, "Na 7"), (2, 0, "! 5,3"), (3, 0, None), (None, 0, "Na 7")]
    reads = [(1, 1, "s kreatinn", "5,3"), (1, 2, "N a", "123 !"), (1, 3, "Ka", "7"), (2, 1, "5", "!"), (2, 2, "Na", "5,3"), (3, 1, "", ""), (None, 1, "Na", "7")]
    found = rows_of.matched_reads(spark.createDataFrame(reads, "page_id long, ord int, raw_name string, value_raw string"), spark.createDataFrame(rows, "page_id long, row_index int, text string"))
    assert {(r.page_id, r.ord): r.found_row for r in found.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): None, (2, 1): 0, (2, 2): None, (3, 1): None, (None, 1): None}
    made = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    assert made and all("_asked" in line for line in made)


def test_intervals_of_flags_are_read_once(spark):
    """no pattern is matched for each row; rows meet the distinct intervals."""
    found = plans.QUERIES["flags"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and _joins(found)
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_normalised_rows_are_spelt_once(spark):
    """what rows print as interval and unit is read once for each distinct pair."""
    from mensura.plans import more  # noqa: F401  (it registers the query)

    found = plans.QUERIES["normalised_rows"](spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString() and _joins(found)


def test_weak_matches_of_rows_printed_alike(spark):
    """rows printed alike meet aliases and catalogue as one row, and are all counted."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, 'lab') as lab", "'zzz_a' as raw_name", "if(id % 2 = 0, 'kg', null) as unit_raw", "if(id % 5 = 0, null, 'a') as canonical_id")
    entries = spark.sql("select 'a' as canonical_id, 'g' as canonical_unit, array('a') as synonyms, array('mg') as other_units")
    aliases = spark.createDataFrame([("lab", "zzz_a", "kg")], "alias_lab string, alias_name string, alias_unit string")
    found = mapping.weak_matches(rows, entries, aliases)
    assert sorted((r.lab or "", r.unit_raw or "", r.why, r.n) for r in found.collect()) == [("", "", "material", 400), ("", "kg", "material", 400), ("lab", "", "material", 800)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: [i for i, line in enumerate(plan) if word in line]
    assert max(depth("Aggregate [lab")) > max(depth("LeftAnti")), "rows are gathered below all joins"


def test_readings_are_dealt_by_page_once(spark):
    """whatever is compared, readings are shuffled once, by their page; rows that are one are told as one, and the same row of three readers isn't."""
    rows = [
        (1, "a", 0, "urea", "5", "g", "1 - 2", 1), (1, "b", 0, "URE urea x", "5", "g", "1 - 3", 1), (1, "a", 1, "p", "7", "g", "", None), (1, "b", 1, "q", "7", "kg", "", None), (1, "b", 2, "r", "7", "g", "", 9),
        (2, "a", 0, "x", "1", "g", "", 3), (2, "b", 0, "y", "1", "g", "", 3), (2, "c", 0, "z", "1", "g", "", 3), (2, "a", 1, "w", "2", "g", "", 4), (2, "a", 2, "w", "2", "g", "", 4),
        (3, "a", 0, "s", "1", None, None, 1), (3, "a", 1, "t", "2", None, None, 1), (3, "b", 0, "u", "9", None, None, 1), (3, "b", 1, "v", "2", None, None, 2), (4, "a", 0, "k", None, "g", "", None), (4, "b", 0, "l", None, "g", "", None),
    ]
    found = reading.reconcile(spark.createDataFrame(rows, READ), pair=True)
    got = {(r.page_id, r.key): (r.raw_name, r.readers, r.disagreement) for r in found.collect()}
    alone = "seen by one reading"
    assert got == {
        (1, "urea"): ("urea", 2, "ranges differ"), (1, "p"): ("p", 2, None), (1, "q"): ("q", 1, alone),
        (2, "x"): ("x", 1, alone), (2, "y"): ("y", 1, alone), (2, "z"): ("z", 1, alone), (2, "w#4"): ("w", 1, alone),
        (3, "s"): ("s", 2, "values differ"), (3, "t"): ("t", 2, None), (4, "k"): ("k", 1, alone), (4, "l"): ("l", 1, alone),
    }
    assert [n.nodeName() for n in _nodes(found._jdf.queryExecution().executedPlan())].count("Exchange") == 1


def test_verdicts_stay_with_their_page(spark):
    """the line items of an order, once together, are shuffled no more, through both readings up to the verdicts."""
    found = plans.QUERIES["reconcile_verdicts"](spark, "/root/testdata/sf0.001")
    assert found.count() > 6000
    assert found.agg(F.count_if("escalated")).collect()[0][0] == found.count()
    found.collect()
    assert [n.nodeName() for n in _nodes(found._jdf.queryExecution().executedPlan())].count("Exchange") == 1


def test_rows_of_pages_are_dealt_once(spark):
    """what becomes of a page's rows is read from one table in buckets by page and shuffled no more, nor is what is counted of them; the table's
    name is gone. Values are looked for at their row, near it, and then on their page alone."""
    line = lambda page, at, *cells: (page, at, list(cells))
    printed = [line(p, 0, "Moč") for p in (1, 2)] + [line(1, 3, "Urea", "7,1", "mmol/l"), line(1, 6, "Urea", "7,1", "mmol/l"), line(1, 9, "Draslík", "4,45", "mmol/l"), line(2, 1, "Urea", "9", "mmol/l"), line(2, None, "Sodík 140"), line(None, 1, "Urea", "9", "mmol/l")]
    read = lambda page, n, name, value, at, reader="a", scan=False: (page, reader, n, name, value, "mmol/l", "", at, "lab", "2024-01-01", scan)
    reads = [read(1, 1, "Urea", "7,1", 5), read(1, 2, "Draslík", "4,4", 9), read(2, 1, "Sodík", "140", 1), read(2, 2, "Chlór", "140", None), read(3, 1, "Urea", "5", 2, scan=True), read(None, 1, "Urea", "9", 1)]
    known = [spark.createDataFrame(r, s) for r, s in (([("urea", "u")], "key string, id string"), ([], "alias_lab string, alias_name string, alias_unit string, target string"), ([("u", "u")], "canonical_id string, material string"))]
    reads = spark.createDataFrame(reads, f"{READ}, lab string, report_date string, scan boolean")
    found = pages.interpret(reads, spark.createDataFrame(printed, "page_id long, row_index int, cells array<string>"), *known)
    got = {(r.page_id, r.source, r.key): (r.row_index, r.placed, r.printed, r.canonical_id, r.snippet) for r in found.collect()}
    assert got == {
        (1, "reading", "urea"): (6, "moved", "row", "u", "Urea  7,1  mmol/l"), (1, "reading", "draslik"): (9, "kept", "page", None, "Draslík  4,45  mmol/l"), (1, "unread", "row 3"): (3, "kept", "row", "u", "Urea  7,1  mmol/l"),
        (2, "reading", "sodik"): (None, "broken", "page", None, None), (2, "reading", "chlor"): (None, "none", "page", None, None), (2, "unread", "row 1"): (1, "kept", "row", "u", "Urea  9  mmol/l"), (3, "reading", "urea"): (2, "scan", "scan", "u", None),
    }
    shuffles = lambda df: [n.nodeName() for n in _nodes(df._jdf.queryExecution().executedPlan())].count("Exchange")
    counts = found.groupBy("page_id").count()
    assert sorted(map(tuple, counts.collect())) == [(1, 3), (2, 3), (3, 1)]
    assert shuffles(found) == 0 and shuffles(counts) == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mensura")]
