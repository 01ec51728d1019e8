"""The registered queries of the library's own operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, names, numbers, printing
from ..operators import documents, ledger, mapping, matching, patients, quality, reading, series
from ..operators import rows as rows_of
from ..sources.shared import shared_folder, told_once
from ..sources.tables import csv_lines, table
from ..streaming import stateful
from . import carriers as c
from .carriers import HIGH, LINES_SQL, LOW, POINTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS, ORDER = ["patient_id", "series"], ["ts", "event_id"]
PTS = f"WITH p AS ({POINTS_SQL})"
LNS = f"WITH l AS ({LINES_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _move(new: str, old: str, share: float, flat: str = "stable") -> str:
    return f"CASE WHEN {old} IS NULL THEN 'single' WHEN abs({new} - {old}) <= greatest(abs({old}) * {share}, 1e-9) THEN '{flat}' WHEN {new} > {old} THEN 'rising' ELSE 'falling' END"


SUMMARY = f"""{PTS}, r AS (SELECT *, row_number() OVER w AS age, count(*) OVER (PARTITION BY patient_id, series) AS n, lead(value) OVER w AS prev_value
  FROM p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY patient_id, series ORDER BY ts DESC, event_id DESC))
SELECT patient_id, series, n, value AS last_value, date AS last_date, flag AS last_flag, prev_value, round(value - prev_value, 6) AS delta, {_move('value', 'prev_value', 0.05)} AS direction
FROM r WHERE age = 1"""


@query(SUMMARY)
def series_summary(spark, d):
    return series.summaries(c.points(spark, d), KEYS, ORDER)


@query(f"""{PTS} SELECT * FROM (SELECT patient_id, series, event_id, date, value, flag, row_number() OVER (PARTITION BY patient_id, series ORDER BY ts DESC, event_id DESC) AS age FROM p WHERE value IS NOT NULL) WHERE age <= 2""")
def latest_two(spark, d):
    return series.latest_two(c.points(spark, d), KEYS, ORDER).select(*KEYS, "event_id", "date", "value", "flag", F.col("age").cast("long"))


@query(f"""{PTS}, s AS (SELECT *, row_number() OVER w AS rn, value - lag(value) OVER w AS step, lag(value) OVER w AS before FROM p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY patient_id, series ORDER BY ts, event_id)),
a AS (SELECT patient_id, series, arg_min(value, rn) AS first_value, arg_max(value, rn) AS last_value, count(*) AS n, CAST(datediff('day', arg_min(date, rn), arg_max(date, rn)) AS INT) AS span_days,
  count(*) FILTER (flag IN ('high', 'low')) AS out_count, arg_max(flag, rn) IN ('high', 'low') AND NOT arg_min(flag, rn) IN ('high', 'low') AS newly_out,
  count(*) - coalesce(max(rn) FILTER (flag NOT IN ('high', 'low')), 0) AS out_streak,
  count(DISTINCT sign(step)) FILTER (abs(step) > greatest(abs(before) * 0.01, 1e-9)) <= 1 AS monotone FROM s GROUP BY ALL)
SELECT *, round(last_value - first_value, 6) AS change, round((last_value - first_value) / nullif(first_value, 0), 6) AS rel_change, {_move('last_value', 'first_value', 0.01, 'flat')} AS direction FROM a WHERE n >= 2""")
def series_shape(spark, d):
    return series.shapes(c.points(spark, d), KEYS, ORDER)


@query(f"""{PTS}, s AS (SELECT *, row_number() OVER (PARTITION BY patient_id, series ORDER BY ts, event_id) AS rn FROM p WHERE value IS NOT NULL)
SELECT patient_id, series, count(*) - coalesce(max(rn) FILTER (flag NOT IN ('high', 'low')), 0) AS out_streak, count(*) AS n FROM s GROUP BY ALL""")
def out_streak(spark, d):
    return series.out_streaks(c.points(spark, d), KEYS, ORDER)


WATCH = f"""{PTS}, g AS (SELECT patient_id, max(date) AS draw FROM p GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY patient_id, series ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY patient_id, series) AS n FROM p WHERE value IS NOT NULL),
k AS (SELECT patient_id, series, count(*) - coalesce(max(rn) FILTER (flag NOT IN ('high', 'low')), 0) AS out_streak FROM s GROUP BY ALL),
w AS (SELECT s.patient_id, s.series, s.date, s.value, s.flag, k.out_streak, round(CASE WHEN value > ref_high THEN (value - ref_high) / ref_high WHEN value < ref_low THEN (ref_low - value) / ref_low END, 6) AS beyond
  FROM s JOIN g USING (patient_id) JOIN k USING (patient_id, series) WHERE rn = n AND date = draw AND flag IN ('high', 'low'))
SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY coalesce(beyond, -1) DESC, out_streak DESC, series) AS rank FROM w"""


@query(WATCH)
def watch_list(spark, d):
    return series.watch_list(c.points(spark, d), ["patient_id"], "series", ORDER).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, series ORDER BY ts DESC, event_id DESC) AS age FROM p WHERE value IS NOT NULL),
t AS (SELECT patient_id, series, max(value) FILTER (age = 1) AS value, max(value) FILTER (age = 2) AS before, max(flag) FILTER (age = 1) AS flag, max(flag) FILTER (age = 2) AS flag_before, max(date) FILTER (age = 1) AS date FROM r GROUP BY ALL),
u AS (SELECT *, CASE WHEN flag_before IS NOT DISTINCT FROM flag THEN 'still ' ELSE 'newly ' END || CASE flag WHEN 'high' THEN 'above' WHEN 'low' THEN 'below' ELSE 'within' END AS transition,
  round((value - before) / nullif(abs(before), 0), 6) AS move, {_move('value', 'before', 0.01)} AS direction FROM t)
SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY flag IN ('high', 'low') DESC, coalesce(abs(move), -1) DESC, series) AS rank FROM u""")
def change_summary(spark, d):
    return series.change_summaries(c.points(spark, d), ["patient_id"], "series", ORDER).withColumn("rank", F.col("rank").cast("long"))


def _daily(spark, d):
    """Readings of one user and day form a report."""
    return c.points(spark, d).withColumn("report_id", F.concat_ws("|", "patient_id", F.col("date").cast("string")))


def _wide(inputs: tuple[str, str]) -> str:
    a, b = inputs
    last = lambda s: f"arg_max(value, (ts, event_id)) FILTER (series = '{s}')"
    return f"{PTS}, w AS (SELECT patient_id, concat_ws('|', patient_id, CAST(date AS VARCHAR)) AS report_id, date, {last(a)} AS a, {last(b)} AS b FROM p WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"""{_wide(('click', 'view'))}, v AS (SELECT *, round(a / nullif(b, 0), 6) AS value FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT patient_id, count(value) AS usable, count(*) - count(value) AS skipped FROM v GROUP BY ALL HAVING count(value) >= 2) SELECT patient_id, report_id, date, value, usable, skipped FROM v JOIN e USING (patient_id)""")
def derived_ratio(spark, d):
    return series.derived(_daily(spark, d), ["patient_id"], "series", "report_id", ["click", "view"], lambda a, b: F.try_divide(a, b), ORDER)


@query(f"""{_wide(('purchase', 'signup'))}, v AS (SELECT *, CASE WHEN b <= 45 THEN round(a - b / 2.2, 6) END AS value FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT patient_id, count(value) AS usable, count(*) - count(value) AS skipped FROM v GROUP BY ALL HAVING count(value) >= 2) SELECT patient_id, report_id, date, value, usable, skipped FROM v JOIN e USING (patient_id)""")
def derived_guarded(spark, d):
    return series.derived(_daily(spark, d), ["patient_id"], "series", "report_id", ["purchase", "signup"], lambda a, b: a - b / 2.2, ORDER, guard=lambda a, b: b > 45)


_UNIT_OF = "CASE event_id % 5 WHEN 0 THEN 'mg/l' WHEN 1 THEN 'mg / L' WHEN 2 THEN 'g/l' WHEN 3 THEN 'arb' ELSE '' END"


def _with_units(spark, d):
    return c.points(spark, d).withColumn("unit", F.expr(_UNIT_OF))


_UNITS_SQL = f"""{PTS}, u AS (SELECT *, {_UNIT_OF} AS unit FROM p), f AS (SELECT *, CASE WHEN unit IN ('mg/l', 'mg / L', '') THEN 1 WHEN unit = 'g/l' THEN 1000 END AS factor FROM u),
s AS (SELECT *, bool_or(factor IS NOT NULL) OVER (PARTITION BY patient_id, series) AS settled FROM f)"""


@query(f"""{_UNITS_SQL} SELECT patient_id, series, ts, event_id,
  CASE WHEN factor = 1000 AND value = 0 THEN 0.0 WHEN factor = 1000 THEN round(value * 1000 * pow(10, 3 - floor(log10(abs(value * 1000)))), 0) / pow(10, 3 - floor(log10(abs(value * 1000)))) ELSE value END AS value,
  CASE WHEN settled THEN 'mg/l' ELSE unit END AS unit FROM s WHERE factor IS NOT NULL OR NOT settled""")
def trend_canonical_unit(spark, d):
    units = spark.createDataFrame([(s, u, f, "mg/l") for s in ("click", "view", "purchase", "signup", "error") for u, f in (("mg/l", 1.0), ("g/l", 1000.0))], "series string, unit_key string, factor double, canonical_unit string")
    return series.canonical_series(_with_units(spark, d), KEYS, ORDER, units)[0]


@query(f"""{_UNITS_SQL} SELECT patient_id, series, unit, count(*) AS n FROM s WHERE factor IS NULL AND settled GROUP BY ALL""")
def unit_misfits(spark, d):
    units = spark.createDataFrame([(s, u, f, "mg/l") for s in ("click", "view", "purchase", "signup", "error") for u, f in (("mg/l", 1.0), ("g/l", 1000.0))], "series string, unit_key string, factor double, canonical_unit string")
    return series.canonical_series(_with_units(spark, d), KEYS, ORDER, units)[1]


@query(f"""{PTS}, u AS (SELECT *, {_UNIT_OF} AS unit FROM p), k AS (SELECT patient_id, series, lower(unit) AS lu, count(*) AS n, arg_min(unit, (ts, event_id)) AS unit, min((ts, event_id)) AS seen FROM u WHERE unit <> '' GROUP BY ALL)
SELECT patient_id, series, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, series ORDER BY n DESC, seen) AS rn FROM k) WHERE rn = 1""")
def majority_unit(spark, d):
    return series.majority_unit(_with_units(spark, d), KEYS, ORDER)


@query(f"""SELECT s.*, c_name, c_mktsegment FROM ({SUMMARY}) s JOIN customer ON c_custkey = patient_id WHERE direction = 'rising' AND last_flag = 'high' ORDER BY last_date DESC, patient_id, series LIMIT 25""")
def cohort_filter(spark, d):
    patients = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), "c_name", "c_mktsegment")
    return quality.cohort(series_summary(spark, d), patients, "patient_id", "rising", "high")


@query("SELECT event_type AS metric, count(*) AS n, max(CAST(ts AS DATE)) AS last_date FROM events GROUP BY 1")
def perf_metrics_list(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date("ts")).alias("last_date"))


@query(f"""{PTS} SELECT series, count(*) AS n, count(DISTINCT date) AS n_dates, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, min(date) AS first_date, max(date) AS last_date,
  list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_value FROM p WHERE value IS NOT NULL GROUP BY series""")
def observed_stats(spark, d):
    return series.observed(c.points(spark, d), "series")


@query(f"""{PTS}, v AS (SELECT DISTINCT user_id AS patient_id, CAST(ts AS DATE) + 1 AS visit_date FROM events),
k AS (SELECT patient_id, date AS visit_date, count(*) AS labs, count(*) FILTER (flag <> 'normal') AS not_normal, count(*) FILTER (flag IN ('high', 'low')) AS out_of_range FROM p GROUP BY ALL)
SELECT patient_id, visit_date, coalesce(labs, 0) AS labs, coalesce(not_normal, 0) AS not_normal, coalesce(out_of_range, 0) AS out_of_range FROM v LEFT JOIN k USING (patient_id, visit_date)""")
def visit_counts(spark, d):
    visits = table(spark, d, "events").select(F.col("user_id").alias("patient_id"), F.date_add(F.to_date("ts"), 1).alias("visit_date")).distinct()
    return quality.visit_counts(visits, c.points(spark, d), "patient_id", "visit_date")


@query(f"""{PTS}, v AS (SELECT patient_id, series, date, arg_max(value, (ts, event_id)) AS value FROM p GROUP BY ALL)
SELECT *, round(value - lag(value) OVER (PARTITION BY patient_id, series ORDER BY date), 6) AS delta FROM v""")
def visit_delta(spark, d):
    days = c.points(spark, d).groupBy(*KEYS, "date").agg(F.max_by("value", F.struct(*ORDER)).alias("value"))
    return days.withColumn("delta", F.round(F.col("value") - F.lag("value").over(Window.partitionBy(*KEYS).orderBy("date")), 6))


_VALUE = "CASE id % 8 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 6 THEN CAST(cents // 100 AS DOUBLE) ELSE cents / 100.0::DOUBLE END"


@query(f"{LNS} SELECT id, {_VALUE} AS value FROM l")
def parse_numbers(spark, d):
    return c.value_cells(c.lines(spark, d)).select("id", numbers.parse_value(F.col("value_raw")).alias("value"))


@query(f"""{LNS} SELECT id, CASE WHEN id % 10 IN (0, 1, 4, 5, 7) THEN CAST(lo AS DOUBLE) END AS low, CASE WHEN id % 10 IN (0, 1, 2, 3, 5, 7) THEN hi + 0.5::DOUBLE END AS high,
  CASE id % 10 WHEN 6 THEN lo || ' - ' || hi || ',5 let' WHEN 8 THEN 'M: ' || lo || '-' || hi || ',5 Ž: 1-2' WHEN 9 THEN 'negativní' END AS text FROM l""")
def parse_ranges(spark, d):
    return numbers.with_range(c.range_cells(c.lines(spark, d)).select("id", "range_raw"), F.col("range_raw"), "r").select("id", "r.*")


@query(f"{LNS} SELECT id, [{', '.join(repr(b) for _, b in c.UNITS)}][id % {len(c.UNITS)} + 1] AS unit FROM l")
def canonical_units(spark, d):
    return c.lines(spark, d).select("id", numbers.canonical_unit(c.pick(F.col("id"), [a for a, _ in c.UNITS])).alias("unit"))


@query(f"""{LNS}, v AS (SELECT *, {_VALUE} / 1000 AS value FROM l)
SELECT id, CASE WHEN value IS NULL THEN 'unknown' WHEN id % 10 IN (0, 1, 5, 7, 4) AND value < lo THEN 'low' WHEN id % 10 IN (0, 1, 2, 3, 5, 7) AND value > hi + 0.5 THEN 'high' WHEN id % 10 IN (6, 8, 9) THEN 'unknown' ELSE 'normal' END AS flag FROM v""")
def flags(spark, d):
    rows = told_once(c.range_cells(c.value_cells(c.lines(spark, d))), ["range_raw"], lambda texts: numbers.with_range(texts, F.col("range_raw"), "span"))
    return rows.select("id", numbers.compute_flag(numbers.parse_value(F.col("value_raw")) / 1000, F.col("span.low"), F.col("span.high")).alias("flag"))


@query(f"{LNS} SELECT id, CASE WHEN id % 8 = 7 AND cents / 100.0 >= hi * 1000 OR id % 8 = 4 AND hi > lo OR id % 8 = 1 AND lo > 25 THEN 'high' ELSE 'unknown' END AS flag FROM l")
def censored_flags(spark, d):
    """Results printed as bounds: > (the top itself is past it), ≥ and >= (it isn't), and those below a bound."""
    rows, k = c.value_cells(c.lines(spark, d)), F.col("id") % 8
    cell = F.when(k == 4, F.concat(F.lit("≥ "), "hi", F.lit("000"))).when(k == 1, F.concat(F.lit(">="), "lo", F.lit(" 000 !"))).otherwise(F.col("value_raw"))
    top = F.when(k == 4, F.col("lo")).when(k == 1, 25).otherwise(F.col("hi")) * 1000.0
    return rows.select("id", numbers.censored_flag(cell, top).alias("flag"))


@query("""SELECT doc_id, trim(regexp_replace(strip_accents(lower(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)))), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT doc_id, replace(text, '#', ' ') AS text FROM documents)""")
def norm_keys(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", names.norm_key(F.concat(F.lit("S_"), F.ltrim(text))).alias("key"))


_INITIALS = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:3])), '')"


@query(f"""{LNS}, n AS (SELECT id, p_name, id % 6 AS form, {_INITIALS} AS ini FROM l JOIN part ON p_partkey = l_partkey),
cat AS (SELECT p_name, min(p_partkey) AS ord, any_value({_INITIALS}) AS ini FROM part GROUP BY p_name),
ab AS (SELECT ini, arg_max(p_name, ord) AS p FROM cat GROUP BY ini)
SELECT id, CASE WHEN form = 5 THEN NULL WHEN form = 2 THEN replace((SELECT p FROM ab WHERE ab.ini = n.ini), ' ', '_') ELSE replace(p_name, ' ', '_') END AS canonical_id,
  CASE form WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 END AS rule FROM n""")
def name_lookup(spark, d):
    rows = c.printed_names(spark, d)
    found = matching.lookup(rows, "raw_name", matching.name_index(c.catalogue(spark, d)))
    return rows.join(found.withColumnRenamed("id", "canonical_id"), "raw_name", "left").select("id", "canonical_id", "rule")


@query(f"""{LNS}, n AS (SELECT id, p_name, 'lab' || l_suppkey % 4 AS lab, CASE WHEN id % 3 = 0 THEN 'g' ELSE 'mg' END AS unit_raw FROM l JOIN part ON p_partkey = l_partkey)
SELECT id, CASE WHEN p_name LIKE '%bolt' AND lab = 'lab1' AND unit_raw = 'g' THEN 'taught_1' WHEN p_name LIKE '%bolt' AND lab = 'lab1' THEN NULL WHEN p_name LIKE '%bolt' AND unit_raw = 'mg' THEN 'taught_2' ELSE replace(p_name, ' ', '_') END AS canonical_id,
  CASE WHEN p_name LIKE '%bolt' AND lab = 'lab1' AND unit_raw = 'g' THEN 'lab+unit' WHEN p_name LIKE '%bolt' AND lab = 'lab1' THEN 'lab' WHEN p_name LIKE '%bolt' AND unit_raw = 'mg' THEN 'unit' ELSE 'catalogue' END AS via FROM n""")
def scoped_alias(spark, d):
    parts = table(spark, d, "part")
    rows = c.lines(spark, d).join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("raw_name")), "l_partkey")
    rows = rows.select("id", "raw_name", F.concat(F.lit("lab"), (F.col("l_suppkey") % 4).cast("string")).alias("lab"), F.when(F.col("id") % 3 == 0, "g").otherwise("mg").alias("unit_raw"))
    taught = [F.struct(F.lit(a).alias("alias_lab"), F.lit(u).alias("alias_unit"), F.lit(t).alias("target")) for a, u, t in (("Lab1 ", "g", "taught_1"), ("lab1", None, None), (None, "mg", "taught_2"))]
    aliases = parts.where(F.endswith("p_name", F.lit("bolt"))).select(F.col("p_name").alias("alias_name")).distinct().select("alias_name", F.inline(F.array(*taught)))
    return matching.resolve(rows, matching.name_index(c.catalogue(spark, d)), aliases).select("id", "canonical_id", "via")


_GRAMS = "[substr({0}, i, 2) FOR i IN range(1, length({0}))]"
_DICE = f"""CASE WHEN key = ckey THEN 1.0::DOUBLE WHEN length(key) < 2 OR length(ckey) < 2 THEN 0.0 ELSE
  2.0 * list_sum([least(len(list_filter({_GRAMS.format('key')}, lambda x: x = g)), len(list_filter({_GRAMS.format('ckey')}, lambda x: x = g))) FOR g IN list_distinct({_GRAMS.format('key')})]) / (length(key) + length(ckey) - 2)::DOUBLE END"""


@query(f"""WITH n AS (SELECT p_name || ' ' || lower(p_type) AS name, [' g', 'kg', 'MG', NULL][count(*) % 4 + 1] AS unit, CASE WHEN count(*) % 5 > 0 THEN min(p_size)::DOUBLE END AS low, max(p_size)::DOUBLE AS high, round(avg(p_retailprice), 6) AS mean, CASE length(p_type) % 3 WHEN 0 THEN 's' WHEN 1 THEN 'u' END AS material FROM part GROUP BY p_name, p_type),
e AS (SELECT replace(p_name, ' ', '_') AS canonical_id, p_name, [p_name, lower({_INITIALS}), CASE WHEN length(split_part(p_name, ' ', 1)) <= 4 THEN substr(p_name, length(split_part(p_name, ' ', 1)) + 2) ELSE p_name END] AS keys, min(p_size)::DOUBLE AS ref_low, max(p_size)::DOUBLE + CASE WHEN length(p_name) % 5 = 0 THEN 9 ELSE 0 END AS ref_high, min(p_retailprice) AS min_value, max(p_retailprice) AS max_value, length(p_name) % 2 = 0 AS plasma FROM part GROUP BY p_name),
k AS (SELECT *, name AS key FROM n, (SELECT *, unnest(keys) AS ckey FROM e)),
t AS (SELECT name, unit, low, high, mean, material, canonical_id, ref_low, ref_high, min_value, max_value, plasma, max({_DICE}) AS ns, bool_or(length(ckey) >= 3 AND (contains(key, ckey) OR contains(ckey, key))) AS inside FROM k GROUP BY ALL),
u AS (SELECT *, CASE WHEN unit IS NOT NULL THEN unit <> 'kg' END AS unit_match, CASE WHEN low IS NULL THEN NULL WHEN least(high, ref_high) - greatest(low, ref_low) <= 0 THEN FALSE ELSE greatest(high, ref_high) - least(low, ref_low) <= 0 OR (least(high, ref_high) - greatest(low, ref_low)) / (greatest(high, ref_high) - least(low, ref_low)) >= 0.3 END AS range_match,
  mean BETWEEN min_value / 3 AND max_value * 3 AS value_ok, CASE WHEN material IS NOT NULL AND plasma THEN material = 's' END AS material_match FROM t WHERE ns >= 0.28),
v AS (SELECT *, round(ns + CASE WHEN inside THEN 0.15 ELSE 0 END + CASE WHEN unit_match THEN 0.2 WHEN NOT unit_match THEN -0.25 ELSE 0 END + CASE WHEN range_match THEN 0.3 WHEN NOT range_match THEN -0.6 ELSE 0 END + CASE WHEN value_ok THEN 0.1 ELSE -0.35 END
  + CASE WHEN material_match THEN 0.05 WHEN NOT material_match THEN -0.4 ELSE 0 END, 6) AS score FROM u)
SELECT name, canonical_id, round(ns, 6) AS name_sim, score, unit_match, range_match, value_ok, material_match, rank FROM (SELECT *, row_number() OVER (PARTITION BY name, unit, low, high, mean, material ORDER BY score DESC, canonical_id) AS rank FROM v WHERE ns >= 0.45 OR score >= 0.45) WHERE rank <= 3""")
def suggest_mappings(spark, d):
    parts = table(spark, d, "part")
    unmapped = parts.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").cast("double").alias("low"), F.max("p_size").cast("double").alias("high"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
    k = F.length("p_type") % 3
    unmapped = unmapped.select(
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), c.pick(F.col("n"), [F.lit(" g"), F.lit("kg"), F.lit("MG"), F.lit(None).cast("string")]).alias("unit"), F.when(F.col("n") % 5 > 0, F.col("low")).alias("low"), "high", "mean",
        F.when(k == 0, "s").when(k == 1, "u").alias("material"),
    )
    return matching.suggestions(unmapped, c.catalogue(spark, d)).withColumn("rank", F.col("rank").cast("long"))


_TRI = "list_distinct([substr(' ' || {0} || ' ', i, 3) FOR i IN range(1, length({0}) + 1)])"


@query(f"""WITH n AS (SELECT DISTINCT reverse(p_type) || ' ' || p_name AS name FROM part), a AS (SELECT name, unnest({_TRI.format("lower(name)")}) AS gram FROM n),
v AS (SELECT DISTINCT p_name AS id FROM part), b AS (SELECT id, unnest({_TRI.format('id')}) AS gram FROM v),
s AS (SELECT name, id, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY ALL), na AS (SELECT name, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS nb FROM b GROUP BY 1),
r AS (SELECT name, id, shared, round(2.0::DOUBLE * shared / (na + nb), 6) AS score FROM s JOIN na USING (name) JOIN nb USING (id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 5""")
def trigram_shortlist(spark, d):
    parts = table(spark, d, "part")
    found = matching.shortlist(parts.select(F.concat_ws(" ", F.reverse("p_type"), "p_name").alias("name")), parts.select(F.col("p_name").alias("id"), F.col("p_name").alias("label")))
    return found.withColumns({"rank": F.col("rank").cast("long"), "shared": F.col("shared").cast("long")})


READS = f"""{LNS}, c0 AS (SELECT l_orderkey AS page_id, p_name, cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cents) AS ord FROM l JOIN part ON p_partkey = l_partkey),
cells AS (SELECT *, (page_id * 100 + ord) % 13 AS k FROM c0),
names AS (SELECT page_id, p_name, count(*) > 1 AS twice, count(*) FILTER (k NOT IN (0, 3)) > 1 AS twice_b FROM cells GROUP BY ALL)"""


_CELL = """[big || ',' || part, whole || ',' || part || ' !', '<' || whole || ',' || part, 'negativní', '  ' || whole || '.' || part || ' ', replace(big, ' ', '.') || ',' || part, '↑ ' || whole, '> ' || whole || ',' || part][(page_id * 100 + ord) % 8 + 1]"""
_PRINTS = """w AS (SELECT *, cents // 100 AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part, CASE WHEN cents >= 100000 THEN cents // 100000 || ' ' || lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0') ELSE CAST(cents // 100 AS VARCHAR) END AS big FROM cells)"""


@query(f"""{READS}, {_PRINTS}, pages AS (SELECT page_id, count(*) FILTER (k <> 0) > 0 AS complete FROM cells GROUP BY 1),
a AS (SELECT page_id, p_name || CASE WHEN twice THEN '#' || ord ELSE '' END AS key, p_name AS raw_name, {_CELL} AS value_raw, CASE WHEN k IN (0, 3) THEN 1 ELSE 2 END AS readers,
  CASE WHEN k = 1 THEN 'values differ' WHEN NOT complete THEN 'a reading failed' WHEN k IN (0, 3) THEN 'seen by one reading' WHEN k = 4 THEN 'units differ' WHEN k = 6 THEN 'ranges differ' END AS disagreement FROM w JOIN names USING (page_id, p_name) JOIN pages USING (page_id)),
b AS (SELECT page_id, 'xx' || p_name || CASE WHEN count(*) OVER (PARTITION BY page_id, p_name) > 1 THEN '#' || ord ELSE '' END AS key, 'XX' || p_name AS raw_name, {_CELL} AS value_raw, 1 AS readers, 'seen by one reading' AS disagreement FROM w WHERE k = 3)
SELECT *, 'mmol/l' AS unit_raw, '1 - 5' AS ref_range_raw, TRUE AS escalated FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def reconcile_reads(spark, d):
    return reading.reconcile(c.reads(spark, d), expected=2)


@query(f"""{READS}, pages AS (SELECT page_id, count(*) FILTER (k <> 0) > 0 AS complete FROM cells GROUP BY 1),
a AS (SELECT page_id, p_name || CASE WHEN twice THEN '#' || ord ELSE '' END AS key, CASE WHEN k IN (0, 3) THEN 1 ELSE 2 END AS readers, CASE WHEN k = 1 THEN 'values differ' WHEN NOT complete THEN 'a reading failed' WHEN k IN (0, 3) THEN 'seen by one reading' WHEN k = 4 THEN 'units differ' WHEN k = 6 THEN 'ranges differ' END AS disagreement
  FROM cells JOIN names USING (page_id, p_name) JOIN pages USING (page_id)),
b AS (SELECT page_id, 'xx' || p_name || CASE WHEN count(*) OVER (PARTITION BY page_id, p_name) > 1 THEN '#' || ord ELSE '' END AS key, 1 AS readers, 'seen by one reading' AS disagreement FROM cells WHERE k = 3)
SELECT *, TRUE AS escalated FROM a UNION ALL SELECT *, TRUE FROM b""")
def reconcile_verdicts(spark, d):
    return reading.reconcile(c.reads(spark, d), expected=2).select("page_id", "key", F.col("readers").cast("int"), "disagreement", "escalated")


@query(f"""{READS}, x AS (SELECT *, row_number() OVER (PARTITION BY page_id, p_name ORDER BY ord) AS nth FROM cells JOIN names USING (page_id, p_name))
SELECT page_id, p_name || CASE WHEN twice THEN '#' || ord ELSE '' END AS kept, 'xx' || p_name || CASE WHEN count(*) OVER (PARTITION BY page_id, p_name, k = 3) > 1 THEN '#' || ord ELSE '' END AS merged, 'row' AS by FROM x WHERE k = 3""")
def orphan_pairs(spark, d):
    return reading.orphan_pairs(c.reads(spark, d))


@query(f"{PTS} SELECT event_id, CASE WHEN value > 20 + 18 * 100 OR value < 0 THEN 'impossible' WHEN (value > 20 OR value < 2) AND (value * 10 BETWEEN 2 AND 20 OR value * 0.1 BETWEEN 2 AND 20) THEN 'suspect-decimal' END AS doubt FROM p")
def implausible_values(spark, d):
    return c.points(spark, d).select("event_id", numbers.implausible(F.col("value"), F.lit(2.0), F.lit(20.0)).alias("doubt"))


_REVIEW = """event_id % 41 = 0 AS dated, event_id % 17 = 0 AS confirmed, event_id % 3 = 0 AS escalated, event_id % 7 = 0 AS differs, event_id % 21 = 0 AS same_number, event_id % 11 = 0 AS unsure, event_id % 2 = 0 AS has_curated"""


@query(f"""{PTS}, r AS (SELECT *, {_REVIEW} FROM p),
o AS (SELECT *, CASE WHEN value BETWEEN {LOW} AND {HIGH} THEN NULL WHEN has_curated THEN CASE WHEN value > 20 + 1800 THEN 'impossible' WHEN (value > 20 OR value < 2) AND (value * 10 BETWEEN 2 AND 20 OR value * 0.1 BETWEEN 2 AND 20) THEN 'suspect' END
  ELSE CASE WHEN value > {HIGH} + {HIGH - LOW} * 100 THEN 'impossible' WHEN (value > {HIGH} OR value < {LOW}) AND (value * 10 BETWEEN {LOW} AND {HIGH} OR value * 0.1 BETWEEN {LOW} AND {HIGH}) THEN 'suspect' END END AS odd FROM r),
s AS (SELECT event_id, CASE WHEN dated THEN 'unconfirmed date' WHEN confirmed THEN 'ok ' WHEN odd = 'suspect' AND escalated AND NOT differs THEN 'unconfirmed decimal' WHEN odd = 'suspect' THEN 'withheld decimal' WHEN odd = 'impossible' THEN 'withheld impossible'
  WHEN differs AND NOT same_number THEN 'unconfirmed disagreement' WHEN unsure THEN 'unconfirmed confidence' ELSE 'ok ' END AS r FROM o)
SELECT event_id, split_part(r, ' ', 1) AS level, split_part(r, ' ', 2) AS reason FROM s""")
def review_levels(spark, d):
    rows = c.points(spark, d).selectExpr("*", *_REVIEW.split(", "))
    none = F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "date_doubt": F.when(F.col("dated"), "future"), "curated_low": F.when(F.col("has_curated"), 2.0), "curated_high": F.when(F.col("has_curated"), 20.0), "extracted_by": F.lit("reader"),
            "printed_on_page": F.lit(False), "disagreement": F.when(F.col("differs"), "values differ").otherwise(none), "confidence": F.when(F.col("unsure"), "low").otherwise("high"),
        }
    )
    return reading.review(rows).select("event_id", "level", "reason")


@query(f"""{LNS}, o AS (SELECT o_custkey AS patient_id, date_trunc('month', o_orderdate)::DATE AS day, o_orderkey AS report, l_linenumber AS key, max(floor(l_quantity / 10)) AS v FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
z AS (SELECT report, count(*) AS n FROM o GROUP BY 1),
b AS (SELECT x.patient_id, x.day, x.report AS a, y.report AS b, count(*) AS shared, count(*) FILTER (x.v IS NOT DISTINCT FROM y.v) AS equal FROM o x JOIN o y ON x.patient_id = y.patient_id AND x.day = y.day AND x.key = y.key AND x.report < y.report GROUP BY ALL)
SELECT b.*, CASE WHEN equal >= shared * 0.9 THEN 'duplicate' ELSE 'repeat' END AS verdict FROM b JOIN z za ON za.report = a JOIN z zb ON zb.report = b.b WHERE shared >= greatest(1, least(za.n, zb.n) / 2.0)""")
def same_day_check(spark, d):
    rows = c.lines(spark, d).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("patient_id"), F.trunc("o_orderdate", "month").alias("day"), F.col("o_orderkey").alias("report"), F.col("l_linenumber").alias("key"), F.floor(F.col("l_quantity") / 10).alias("v"))
    return reading.same_day(rows, "patient_id", "report", "day", "key", "v")


_FOLDED = "translate(lower(text), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')"


@query(f"""WITH m AS (SELECT doc_id, text, strpos({_FOLDED}, 'elleen') AS pos FROM documents), t AS (SELECT * FROM m WHERE pos > 0 ORDER BY doc_id DESC LIMIT 10)
SELECT doc_id, CAST(pos AS INT) AS "at", CASE WHEN pos > 241 THEN '…' ELSE '' END || substr(text, greatest(1, pos - 240), least(length(text) + 1, pos + 246) - greatest(1, pos - 240)) || CASE WHEN pos + 246 <= length(text) THEN '…' ELSE '' END AS excerpt FROM t""")
def document_search(spark, d):
    return documents.search(table(spark, d, "documents"), "Élleèn")


@query(r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, [trim(x) FOR x IN regexp_split_to_array(coalesce(text, ''), '\n+')] AS parts FROM documents)
SELECT doc_id, substr(coalesce(list_filter(parts, lambda x: length(x) >= 80 AND len(regexp_extract_all(x, '\p{L}')) * 2 >= length(x))[1], trim(text)), 1, 240) AS excerpt FROM p""")
def document_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", documents.substantive(F.col("text")).alias("excerpt"))


def _redact_sql() -> str:
    text, cols = "coalesce(text, '')", []
    for kind, pattern in documents.IDENTITY.items():
        cols.append(f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INT) AS n_{kind}")
        text = f"regexp_replace({text}, '{pattern}', '[{kind}]', 'g')"
    left = " + ".join(f"len(regexp_extract_all(redacted, '{p}'))" for p in documents.IDENTITY.values())
    return f"SELECT *, CAST({left} AS INT) AS surviving FROM (SELECT doc_id, {text} AS redacted, {', '.join(cols)} FROM documents)"


@query(_redact_sql())
def redact_text(spark, d):
    return documents.redacted(table(spark, d, "documents"))


@query("""WITH k AS (SELECT l_orderkey AS report_id, l_partkey % 50 AS source, min(l_linenumber) AS seen, count(*) AS uses FROM lineitem GROUP BY ALL)
SELECT report_id, source, uses, row_number() OVER (PARTITION BY report_id ORDER BY seen, source) AS number FROM k""")
def citation_numbers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), (F.col("l_partkey") % 50).alias("source"), "l_linenumber")
    return documents.citation_numbers(rows, "report_id", "source", ["l_linenumber"])


@query("""SELECT user_id % 8 AS shard, event_type AS capability, date_trunc('month', ts)::DATE AS month, round(sum(value), 6) AS usd, count(*) AS n,
  CASE WHEN round(sum(value), 6) >= 14000 THEN 'stop' WHEN round(sum(value), 6) >= 11200 THEN 'warn' ELSE 'ok' END AS state FROM events GROUP BY ALL""")
def spend_ledger(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 8).alias("shard"), F.col("event_type").alias("capability"), F.trunc("ts", "month").alias("month"), "value")
    return ledger.spend(rows, ["shard", "capability", "month"], "value", (11200.0, 14000.0))


@query("""WITH p(model, since, i, o) AS (VALUES ('click', TIMESTAMP '2024-01-01', 2.0::DOUBLE, 8.0::DOUBLE), ('click', TIMESTAMP '2024-01-15', 1.0, 4.0), ('view', TIMESTAMP '2024-01-10', 0.5, 1.5)),
u AS (SELECT event_id, event_type, ts, value * 100 AS tin, value * 10 AS tout, event_id % 5 * 10 AS cached, event_id % 3 * 10 AS written FROM events)
SELECT event_type, count(*) AS calls, count(i) AS priced, round(sum((tin * i + cached * i * 0.1 + written * i * 1.25 + tout * o) / 1e6), 6) AS usd
FROM u ASOF LEFT JOIN p ON event_type = model AND ts >= since GROUP BY 1""")
def price_usage(spark, d):
    prices = spark.createDataFrame([("click", "2024-01-01", 2.0, 8.0), ("click", "2024-01-15", 1.0, 4.0), ("view", "2024-01-10", 0.5, 1.5)], "event_type string, since string, usd_in double, usd_out double").withColumn("since", F.to_timestamp("since"))
    usage = table(spark, d, "events").select("event_id", "event_type", "ts", (F.col("value") * 100).alias("tokens_in"), (F.col("value") * 10).alias("tokens_out"), (F.col("event_id") % 5 * 10).alias("cached"), (F.col("event_id") % 3 * 10).alias("written"))
    return ledger.priced(usage, prices, "event_type", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count("usd").alias("priced"), F.round(F.sum("usd"), 6).alias("usd"))


@query("""WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_hour, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_day FROM t)
SELECT *, n_hour > 2 OR n_day > 5 AS limited FROM w""")
def rate_limit_hits(spark, d):
    return ledger.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", {"hour": (3600, 2), "day": (86400, 5)}).drop("ts")


@query(f"""{PTS}, s AS (SELECT patient_id, series, event_id, flag AS state, lag(flag) OVER (PARTITION BY patient_id, series ORDER BY ts, event_id) AS before FROM p) SELECT * FROM s WHERE state IS DISTINCT FROM before""")
def state_transitions(spark, d):
    return ledger.transitions(c.points(spark, d), KEYS, ORDER, F.col("flag")).select(*KEYS, "event_id", "state", "before")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY OR event_type = 'purchase'")
def retention_prune(spark, d):
    return ledger.retained(table(spark, d, "events"), "ts", F.lit("2024-01-30").cast("timestamp"), 14, F.col("event_type") == "purchase").select("event_id", "ts")


@query(f"""{LNS}, t AS (SELECT l_orderkey, l_partkey % 5 AS key, lo, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey, lo) AS nth FROM l),
a AS (SELECT l_orderkey, l_partkey % 5 AS key, CASE WHEN id % 9 = 0 THEN lo + 1 ELSE lo END AS lo, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey, lo) AS nth FROM l WHERE id % 11 <> 0)
SELECT l_orderkey, key, nth, CASE WHEN a.lo IS NULL THEN 'missing' WHEN t.lo IS NULL THEN 'extra' WHEN a.lo = t.lo THEN 'matched' ELSE 'mismatch' END AS verdict FROM t FULL JOIN a USING (l_orderkey, key, nth)""")
def score_truth(spark, d):
    truth = c.lines(spark, d).select("l_orderkey", (F.col("l_partkey") % 5).alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "lo").alias("ord"), F.col("lo").alias("value"), "id")
    arm = truth.where(F.col("id") % 11 != 0).withColumn("value", F.when(F.col("id") % 9 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return quality.scored(truth, arm, ["l_orderkey", "key"]).withColumn("nth", F.col("nth").cast("long"))


@query("""SELECT count(*) FILTER (t AND f) AS caught, count(*) FILTER (t AND NOT f) AS missed, count(*) FILTER (NOT t AND f) AS false_alarms, count(*) FILTER (NOT t AND NOT f) AS clean
FROM (SELECT quality = 0 AS t, length(text) - length(replace(text, '#', '')) > 3 AS f FROM labels JOIN documents USING (doc_id))""")
def score_pairs(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return quality.confusion(rows.select((F.col("quality") == 0).alias("t"), (F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit(""))) > 3).alias("f")), "t", "f")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49 AND l_returnflag = 'R')")
def semi_exists(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_integrity(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return quality.unresolved(table(spark, d, "events").select("event_id", "user_id"), "user_id", known, "o_custkey")


@query("""WITH RECURSIVE w AS (SELECT user_id AS key, event_id AS seq, event_type AS owner, event_id % 4 AS expected_rev, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT key, rn, 1::BIGINT AS rev, owner, value, 0::BIGINT AS conflicts FROM w WHERE rn = 1
  UNION ALL SELECT f.key, w.rn, CASE WHEN w.owner = f.owner AND w.expected_rev = f.rev THEN f.rev + 1 ELSE f.rev END, f.owner, CASE WHEN w.owner = f.owner AND w.expected_rev = f.rev THEN w.value ELSE f.value END,
    CASE WHEN w.owner = f.owner AND w.expected_rev = f.rev THEN f.conflicts ELSE f.conflicts + 1 END FROM f JOIN w ON w.key = f.key AND w.rn = f.rn + 1)
SELECT key, arg_max(rev, rn) AS rev, arg_max(owner, rn) AS owner, arg_max(value, rn) AS value, arg_max(conflicts, rn) AS conflicts FROM f GROUP BY key""")
def revision_replay(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("owner"), (F.col("event_id") % 4).alias("expected_rev"), "value")
    return ledger.replay(rows, "key", "key long, rev long, owner string, value double, conflicts long")


@query("""WITH o AS (SELECT user_id, arg_min(event_type, event_id) AS owner FROM events GROUP BY 1)
SELECT e.user_id, owner, arg_max(value, event_id) AS value, count(*) AS writes FROM events e JOIN o ON o.user_id = e.user_id AND owner = event_type GROUP BY ALL""")
def first_writer(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("owner"), "event_id", "value")
    return ledger.first_writer(rows, ["user_id"], "owner", ["event_id"])


@query("""SELECT o_orderkey, l_linenumber, '"' || o_orderkey || '";"' || strftime(o_orderdate, '%Y-%m-%d') || '";"' || replace(p_name || '"x"', '"', '""') || '";"' || l_returnflag || '"' AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""")
def csv_export_rows(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select("o_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat("p_name", F.lit('"x"')).alias("name"), "l_returnflag")
    return csv_lines(rows, ["o_orderkey", "day", "name", "l_returnflag"], ["o_orderkey", "l_linenumber"])


@query("SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 12")
def conversation_tail(spark, d):
    return documents.tail(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn").withColumn("age", F.col("age").cast("long"))


@query(f"""{PTS}, u AS (SELECT *, CASE WHEN series IN ('click', 'view') THEN 'count' ELSE 'usd' END AS unit FROM p WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND value IS NOT NULL),
k AS (SELECT patient_id, series, unit, count(*) AS n FROM u GROUP BY ALL)
SELECT patient_id, unit, string_agg(series, ',' ORDER BY series) FILTER (n >= 2) AS series, sum(CASE WHEN n >= 2 THEN n ELSE 0 END)::BIGINT AS points, CASE WHEN count(*) FILTER (n >= 2) = 0 THEN 'refused: fewer than two points' ELSE 'ok' END AS status FROM k GROUP BY ALL""")
def charts_by_unit(spark, d):
    rows = c.points(spark, d).where("date between date'2024-01-05' and date'2024-01-25' and value is not null").withColumn("unit", F.when(F.col("series").isin("click", "view"), "count").otherwise("usd"))
    counts = rows.groupBy("patient_id", "series", "unit").agg(F.count(F.lit(1)).alias("n"))
    good = F.col("n") >= 2
    names_ = F.array_join(F.array_sort(F.collect_list(F.when(good, F.col("series")))), ",")
    out = counts.groupBy("patient_id", "unit").agg(F.when(F.count_if(good) > 0, names_).alias("series"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("points"), F.when(F.count_if(good) == 0, "refused: fewer than two points").otherwise("ok").alias("status"))
    return out


@query("""SELECT o_orderkey, floor(datediff('month', DATE '1990-01-31', o_orderdate::DATE) / 12.0)::INT - CASE WHEN (month(o_orderdate) = 1 AND day(o_orderdate) < 31) THEN 1 ELSE 0 END AS age,
  (year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 - CASE WHEN day(o_orderdate) < 31 THEN 1 ELSE 0 END AS months FROM orders""")
def ages(spark, d):
    day, born = F.to_date("o_orderdate"), F.lit("1990-01-31").cast("date")
    return table(spark, d, "orders").select("o_orderkey", dates.age_on(born, day).alias("age"), dates.whole_months(born, day).cast("long").alias("months"))


@query(f"""{PTS}, s AS (SELECT patient_id, series, event_id AS id, flag AS state, lag(flag) OVER (PARTITION BY patient_id, series ORDER BY ts, event_id) AS before FROM p) SELECT * FROM s WHERE state IS DISTINCT FROM before""")
def stream_transitions(spark, d):
    """state_transitions as a stream over the events files, read to their end."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    flag = numbers.compute_flag(F.col("value"), F.lit(LOW), F.lit(HIGH))
    rows = rows.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), flag.alias("state"))
    return stateful.run_to_end(stateful.changes(rows, KEYS, "patient_id long, series string"), shared_folder(spark, "transitions"))


_PRINTED = "replace(CASE WHEN x IS NULL THEN '—' ELSE regexp_replace(regexp_replace(CASE WHEN abs(x) >= 100 THEN printf('%.1f', x) WHEN abs(x) >= 1 THEN printf('%.2f', x) ELSE printf('%.3f', x) END, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END, '.', ',')"


@query(f"WITH e AS (SELECT event_id, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) * 2 AS x FROM events) SELECT event_id, {_PRINTED} AS printed FROM e")
def printed_numbers(spark, d):
    x = F.round(F.col("value") * 100, 0).cast("long").cast("double") * 2
    return table(spark, d, "events").select("event_id", printing.printed_number(x).alias("printed"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, p_name || ' ' || l_returnflag AS raw_name, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN replace(p_name, ' ', '_') END AS canonical_id, 'u' || l_suppkey % 4 AS unit_raw, l_quantity AS value, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_partkey % 5 = 1 THEN l_quantity - 1 END AS ref_low, CASE WHEN l_partkey % 5 = 1 THEN l_quantity + 1 END AS ref_high, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS o FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT raw_name, arg_min(unit_raw, o) AS unit_raw, arg_min(ref_low, o) FILTER (ref_low IS NOT NULL) AS low, arg_min(ref_high, o) FILTER (ref_low IS NOT NULL) AS high, CAST(NULL AS VARCHAR) AS material, count(*) AS n, count(DISTINCT date) AS n_dates, count(value) AS n_values, round(avg(value), 6) AS mean
FROM r WHERE canonical_id IS NULL GROUP BY raw_name""")
def find_unmapped(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    stated = F.col("l_partkey") % 5 == 1
    rows = rows.select(
        F.col("l_orderkey").alias("report_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("canonical_id"),
        F.concat_ws(" ", "p_name", "l_returnflag").alias("raw_name"), F.concat(F.lit("u"), (F.col("l_suppkey") % 4).cast("string")).alias("unit_raw"), F.col("l_quantity").alias("value"), F.when(stated, F.col("l_quantity") - 1).alias("ref_low"), F.when(stated, F.col("l_quantity") + 1).alias("ref_high"), F.lit(None).cast("string").alias("material"),
    )
    return mapping.unmapped(rows).withColumn("mean", F.round("mean", 6))


@query("""WITH r AS (SELECT 'lab' || l_suppkey % 4 AS lab, CASE WHEN l_partkey % 7 = 0 THEN 'zzz_' ELSE 'S_' END || p_name AS raw_name, CASE WHEN l_partkey % 3 = 0 THEN 'kg' WHEN l_partkey % 3 = 1 THEN 'mg' ELSE 'G' END AS unit_raw, replace(p_name, ' ', '_') AS id, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT lab, raw_name, unit_raw, min(id) AS canonical_id, min(CASE WHEN l_partkey % 7 = 0 THEN 'material' ELSE 'unit' END) AS why, count(*) AS n FROM r WHERE (l_partkey % 7 = 0 OR l_partkey % 3 = 0) AND lab <> 'lab2' GROUP BY lab, raw_name, unit_raw""")
def weak_matches(spark, d):
    parts = table(spark, d, "part")
    rows = table(spark, d, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(
        F.concat(F.lit("lab"), (F.col("l_suppkey") % 4).cast("string")).alias("lab"), F.concat(F.when(F.col("l_partkey") % 7 == 0, "zzz_").otherwise("S_"), "p_name").alias("raw_name"),
        F.when(F.col("l_partkey") % 3 == 0, "kg").when(F.col("l_partkey") % 3 == 1, "mg").otherwise("G").alias("unit_raw"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_id"),
    )
    entries = c.catalogue(spark, d).withColumn("other_units", F.array(F.lit("mg")))
    aliases = parts.select(F.lit("LAB2").alias("alias_lab"), F.explode(F.array("p_name", F.concat(F.lit("zzz_"), "p_name"))).alias("alias_name"), F.lit(None).cast("string").alias("alias_unit")).distinct()
    return mapping.weak_matches(rows, entries, aliases)


@query(f"""WITH s AS ({ORACLE['suggest_mappings']}), c AS (SELECT *, NOT coalesce(unit_match, TRUE) OR NOT coalesce(range_match, TRUE) OR NOT coalesce(value_ok, TRUE) OR NOT coalesce(material_match, TRUE) AS against,
  coalesce(unit_match, FALSE) OR coalesce(range_match, FALSE) OR coalesce(value_ok, FALSE) OR coalesce(material_match, FALSE) AS fit FROM s)
SELECT name, canonical_id, rank, CASE WHEN against OR name_sim < 0.45 THEN 'contradicted' WHEN fit THEN 'recommended' ELSE 'possible' END AS verdict, NOT against AND coalesce(unit_match, FALSE) AS may_apply FROM c""")
def mapping_verdicts(spark, d):
    rows = suggest_mappings(spark, d)
    unit, span, value, material = F.col("unit_match"), F.col("range_match"), F.col("value_ok"), F.col("material_match")
    return rows.select("name", "canonical_id", "rank", mapping.verdict(F.col("name_sim") < 0.45, unit, span, value, material).alias("verdict"), mapping.may_apply(unit, span, value, material).alias("may_apply"))


@query("""WITH a AS (SELECT o_custkey AS patient_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, lower(split_part(o_orderpriority, '-', 2)) AS kind, o_orderkey AS id FROM orders),
r AS (SELECT *, CASE kind WHEN 'urgent' THEN 1 WHEN 'high' THEN 2 ELSE 0 END AS p FROM a)
SELECT patient_id, date, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, count(*) AS n, arg_min(id, (p, id)) FILTER (p > 0) AS note_id, row_number() OVER (PARTITION BY patient_id ORDER BY date) AS number FROM r GROUP BY patient_id, date""")
def visit_spine(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.trunc("o_orderdate", "month").alias("date"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("kind"), F.col("o_orderkey").alias("id"))
    return patients.visits(rows, "patient_id", ["urgent", "high"])


@query(f"""{PTS}, e AS (SELECT *, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) * 2 AS x, (row_number() OVER (PARTITION BY patient_id, series ORDER BY ts, event_id) - 1) // 500 AS part FROM p WHERE value IS NOT NULL)
SELECT patient_id, series, part, series || ' | 5–110 | ' || string_agg(strftime(date, '%Y-%m-%d') || ': ' || {_PRINTED} || ' (' || flag || ')', '; ' ORDER BY ts, event_id) AS line FROM e GROUP BY patient_id, series, part""")
def context_table(spark, d):
    rows = c.points(spark, d).withColumn("value", F.round(F.col("value") * 100, 0).cast("long").cast("double") * 2)
    return patients.context_lines(rows, "patient_id", "series", ORDER)


@query(f"""{LNS}, r AS (SELECT id, l_partkey, p_name, l_partkey % 4 AS k FROM l JOIN part ON p_partkey = l_partkey)
SELECT id, CASE WHEN k = 0 THEN replace(p_name, ' ', '_') WHEN k = 1 AND p_name LIKE '%ring' THEN replace(p_name, ' ', '_') WHEN k = 1 THEN 'old' ELSE 'kept' END AS canonical_id, k = 0 OR (k = 1 AND p_name LIKE '%ring') AS changed FROM r""")
def rematch_rows(spark, d):
    rows = c.lines(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("l_partkey") % 4
    rows = rows.select("id", F.concat(F.lit("S_"), "p_name").alias("raw_name"), F.when(k == 1, "old").when(k > 1, "kept").alias("canonical_id"))
    entries = c.catalogue(spark, d)
    splits = entries.where(F.endswith("canonical_id", F.lit("_ring"))).select("canonical_id", F.lit("old").alias("split_from"))
    return mapping.rematched(rows, matching.name_index(entries), splits).select("id", "canonical_id", "changed")


@query(f"""{LNS} SELECT l_orderkey AS sheet, least(count(DISTINCT CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END), 6) * 1.5 + least(count(*) FILTER (id % 3 < 2), 10) * 0.5 + least(1 + count(*) FILTER (id % 5 = 0), 4) + least(count(*), 20) * 0.25::DOUBLE AS score FROM l GROUP BY 1""")
def sheet_scores(spark, d):
    """Each order as a printed sheet: a heading, then rows of a name, a value with decimals, a unit, an interval, here and there
    another heading."""
    k = F.col("id")
    unit = c.pick(k, ["mmol / l", "j/24 h", "× 10 9/l", "µkat/kg", "fl", "stejné"])
    span = c.pick(k, [F.concat("lo", F.lit(" — "), "hi"), F.concat(F.lit("≤ "), "hi"), F.lit("beze změny")])
    row = F.concat_ws("  ", F.lit("Látka"), F.concat("lo", F.lit(",5")), unit, span, F.when(k % 5 == 0, "Ref. meze"))
    rows = c.lines(spark, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    return rows.select(F.col("l_orderkey").alias("sheet"), printing.sheet_score(F.concat(F.lit("Vyšetření\n\n"), "rows")).alias("score"))


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS key, ('lab' || l_suppkey % 3) AS target, CASE WHEN l_partkey % 4 = 0 THEN 'person' ELSE 'model' END AS source, CASE WHEN l_linenumber % 3 = 0 THEN 'ann' WHEN l_linenumber % 3 = 1 THEN 'bob' ELSE 'demo' END AS taught_by,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem),
f AS (SELECT key, rn, target, source, taught_by FROM w WHERE rn = 1
  UNION ALL SELECT w.key, w.rn, CASE WHEN ok THEN w.target ELSE f.target END, CASE WHEN ok THEN w.source ELSE f.source END, CASE WHEN ok THEN w.taught_by ELSE f.taught_by END FROM f JOIN w ON w.key = f.key AND w.rn = f.rn + 1,
    LATERAL (SELECT (f.taught_by = w.taught_by AND NOT (f.source = 'person' AND w.source = 'model')) OR f.taught_by = 'demo' OR (f.source = 'model' AND w.source = 'person') AS ok))
SELECT key, arg_max(target, rn) AS target, arg_max(source, rn) AS source, arg_max(taught_by, rn) AS taught_by FROM f GROUP BY key""")
def alias_precedence(spark, d):
    rows = table(spark, d, "lineitem")
    who = F.when(F.col("l_linenumber") % 3 == 0, "ann").when(F.col("l_linenumber") % 3 == 1, "bob").otherwise("demo")
    rows = rows.select(
        F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.concat(F.lit("lab"), (F.col("l_suppkey") % 3).cast("string")).alias("target"),
        F.when(F.col("l_partkey") % 4 == 0, "person").otherwise("model").alias("source"), who.alias("taught_by"),
    )
    return ledger.alias_writes(rows, "key", "key long, target string, source string, taught_by string")


@query()
def page_row_clusters(spark, d):
    """Line items as positioned words of an order's page."""
    rows = c.lines(spark, d)
    word = lambda text, x: F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x0"))
    words = rows.select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 20.0 + F.col("l_partkey") % 3).alias("y0"), F.inline(F.array(word(F.col("l_partkey"), 10), word(F.col("lo"), 200), word(F.col("hi"), 300))))
    words = words.select("page_id", "text", "x0", "y0", (F.col("x0") + 40).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return rows_of.page_rows(words).withColumn("cells", F.array_join("cells", "|"))


@query(f"""{PTS}, g AS (SELECT patient_id, count(DISTINCT date) AS draws, max(date) AS last_draw FROM p GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS age, lead(flag) OVER w AS before FROM p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY patient_id, series ORDER BY ts DESC, event_id DESC)),
l AS (SELECT r.*, g.draws, g.last_draw, date = last_draw AS now, flag IN ('high', 'low') AS out, coalesce(before IN ('high', 'low'), FALSE) AS was,
  round(CASE WHEN value > ref_high THEN (value - ref_high) / ref_high WHEN value < ref_low THEN (ref_low - value) / ref_low END, 6) AS beyond FROM r JOIN g USING (patient_id) WHERE age = 1)
SELECT patient_id, draws, last_draw, count(*) AS n_series, count(*) FILTER (now AND out) AS out_now, count(*) FILTER (now AND out AND NOT was) AS newly_out, count(*) FILTER (now AND NOT out AND was) AS returned,
  arg_max(series, (beyond, series)) FILTER (now AND out) AS furthest FROM l GROUP BY patient_id, draws, last_draw""")
def patient_overview(spark, d):
    return series.overview(c.points(spark, d), ["patient_id"], "series", ORDER)


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
s AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS strike FROM e) SELECT *, strike % 3 = 0 AS kept FROM s""")
def empty_read_strikes(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return ledger.strikes(rows, "user_id", "ts", days=7).drop("ts")
