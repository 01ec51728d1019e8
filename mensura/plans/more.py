"""Further registered queries: typed rows, doubts, codes, charts, citations, redaction. Printed cells are made from columns of the
tables by rule, so that the SQL says what each must give without repeating a pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, numbers, printing
from ..operators import charts, citations, codes, documents, normal, prose
from ..operators.series import computed_series as computed
from ..sources.tables import table
from . import carriers as c
from .carriers import LINES_SQL, POINTS_SQL
from .queries import KEYS, ORACLE, ORDER, _VALUE, change_summary, query

PTS = f"WITH p AS ({POINTS_SQL})"
LNS = f"WITH l AS ({LINES_SQL})"
_LOW = "CASE WHEN id % 10 IN (0, 1, 4, 5, 7) THEN CAST(lo AS DOUBLE) END"
_HIGH = "CASE WHEN id % 10 IN (0, 1, 2, 3, 5, 7) THEN hi + 0.5::DOUBLE END"
_TEXT = "CASE id % 10 WHEN 6 THEN lo || ' - ' || hi || ',5 let' WHEN 8 THEN 'M: ' || lo || '-' || hi || ',5 Ž: 1-2' WHEN 9 THEN 'negativní' END"


def _rows(spark, d):
    """Printed rows; each eleventh value has too many commas, each seventh row is doubted by its reader, each ninth disagreed on."""
    rows = c.range_cells(c.value_cells(c.lines(spark, d)))
    odd = F.when(F.col("id") % 11 == 0, F.concat(F.col("lo").cast("string"), F.lit(",1,2"))).otherwise(F.col("value_raw"))
    return rows.withColumns(
        {
            "value_raw": odd, "unit_raw": c.pick(F.col("id"), [a for a, _ in c.UNITS]), "ref_range_raw": F.col("range_raw"), "confidence": F.when(F.col("id") % 7 == 0, "low").otherwise("high"),
            "disagreement": F.when(F.col("id") % 9 == 0, "value"),
        }
    )


_ROWS = f"""{LNS}, v AS (SELECT *, CASE WHEN id % 11 <> 0 THEN {_VALUE} END AS value, {_LOW} AS low, {_HIGH} AS high FROM l),
n AS (SELECT id, value, [{', '.join(repr(b) for _, b in c.UNITS)}][id % {len(c.UNITS)} + 1] AS unit, low AS ref_range_low, high AS ref_range_high, {_TEXT} AS ref_range_text,
  CASE WHEN value IS NULL THEN CASE WHEN id % 11 <> 0 AND id % 8 = 7 AND cents / 100.0 >= high THEN 'high' ELSE 'unknown' END
    WHEN low IS NULL AND high IS NULL THEN 'unknown' WHEN value < low THEN 'low' WHEN value > high THEN 'high' ELSE 'normal' END AS flag,
  CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 'low' ELSE 'high' END AS confidence,
  id % 7 = 0 OR id % 9 = 0 OR id % 11 = 0 OR id % 8 IN (2, 7) AS flagged FROM v)"""


@query(f"{_ROWS} SELECT * EXCLUDE (flagged) FROM n")
def normalised_rows(spark, d):
    return normal.normalised(_rows(spark, d)).select("id", "value", "unit", "ref_range_low", "ref_range_high", "ref_range_text", "flag", "confidence")


@query(f"{_ROWS} SELECT id, flagged FROM n")
def flagged_rows(spark, d):
    return normal.normalised(_rows(spark, d)).select("id", normal.is_flagged().alias("flagged"))


_DOUBT = """CASE WHEN event_id % 17 = 0 THEN 'impossible' END AS suspect, CASE WHEN event_id % 5 = 0 THEN 'date' END AS unconfirmed"""


def _doubted(spark, d):
    """Readings, some held back, some plotted with a doubt, each sixth a bound without a number."""
    rows = c.points(spark, d)
    return rows.withColumns(
        {
            "suspect": F.when(F.col("event_id") % 17 == 0, "impossible"), "unconfirmed": F.when(F.col("event_id") % 5 == 0, "date"),
            "value": F.when(F.col("event_id") % 6 != 0, F.col("value")), "flag": F.when(F.col("event_id") % 12 == 0, "high").when(F.col("event_id") % 6 == 0, "unknown").otherwise(F.col("flag")),
        }
    )


_DOUBTED = f"""{PTS}, q AS (SELECT * REPLACE (CASE WHEN event_id % 6 <> 0 THEN value END AS value, CASE WHEN event_id % 12 = 0 THEN 'high' WHEN event_id % 6 = 0 THEN 'unknown' ELSE flag END AS flag), {_DOUBT} FROM p)"""


@query(f"""{_DOUBTED} SELECT patient_id, series, count(*) AS n, count(suspect) AS suspects, count(*) FILTER (value IS NOT NULL AND suspect IS NULL AND unconfirmed IS NOT NULL) AS unconfirmed,
  bool_or(suspect IS NOT NULL OR unconfirmed IS NOT NULL) AS has_doubt FROM q GROUP BY patient_id, series""")
def series_doubts(spark, d):
    return normal.doubts(_doubted(spark, d), KEYS)


@query(f"""{_DOUBTED} SELECT event_id, 'suspect' AS kind FROM q WHERE suspect IS NOT NULL UNION ALL SELECT event_id, 'unconfirmed' FROM q WHERE suspect IS NULL AND unconfirmed IS NOT NULL AND value IS NOT NULL""")
def doubted_points(spark, d):
    rows = _doubted(spark, d)
    kind = lambda df, k: df.select("event_id", F.lit(k).alias("kind"))
    return kind(normal.suspects(rows), "suspect").unionByName(kind(normal.unconfirmed(rows), "unconfirmed"))


@query(f"""{_DOUBTED}, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, series ORDER BY ts DESC, event_id DESC) AS age FROM q)
SELECT patient_id, series, event_id, date, flag FROM r WHERE age = 1 AND value IS NULL AND suspect IS NULL AND flag IN ('high', 'low')""")
def latest_censored(spark, d):
    return normal.latest_censored_out(_doubted(spark, d), KEYS, ORDER).select(*KEYS, "event_id", "date", "flag")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT o_orderkey, day, k, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'not a day' WHEN 2 THEN '19' || strftime(day, '%y-%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS report_date FROM r)
SELECT o_orderkey, report_date, CASE WHEN k = 0 THEN NULL WHEN k = 3 THEN 'order' WHEN k = 2 AND try_cast(report_date AS DATE) < DATE '1990-01-01' THEN 'before 1990' END AS report_date_doubt FROM s
WHERE k = 0 OR (k IN (2, 3, 4) AND try_cast(report_date AS DATE) <= DATE '1997-01-02')""")
def reports_for_trends(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, None).when(k == 1, "not a day").when(k == 2, F.concat(F.lit("19"), F.date_format(day, "yy-MM-dd"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("report_date"), F.when(k == 3, "order").alias("date_doubt"))
    return normal.for_trends(rows, F.lit("1997-01-01").cast("date")).drop("date_doubt")


@query(f"""{PTS} SELECT event_id, CASE WHEN patient_id % 3 = 0 THEN NULL ELSE DATE '2024-01-05' END AS first_day, CASE WHEN patient_id % 4 = 0 THEN NULL ELSE DATE '2024-01-20' END AS last_day FROM p
WHERE (patient_id % 3 = 0 OR date >= DATE '2024-01-05') AND (patient_id % 4 = 0 OR date <= DATE '2024-01-20')""")
def points_in_window(spark, d):
    rows = c.points(spark, d).withColumns({"first_day": F.when(F.col("patient_id") % 3 != 0, F.lit("2024-01-05").cast("date")), "last_day": F.when(F.col("patient_id") % 4 != 0, F.lit("2024-01-20").cast("date"))})
    return rows.where(normal.in_window(F.col("date"), F.col("first_day"), F.col("last_day"))).select("event_id", "first_day", "last_day")


_PREFIX = "['s', 'u', NULL, 's,p', 'pk'][l_partkey % 5 + 1]"


@query(f"""{LNS}, n AS (SELECT DISTINCT l_partkey % 5 AS k, p_name || ' ' || l_suppkey AS name FROM (SELECT *, {_VALUE} AS value FROM l) JOIN part ON p_partkey = l_partkey WHERE l_partkey % 5 <> 1 AND value IS NOT NULL)
SELECT k, name FROM n""")
def trendable_names(spark, d):
    rows = c.value_cells(c.lines(spark, d)).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    material = c.pick(F.col("l_partkey"), [F.lit("s"), F.lit("u"), F.lit(None).cast("string"), F.lit("s,p"), F.lit("pk")])
    rows = rows.select((F.col("l_partkey") % 5).alias("k"), F.concat_ws(" ", "p_name", "l_suppkey").alias("name"), material.alias("material"), numbers.parse_value(F.col("value_raw")).alias("value"))
    return normal.trendable(rows, ["k", "name"], "material", "value")


@query(f"""{LNS} SELECT id, CASE id % 3 WHEN 0 THEN lo * 1000.0::DOUBLE WHEN 1 THEN lo::DOUBLE ELSE CASE WHEN id % 2 = 0 THEN lo::DOUBLE END END AS value, CASE id % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'G' ELSE 'mg' END AS unit,
  CASE id % 3 WHEN 0 THEN hi * 1000.0::DOUBLE ELSE hi::DOUBLE END AS ref_high FROM l""")
def exact_conversion(spark, d):
    k = F.col("id") % 3
    rows = c.lines(spark, d).select("id", F.lit("a").alias("canonical_id"), F.when((k == 2) & (F.col("id") % 2 != 0), None).otherwise(F.col("lo").cast("double")).alias("value"), F.when(k == 0, "g").when(k == 1, "G").otherwise("mg").alias("unit"), F.lit(None).cast("double").alias("ref_low"), F.col("hi").cast("double").alias("ref_high"))
    units = spark.createDataFrame([("a", "g", 1000.0, "mg"), ("a", "mg", 1.0, "mg")], "canonical_id string, from_unit string, factor double, canonical_unit string")
    return normal.converted(rows, units).select("id", "value", "unit", "ref_high")


@query(f"""{LNS} SELECT id, CASE id % 4 WHEN 0 THEN '>' || (lo * 2) || 'mg/dl' WHEN 1 THEN replace(CAST(lo + 0.5::DOUBLE AS VARCHAR), '.', ',') WHEN 2 THEN 'negativní' ELSE '<' || lo || ',5' END AS shown FROM l""")
def converted_texts(spark, d):
    k, lo = F.col("id") % 4, F.col("lo").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(">"), lo, F.lit(" mg/dl"))).when(k == 1, lo).when(k == 2, "negativní").otherwise(F.concat(F.lit("<"), lo, F.lit(",5")))
    rows = c.lines(spark, d).select("id", raw.alias("raw"), F.when(k == 1, F.col("lo") + 0.5).alias("value"), F.when(k == 3, None).otherwise(2.0).alias("factor"))
    return rows.select("id", printing.converted_text(F.col("raw"), F.col("value"), F.col("factor")).alias("shown"))


@query("""WITH a AS (SELECT o_custkey AS owner, CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT user_id, CAST(ts AS DATE) FROM events UNION SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT * FROM a""")
def artifact_dates(spark, d):
    orders = table(spark, d, "orders")
    ships = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner")), "l_orderkey").select("owner", F.to_date("l_shipdate").alias("date"))
    return normal.dated_union(orders.select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date")), table(spark, d, "events").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("date")), ships)


@query("""SELECT o_orderstatus AS session, o_orderpriority AS person_name, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'c' || o_custkey END AS person_id, min(o_orderkey) AS first FROM orders GROUP BY ALL""")
def printed_identities(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("session"), F.col("o_orderpriority").alias("person_name"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("person_id"), "o_orderkey")
    return normal.distinct_identities(rows, "session", ["o_orderkey"]).withColumn("first", F.col("first.o_orderkey"))


_INI = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:3])), '')"


@query(f"""{LNS}, n AS (SELECT id, p_name, id % 5 AS form, lower({_INI}) AS ini, lower(p_type) AS t FROM l JOIN part ON p_partkey = l_partkey)
SELECT id, CASE form WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || t || ',' || p_name || ',' || t WHEN 2 THEN ini || ' ' || p_name || ',' || ini || ',' || p_name
  WHEN 3 THEN p_name || ' ' || ini || ',' || ini WHEN 4 THEN '' END AS keys FROM n""")
def name_keys(spark, d):
    rows = c.lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    ini = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.left(w, F.lit(3)))), "")
    say = lambda *x: F.concat(*[v if not isinstance(v, str) or v in ("p_name", "p_type") else F.lit(v) for v in x])
    forms = [say("p_name"), say("p_name", " (", "p_type", ")"), F.concat(ini, F.lit(" – "), F.col("p_name")), F.concat(F.col("p_name"), F.lit(" ["), F.left(ini, F.lit(6)), F.lit("]")), F.lit(" ** ")]
    return rows.select("id", F.array_join(names.name_keys(c.pick(F.col("id"), forms)), ",").alias("keys"))


@query(f"""{LNS} SELECT id, 'unrecognised:lab' || l_suppkey % 4 || '|' || p_name || '|' || CASE id % 3 WHEN 0 THEN 'g/l' WHEN 1 THEN '' ELSE 'mmol' END AS key FROM l JOIN part ON p_partkey = l_partkey""")
def series_keys(spark, d):
    rows = c.lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    unit = F.when(F.col("id") % 3 == 0, " G/L ").when(F.col("id") % 3 == 1, None).otherwise("mmol")
    return rows.select("id", names.series_key(F.concat(F.lit("lab"), F.col("l_suppkey") % 4), F.concat(F.lit("S_"), F.initcap("p_name")), unit).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 's' WHEN p_size % 4 = 2 THEN 's,p' ELSE 'u,s,p' END AS materials,
  array_to_string(list_filter([p_name, 'x ' || p_brand, p_type], lambda x: NOT (x = p_type AND p_size % 2 = 0)), ',') AS merged FROM part""")
def entry_names(spark, d):
    k = F.col("p_size") % 4
    said = lambda p: F.concat(F.lit(p), F.col("p_name"))
    every = F.when(k == 0, F.array(F.col("p_name"), said("xxx_"))).when(k == 1, F.array(said("S_"), F.col("p_name"), said("s_"))).when(k == 2, F.array(said("S_"), said("P_"))).otherwise(F.array(said("U_"), said("S,P-")))
    brand = F.concat(F.lit("x "), F.col("p_brand"))
    merged = names.merged_names(F.array("p_name", brand), F.array(brand, F.col("p_type"), F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "part").select("p_partkey", names.materials_of(every).alias("materials"), F.array_join(merged, ",").alias("merged"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN p_name || ' (a)' ELSE '(S; ' || p_brand || ')' END AS name FROM part""")
def friendly_names(spark, d):
    k = F.col("p_size") % 4
    said = F.when(k == 0, F.concat(F.col("p_name"), F.lit(" (S; látková konc. (celk. [x]) [g/l])"))).when(k == 1, F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))).when(k == 2, F.concat(F.col("p_name"), F.lit(" (a) (b; (c))")))
    return table(spark, d, "part").select("p_partkey", names.friendly_name(said.otherwise(F.concat(F.lit(" (S; "), F.col("p_brand"), F.lit(")")))).alias("name"))


_CODES = """codes AS (SELECT p_name || ':' || m.mat || ':' || m.prop AS id, p_name AS label, m.* FROM (SELECT DISTINCT p_name FROM part),
  (VALUES ('s', 'g/l', 'MCnc', NULL), ('p', 'g/l', 'MCnc', NULL), ('u', 'g/l', 'MCnc', NULL), ('s', NULL, 'NFr', 'vzorec'), ('b', 'mmol/l', 'SCnc', NULL)) m(mat, unit, prop, method))"""


@query(f"""WITH {_CODES}, n AS (SELECT DISTINCT p_size % 3 AS form, p_partkey % 5 AS u, p_name FROM part),
a AS (SELECT CASE form WHEN 0 THEN 'S_' || p_name WHEN 1 THEN p_name || ' (dog)' ELSE 'X_' || p_name END AS name, ['g/l', 'mg / dl', 'mmol/l', '%', NULL][u + 1] AS unit, form, u, p_name FROM n),
s AS (SELECT a.*, c.id, c.mat, c.prop, CASE form WHEN 1 THEN 2 ELSE 3 END AS k, CASE u WHEN 0 THEN CASE WHEN c.unit = 'g/l' THEN 2 ELSE 0 END WHEN 1 THEN CASE prop WHEN 'MCnc' THEN 1 ELSE 0 END WHEN 2 THEN CASE prop WHEN 'SCnc' THEN 2 ELSE 0 END WHEN 3 THEN CASE prop WHEN 'NFr' THEN 2 ELSE 0 END ELSE 1 END AS us,
  CASE form WHEN 0 THEN CASE mat WHEN 's' THEN 2 WHEN 'u' THEN -1 ELSE 1 END WHEN 1 THEN CASE mat WHEN 'u' THEN -1 ELSE 0 END ELSE 0 END AS ms, CASE WHEN mat = 's' THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN method IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END AS extra FROM a JOIN codes c ON c.label = a.p_name),
r AS (SELECT name, unit, id, round(k + us + ms + extra, 6) AS score FROM s WHERE ms >= 0)
SELECT *, row_number() OVER (PARTITION BY name, unit ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 3""")
def code_ranking(spark, d):
    parts = table(spark, d, "part")
    rows = [("s", "g/l", "MCnc", None), ("p", "g/l", "MCnc", None), ("u", "g/l", "MCnc", None), ("s", None, "NFr", "vzorec"), ("b", "mmol/l", "SCnc", None)]
    row = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("material", "unit", "prop", "method"), r)]) for r in rows]
    table_ = parts.select("p_name").distinct().select("p_name", F.inline(F.array(*row)))
    table_ = table_.select(F.concat_ws(":", "p_name", "material", "prop").alias("id"), F.col("p_name").alias("label"), "unit", "prop", "material", "method")
    form = F.col("p_size") % 3
    name = F.when(form == 0, F.concat(F.lit("S_"), F.col("p_name"))).when(form == 1, F.concat(F.col("p_name"), F.lit(" (dog)"))).otherwise(F.concat(F.lit("X_"), F.col("p_name")))
    unit = c.pick(F.col("p_partkey"), [F.lit("g/l"), F.lit("mg / dl"), F.lit("mmol/l"), F.lit("%"), F.lit(None).cast("string")])
    asked = parts.select(name.alias("name"), unit.alias("unit"), F.lit(None).cast("string").alias("material"))
    return codes.code_lookup(asked, table_, top=3).select("name", "unit", "id", "score", "rank")


@query(f"""{PTS}, s AS (SELECT DISTINCT patient_id FROM p), q AS (SELECT patient_id, patient_id % 5 AS k FROM s UNION ALL SELECT DISTINCT -patient_id - 1, 0 FROM s WHERE patient_id % 10 = 0),
w AS (SELECT patient_id, series, CASE WHEN series IN ('click', 'view') THEN 'count' ELSE 'usd' END AS unit, count(*) FILTER (value IS NOT NULL AND (patient_id % 5 IN (0, 2) AND date >= DATE '2024-01-05' OR patient_id % 5 = 4 OR patient_id % 5 = 3 AND date < DATE '2001-01-01')) AS n FROM p WHERE series IN ('click', 'view', 'purchase') GROUP BY ALL),
x AS (SELECT q.patient_id, q.k, w.series, w.unit, w.n, CASE w.series WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 3 END AS place, CASE w.series WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE 'Purchase' END AS shown FROM q JOIN w USING (patient_id) WHERE q.k IN (0, 3, 4)),
t AS (SELECT patient_id, count(*) FILTER (n >= 2) AS usable, coalesce(string_agg(shown, ', ' ORDER BY place) FILTER (n < 2), '') AS dropped, list(series) AS have FROM x GROUP BY 1),
g AS (SELECT patient_id, unit, string_agg(series, ',' ORDER BY place) AS series, sum(n)::BIGINT AS points, min(place) AS first FROM x WHERE n >= 2 GROUP BY 1, 2),
o AS (SELECT q.*, t.usable, t.dropped, t.have, g.unit, g.series, g.points, g.first, EXISTS (SELECT 1 FROM s WHERE s.patient_id = q.patient_id) AS data FROM q LEFT JOIN t USING (patient_id) LEFT JOIN g USING (patient_id)),
z AS (SELECT *, CASE WHEN k = 1 THEN 'invalid' WHEN NOT data THEN 'no data' WHEN usable IS NULL THEN 'not found' WHEN usable = 0 THEN 'too few' ELSE 'ok' END AS status FROM o)
SELECT patient_id, status, CASE WHEN status = 'ok' THEN row_number() OVER (PARTITION BY patient_id ORDER BY first, unit) END AS chart, unit, CASE WHEN unit IS NOT NULL THEN CASE WHEN k = 4 THEN 'bar' ELSE 'line' END END AS type, series, points,
  CASE WHEN k = 1 OR NOT data THEN '' WHEN k = 2 THEN 'x1, x2, x3, x4, x5, x6, x7, x8 a další' ELSE array_to_string(list_filter(['click', 'VIEW', 'nothing', 'click', 'purchase'], lambda m: m = 'nothing' OR NOT coalesce(list_contains(have, lower(m)), FALSE)), ', ') END AS missing, coalesce(dropped, '') AS dropped FROM z""")
def chart_requests(spark, d):
    rows = c.points(spark, d)
    rows = rows.select("patient_id", "series", F.initcap("series").alias("display_name"), F.when(F.col("series").isin("click", "view"), "count").otherwise("usd").alias("unit"), "date", "value")
    users = rows.select("patient_id", (F.col("patient_id") % 5).alias("k")).distinct()
    users = users.unionByName(users.where("patient_id % 10 = 0").select((-F.col("patient_id") - 1).alias("patient_id"), F.lit(0).cast("long").alias("k")))
    names_ = '"parameters": ["click", " VIEW ", "nothing", "click", "purchase", ""]'
    many = ", ".join(f'"x{i}"' for i in range(1, 11))
    spec = (
        F.when(F.col("k") == 0, f'{{{names_}, "from": "2024-01-05", "to": null, "title": "dropped"}}').when(F.col("k") == 1, f'{{{names_}, "from": "last year"}}').when(F.col("k") == 2, f'{{"parameters": [{many}], "from": "2024-01-05"}}')
        .when(F.col("k") == 3, f'{{{names_}, "to": "2000-12-31", "type": "pie"}}').otherwise(f'{{{names_}, "type": "bar"}}')
    )
    specs = charts.parsed_specs(users.select("patient_id", F.lit(1).alias("spec_id"), spec.alias("spec")))
    return charts.resolved_charts(specs, rows, "patient_id").drop("spec_id")


@query("""WITH r AS (SELECT o_custkey AS owner, o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS date, 'x' AS k FROM orders),
p AS (SELECT o_custkey AS owner, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_orderkey ELSE -l_orderkey END AS report_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT owner, date, min(report_id) AS first FROM r GROUP BY 1, 2)
SELECT p.*, coalesce(CASE WHEN p.report_id > 0 THEN p.report_id WHEN p.report_id = 0 THEN 0 END, f.first) AS found_report, CASE WHEN p.report_id >= 0 THEN 'id' WHEN f.first IS NOT NULL THEN 'date' END AS via FROM p LEFT JOIN f USING (owner, date)""")
def reports_of_points(spark, d):
    orders = table(spark, d, "orders")
    reports = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("date"))
    k, n = F.col("l_linenumber") % 3, F.col("l_linenumber")
    points = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"), "o_orderdate"), "l_orderkey")
    # no report has a number below 0
    points = points.select("owner", (F.col("l_orderkey") * 10 + n).alias("id"), F.when(k == 1, F.col("l_orderkey")).when(k == 2, -F.col("l_orderkey")).alias("report_id"), F.when(n % 2 == 0, F.to_date("o_orderdate")).alias("date"))
    return citations.report_of_point(points, reports, "owner", ["report_id"])


@query(f"""{LNS} SELECT id, CASE WHEN l_partkey % 3 = 0 THEN p_name || ' ' || CASE WHEN l_partkey % 2 = 0 THEN 'own ' || l_linenumber ELSE 'read' END || ' g' ELSE p_name || ' read g' END AS label, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE 1 END AS page, l_partkey % 3 = 0 AS located
FROM l JOIN part ON p_partkey = l_partkey""")
def cited_rows(spark, d):
    rows = c.lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = rows.withColumn("report_id", F.concat_ws("-", "id", "l_partkey", "cents"))
    points = rows.select("id", F.col("report_id").alias("found_report"), F.col("l_partkey").alias("canonical_id"), F.col("p_name").alias("display_name"), F.lit(" read").alias("value_raw"), F.lit("g ").alias("unit"))
    printed = rows.where("l_partkey % 3 = 0").select("report_id", F.col("l_partkey").alias("canonical_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("own "), F.col("l_linenumber"))).alias("v"), "l_linenumber")
    printed = printed.select("report_id", "canonical_id", "ord", F.when(F.col("ord") == 1, F.col("v")).otherwise("later").alias("value_raw"), F.lit(None).cast("string").alias("unit"), F.col("l_linenumber").cast("int").alias("page"))
    return citations.cited_rows(points, printed).select("id", "label", "page", "located")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, d.doc_id, d.source FROM lineitem LEFT JOIN (SELECT o_orderkey, doc_id, source FROM orders JOIN documents ON doc_id = o_orderkey % 1500 WHERE o_orderkey % 3 <> 0) d ON o_orderkey = l_orderkey""")
def notes_of_points(spark, d):
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("visit_id"))
    visits = table(spark, d, "orders").select(F.col("o_orderkey").alias("visit_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 1500).alias("note_id"))
    return citations.note_of_point(points, visits, table(spark, d, "documents").select("doc_id", "source")).select("id", "doc_id", "source")


@query("""WITH d AS (SELECT doc_id, doc_id % 100 AS owner, source AS title FROM documents), g AS (SELECT page_id % 400 AS doc_id, count(*) AS n, string_agg(url, ',' ORDER BY page_id, url) AS pages FROM pages GROUP BY 1)
SELECT o_orderkey AS request_id, o_custkey % 100 AS owner, o_orderkey % 1200 AS doc_id, d.doc_id IS NOT NULL AS found, title, CAST(CASE WHEN d.doc_id IS NULL THEN 0 ELSE coalesce(n, 0) END AS INT) AS n_pages, CASE WHEN d.doc_id IS NOT NULL THEN pages END AS pages
FROM orders LEFT JOIN d ON d.doc_id = o_orderkey % 1200 AND d.owner = o_custkey % 100 LEFT JOIN g ON g.doc_id = d.doc_id""")
def owned_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("owner"), F.col("source").alias("title"))
    sheets = table(spark, d, "pages").select((F.col("page_id") % 400).alias("doc_id"), F.col("page_id").alias("page_num"), F.col("url").alias("image_url"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 100).alias("owner"), (F.col("o_orderkey") % 1200).alias("doc_id"))
    return citations.owned_documents(asked, docs, sheets, "owner")


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t]{2,}', ' ', 'g') || CASE WHEN coalesce(text, '') = '' OR right(text, 1) NOT IN (' ', chr(9)) THEN ' ' ELSE '' END || 'ref end p-vlna' AS text FROM documents WHERE coalesce(text, '') = '' OR right(text, 1) NOT IN (' ', chr(9))""")
def scrubbed_documents(spark, d):
    rows = table(spark, d, "documents").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[ \t]$"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" ref p-novak-88  known"), F.col("doc_id").cast("string"), F.lit(" end p-vlna"))
    return rows.select("doc_id", citations.scrubbed(said, F.array(F.concat(F.lit("known"), F.col("doc_id").cast("string")))).alias("text"))


@query(f"SELECT *, rank <= 6 AS cited FROM ({ORACLE['change_summary']})")
def cited_changes(spark, d):
    return citations.cited_changes(change_summary(spark, d))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' WHEN turn % 5 = 1 THEN 'Ask ' || role || '|turn ' || turn || '|n' ELSE 'Ask ' || role || '|more' END AS asked FROM conversations""")
def follow_ups(spark, d):
    role, turn, k = F.col("role"), F.col("turn").cast("string"), F.col("turn") % 5
    q = lambda *x: F.concat(F.coalesce("text", F.lit("")), *[v if not isinstance(v, str) else F.lit(v) for v in x])
    whole = F.concat(F.lit('\nNext: ["Ask '), role, F.lit('", " ask '), F.upper(role), F.lit('", "turn '), turn, F.lit('", "", 7, "n", "more"] '))
    less = F.concat(F.lit('\nNext: ["Ask '), role, F.lit('", null, {"a": "b"}, "'), F.repeat(F.lit("x"), F.lit(201)), F.lit('", "more"]'))
    # of a text with brackets of its own only the end is looked at, as a turn's end is
    end = F.when(k == 0, F.concat(F.lit('\nNext: ["Ask '), role)).when(k == 1, whole).otherwise(less)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(citations.followups(end), "|").alias("asked"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, 'Q' || doc_id || 'zuv' AS last, length('Q' || doc_id || 'zuv') AS n FROM documents)
SELECT doc_id, 'Pacient: ' || repeat('█', 5 + n) || '  Narozena: ' || repeat('█', 8) || '
Rodné číslo: ' || repeat('█', 11) || chr(9) || 'Datum odběru: 3.4.2020
' || text || '
Podepsán(a) ' || repeat('█', n) || ', ' || repeat('█', 10) || ' ' || last || 'ová' AS redacted, 'birth-date,birth-number,name' AS kinds, 7 AS spellings, 0 AS surviving FROM t""")
def without_identity(spark, d):
    last = F.concat(F.lit("Q"), F.col("doc_id").cast("string"), F.lit("zuv"))
    head = F.concat(F.lit("Pacient: Xeno "), last, F.lit("  Narozena: 1.2.1980\nRodné číslo: 805201/0002\tDatum odběru: 3.4.2020\n"))
    said = F.concat(head, F.coalesce("text", F.lit("")), F.lit("\nPodepsán(a) "), F.upper(last), F.lit(", 8052010002 "), last, F.lit("ová"))
    return documents.without_identity(table(spark, d, "documents").select("doc_id", said.alias("text")), bare=False)


@query("""WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS b, DATE '1996-06-15' AS t, o_totalprice AS x FROM orders),
m AS (SELECT *, (year(t) - year(b)) * 12 + month(t) - month(b) - CASE WHEN day(t) < day(b) THEN 1 ELSE 0 END AS months, date_diff('day', b, t) AS days FROM s),
w AS (SELECT *, months // 12 AS y, months % 12 AS r FROM m)
SELECT o_orderkey, CASE WHEN months < 0 THEN NULL WHEN months = 0 THEN days || CASE WHEN days = 1 THEN ' den' WHEN days BETWEEN 2 AND 4 THEN ' dny' ELSE ' dnů' END ELSE
  CASE WHEN y > 0 THEN y || CASE WHEN y = 1 THEN ' rok' WHEN y BETWEEN 2 AND 4 THEN ' roky' ELSE ' let' END ELSE '' END || CASE WHEN y > 0 AND r > 0 THEN ' a ' ELSE '' END ||
  CASE WHEN r > 0 THEN r || CASE WHEN r = 1 THEN ' měsíc' WHEN r BETWEEN 2 AND 4 THEN ' měsíce' ELSE ' měsíců' END ELSE '' END END AS span,
  month(b) || '/' || strftime(b, '%y') AS month, replace(replace(replace(CASE WHEN round(x, 0) = x THEN format('{:,}', CAST(x AS BIGINT)) ELSE format('{:,.2f}', x) END, ',', chr(160)), '.', ','), ';', ',') AS money FROM w""")
def printed_spans(spark, d):
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", printing.printed_span(day, F.lit("1996-06-15").cast("date")).alias("span"), printing.printed_month(day).alias("month"), printing.printed_money(F.col("o_totalprice")).alias("money"))


@query("""SELECT event_id, left(sha256('salt|' || strftime(ts, '%Y-%m-%d') || '|' || user_id), 16) AS owner, left(sha256('salt|' || event_type), 16) AS kind FROM events""")
def hashed_owners(spark, d):
    return table(spark, d, "events").select("event_id", printing.hashed_owner(F.col("user_id").cast("string"), "salt", F.col("ts")).alias("owner"), printing.hashed_owner(F.col("event_type"), "salt").alias("kind"))


_NAMED = {"click": "cholesterol", "view": "hdl", "purchase": "triacylglyceroly", "signup": "ast", "error": "alt"}


def _computed_sql() -> str:
    wide = ", ".join(f"arg_max({{'v': x, 'u': unit}}, (ts, event_id)) FILTER (series = '{s}') AS {n}" for s, n in _NAMED.items())
    cases = [
        ("derived:non_hdl", ("cholesterol", "hdl"), "cholesterol.v - hdl.v", "TRUE", ""), ("derived:ldl_friedewald", ("cholesterol", "hdl", "triacylglyceroly"), "cholesterol.v - hdl.v - triacylglyceroly.v / 2.2", "triacylglyceroly.v <= 4.5", "nad 4,5 mmol/l triacylglycerolů Friedewaldův výpočet neplatí"),
        ("derived:chol_hdl", ("cholesterol", "hdl"), "cholesterol.v / hdl.v", "hdl.v > 0", "HDL je nula"), ("derived:ast_alt", ("ast", "alt"), "ast.v / alt.v", "alt.v > 0", "ALT je nula"),
    ]
    parts = []
    for name, inputs, value, good, reason in cases:
        units = " AND ".join([good, *(f"{i}.u = '{'mmol/l' if name != 'derived:ast_alt' else 'µkat/l'}'" for i in inputs)])
        there = " AND ".join(f"{i} IS NOT NULL" for i in inputs)
        parts.append(f"SELECT *, '{name}' AS series, '{reason}' AS why FROM (SELECT patient_id, report_id, date, CASE WHEN {units} THEN round({value}, 6) END AS value FROM w WHERE {there})")
    return f"""{PTS}, q AS (SELECT *, concat_ws('|', patient_id, CAST(date AS VARCHAR)) AS report_id, CASE WHEN series = 'purchase' THEN value * 0.05 WHEN event_id % 50 = 0 THEN 0 ELSE value END AS x, CASE WHEN event_id % 9 = 0 THEN 'mg/dl' WHEN series IN ('signup', 'error') THEN 'µkat/l' ELSE 'mmol/l' END AS unit FROM p WHERE value IS NOT NULL),
w AS (SELECT patient_id, report_id, date, {wide} FROM q GROUP BY ALL), v AS ({' UNION ALL '.join(parts)}),
e AS (SELECT patient_id, series, count(value) AS usable, count(*) - count(value) AS skipped FROM v GROUP BY ALL HAVING count(value) >= 2)
SELECT patient_id, series, report_id, date, value, usable, skipped, 'unknown' AS flag, CASE WHEN skipped > 0 AND why <> '' THEN why END AS reason FROM v JOIN e USING (patient_id, series) WHERE value IS NOT NULL"""


@query(_computed_sql())
def computed_series(spark, d):
    """Readings under the names of the formulas' inputs; each ninth is in another unit, some are 0."""
    rows = c.points(spark, d)
    name = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])[F.col("series")]
    value = F.when(F.col("series") == "purchase", F.col("value") * 0.05).when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value"))
    unit = F.when(F.col("event_id") % 9 == 0, "mg/dl").when(F.col("series").isin("signup", "error"), "µkat/l").otherwise("mmol/l")
    rows = rows.where("value is not null").withColumns({"report_id": F.concat_ws("|", "patient_id", F.col("date").cast("string")), "value": value, "unit": unit, "series": name})
    return computed(rows, ["patient_id"], "series", "report_id", ORDER)


@query(f"""WITH sh AS ({ORACLE['series_shape']}), p AS ({POINTS_SQL}),
e AS (SELECT patient_id, series, arg_min(flag, (ts, event_id)) AS first_flag, arg_max(flag, (ts, event_id)) AS last_flag, arg_max(date, (ts, event_id)) AS last_date, arg_max(value, (ts, event_id)) AS lv FROM p WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT patient_id, max(date) AS draw FROM p GROUP BY 1),
r AS (SELECT e.*, draw, sh.* EXCLUDE (patient_id, series), coalesce(abs(rel_change), abs(change), 0) AS size, last_flag IN ('high', 'low') AS out, first_flag IN ('high', 'low') AS out0 FROM e JOIN d USING (patient_id) LEFT JOIN sh ON sh.patient_id = e.patient_id AND sh.series = e.series),
k AS (SELECT *, 'out' AS kind FROM r WHERE out AND last_date = draw UNION ALL SELECT *, 'longest' FROM r WHERE out AND last_date = draw AND out_streak >= 3
  UNION ALL SELECT *, direction FROM r WHERE span_days > 0 AND (last_flag = 'high' AND direction = 'rising' OR last_flag = 'low' AND direction = 'falling')
  UNION ALL SELECT *, 'drift' FROM r WHERE n IS NOT NULL AND NOT out AND monotone AND size >= 0.15 UNION ALL SELECT *, 'returned' FROM r WHERE n IS NOT NULL AND out0 AND NOT out
  UNION ALL SELECT *, 'recovering' FROM r WHERE n IS NOT NULL AND (last_flag = 'high' AND direction = 'falling' OR last_flag = 'low' AND direction = 'rising') AND size >= 0.05),
h AS (SELECT *, bool_or(kind IN ('rising', 'falling')) OVER w AS worse, bool_or(kind = 'returned') OVER w AS came FROM k WINDOW w AS (PARTITION BY patient_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY patient_id, kind ORDER BY CASE WHEN kind = 'longest' THEN out_streak ELSE 0 END DESC, size DESC, series) AS place FROM h WHERE NOT (kind = 'drift' AND worse) AND NOT (kind = 'recovering' AND came))
SELECT patient_id, kind, place, series, coalesce(first_value, lv) AS first_value, coalesce(last_value, lv) AS last_value, rel_change, CAST(coalesce(out_streak, 1) AS BIGINT) AS out_streak FROM o
WHERE kind = 'out' OR place <= CASE WHEN kind IN ('rising', 'falling', 'returned') THEN 2 ELSE 1 END""")
def prose_picks(spark, d):
    return prose.picks(c.points(spark, d), ["patient_id"], "series", ORDER)
