"""Queries of pages interpreted as rows of reports. Pages and readings are made of line items by a kind of fault for each item; the SQL says
what a fault must lead to, not the operator's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, pages, series
from ..sources.tables import table
from . import carriers as c
from .layouts import _NTH, _numbered
from .queries import query
from .rest import LNS, PTS

#: What is wrong with an item's reading, by kind: 0 the second reader may miss it, 1 its index is one too high, 2 its name is misspelt, 3 its value is
#: made up, 4 nobody reads it, 5 it has a result in words and nobody reads it, 6 it has no index, 7 the second reader names it
#: otherwise, 8 its row begins with a code and its name is misspelt, 9 nothing is wrong and its unit differs.
_KIND = "(l_partkey + 3 * k) % 10"


def _page(spark, d):
    """reads, pages: an order's items as rows of a page behind a heading, read by two readers."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = _numbered(spark, d).join(parts, "l_partkey").withColumn("kind", F.expr(_KIND))
    text = lambda x: F.col(x).cast("string")
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), text("k"), F.lit(" "), "p_name")
    value = F.concat(F.lpad(text("k"), 3, "0"), F.lit(","), text("cents"))
    rows = rows.select(F.col("l_orderkey").alias("page_id"), "k", "kind", "cents", name.alias("name"), value.alias("value"), "p_name")
    rows = rows.withColumn("misspelt", F.concat(F.substring_index("name", " ", 1), F.lit(" x"), "p_name"))
    tail = [F.col("value"), F.lit("g/l"), F.lit("1 - 5")]
    cells = F.when(F.col("kind") == 5, F.array("name", F.lit("málo"), F.lit("materiálu"), F.lit("krev"))).when(F.col("kind") == 8, F.array(F.lit("81234"), "name", *tail)).otherwise(F.array("name", *tail))
    heading = c.pick(F.col("page_id"), [F.array(F.lit("Moč")), F.array(F.lit("Biochemie")), F.array(F.lit("Metabolity"))])
    printed = rows.select("page_id", F.col("k").alias("row_index"), cells.alias("cells"))
    printed = printed.unionByName(rows.where("k = 1").select("page_id", F.lit(0).alias("row_index"), heading.alias("cells")))
    said = rows.where("kind not in (4, 5)").select(
        "page_id", F.col("k").alias("ord"), "kind", "cents", "name", F.when(F.col("kind").isin(2, 8), F.col("misspelt")).otherwise(F.col("name")).alias("raw_name"), F.when(F.col("kind") == 3, F.concat("value", F.lit("9"))).otherwise(F.replace("value", F.lit(","), F.lit(" ,"))).alias("value_raw"),
        F.lit("g/l").alias("unit_raw"), F.lit("1 - 5").alias("ref_range_raw"), F.when(F.col("kind") != 6, F.col("k") + F.when(F.col("kind") == 1, 1).otherwise(0)).alias("row_index"), F.lit("lab").alias("lab"), F.lit(False).alias("scan"),
    )
    second = said.where("not (kind = 0 and cents % 4 = 0)").withColumns({"raw_name": F.when(F.col("kind") == 7, F.concat(F.lit("other "), F.reverse("name"))).otherwise(F.col("raw_name")), "unit_raw": F.when(F.col("kind") == 9, "mg/l").otherwise(F.col("unit_raw"))})
    day = lambda n: F.when(F.col("page_id") % 4 == 0, F.lit(f"2024-01-0{n}")).otherwise("2024-01-01")
    reads = said.withColumns({"reader": F.lit("a"), "report_date": day(2)}).unionByName(second.withColumns({"reader": F.lit("b"), "report_date": day(1)}))
    return reads, printed


def _interpreted(spark, d):
    entries = c.catalogue(spark, d)
    none = spark.createDataFrame([], "alias_lab string, alias_name string, alias_unit string, target string")
    known = entries.select("canonical_id", F.when(F.length("display_name") % 2 == 0, "s").otherwise("u").alias("material"))
    reads, printed = _page(spark, d)
    return pages.interpret(reads, printed, matching.name_index(entries), none, known, expected=2), reads


_ITEMS = f"""{LNS}, i AS (SELECT l.*, p_name, {_NTH} FROM l JOIN part ON p_partkey = l_partkey), k AS (SELECT *, {_KIND} AS kind FROM i),
q AS (SELECT l_orderkey AS page_id, k, kind, cents, p_name, upper(p_name[1]) || k || ' ' || p_name AS name, count_if(kind NOT IN (4, 5) AND NOT (kind = 0 AND cents % 4 = 0)) OVER (PARTITION BY l_orderkey) > 0 AS second,
  ['u', 's', NULL][l_orderkey % 3 + 1] AS above, CASE WHEN kind = 5 THEN 'b' ELSE ['u', 's', NULL][l_orderkey % 3 + 1] END AS own, CASE WHEN length(p_name) % 2 = 0 THEN 'b' ELSE 'u' END AS entry FROM k),
f AS (SELECT *, CASE kind WHEN 4 THEN 'unread' WHEN 5 THEN 'printed' ELSE 'reading' END AS source, CASE kind WHEN 1 THEN 'moved' WHEN 3 THEN 'broken' WHEN 6 THEN 'none' ELSE 'kept' END AS placed,
  CASE WHEN kind IN (2, 8) THEN 'from row' WHEN kind IN (4, 5) THEN 'as printed' ELSE 'as read' END AS named, CASE kind WHEN 3 THEN 'absent' WHEN 6 THEN 'page' ELSE 'row' END AS printed,
  CASE WHEN kind IN (4, 5) THEN NULL WHEN NOT second THEN 'a reading failed' WHEN kind = 0 AND cents % 4 = 0 THEN 'seen by one reading' WHEN kind = 9 THEN 'units differ' END AS reconciled,
  CASE WHEN kind NOT IN (3, 6) THEN own END AS material FROM q),
g AS (SELECT *, CASE WHEN kind = 3 THEN 'not printed' ELSE reconciled END AS doubt, CASE WHEN material IS NULL OR (material = 'u') = (entry = 'u') THEN replace(p_name, ' ', '_') END AS canonical_id FROM f)"""


@query(f"""{_ITEMS} SELECT page_id, name AS raw_name, source, CASE WHEN kind NOT IN (3, 6) THEN k END AS row_index, placed, named, printed, reconciled, doubt, material, canonical_id, CASE WHEN canonical_id IS NULL THEN 'refused' ELSE 'catalogue' END AS via,
  CASE kind WHEN 4 THEN NULL WHEN 5 THEN 'málo materiálu' WHEN 3 THEN lpad(k::VARCHAR, 3, '0') || ',' || cents || '9' ELSE lpad(k::VARCHAR, 3, '0') || ' ,' || cents END AS value_raw FROM g
UNION ALL SELECT page_id, name, 'unread', k, 'kept', 'as printed', 'row', NULL, NULL, own, CASE WHEN own IS NULL OR (own = 'u') = (entry = 'u') THEN replace(p_name, ' ', '_') END,
  CASE WHEN own IS NULL OR (own = 'u') = (entry = 'u') THEN 'catalogue' ELSE 'refused' END, NULL FROM g WHERE kind IN (3, 6)""")
def page_interpretation(spark, d):
    """Every row of every order's page. A row whose reading has a made-up value or no index is pointed at by none, so it is told as unread as well."""
    rows, _ = _interpreted(spark, d)
    return rows.select("page_id", "raw_name", "source", F.col("row_index").cast("long").alias("row_index"), "placed", "named", "printed", "reconciled", "doubt", "material", "canonical_id", "via", "value_raw")


@query(f"""{_ITEMS}, n AS (SELECT page_id, count(*) FILTER (WHERE source = 'reading') AS readings, count(*) FILTER (WHERE kind = 5) AS qualitative, count(*) FILTER (WHERE kind IN (3, 4, 6)) AS unread, count(*) FILTER (WHERE kind = 1) AS repaired, count(*) FILTER (WHERE kind = 3) AS broken, count(*) FILTER (WHERE kind IN (2, 8)) AS renamed, count(*) FILTER (WHERE kind = 3) AS unverified,
  count(doubt) AS doubts, bool_or(second) AND bool_or(source = 'reading') AS again FROM g GROUP BY page_id)
SELECT n.* EXCLUDE (again), CASE WHEN readings > 0 THEN 'lab' END AS lab, CASE WHEN readings > 0 THEN CASE WHEN page_id % 4 = 0 THEN '2024-01-02' ELSE '2024-01-01' END END AS report_date, CASE WHEN again AND page_id % 4 = 0 THEN '2024-01-01,2024-01-02' END AS date_conflict FROM n""")
def page_reports(spark, d):
    """What each page's rows came to, with its laboratory, its date and the dates that its readings don't agree on."""
    rows, reads = _interpreted(spark, d)
    return pages.page_counts(rows, pages.page_facts(reads)).drop("matched", "scan").withColumn("date_conflict", F.array_join("date_conflict", ","))


_CZECH = "CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN translate(p_name, 'srzc', 'šřžč') ELSE replace(p_name, 'g', 'ch') END"
_CZECH_KEY = "replace(replace(replace(replace(replace({0}, 'ch', 'h~'), 'č', 'c~'), 'ř', 'r~'), 'š', 's~'), 'ž', 'z~')"


@query(f"""WITH n AS (SELECT DISTINCT p_type, {_CZECH} AS name FROM part) SELECT p_type, name, row_number() OVER (PARTITION BY p_type ORDER BY {_CZECH_KEY.format('name')}) AS rank FROM n""")
def czech_order(spark, d):
    """Names of parts, spelt with letters with hooks and with ch, in the order of the Czech alphabet."""
    names = table(spark, d, "part").select("p_type", F.expr(_CZECH).alias("name"))
    return series.ranked_names(names, ["p_type"], "name").withColumn("rank", F.col("rank").cast("long"))


@query(f"""{PTS}, n AS (SELECT *, CASE series WHEN 'click' THEN 'chlor' WHEN 'view' THEN 'hořčík' WHEN 'purchase' THEN 'čas' WHEN 'signup' THEN 'cukr' ELSE 'i ' || series END AS name FROM p),
v AS (SELECT * FROM n WHERE value IS NOT NULL), t AS (SELECT patient_id, name, arg_max(value, (ts, event_id)) AS value, arg_max(flag, (ts, event_id)) AS flag, max(date) AS date FROM v GROUP BY ALL),
w AS (SELECT patient_id, max(date) AS draw FROM p GROUP BY 1)
SELECT patient_id, name, flag, row_number() OVER (PARTITION BY patient_id ORDER BY {_CZECH_KEY.format('name')}) AS rank FROM t JOIN w USING (patient_id) WHERE date = draw AND flag IN ('high', 'low')""")
def watched_names(spark, d):
    """Watched series by their Czech names alone."""
    said = F.create_map(*[F.lit(x) for x in ("click", "chlor", "view", "hořčík", "purchase", "čas", "signup", "cukr")])
    points = c.points(spark, d).withColumn("name", F.coalesce(F.try_element_at(said, "series"), F.concat(F.lit("i "), "series")))
    watched = series.watch_list(points, ["patient_id"], "name", ["ts", "event_id"]).select("patient_id", "name", "flag")
    ranks = series.ranked_names(watched, ["patient_id"], "name")
    return watched.join(ranks, ["patient_id", "name"]).withColumn("rank", F.col("rank").cast("long"))
