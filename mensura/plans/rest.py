"""Queries of operators that stand beside the main ones: identities, decisions about names, pages, ledgers, exports, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, names, printing
from ..operators import documents, ledger, mapping, matching, patients, quality
from ..operators import rows as rows_of
from ..sources import tables
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import stateful
from . import carriers as c
from .carriers import LINES_SQL, POINTS_SQL
from .queries import KEYS, ORDER, QUERIES, ORACLE, query  # noqa: F401

PTS = f"WITH p AS ({POINTS_SQL})"
LNS = f"WITH l AS ({LINES_SQL})"

_NUMBER = """WITH n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, o_orderkey % 2 = 1 AS woman, o_orderkey % 4 AS k FROM orders),
d AS (SELECT *, strftime(b, '%y') || lpad(CAST(month(b) + CASE WHEN woman THEN 50 ELSE 0 END AS VARCHAR), 2, '0') || strftime(b, '%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS nine FROM n)"""


@query(f"{_NUMBER} SELECT o_orderkey, k <> 3 AS valid, CASE WHEN k <> 3 THEN b END AS birth, CASE WHEN k <> 3 THEN CASE WHEN woman THEN 'F' ELSE 'M' END END AS sex FROM d")
def birth_numbers(spark, d):
    """Birth numbers made of order dates; each fourth has a wrong last digit."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    month = F.month(day) + F.when(F.col("o_orderkey") % 2 == 1, 50).otherwise(0)
    nine = F.concat(F.date_format(day, "yy"), F.lpad(month.cast("string"), 2, "0"), F.date_format(day, "dd"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"), nine.alias("nine"))
    check = (F.col("nine").cast("long") % 11 + F.when(F.col("k") == 3, 3).otherwise(0)) % 11 % 10
    number = F.concat(F.left("nine", F.lit(6)), F.when(F.col("k") == 0, "/").when(F.col("k") == 1, " / ").otherwise(""), F.substr("nine", F.lit(7)), check.cast("string"))
    return rows.select("o_orderkey", F.inline(F.array(dates.birth_number(number))))


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter(string_split(lower(c_mktsegment) || ' eva customer d ph', ' '), lambda x: x <> '')), ' ') AS key FROM customer""")
def person_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", names.sorted_tokens(F.concat(F.lit("MUDr. "), F.col("c_name"), F.lit(", ÉVA  "), F.col("c_mktsegment"), F.lit(", Ph.D., CSc."))).alias("key"))


@query(f"{LNS} SELECT id, ['reject', 'ok', 'ok', 'warn', 'ok', 'reject', 'reject'][id % 7 + 1] AS verdict FROM l")
def correction_checks(spark, d):
    lo = F.col("lo").cast("string")
    forms = [F.lit("  "), F.concat(F.lit("< "), lo), F.concat(F.lit("Negativní "), lo), F.concat(F.lit("- "), lo, F.lit(",5")), F.concat(lo, F.lit(",25 !")), F.concat(F.lit("x"), lo), F.lit(None).cast("string")]
    return c.lines(spark, d).select("id", printing.correction_check(c.pick(F.col("id"), forms), ["negativ"]).alias("verdict"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def draw_dates(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    said = lambda p: F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.month(day).cast("string"), F.lit("."), F.date_format(day, p))
    text = (
        F.when(k == 0, F.concat(F.lit("Tisk 1.1.2001\nDatum  ODBĚRU: "), said("yyyy"), F.lit(" 8:00"))).when(k == 1, F.concat(F.lit("Odběr:\nPříjem 40.1.2020\nodebráno 7:30 dne "), said("yyyy")))
        .when(k == 2, F.concat(F.lit("nar. 1.1.1950 přijetí "), said("yyyy"), F.lit(" odběr 2.2.2002"))).otherwise(F.concat(F.lit("odběr\n"), said("yyyy")))
    )
    return table(spark, d, "orders").select("o_orderkey", printing.draw_date(text).alias("day"))


@query("""SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'the') AND contains(strip_accents(lower(text)), 'on')""")
def documents_with_words(spark, d):
    return table(spark, d, "documents").where(documents.all_tokens(F.col("text"), "THE ón")).select("doc_id")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'stored' WHEN 2 THEN 'unparseable' WHEN 3 THEN 'before 1990' ELSE CASE WHEN day > DATE '1997-01-02' THEN 'future' END END AS doubt FROM r""")
def date_doubts(spark, d):
    k, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 0, "").when(k == 2, F.concat(day, F.lit("x"))).when(k == 3, F.concat(F.lit("1888"), F.substr(day, F.lit(5)))).otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", dates.date_doubt(text, F.lit("1997-01-01").cast("date"), F.when(k == 1, "stored")).alias("doubt"))


@query("""WITH k AS (SELECT DISTINCT replace(p_name, ' ', '_') AS id, unnest([p_name, lower(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:3])), '')),
  CASE WHEN length(split_part(p_name, ' ', 1)) <= 4 THEN substr(p_name, length(split_part(p_name, ' ', 1)) + 2) ELSE p_name END]) AS key FROM part)
SELECT key, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM k GROUP BY key HAVING count(DISTINCT id) > 1""")
def key_collisions(spark, d):
    return matching.collisions(c.catalogue(spark, d)).select("key", F.array_join("ids", ",").alias("ids"))


@query(f"""{LNS}, r AS (SELECT id, p_name, l_partkey % 4 AS k, l_suppkey % 2 AS m FROM l JOIN part ON p_partkey = l_partkey)
SELECT id, CASE WHEN k = 0 OR (k = 1 AND m = 0) THEN replace(p_name, ' ', '_') END AS canonical_id, CASE WHEN k = 0 OR (k = 1 AND m = 0) THEN 'catalogue' END AS via FROM r""")
def materials_against_names(spark, d):
    """A name whose code contradicts the entry's material isn't filed under it."""
    rows = c.lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    k, m = F.col("l_partkey") % 4, F.col("l_suppkey") % 2
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.when(m == 0, "P_").otherwise("U_"), F.col("p_name"))).otherwise(F.concat(F.lit("zz yy "), F.col("p_name")))
    rows = rows.select("id", name.alias("raw_name"), F.lit("lab").alias("lab"), F.lit(None).cast("string").alias("unit_raw"))
    entries = c.catalogue(spark, d)
    none = spark.createDataFrame([], "alias_lab string, alias_name string, alias_unit string, target string")
    known = entries.select("canonical_id", F.lit("s").alias("material"))
    return matching.resolve(rows, matching.name_index(entries), none, materials=known).select("id", "canonical_id", "via")


@query("""WITH e AS (SELECT id, arg_min(entry, (p, entry)) AS entry FROM (SELECT 'p' || p_partkey AS entry, unnest([{'p': 0, 'id': 'p' || p_partkey}, {'p': 1, 'id': 'm' || p_partkey % 50}, {'p': 2, 'id': 'l' || p_size}], recursive := true) FROM part) GROUP BY id)
SELECT l_orderkey, l_linenumber, code, entry FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'p' || l_partkey WHEN 1 THEN 'm' || l_partkey % 50 WHEN 2 THEN 'l' || l_linenumber ELSE 'none' END AS code FROM lineitem) LEFT JOIN e ON e.id = code""")
def rows_by_code(spark, d):
    key = F.col("p_partkey").cast("string")
    codes = table(spark, d, "part").select(F.concat(F.lit("p"), key).alias("id"), F.array(F.concat(F.lit("m"), (F.col("p_partkey") % 50).cast("string"))).alias("methods"), F.array(F.concat(F.lit("l"), F.col("p_size").cast("string"))).alias("loinc"))
    n = F.col("l_linenumber") % 4
    code = F.when(n == 0, F.concat(F.lit("p"), "l_partkey")).when(n == 1, F.concat(F.lit("m"), F.col("l_partkey") % 50)).when(n == 2, F.concat(F.lit("l"), "l_linenumber")).otherwise("none")
    return mapping.by_code(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code")), codes).withColumnRenamed("id", "entry")


@query("""WITH r AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, 'to ask' AS kind FROM r WHERE length(name) % 2 = 1
UNION ALL SELECT DISTINCT p_name || ' ' || p_partkey, 'unrecognised' FROM part WHERE p_size % 3 = 0 OR p_size % 3 = 1 AND p_name LIKE '%r'""")
def names_left(spark, d):
    parts = table(spark, d, "part")
    asked = parts.where(F.length("p_name") % 2 == 0).select(F.col("p_name").alias("name")).distinct()
    ask = mapping.still_to_ask(parts.select(F.col("p_name").alias("name")), asked)
    rows = parts.select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.when(F.col("p_size") % 3 == 1, F.col("p_name")).when(F.col("p_size") % 3 == 2, "known").alias("canonical_id"))
    entries = parts.where(~F.endswith("p_name", F.lit("r"))).select(F.col("p_name").alias("canonical_id")).distinct().unionByName(spark.createDataFrame([("known",)], "canonical_id string"))
    open_ = mapping.unrecognised(rows, entries).select("name").distinct()
    return ask.withColumn("kind", F.lit("to ask")).unionByName(open_.withColumn("kind", F.lit("unrecognised")))


@query("""WITH a AS (SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_name, ' ', '_') END AS canonical_id, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, p_size FROM part WHERE length(p_name) % 2 = 0),
f AS (SELECT * FROM a WHERE canonical_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1)
SELECT ord, name, canonical_id, confidence, CASE WHEN confidence = 'high' AND length(name) % 4 = 0 THEN 'apply' ELSE 'ask' END AS decision FROM f""")
def gated_answers(spark, d):
    """A model's answers, quoted names, entries that don't exist and names that weren't asked among them; applied where the unit agrees
    and nothing is against it."""
    parts = table(spark, d, "part")
    answers = parts.select(F.col("p_partkey").alias("ord"), F.concat(F.lit('„'), "p_name", F.lit('"')).alias("name"), F.when(F.col("p_size") % 3 == 0, "no_such_entry").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("canonical_id"), F.when(F.col("p_size") % 2 == 0, "high").otherwise("low").alias("confidence"))
    asked = parts.where(F.length("p_name") % 2 == 0).select(F.col("p_name").alias("name")).distinct()
    entries = c.catalogue(spark, d)
    n, none = F.length("display_name"), F.lit(None).cast("boolean")
    evidence = entries.select(F.col("display_name").alias("name"), "canonical_id", F.when(n % 4 == 0, True).when(n % 4 == 2, False).alias("unit_match"), none.alias("range_match"), none.alias("value_ok"), none.alias("material_match"))
    return mapping.gated(mapping.accepted_answers(answers, asked, entries), evidence).select("ord", "name", "canonical_id", "confidence", "decision")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""")
def nearest_headings(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return documents.nearest_heading(rows, "conv_id", "turn", F.col("role") == "user", F.col("turn")).select("conv_id", "turn", "heading")


ORACLE["page_row_clusters"] = f"""{LNS}, w AS (SELECT l_orderkey AS page_id, l_linenumber, l_linenumber * 20.0 + l_partkey % 3 AS y0, unnest([{{'x': 10, 't': CAST(l_partkey AS VARCHAR)}}, {{'x': 200, 't': CAST(lo AS VARCHAR)}}, {{'x': 300, 't': CAST(hi AS VARCHAR)}}], recursive := true) FROM l)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_linenumber) - 1 AS INT) AS row_index, string_agg(t, '|' ORDER BY x, y0, t) AS cells, CAST(min(y0) AS DOUBLE) AS y FROM w GROUP BY page_id, l_linenumber"""


@query(f"""{LNS} SELECT id, id % 4 <> 3 AS printed, id % 3 <> 0 AS unclaimed FROM l""")
def printed_rows(spark, d):
    """Rows of pages with a value in one cell or over two, with and without marks; those that no measurement points at."""
    k, lo, hi = F.col("id") % 4, F.col("lo").cast("string"), F.col("hi").cast("string")
    cells = F.when(k == 0, F.array(F.lit("Látka"), F.concat(lo, F.lit(","), hi, F.lit(" !")), F.lit("g/l"))).when(k == 1, F.array(F.lit("Látka"), lo, F.concat(F.lit(","), hi))).when(k == 2, F.array(F.lit("Látka"), F.concat(F.lit("↑ "), lo, F.lit(","), hi))).otherwise(F.array(F.lit("Látka"), F.concat(lo, F.lit(",9"), hi)))
    rows = c.lines(spark, d).select("id", cells.alias("cells"), F.concat(lo, F.lit(","), hi).alias("value_raw"))
    rows = rows.withColumns({"page_id": F.col("id"), "row_index": F.lit(0)})
    left = rows_of.unclaimed(rows.select("page_id", "row_index", "cells").distinct(), rows.where("id % 3 = 0").select("page_id", "row_index")).select("page_id").distinct().withColumn("unclaimed", F.lit(True))
    return rows.join(left, "page_id", "left").select("id", rows_of.printed_on_row(F.col("value_raw"), F.col("cells")).alias("printed"), F.coalesce("unclaimed", F.lit(False)).alias("unclaimed"))


_PAGE = """r AS (SELECT l_orderkey AS page_id, l_partkey, cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cents) AS ord FROM l)"""


def _page(spark, d):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents"))
    return c.lines(spark, d).select(F.col("l_orderkey").alias("page_id"), "l_partkey", "cents", nth.alias("ord"))


@query(f"""{LNS}, {_PAGE}, h AS (SELECT DISTINCT page_id, 0 AS row_index, ['s', 'u', NULL, 'b', 'u'][page_id % 5 + 1] AS material FROM r)
SELECT page_id, row_index, material, CASE WHEN material IS NOT NULL THEN 'heading' END AS source FROM h UNION ALL
SELECT page_id, ord, CASE WHEN l_partkey % 5 = 0 THEN 'b' ELSE material END, CASE WHEN l_partkey % 5 = 0 THEN 'column' WHEN material IS NOT NULL THEN 'heading' END FROM r JOIN h USING (page_id)""")
def row_materials(spark, d):
    """Pages with a heading and rows whose first cell is spelt like a material; some say their material in a column."""
    rows = _page(spark, d)
    heading = c.pick(F.col("page_id"), [F.array(F.lit(" Biochemie ")), F.array(F.lit("Moč - biochemie")), F.array(F.lit("Metabolity")), F.array(F.lit("KREVNÍ OBRAZ")), F.array(F.lit("Močový sediment"), F.lit("negativní"))])
    heads = rows.select("page_id").distinct().select("page_id", F.lit(0).alias("row_index"), heading.alias("cells"))
    said = F.array(F.lit("Moč"), F.lit(""), F.col("cents").cast("string"), F.when(F.col("l_partkey") % 5 == 0, "Plná krev").otherwise("krev 2"))
    return rows_of.printed_materials(heads.unionByName(rows.select("page_id", F.col("ord").alias("row_index"), said.alias("cells"))))


@query(f"""{LNS}, {_PAGE} SELECT page_id, ord, CASE WHEN cents % 5 < 3 THEN ord END AS found_row FROM r""")
def matched_reads(spark, d):
    """Reads of rows with a letter lost, a separator lost, another value, and two reads of one row."""
    rows = _page(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    value, k = F.concat(F.col("ord").cast("string"), F.lit(","), F.col("cents").cast("string")), F.col("cents") % 5
    text = F.concat(F.lit("S_"), F.initcap("p_name"), F.lit(" "), F.col("ord").cast("string"), F.lit(" ,"), F.col("cents").cast("string"), F.lit(" ! g/l"))
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit(""))).when(k == 2, F.concat(F.left("p_name", F.length("p_name") - 1), F.lit("q"))).otherwise(F.col("p_name"))
    reads = rows.select("page_id", "ord", name.alias("raw_name"), F.when(k == 3, F.concat(value, F.lit("9"))).otherwise(value).alias("value_raw"), F.explode(F.when(k == 4, F.array(F.lit(0), F.lit(100_000))).otherwise(F.array(F.lit(0)))).alias("twice"))
    reads = reads.select("page_id", (F.col("ord") + F.col("twice")).alias("ord"), "raw_name", "value_raw")
    found = rows_of.matched_reads(reads, rows.select("page_id", F.col("ord").alias("row_index"), text.alias("text")))
    return found.where("ord < 100000").select("page_id", "ord", "found_row")


@query(f"""{LNS} SELECT id, [NULL, 'receipt', 'anthropometric', 'auxiliary', 'toxicology', 'material', 'material', NULL, NULL][id % 9 + 1] AS why FROM l""")
def scope_exclusions(spark, d):
    k, lo = F.col("id") % 9, F.col("lo").cast("string")
    name = F.when(k == 2, "Pt_Hmotnost pacienta").when(k == 3, "Separace krve – séra").when(k == 5, "U_Glukóza").when(k == 7, "xxx_eGF").otherwise("S_Glukóza")
    rows = c.lines(spark, d).select(
        "id", name.alias("raw_name"), F.when(k.isin(1, 8), F.concat(F.lit("Přijato "), lo)).otherwise(lo).alias("value_raw"), F.when(k == 8, "g").alias("unit_raw"), F.lit(" ").alias("ref_range_raw"),
        F.when(k == 4, "Toxikologie").when(k == 6, "Biochemie").alias("section"), F.when(k == 6, "u").when(k == 7, "s").when(k == 5, "s").alias("material"),
    )
    rows = rows.withColumn("raw_name", F.when(k == 6, "Glukóza").otherwise(F.col("raw_name")))
    return rows.select("id", quality.scope_exclusion().alias("why"))


@query(f"""{LNS}, {_PAGE} SELECT page_id, ord, 'value_raw' AS field, ord || ',' || cents || '9' AS value FROM r WHERE cents % 5 = 0 UNION ALL SELECT page_id, ord, 'unit_raw', 'kg' FROM r WHERE cents % 7 = 0""")
def fabricated_fields(spark, d):
    """Values and units that a page doesn't print."""
    rows, value = _page(spark, d), F.concat(F.col("ord").cast("string"), F.lit(","), F.col("cents").cast("string"))
    pages = rows.select("page_id", F.array(F.lit("Látka"), F.concat(F.col("ord").cast("string"), F.lit(" ,")), F.concat(F.col("cents").cast("string"), F.lit(" !")), F.lit("g/l")).alias("cells"))
    arm = rows.select("page_id", "ord", F.when(F.col("cents") % 5 == 0, F.concat(value, F.lit("9"))).otherwise(value).alias("value_raw"), F.when(F.col("cents") % 7 == 0, "kg").when(F.col("cents") % 7 == 1, " ").otherwise("g / l").alias("unit_raw"))
    return quality.fabricated(arm, pages, ["value_raw", "unit_raw"])


@query(f"""{LNS}, {_PAGE}, k AS (SELECT page_id, ord, cents % 6 AS k, p_name, count(*) OVER (PARTITION BY page_id) AS n, lead(p_name) OVER (PARTITION BY page_id ORDER BY ord) AS next FROM r JOIN part ON p_partkey = l_partkey)
SELECT page_id, ord, CASE WHEN k = 1 THEN 'range' WHEN k = 2 THEN 'value' WHEN k = 3 THEN 'range,value' ELSE 'name' END AS reasons FROM k WHERE k IN (1, 2, 3) OR k = 4 AND next IS NOT NULL AND next <> p_name""")
def fused_rows(spark, d):
    """Rows of a reader in which two printed rows are one: two intervals, two numbers, two names; dates, thousands and single
    intervals are none."""
    rows = _page(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    after = F.lead("p_name").over(Window.partitionBy("page_id").orderBy("ord"))
    rows, k = rows.withColumn("next", after), F.col("cents") % 6
    arm = rows.select(
        "page_id", "ord", F.when((k == 4) & F.col("next").isNotNull(), F.concat_ws(" ", "p_name", "next")).otherwise(F.col("p_name")).alias("raw_name"),
        F.when(k.isin(2, 3), "5,3 ! <1,0").when(k == 0, "21.05.2024").when(k == 5, "10 000").otherwise("( 2,5 - 6,4 )").alias("value_raw"), F.when(k.isin(1, 3), "3,6 - 5,6 2,9 až 5,0").otherwise("( 2,5000 - 6,4000 )").alias("ref_range_raw"),
    )
    return quality.merged_rows(arm, rows.select("page_id", F.col("p_name").alias("raw_name")))


@query("""SELECT user_id, sum(event_id % 7 + 1) AS credit, count(*) AS n FROM events GROUP BY user_id""")
def credits_once(spark, d):
    """Purchases told twice or more count once."""
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).alias("credit"))
    return ledger.credited_once(rows.unionByName(rows.where("event_id % 3 = 0")).unionByName(rows.where("event_id % 6 = 0")), "user_id", "event_id", "credit")


@query("""SELECT 'parents' AS what, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 4 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 4 <> 0 OR user_id NOT IN (SELECT c_custkey FROM customer)""")
def cascaded_deletes(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    left = ledger.cascade(customers, customers.where("c_custkey % 4 = 0"), {"orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id")}, "c_custkey")
    one = lambda k: left[k].groupBy().agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n"))
    return one("parents").unionByName(one("orders")).unionByName(one("events"))


@query("""WITH RECURSIVE w AS (SELECT user_id AS key, CASE WHEN event_id % 3 = 0 THEN 'release' ELSE 'claim' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT key, rn, CAST(CASE kind WHEN 'claim' THEN 1 ELSE 0 END AS BIGINT) AS used, CAST(0 AS BIGINT) AS refused FROM w WHERE rn = 1
  UNION ALL SELECT w.key, w.rn, CASE WHEN w.kind = 'release' THEN greatest(f.used - 1, 0) WHEN f.used < 5 THEN f.used + 1 ELSE f.used END, f.refused + CASE WHEN w.kind = 'claim' AND f.used >= 5 THEN 1 ELSE 0 END FROM f JOIN w ON w.key = f.key AND w.rn = f.rn + 1)
SELECT key, arg_max(used, rn) AS used, arg_max(refused, rn) AS refused FROM f GROUP BY key""")
def guarded_counters(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("claim").alias("kind"))
    return ledger.allowance(rows, "key", "key long, used long, refused long", 5)


@query("""WITH r AS (SELECT o_custkey % 40 AS session, o_orderkey, o_custkey, o_orderkey % 5 AS k FROM orders),
l AS (SELECT DISTINCT session, o_custkey FROM r WHERE k = 0), s AS (SELECT DISTINCT session FROM l)
SELECT r.session, r.o_orderkey AS report_id, CASE WHEN s.session IS NULL THEN 'ok' WHEN k = 1 THEN 'unverifiable' WHEN l.o_custkey IS NOT NULL THEN 'ok' ELSE 'mismatch' END AS verdict
FROM r LEFT JOIN s USING (session) LEFT JOIN l ON l.session = r.session AND l.o_custkey = r.o_custkey WHERE k <> 0""")
def identity_checks(spark, d):
    """Reports of customers against those loaded in a session; some without a name."""
    letters = F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("session"), F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") % 5).alias("k"), F.lit(None).cast("string").alias("person_id"), letters.alias("x"))
    loaded = rows.where("k = 0").withColumn("person_name", F.concat(F.lit("Eva "), "x"))
    name = F.when(F.col("k") != 1, F.concat(F.upper("x"), F.lit("  ÉVA")))
    return patients.identity_check(rows.where("k <> 0").withColumn("person_name", name), loaded, "session")


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line FROM orders""")
def json_lines(spark, d):
    return tables.json_export(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("""SELECT 0 AS part, NULL::BIGINT AS o_orderkey, chr(65279) || '"o_orderkey";"o_orderstatus"' AS line UNION ALL SELECT 1, o_orderkey, '"' || o_orderkey || '";"' || o_orderstatus || '"' FROM orders""")
def csv_export(spark, d):
    return tables.csv_document(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"], ["o_orderkey"])


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def seeded_tables(spark, d):
    """Tables written twice, in the order of their references, and read back."""
    folder = shared_folder(spark, "seed")
    given = {n: table(spark, d, n) for n in ("region", "nation", "customer", "orders")}
    tables.seed(given, folder)
    tables.seed(given, folder)
    counts = [spark.read.schema(df.schema).parquet(f"{folder}/{n}").groupBy().agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in given.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT o_orderstatus AS canonical_id, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_custkey % 2 = 1) GROUP BY 1")
def patient_source(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("report_date"), F.col("o_orderstatus").alias("canonical_id"), F.col("o_totalprice").alias("value"))
    first = orders.where("o_custkey % 2 = 1").agg(F.min("o_custkey")).first()[0]
    return tables.TableSource(rows, orders.select(F.col("o_custkey").alias("patient_id")).distinct(), first).list_analytes()


@query(f"""{PTS}, o AS (SELECT min(patient_id) AS patient FROM p) SELECT date, value, flag, ref_low, ref_high FROM p, o WHERE patient_id = patient AND series = 'click'""")
def tool_get_trend(spark, d):
    points = c.points(spark, d).withColumns({"display_name": F.initcap("series"), "unit": F.lit("x")})
    data = {
        "points": points, "patients": table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("name"), F.lit(1990).alias("birth_year")),
        "documents": table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("owner"), F.lit(None).cast("date").alias("doc_date"), F.col("lang").alias("kind"), F.col("source").alias("title"), "text"),
        "performance": points.select("patient_id", F.col("series").alias("metric"), F.col("date").alias("day"), "value"),
    }
    return patients.patient_tools(data, ORDER).run("get_trend", patient=points.agg(F.min("patient_id")).first()[0], series_id="click")


def _stream(spark, d):
    """The events' files as a stream."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


def _cut(rows, text, seq="event_id"):
    """Fragments of a text for each event, cut in the middle: halves of neighbours come together."""
    half = (F.length(text) / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.left(text, half).alias("text")), F.struct(F.lit(1).alias("k"), F.substr(text, half + 1).alias("text")))
    return rows.select(F.col("user_id").cast("string").alias("stream_id"), F.col(seq), F.inline(parts)).select("stream_id", (F.col(seq) * 2 + F.col("k")).alias("seq"), "text")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, '{"id": ' || event_id || ', "s": "}{"}' AS row FROM events)
SELECT stream_id, n, CASE WHEN event_id % 9 = 0 THEN 1000 + length(row) ELSE length(row) END AS size, CASE WHEN event_id % 9 <> 0 THEN row END AS row FROM e""")
def stream_rows(spark, d):
    """Rows of a growing JSON array; each ninth is too long and is skipped."""
    said = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 9 == 0, F.repeat(F.lit(" "), F.lit(1000))).otherwise(""), F.lit(', "s": "}{"}'))
    fragments = _cut(_stream(spark, d), F.concat(F.lit(", "), said))
    return stateful.run_to_end(stateful.scan_rows(fragments, most=500), shared_folder(spark, "rows"))


@query("""SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN '{"id":' || event_id || '}' END AS event FROM events) QUALIFY event IS NOT NULL""")
def stream_frames(spark, d):
    """Server-sent events, some of them no JSON, in fragments that cut them anywhere."""
    k, key = F.col("event_id") % 5, F.col("event_id").cast("string")
    event = F.when(k == 0, F.concat(F.lit('{"id":'), key)).otherwise(F.concat(F.lit('{"id":'), key, F.lit("}")))
    fragments = _cut(_stream(spark, d), F.concat(F.when(k == 1, ": comment\n").otherwise(""), stateful.encoded_frame(event)))
    return stateful.run_to_end(stateful.frames(fragments), shared_folder(spark, "frames"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS stream_id, n, CASE event_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'row' END AS kind, CASE event_id % 7 WHEN 0 THEN '{"type":"done"}' WHEN 1 THEN '{"type":"error"}' ELSE '{"id":' || event_id || '}' END AS line FROM e WHERE event_id % 7 <> 2""")
def stream_lines(spark, d):
    k, key = F.col("event_id") % 7, F.col("event_id").cast("string")
    line = F.when(k == 0, '{"type":"done"}').when(k == 1, '{"type":"error"}').when(k == 2, "no json").otherwise(F.concat(F.lit('{"id":'), key, F.lit("}")))
    return stateful.run_to_end(stateful.response_lines(_cut(_stream(spark, d), F.concat(line, F.lit("\n")))), shared_folder(spark, "lines"))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 20 = 19 AS last FROM events), f AS (SELECT user_id, min(event_id) FILTER (last) AS stop, max(event_id) AS final FROM e GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS stream_id, string_agg(event_id || CASE WHEN stop IS NULL AND event_id = final THEN ' ' ELSE ' <' END, '' ORDER BY event_id) FILTER (stop IS NULL OR event_id <= stop) AS said FROM e JOIN f USING (user_id) GROUP BY 1""")
def stream_gate(spark, d):
    """What is said before a sentinel that comes in two fragments; an end that could be its beginning is held back."""
    text = F.concat(F.col("event_id").cast("string"), F.lit(" <"), F.when(F.col("event_id") % 20 == 19, "<END>").otherwise(""))
    rows = stateful.run_to_end(stateful.gate(_cut(_stream(spark, d), text), "<END>"), shared_folder(spark, "gate"))
    return rows.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("said"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER w AS known, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT CAST(user_id AS VARCHAR) AS session, CAST(event_id AS VARCHAR) AS report_id, CASE WHEN n = 1 OR event_type = known THEN 'admitted' ELSE 'mismatch' END AS decision FROM e WHERE n = 1 OR known <> 'error' AND event_type <> 'error'""")
def stream_admissions(spark, d):
    """A session's first report is admitted; others with an identity are decided as they come, those that can't be compared wait for an
    end that doesn't come."""
    rows = _stream(spark, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit("report").alias("kind"), F.col("event_id").cast("string").alias("report_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("identity"))
    return stateful.run_to_end(stateful.admit(rows), shared_folder(spark, "admit"))


@query("SELECT DISTINCT CAST(round(value) AS BIGINT) % 50 AS k FROM events WHERE value IS NOT NULL")
def stream_first_seen(spark, d):
    """One row for each key, however often it comes inside the delay."""
    rows = _stream(spark, d).where("value is not null").select((F.round("value", 0).cast("long") % 50).alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    return stateful.run_to_end(stateful.first_seen(rows, "k", "ts", "400 days"), shared_folder(spark, "seen")).select("k")
