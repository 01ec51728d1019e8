"""Queries of page geometry, of expiring streams and of pairing by value. Words are placed by numbers of line items and orders, so
the SQL says what each page must give from those numbers, not by the operator's steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout, ledger, mapping, quality
from ..operators import rows as rows_of
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import expiry
from . import carriers as c
from .queries import query
from .rest import LNS, _stream

_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cents) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n"


def _numbered(spark, d):
    """Line items with their place k in the order, from 1, and the order's number of items."""
    order = Window.partitionBy("l_orderkey")
    nth = F.row_number().over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents"))
    return c.lines(spark, d).withColumns({"k": nth, "n": F.count(F.lit(1)).over(order)})


@query(f"""{LNS}, o AS (SELECT *, {_NTH}, l_orderkey % 4 AS kind FROM l),
r AS (
  SELECT l_orderkey AS page_id, 0 AS spot, 0 AS half, 'report of the order' AS cells FROM o WHERE kind = 2 AND k = 1
  UNION ALL SELECT l_orderkey, k, 0, l_partkey || '|' || lo || '|' || hi || '|' || l_suppkey || '|' || cents || '|' || l_returnflag FROM o WHERE NOT (kind = 0 AND n >= 2)
  UNION ALL SELECT l_orderkey, k, 0, l_partkey || '|' || lo || '|' || hi FROM o WHERE kind = 0 AND n >= 2
  UNION ALL SELECT l_orderkey, k, 1, l_suppkey || '|' || cents || '|' || l_returnflag FROM o WHERE kind = 0 AND n >= 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY spot, half) - 1 AS INT) AS row_index, cells FROM r""")
def side_by_side_rows(spark, d):
    """An order's items in two tables of three columns side by side: mirrored within 6 points on every fourth order, with a heading over both on another,
    and with a column too far off on the others. An order of one item is no table."""
    kind, jitter = F.col("l_orderkey") % 4, (F.col("l_partkey") % 6).cast("double")
    word = lambda text, x, wide: F.struct(F.col(text).cast("string").alias("text"), x.alias("x0"), F.lit(wide).alias("wide"))
    off = F.when(kind.isin(1, 3), 9.0).otherwise(0.0)
    cells = [word("l_partkey", F.lit(10.0), 60.0), word("lo", F.lit(110.0), 30.0), word("hi", F.lit(170.0), 40.0), word("l_suppkey", 310.0 + jitter, 50.0), word("cents", 410.0 + off + jitter, 40.0), word("l_returnflag", 470.0 + off + jitter / 2, 10.0)]
    rows = _numbered(spark, d)
    words = rows.select(F.col("l_orderkey").alias("page_id"), (F.col("k") * 20.0 + F.col("l_suppkey") % 3).alias("y0"), F.inline(F.array(*cells)))
    heading = rows.where((kind == 2) & (F.col("k") == 1)).select(F.col("l_orderkey").alias("page_id"), F.lit(0.0).alias("y0"), F.lit("report of the order").alias("text"), F.lit(10.0).alias("x0"), F.lit(500.0).alias("wide"))
    words = words.unionByName(heading).select("page_id", "text", "x0", "y0", (F.col("x0") + F.col("wide")).alias("x1"), (F.col("y0") + 10).alias("y1"))
    return rows_of.page_rows(words).select("page_id", "row_index", F.array_join("cells", "|").alias("cells"))


@query(f"""{LNS}, o AS (SELECT *, {_NTH} FROM l), p AS (SELECT *, count_if(k = 1 OR (l_partkey + k) % 3 = 0) OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS phrase FROM o)
SELECT l_orderkey AS line_id, CAST(phrase AS BIGINT) AS phrase, string_agg(l_partkey::VARCHAR, ' ' ORDER BY k) AS text, count(*) AS words FROM p GROUP BY ALL""")
def line_phrases(spark, d):
    """The items of an order as words of a line, ten high: a gap of twelve points or more ends a phrase."""
    rows = _numbered(spark, d)
    order = Window.partitionBy("l_orderkey").orderBy("k")
    gap = F.when((F.col("l_partkey") + F.col("k")) % 3 == 0, 12.0 + F.col("l_partkey") % 5).otherwise(11.0 - F.col("l_partkey") % 5)
    x0 = F.sum(gap + 30.0).over(order)
    y0 = 100.0 + F.col("l_suppkey") % 2
    words = rows.select((F.col("l_orderkey") % 50).alias("page_id"), F.col("l_orderkey").alias("line_id"), F.col("l_partkey").cast("string").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10).alias("y1"))
    return layout.phrases(words).select("line_id", "phrase", "text", F.size(F.split("text", " ")).cast("long").alias("words"))


@query(f"""{LNS}, o AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1), g AS (SELECT l_orderkey // 128 AS page_id, list_sort(list(((l_orderkey // 128) % 33 - 16) / 10.0 + CASE WHEN l_orderkey % 5 = 0 THEN 1.0 ELSE 0 END)) AS a FROM o WHERE n >= 3 GROUP BY 1)
SELECT page_id, CAST(round(a[len(a) // 2 + 1], 4) AS DOUBLE) AS degrees FROM g""")
def page_tilts(spark, d):
    """Orders as lines of tilted pages, a fifth of them a degree steeper than the page."""
    rows = _numbered(spark, d)
    page = F.floor(F.col("l_orderkey") / 128)
    angle = (page % 33 - 16) / 10.0 + F.when(F.col("l_orderkey") % 5 == 0, 1.0).otherwise(0.0)
    x = F.col("k") * 90.0
    y = (F.col("l_orderkey") % 128) * 20.0 + F.tan(F.radians(angle)) * x
    words = rows.select(page.alias("page_id"), F.col("l_orderkey").alias("line_id"), F.col("l_partkey").cast("string").alias("text"), (x - 20).alias("x0"), (y - 5).alias("y0"), (x + 20).alias("x1"), (y + 5).alias("y1"))
    return layout.tilt(words).select("page_id", F.round("degrees", 4).alias("degrees"))


@query("""WITH o AS (SELECT o_orderkey // 64 AS page_id, o_orderkey FROM orders), p AS (SELECT page_id, page_id % 3 AS kind, count(*) AS n, count_if(o_orderkey % 2 = 0) AS l, count_if(o_orderkey % 2 = 1) AS r FROM o GROUP BY ALL)
SELECT page_id, 440.0::DOUBLE AS "left", 520.0::DOUBLE AS "right" FROM p WHERE kind <> 1 AND 2 * n >= 20 AND 4 * 2 * l >= 2 * n AND 4 * 2 * r >= 2 * n AND kind = 0""")
def two_block_pages(spark, d):
    """Orders as rows of two words; on a page of the first kind each row is on one side of a gutter, on the second kind a word is in it, on the third
    the rows go across, as in one table."""
    rows = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("page_id"), "o_orderkey")
    kind, y = F.col("page_id") % 3, F.col("o_orderkey") % 64 * 20.0
    box = lambda text, a, b: F.struct(F.lit(text).alias("text"), a.cast("double").alias("x0"), b.cast("double").alias("x1"))
    right = F.col("o_orderkey") % 2 == 1
    one = F.when(kind == 2, F.lit(100)).when(right, 520).otherwise(100)
    two = F.when(kind == 2, F.lit(520)).when(right, 700).otherwise(300)
    words = [box("name", one, one + 140), box("value", two, F.when(kind == 1, 510).otherwise(two + 140))]
    placed = rows.select("page_id", y.alias("y0"), (y + 10).alias("y1"), F.inline(F.array(*words))).select("page_id", "text", "x0", "y0", F.greatest("x1", F.col("x0") + 1).alias("x1"), "y1")
    pages = placed.select("page_id").distinct().withColumn("width", F.lit(1000.0))
    return layout.two_blocks(placed, rows_of.page_boxes(placed), pages)


_PLACES = """w AS (SELECT o_custkey AS page_id, o_orderkey AS word_id, CASE o_orderkey % 7 WHEN 0 THEN 'p. ' || c_name || ', Brno' WHEN 1 THEN 'x' || c_name || '9' ELSE o_orderstatus END AS text, o_orderkey * 37 % 1000 AS x0, o_orderkey * 91 % 1400 AS y0, o_orderkey * 37 % 1000 + 20 + o_orderkey % 80 AS x1, o_orderkey * 91 % 1400 + 10 AS y1 FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT o_custkey AS page_id, o_orderkey * 53 % 1000 AS x0, o_orderkey * 29 % 1400 AS y0, o_orderkey * 53 % 1000 + 120 AS x1, o_orderkey * 29 % 1400 + 90 AS y1 FROM orders WHERE o_orderkey % 3 = 0)"""


def _placed(spark, d):
    """Orders as words of a customer's page, some with the customer's name; each third order also marks a box."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    text = F.when(key % 7 == 0, F.concat(F.lit("p. "), "c_name", F.lit(", Brno"))).when(key % 7 == 1, F.concat(F.lit("x"), "c_name", F.lit("9"))).otherwise(F.col("o_orderstatus"))
    box = lambda x, y, wide, high: [a.cast("double").alias(n) for a, n in ((x, "x0"), (y, "y0"), (x + wide, "x1"), (y + high, "y1"))]
    words = orders.select(F.col("o_custkey").alias("page_id"), key.alias("word_id"), text.alias("text"), *box(key * 37 % 1000, key * 91 % 1400, key % 80 + 20, 10))
    hits = orders.where(key % 3 == 0).select(F.col("o_custkey").alias("page_id"), *box(key * 53 % 1000, key * 29 % 1400, 120, 90))
    return words, hits, orders.select(F.col("o_custkey").alias("page_id"), F.col("c_name").alias("needle")).distinct()


@query(f"""WITH {_PLACES} SELECT page_id, word_id FROM w WHERE word_id % 7 <> 0
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = w.page_id AND w.x0 < h.x1 AND h.x0 < w.x1 AND w.y0 < h.y1 AND h.y0 < w.y1)""")
def words_outside_boxes(spark, d):
    """What stays of the words: none under a box, none that spells its page's name; a name inside a longer word isn't one."""
    return layout.without_boxes(*_placed(spark, d)).select("page_id", "word_id")


@query(f"""WITH {_PLACES}, s AS (SELECT DISTINCT page_id FROM w WHERE word_id % 7 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 > 1)
SELECT page_id, c_name AS needle FROM s JOIN customer ON c_custkey = page_id""")
def surviving_names(spark, d):
    """Names that can be read on a page before anything is removed, also over two words; none can be read after."""
    words, hits, needles = _placed(spark, d)
    # an eleventh of the words is followed by the page's name in two words
    split = words.where((F.col("word_id") % 11 == 0) & (F.col("word_id") % 7 > 1)).join(needles, "page_id").select("page_id", (F.col("word_id") * 4).alias("word_id"), F.split("needle", "#").alias("_p"))
    two = split.select("page_id", F.col("word_id") + 1, F.concat(F.get("_p", F.lit(0)), F.lit(":")).alias("text")).toDF("page_id", "word_id", "text").unionByName(split.select("page_id", F.col("word_id") + 2, F.get("_p", F.lit(1)).alias("text")).toDF("page_id", "word_id", "text"))
    before = layout.surviving(words.select("page_id", (F.col("word_id") * 4).alias("word_id"), "text").unionByName(two), needles)
    after = layout.surviving(layout.without_boxes(words, hits, needles), needles)
    return before.unionByName(after.withColumn("needle", F.concat(F.lit("left: "), "needle")))


@query("""WITH r AS (SELECT l_orderkey AS page_id, l_suppkey % 3 AS name, l_quantity::BIGINT AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
a AS (SELECT page_id, name, CASE WHEN ord % 4 = 0 THEN v + 1 ELSE v END AS v FROM r WHERE ord % 5 <> 0 UNION ALL SELECT page_id, name, 0 FROM r WHERE ord % 6 = 0),
t AS (SELECT page_id, name, v, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT page_id, name, v, count(*) AS n FROM a GROUP BY ALL),
m AS (SELECT page_id, name, sum(least(t.n, b.n)) AS matched FROM t JOIN b USING (page_id, name, v) GROUP BY ALL),
c AS (SELECT page_id, name, sum(tn) AS tn, sum(bn) AS bn FROM (SELECT page_id, name, n AS tn, 0 AS bn FROM t UNION ALL SELECT page_id, name, 0, n FROM b) GROUP BY ALL),
f AS (SELECT tn, bn, coalesce(matched, 0) AS m, page_id FROM c LEFT JOIN m USING (page_id, name))
SELECT page_id, sum(m)::BIGINT AS matched, sum(least(tn, bn) - m)::BIGINT AS mismatch, sum(tn - least(tn, bn))::BIGINT AS missing, sum(bn - least(tn, bn))::BIGINT AS extra FROM f GROUP BY page_id""")
def value_pairs(spark, d):
    """Truth and an arm that reads the rows backwards, misreads some, misses some and invents some; names recur on a page."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    truth = table(spark, d, "lineitem").withColumn("ord", nth).select(F.col("l_orderkey").alias("page_id"), (F.col("l_suppkey") % 3).alias("name"), F.col("l_quantity").cast("long").alias("value"), "ord")
    read = truth.where("ord % 5 <> 0").withColumns({"value": F.when(F.col("ord") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")), "ord": -F.col("ord")})
    arm = read.unionByName(truth.where("ord % 6 = 0").withColumns({"value": F.lit(0).cast("long"), "ord": F.col("ord") + 100}))
    verdicts = quality.paired_by_value(truth, arm, ["page_id", "name"], "value")
    return verdicts.groupBy("page_id").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "mismatch", "missing", "extra")))


@query("""SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 2 OR count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) > 5 AS limited FROM events""")
def stream_rate_limits(spark, d):
    """rate_limit_hits as a stream: two hits an hour, five a day."""
    found = expiry.limited(_stream(spark, d), F.col("user_id"), "ts", "event_id", {"hour": (3600, 2), "day": (86400, 5)}, "1 hour")
    return expiry.run_to_end(found, shared_folder(spark, "limits")).select("id", "limited")


_SPENT = "sum(CAST(round(abs(coalesce(value, 0)) * 100) AS BIGINT)) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id)"


@query(f"""WITH e AS (SELECT event_id, ts, strftime(ts, '%Y-%m') AS month, CAST({_SPENT} AS BIGINT) AS total FROM events), t AS (SELECT * FROM (VALUES ('80 %', 80000), ('100 %', 100000)) v(alert, least))
SELECT month, alert, arg_min(event_id, (ts, event_id)) AS id, min(total) AS total FROM e, t WHERE total >= least GROUP BY ALL""")
def stream_month_alerts(spark, d):
    """Amounts of events against a budget of a month: each of its two thresholds is told once."""
    cents = F.round(F.abs(F.coalesce("value", F.lit(0.0))) * 100, 0).cast("long")
    found = expiry.month_alerts(_stream(spark, d), "ts", "event_id", cents, {"80 %": 80_000, "100 %": 100_000}, "1 day", refunds=False)
    return expiry.run_to_end(found, shared_folder(spark, "alerts")).withColumnRenamed("key", "month")


@query("""SELECT user_id AS key, event_id AS id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 2 HOUR""")
def stream_fresh(spark, d):
    """Users that haven't been seen for two hours."""
    return expiry.run_to_end(expiry.fresh(_stream(spark, d), F.col("user_id"), "ts", "event_id", 7200, "1 hour"), shared_folder(spark, "fresh"))


@query("""WITH RECURSIVE w AS (SELECT user_id AS key, CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'send' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT key, rn, CAST(kind = 'send' AS BIGINT) AS sent, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS refused FROM w WHERE rn = 1
  UNION ALL SELECT w.key, w.rn, f.sent + CAST(w.kind = 'send' AND f.sent - f.failed < 2 AND f.sent < 6 AS BIGINT), least(f.sent, f.failed + CAST(w.kind = 'fail' AS BIGINT)),
    f.refused + CAST(w.kind = 'send' AND (f.sent - f.failed >= 2 OR f.sent >= 6) AS BIGINT) FROM f JOIN w ON w.key = f.key AND w.rn = f.rn + 1)
SELECT key, arg_max(sent, rn) AS sent, arg_max(failed, rn) AS failed, arg_max(refused, rn) AS refused FROM f GROUP BY key""")
def page_caps(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "fail").otherwise("send").alias("kind"))
    return ledger.pages_allowed(rows, "key", "key long, sent long, failed long, refused long", 2)


@query("""WITH t AS (SELECT replace(p_name, ' ', '_') AS base, count(DISTINCT p_size) AS used FROM part WHERE p_partkey % 4 = 0 GROUP BY 1),
n AS (SELECT p_name AS name, p_partkey AS ord, replace(p_name, ' ', '_') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 4 <> 0)
SELECT name, ord, CASE WHEN n + coalesce(used, 0) > 1 THEN base || '_' || (n + coalesce(used, 0)) ELSE base END AS canonical_id FROM n LEFT JOIN t USING (base)""")
def new_identifiers(spark, d):
    """Three quarters of the parts become entries; the others' names are taken, once for each size, with numbers behind them."""
    parts = table(spark, d, "part")
    slugs = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), (F.col("p_size") + 100).cast("string"))
    taken = parts.where("p_partkey % 4 = 0").select(slugs.alias("canonical_id")).distinct()
    return mapping.founded_ids(parts.where("p_partkey % 4 <> 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), taken)


@query("""SELECT lower(l_returnflag) || '|' || p_name || '|g' AS scope, l_returnflag AS lab, p_name AS raw_name, 'g' AS unit_raw, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_size <= 10 GROUP BY l_returnflag, p_name""")
def rows_of_entry(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("raw_name"), F.when(F.col("p_size") <= 10, "small").otherwise("large").alias("canonical_id"))
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("lab"), F.lit("g").alias("unit_raw"))
    return mapping.rows_under(rows.join(parts, "l_partkey"), "small")
