"""How the given tables carry measurements: the inputs of the registered queries, each a projection of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import compute_flag
from ..sources.tables import table

LOW, HIGH = 5.0, 110.0


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events as dated readings: a user is a patient, an event type a series; the interval is fixed."""
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("patient_id"), F.col("event_type").alias("series"), "ts", F.to_date("ts").alias("date"), "value", F.lit(LOW).alias("ref_low"), F.lit(HIGH).alias("ref_high")
    )
    return rows.withColumn("flag", compute_flag(F.col("value"), F.col("ref_low"), F.col("ref_high")))


POINTS_SQL = f"""SELECT event_id, user_id AS patient_id, event_type AS series, ts, CAST(ts AS DATE) AS date, value, {LOW} AS ref_low, {HIGH} AS ref_high,
  CASE WHEN value IS NULL THEN 'unknown' WHEN value < {LOW} THEN 'low' WHEN value > {HIGH} THEN 'high' ELSE 'normal' END AS flag FROM events"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with an identifier and the whole numbers from which printed cells are made."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.round(F.col("l_extendedprice") * 100, 0).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("lo"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 10).alias("hi"),
    )


LINES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_orderkey * 10 + l_linenumber AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CAST(l_quantity AS BIGINT) AS lo, CAST(l_quantity AS BIGINT) + l_linenumber * 10 AS hi FROM lineitem"""


def pick(number: Column, choices: list) -> Column:
    """The choice at number modulo their count."""
    return F.get(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))).cast("int"))


def value_cells(rows: DataFrame) -> DataFrame:
    """Printed value cells in eight manners."""
    text = lambda x: F.col(x).cast("string")
    kept = rows.columns
    # each step is a projection of the one before it, so that no part is spelt twice
    rows = rows.withColumns({"_whole": F.floor(F.col("cents") / 100), "_part": F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), "_form": F.pmod(F.col("id"), F.lit(8))})
    thousands = F.when(F.col("_whole") >= 1000, F.concat(F.floor(F.col("_whole") / 1000).cast("string"), F.lit(" "), F.lpad((F.col("_whole") % 1000).cast("string"), 3, "0"))).otherwise(text("_whole"))
    rows = rows.withColumns({"_plain": F.concat(text("_whole"), F.lit(","), F.col("_part")), "_thousands": thousands})
    forms = [
        F.concat("_thousands", F.lit(","), "_part"), F.concat("_plain", F.lit(" !")), F.concat(F.lit("<"), "_plain"), F.lit("negativní"),
        F.concat(F.lit("  "), text("_whole"), F.lit("."), "_part", F.lit(" ")), F.concat(F.translate("_thousands", " ", "."), F.lit(","), "_part"), F.concat(F.lit("↑ "), text("_whole")), F.concat(F.lit("> "), "_plain"),
    ]
    value = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        value = F.when(F.col("_form") == k, form).otherwise(value)
    return rows.select(*kept, value.alias("value_raw"))


def range_cells(rows: DataFrame) -> DataFrame:
    """Printed intervals in ten manners."""
    lo, hi = F.col("lo").cast("string"), F.concat(F.col("hi").cast("string"), F.lit(",5"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    forms = [say(lo, " - ", hi), say("(", lo, "–", hi, ")"), say("< ", hi), say("do ", hi, " g/l"), say("nad ", lo), say("M: ", lo, " - ", hi), say(lo, " - ", hi, " let"), say(lo, " až ", hi, " 10^9/l"), say("M: ", lo, "-", hi, " Ž: 1-2"), F.lit("negativní")]
    return rows.withColumn("range_raw", pick(F.col("id"), forms))


#: Printed units and their canonical spellings.
UNITS = [("umol/l", "µmol/l"), ("μmol / L", "µmol/l"), ("x 109/l", "10^9/l"), ("10E9/l", "10^9/l"), ("G/l", "10^9/l"), ("-", ""), ("1", ""), ("ml/s/1,73m^2", "ml/s/1,73 m2"), ("U/l", "U/l"), ("10˄12/l", "10^12/l"), ("ug/l", "µg/l"), ("mmol/L", "mmol/l")]


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Part names as a catalogue: one entry for each name, its synonyms a material code before it and its initials. Four in five have
    a curated interval (extremes of sizes), all an observed one and observed prices; half were seen in plasma."""
    parts = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.min("p_size").cast("double").alias("low"), F.max("p_size").cast("double").alias("high"), F.min("p_retailprice").alias("min_value"), F.max("p_retailprice").alias("max_value"))
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.left(w, F.lit(3)))), "")
    curated, none = F.length("p_name") % 5 != 0, F.array().cast("array<string>")
    return parts.select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_id"), F.col("p_name").alias("display_name"), F.array(F.concat(F.lit("S_"), "p_name"), initials).alias("synonyms"), F.lit("g").alias("canonical_unit"), F.array(F.lit("mg")).alias("conversions"), "ord",
        F.when(curated, F.col("low")).alias("ref_low"), F.when(curated, F.col("high")).alias("ref_high"), F.lit("g").alias("seen_unit"), F.col("low").alias("seen_low"), (F.col("high") + 9).alias("seen_high"), "min_value", "max_value",
        F.when(F.length("p_name") % 2 == 0, F.array(F.lit("p"))).otherwise(none).alias("materials"),
    )


def printed_names(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a printed name of their part in six manners."""
    rows = lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.left(w, F.lit(3)))), "")
    first = F.upper(F.left("p_name", F.lit(3)))
    forms = [F.col("p_name"), F.concat(F.lit("S_"), F.initcap("p_name")), F.concat(F.lit("nález "), F.lit("["), initials, F.lit("]")), F.concat(first, F.lit(" "), "p_name"), F.concat(F.lit("B-"), F.upper("p_name")), F.concat(F.lit("unknown "), F.reverse("p_name"))]
    return rows.withColumn("raw_name", pick(F.col("id"), forms))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of each order as a page: the second one misses, misreads or renames some rows by rule."""
    rows = lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents"))
    rows = value_cells(rows.withColumn("ord", nth).withColumn("id", F.col("l_orderkey") * 100 + F.col("ord")))
    k = F.pmod("id", F.lit(13))
    # both readings of a row come from one row: it is made once
    readers = F.when(k != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = rows.select(F.col("l_orderkey").alias("page_id"), "ord", F.col("p_name").alias("raw_name"), "value_raw", "id", F.explode(readers).alias("reader"))
    second = lambda x, other: F.when(F.col("reader") == "b", other).otherwise(x)
    unit, span = F.lit("mmol/l"), F.lit("1 - 5")
    return rows.select(
        "page_id", "ord", second(F.col("raw_name"), F.concat(F.when(k == 3, "XX").otherwise("S_"), "raw_name")).alias("raw_name"),
        second(F.col("value_raw"), F.concat("value_raw", F.when(k == 1, "9").when(k == 2, " !").otherwise(""))).alias("value_raw"),
        second(unit, F.when(k == 4, "umol/l").when(k == 5, "mmol / L").otherwise(unit)).alias("unit_raw"), second(span, F.when(k == 6, "1 - 6").when(k == 7, "1–5").otherwise(span)).alias("ref_range_raw"),
        F.col("ord").alias("row_index"), "id", "reader",
    )
