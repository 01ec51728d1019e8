"""Independent readings of one page: reconciliation, orphans, review levels, same-day reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm_key
from ..functions.numbers import VALUE_MARKS, implausible, unit_key, with_range
from ..sources.shared import told_once


def compared(reads: DataFrame, of_page: dict[str, Column] | None = None) -> DataFrame:
    """reads (page_id, reader, ord, raw_name, value_raw, unit_raw, ref_range_raw, row_index) with the keys under which rows meet:
    the name; with the row index (or its ordinal) if any reader has the name twice on the page; and with total, the page's number of
    readers. of_page: further columns, each an aggregate over the page's rows. Each distinct (name, unit, interval) is worked out once.
    Rows are dealt by page once, and all that follows stays on their page."""
    number = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    span = lambda s: F.when(s["low"].isNotNull() | s["high"].isNotNull(), F.concat_ws("|", number(s["low"]), number(s["high"])))
    spelt = lambda texts: with_range(texts, F.col("ref_range_raw"), "_span").withColumns({"name": norm_key(F.col("raw_name")), "unit_k": unit_key(F.col("unit_raw")), "range_key": span(F.col("_span"))}).drop("_span")
    rows = told_once(reads, ["raw_name", "unit_raw", "ref_range_raw"], spelt).repartition("page_id")
    own, page = Window.partitionBy("page_id", "name", "reader"), Window.partitionBy("page_id")
    # the first window's order serves all of them
    rows = rows.withColumn("nth", F.row_number().over(own.orderBy("ord")) - 1)
    rows = rows.withColumn("_twice", F.max("nth").over(Window.partitionBy("page_id", "name")) > 0)
    rows = rows.withColumns({"total": F.size(F.collect_set("reader").over(page)), **{c: x.over(page) for c, x in (of_page or {}).items()}})
    return rows.withColumns(
        {
            "key": F.when(F.col("_twice"), F.concat_ws("#", "name", F.coalesce("row_index", "nth").cast("string"))).otherwise(F.col("name")),
            "value_key": F.lower(F.regexp_replace(F.translate(F.coalesce("value_raw", F.lit("")), VALUE_MARKS, ""), r"\s+", "")),
        }
    ).drop("_twice")


#: What the rows of one key are compared by, and the columns that say how far they go.
_ENDS = [(f, k, f"{end}_{k}") for k in ("value_key", "unit_k", "range_key") for f, end in ((F.min, "low"), (F.max, "high"))]


def grouped(rows: DataFrame) -> DataFrame:
    """Of compared rows the first reader's one per page and key, with readers, how many have the key, and the least and the greatest of
    what they are compared by, which differ where the rows do."""
    key = Window.partitionBy("page_id", "key")
    order = key.orderBy("reader", "ord")
    new = F.when(F.lag("reader").over(order).eqNullSafe(F.col("reader")), None).otherwise(F.col("reader"))
    rows = rows.withColumns({"_nth": F.row_number().over(order), "_new": new})
    return rows.withColumns({"readers": F.count("_new").over(key), **{name: f(k).over(key) for f, k, name in _ENDS}}).where("_nth = 1").drop("_nth", "_new")


def reconcile(reads: DataFrame, expected: int = 1, pair: bool = False, also: tuple[str, ...] = (), of_page: dict[str, Column] | None = None) -> DataFrame:
    """One row per page and key: the first reader's row, the number of readers, and the first disagreement that holds: values,
    a missing reader, seen by one, units, ranges. Doubt is stated, never dropped. pair: rows that orphan_pairs finds to be one are
    compared as one; also: further columns of the first reader's row; of_page: columns that compared() adds."""
    found = grouped(compared(reads, of_page))
    if pair:
        found = paired(found).withColumn("key", F.coalesce("kept", "key"))
        key = Window.partitionBy("page_id", "key")
        found = found.withColumns({"_nth": F.row_number().over(key.orderBy("reader", "ord")), "readers": F.sum("readers").over(key), **{name: f(name).over(key) for f, _, name in _ENDS}}).where("_nth = 1")
    wanted, differ = F.greatest(F.lit(expected), F.col("total")), lambda k: F.col(f"low_{k}") != F.col(f"high_{k}")
    doubt = (
        F.when(differ("value_key"), "values differ").when(wanted > F.col("total"), "a reading failed").when((F.col("total") > 1) & (F.col("readers") < F.col("total")), "seen by one reading")
        .when(differ("unit_k"), "units differ").when(differ("range_key"), "ranges differ")
    )
    return found.select("page_id", "key", "raw_name", "value_raw", "unit_raw", "ref_range_raw", *also, *(of_page or {}), "readers", doubt.alias("disagreement"), (wanted > 1).alias("escalated"))


def orphan_pairs(reads: DataFrame) -> DataFrame:
    """For two readers: rows that one reader alone has, paired with one of the other by the same row index when exactly one side has one
    row there (its first with the other side's first), else by the same value and unit that each side has once."""
    return paired(grouped(compared(reads))).where("kept is not null").select("page_id", "kept", F.col("key").alias("merged"), "by")


def paired(rows: DataFrame) -> DataFrame:
    """grouped rows with kept, the key of the row that a row is one with by orphan_pairs (only the later reader's has one), and by. Both ways are
    windows over the page's rows, so nothing is joined or shuffled."""

    def met(rows: DataFrame, way: str, among: Column, by: list[str], ok: Column) -> DataFrame:
        """rows with way: kept and merged of the pair at the row's place, or NULL; the rows of `among` alone have a place."""
        rows = rows.withColumn("_among", F.coalesce(among, F.lit(False)))
        at = Window.partitionBy("page_id", *[F.when(F.col("_among"), F.col(c)) for c in by])
        reader, row = F.when(F.col("_among"), F.col("reader")), F.struct("ord", "key")
        rows = rows.withColumns({"_reader": reader, "_low": F.min(reader).over(at), "_high": F.max(reader).over(at), "_n": F.count_if("_among").over(at)})
        one, other = (F.when(F.col("_reader") == F.col(end), row) for end in ("_low", "_high"))
        rows = rows.withColumns({"_a": F.count(one).over(at), "_b": F.count(other).over(at), "_kept": F.min(one).over(at), "_merged": F.min(other).over(at)})
        two = F.col("_among") & (F.col("_low") != F.col("_high")) & (F.col("_a") + F.col("_b") == F.col("_n")) & ok
        return rows.withColumn(way, F.when(two, F.struct(F.col("_kept.key").alias("kept"), F.col("_merged.key").alias("merged")))).drop("_among", "_reader", "_low", "_high", "_n", "_a", "_b", "_kept", "_merged")

    alone = F.col("readers") == 1
    rows = met(rows, "_row", alone & F.col("row_index").isNotNull(), ["row_index"], F.least("_a", "_b") == 1)
    used = F.coalesce(F.col("key").isin(F.col("_row.kept"), F.col("_row.merged")), F.lit(False))
    rows = met(rows, "_value", alone & ~used & (F.col("value_key") != ""), ["value_key", "unit_k"], F.greatest("_a", "_b") == 1)
    is_ = lambda way: F.col("key") == F.col(f"{way}.merged")
    kept = F.when(is_("_row"), F.col("_row.kept")).when(is_("_value"), F.col("_value.kept"))
    return rows.withColumns({"kept": kept, "by": F.when(is_("_row"), "row").when(is_("_value"), "value")}).drop("_row", "_value")


def review(rows: DataFrame) -> DataFrame:
    """level and reason of each row (value, ref_low, ref_high, curated_low, curated_high, date_doubt, confirmed, extracted_by,
    printed_on_page, escalated, disagreement, same_number, confidence): the first rule that holds."""
    inside = F.col("value").isNotNull() & (F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()) & F.coalesce(F.col("value") >= F.col("ref_low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("ref_high"), F.lit(True))
    curated = F.col("curated_low").isNotNull() & F.col("curated_high").isNotNull()
    low, high = (F.when(curated, F.col(f"curated_{x}")).when(F.col("ref_low").isNotNull() & F.col("ref_high").isNotNull(), F.col(f"ref_{x}")) for x in ("low", "high"))
    odd = F.when(~inside & ~F.coalesce("printed_on_page", F.lit(False)), implausible(F.col("value"), low, high))
    agreed = F.coalesce("escalated", F.lit(False)) & F.col("disagreement").isNull()
    text = F.coalesce(F.col("extracted_by") == "printed-row", F.lit(False)) & F.col("value").isNull()
    is_ = lambda level, reason: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
    found = (
        F.when(F.col("date_doubt").isNotNull(), is_("unconfirmed", "date"))
        .when(F.coalesce("confirmed", F.lit(False)) | text, is_("ok", ""))
        .when((odd == "suspect-decimal") & agreed, is_("unconfirmed", "decimal"))
        .when(odd == "suspect-decimal", is_("withheld", "decimal"))
        .when(odd == "impossible", is_("withheld", "impossible"))
        .when(F.col("disagreement").isNotNull() & ~F.coalesce("same_number", F.lit(False)), is_("unconfirmed", "disagreement"))
        .when(F.col("confidence") == "low", is_("unconfirmed", "confidence"))
        .otherwise(is_("ok", ""))
    )
    return rows.withColumn("_r", found).select(*rows.columns, "_r.level", "_r.reason")


def same_day(rows: DataFrame, owner: str, report: str, day: str, key: str, value: str) -> DataFrame:
    """Pairs of an owner's reports of one day: `duplicate` if they share at least half of the smaller one's keys and 90 % of those
    have equal values, `repeat` if they share as many with other values."""
    rows = rows.groupBy(owner, day, report, key).agg(F.max(value).alias(value))
    sizes = rows.groupBy(owner, day, report).agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: rows.select(owner, day, key, F.col(report).alias(x), F.col(value).alias(f"v{x}"))
    both = side("a").join(side("b"), [owner, day, key]).where("a < b").groupBy(owner, day, "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("va").eqNullSafe(F.col("vb"))).alias("equal"))
    size = lambda x: sizes.select(F.col(report).alias(x), F.col("n").alias(f"n{x}"))
    both = both.join(size("a"), "a").join(size("b"), "b").where(F.col("shared") >= F.greatest(F.lit(1.0), F.least("na", "nb") / 2))
    return both.select(owner, day, "a", "b", "shared", "equal", F.when(F.col("equal") >= F.col("shared") * 0.9, "duplicate").otherwise("repeat").alias("verdict"))
