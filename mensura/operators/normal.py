"""From printed cells to typed rows, and the filters of doubt that every later operator relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_doubt
from ..functions.names import BLOOD
from ..functions.numbers import censored_flag, compute_flag, parse_value, with_range, with_unit
from ..sources.shared import told_once


def looks_numeric(raw: Column) -> Column:
    """Whether a cell has something printed and no letter."""
    return (F.trim(raw) != "") & ~raw.rlike(r"\p{L}")


def normalised(rows: DataFrame) -> DataFrame:
    """rows (value_raw, unit_raw, ref_range_raw, confidence) with value, unit, ref_range_low, ref_range_high, ref_range_text and flag. A
    cell that looks like a number, isn't a bound and gives no number makes the confidence low; else it stays. A result printed
    as a bound has the flag that the bound decides. NULL cells give NULL and the flag unknown."""
    spelt = lambda texts: with_unit(with_range(texts, F.col("ref_range_raw"), "_span"), F.col("unit_raw"), "unit")
    typed = told_once(rows, ["ref_range_raw", "unit_raw"], spelt).withColumn("value", parse_value(F.col("value_raw")))
    low, high = F.col("_span.low"), F.col("_span.high")
    flag = F.when(F.col("value").isNull(), censored_flag(F.col("value_raw"), high)).otherwise(compute_flag(F.col("value"), low, high))
    unread = F.col("value").isNull() & looks_numeric(F.col("value_raw")) & ~F.col("value_raw").rlike("[<>]")
    return typed.withColumns(
        {"ref_range_low": low, "ref_range_high": high, "ref_range_text": F.col("_span.text"), "flag": flag, "confidence": F.when(unread, "low").otherwise(F.col("confidence"))}
    ).drop("_span")


def is_flagged(disagreement: str | None = "disagreement") -> Column:
    """Of a normalised row: whether a person has to look at it: low confidence, readers that disagree, or no number in what
    looks like one."""
    odd = F.coalesce(F.col("confidence") == "low", F.lit(False)) | (F.col("value").isNull() & F.coalesce(looks_numeric(F.col("value_raw")), F.lit(False)))
    return odd | F.col(disagreement).isNotNull() if disagreement else odd


def suspects(points: DataFrame, suspect: str = "suspect") -> DataFrame:
    """Points that are held back."""
    return points.where(F.col(suspect).isNotNull())


def unconfirmed(points: DataFrame, suspect: str = "suspect", doubt: str = "unconfirmed") -> DataFrame:
    """Points that are plotted though nothing has confirmed them."""
    return points.where(F.col("value").isNotNull() & F.col(suspect).isNull() & F.col(doubt).isNotNull())


def doubts(points: DataFrame, keys: list[str], suspect: str = "suspect", doubt: str = "unconfirmed") -> DataFrame:
    """Of each series: points, those held back, those plotted with a doubt, and whether there is any."""
    held, open_ = F.col(suspect).isNotNull(), F.col("value").isNotNull() & F.col(suspect).isNull() & F.col(doubt).isNotNull()
    any_ = F.bool_or(held | F.col(doubt).isNotNull())
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("suspects"), F.count_if(open_).alias("unconfirmed"), any_.alias("has_doubt"))


def latest_censored_out(points: DataFrame, keys: list[str], order: list[str], suspect: str = "suspect") -> DataFrame:
    """The newest point of each series where it has no number, isn't held back and is out of range. One aggregation with
    partial maxima."""
    others = [c for c in points.columns if c not in keys]
    last = points.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("p")).select(*keys, "p.*")
    return last.where(F.col("value").isNull() & F.col(suspect).isNull() & F.col("flag").isin("high", "low"))


def in_window(day: Column, first: Column | None, last: Column | None) -> Column:
    """Whether a day is from first to last, both included; NULL or none leaves that end open."""
    found = F.lit(True)
    if first is not None:
        found = found & (first.isNull() | (day >= first))
    if last is not None:
        found = found & (last.isNull() | (day <= last))
    return found


def trendable(occurrences: DataFrame, keys: list[str], material: str, value: str) -> DataFrame:
    """Keys whose material is blood or unknown and that have a number anywhere."""
    blood = F.col(material).isNull() | F.exists(F.split(F.col(material), ","), lambda m: m.isin(BLOOD))
    return occurrences.where(blood & F.col(value).isNotNull()).select(*keys).distinct()


def for_trends(reports: DataFrame, today: Column, day: str = "report_date", stored: str | None = "date_doubt") -> DataFrame:
    """Reports as trends see them, with report_date_doubt: those without a date stay; of dates in doubt, future ones (more than a
    day ahead) and those that are no dates go."""
    doubt = F.when(F.coalesce(F.col(day), F.lit("")) != "", date_doubt(F.col(day), today, F.col(stored) if stored else None))
    parsed = F.try_to_date(F.col(day), "yyyy-MM-dd")
    gone = doubt.isNotNull() & (parsed.isNull() | (parsed > F.date_add(today, 1)))
    return reports.withColumn("report_date_doubt", doubt).where(~gone)


def converted(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows (canonical_id, value, unit, ref_low, ref_high) in the entry's own unit where the unit, as it is spelt, has a factor;
    nothing is rounded. units: canonical_id, from_unit, factor, canonical_unit."""
    known = units.select("canonical_id", F.col("from_unit").alias("unit"), "factor", "canonical_unit")
    met = rows.join(known, ["canonical_id", "unit"], "left")
    apply = F.col("value").isNotNull() & F.col("factor").isNotNull() & (F.col("unit") != F.col("canonical_unit"))
    times = lambda c: F.when(apply, F.col(c) * F.col("factor")).otherwise(F.col(c))
    new = {"value": times("value"), "ref_low": times("ref_low"), "ref_high": times("ref_high"), "unit": F.when(apply, F.col("canonical_unit")).otherwise(F.col("unit"))}
    return met.withColumns(new).select(rows.columns)


def distinct_identities(reports: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Each printed (person_name, person_id) of a session once, where it stands first; reports without both are none."""
    known = reports.where((F.coalesce("person_name", F.lit("")) != "") | (F.coalesce("person_id", F.lit("")) != ""))
    return known.groupBy(session, "person_name", "person_id").agg(F.min(F.struct(*order)).alias("first"))


def dated_union(*artifacts: DataFrame) -> DataFrame:
    """The distinct (owner, date) of several kinds of artifacts."""
    every = artifacts[0]
    for other in artifacts[1:]:
        every = every.unionByName(other)
    return every.distinct()
