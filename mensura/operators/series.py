"""Series of dated points: shape, last change, streaks, units, watch list.

Points have key columns and seq, a total order inside a series (date, then ordinals). All window operators of a series
partition by the same keys, so Spark shuffles the points once for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import direction, significant, unit_key



def out_of_range() -> Column:
    return F.col("flag").isin("high", "low")


def numeric(points: DataFrame, suspect: str | None = None) -> DataFrame:
    """Points that may be plotted and compared: with a value, not held back."""
    rows = points.where(F.col("value").isNotNull())
    return rows.where(F.col(suspect).isNull()) if suspect else rows


def latest_two(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last two points of each series, age 1 being the last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return numeric(points).withColumn("age", F.row_number().over(w)).where("age <= 2")


def summaries(points: DataFrame, keys: list[str], order: list[str], share: float = 0.05) -> DataFrame:
    """Last and previous value, date and flag, delta (6 decimals) and direction of each series. One aggregation with partial
    sums, no window: a long series isn't sorted in one task."""
    p = numeric(points)
    at = F.struct(*order)
    top = F.struct(at.alias("at"), "value", "date", "flag")
    rows = p.groupBy(*keys).agg(F.max_by(top, at).alias("last"), F.count(F.lit(1)).alias("n"))
    before = p.join(rows.select(*keys, F.col("last.at").alias("_at")), keys).where(at < F.col("_at"))
    before = before.groupBy(*keys).agg(F.max_by("value", at).alias("prev_value"))
    rows = rows.join(before, keys, "left")
    last = F.col("last.value")
    return rows.select(
        *keys, "n", last.alias("last_value"), F.col("last.date").alias("last_date"), F.col("last.flag").alias("last_flag"), "prev_value",
        F.round(last - F.col("prev_value"), 6).alias("delta"), direction(last, F.col("prev_value"), share).alias("direction"),
    )


def shapes(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First, last, count, span, change, direction (1 %), out-of-range count, whether newly out, streak and monotony of each
    series of two points or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col("value") - F.lag("value").over(w)
    eps = F.greatest(F.abs(F.lag("value").over(w)) * 0.01, F.lit(1e-9))
    rows = numeric(points).withColumns({"rn": F.row_number().over(w), "sign": F.when(F.abs(step) > eps, F.signum(step))})
    at = F.struct(*order)
    end = lambda f, c: f(c, at)
    agg = rows.groupBy(*keys).agg(
        end(F.min_by, "value").alias("first_value"), end(F.max_by, "value").alias("last_value"), F.count(F.lit(1)).alias("n"),
        F.datediff(end(F.max_by, "date"), end(F.min_by, "date")).alias("span_days"), F.count_if(out_of_range()).alias("out_count"),
        (end(F.max_by, "flag").isin("high", "low") & ~end(F.min_by, "flag").isin("high", "low")).alias("newly_out"),
        (F.count(F.lit(1)) - F.coalesce(F.max(F.when(~out_of_range(), F.col("rn"))), F.lit(0))).alias("out_streak"),
        (F.coalesce(F.min("sign"), F.lit(0.0)) == F.coalesce(F.max("sign"), F.lit(0.0))).alias("monotone"),
    )
    change = F.col("last_value") - F.col("first_value")
    move = direction(F.col("last_value"), F.col("first_value"), 0.01)
    return agg.where("n >= 2").withColumns({"change": F.round(change, 6), "rel_change": F.round(F.try_divide(change, "first_value"), 6), "direction": F.when(move == "stable", "flat").otherwise(move)})


def out_streaks(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Points out of range at the end of each series: those behind its last point in range."""
    at = F.struct(*order)
    p = numeric(points)
    ends = p.groupBy(*keys).agg(F.max(F.when(~out_of_range(), at)).alias("_in"))
    rows = p.join(ends, keys)
    behind = F.col("_in").isNull() | (at > F.col("_in"))
    return rows.groupBy(*keys).agg(F.count_if(behind).alias("out_streak"), F.count(F.lit(1)).alias("n"))


def beyond_limit(value: Column, low: Column, high: Column) -> Column:
    """How far past the crossed limit, as a share of it."""
    return F.when(value > high, F.try_divide(value - high, F.abs(high))).when(value < low, F.try_divide(low - value, F.abs(low)))


def in_order(name: str, collation: str | None = None) -> Column:
    """A name as sorted: by code points, or as a language sorts (cs: ch behind h, letters with a hook behind the plain ones). Names that
    a collation doesn't tell apart stay in the order of their code points if sorted by both."""
    return F.collate(F.col(name), collation) if collation else F.col(name)


def ranked_names(rows: DataFrame, owner: list[str], name: str, collation: str = "cs") -> DataFrame:
    """The distinct names of each owner with their rank in a language's order; NULL comes last."""
    w = Window.partitionBy(*owner).orderBy(in_order(name, collation).asc_nulls_last(), name)
    return rows.select(*owner, name).distinct().withColumn("rank", F.row_number().over(w))


def watch_list(points: DataFrame, owner: list[str], series: str, order: list[str], collation: str | None = None) -> DataFrame:
    """Series whose last point is out of range and falls on the owner's last draw date; the farthest beyond first, then the longest
    streak, then by name, as the collation sorts."""
    keys = [*owner, series]
    draws = points.groupBy(*owner).agg(F.max("date").alias("draw"))
    at = F.struct(*order)
    last = numeric(points).groupBy(*keys).agg(F.max_by(F.struct("date", "value", "flag", "ref_low", "ref_high"), at).alias("l"))
    rows = last.join(draws, owner).where((F.col("l.date") == F.col("draw")) & F.col("l.flag").isin("high", "low"))
    rows = rows.join(out_streaks(points, keys, order).select(*keys, "out_streak"), keys)
    beyond = F.round(beyond_limit(F.col("l.value"), F.col("l.ref_low"), F.col("l.ref_high")), 6)
    rows = rows.select(*keys, F.col("l.date").alias("date"), F.col("l.value").alias("value"), F.col("l.flag").alias("flag"), beyond.alias("beyond"), "out_streak")
    w = Window.partitionBy(*owner).orderBy(F.desc(F.coalesce("beyond", F.lit(-1.0))), F.desc("out_streak"), in_order(series, collation), series)
    return rows.withColumn("rank", F.row_number().over(w))


def change_summaries(points: DataFrame, owner: list[str], series: str, order: list[str]) -> DataFrame:
    """The last step of each series: transition between ranges, relative move, and its rank: out of range first, then the
    largest move."""
    keys = [*owner, series]
    two = latest_two(points, keys, order)
    pick = lambda age, c: F.max(F.when(F.col("age") == age, F.col(c)))
    rows = two.groupBy(*keys).agg(pick(1, "value").alias("value"), pick(2, "value").alias("before"), pick(1, "flag").alias("flag"), pick(2, "flag").alias("flag_before"), pick(1, "date").alias("date"))
    place = F.when(F.col("flag") == "high", "above").when(F.col("flag") == "low", "below").otherwise("within")
    rows = rows.withColumn("transition", F.concat(F.when(F.col("flag_before").eqNullSafe(F.col("flag")), "still ").otherwise("newly "), place))
    rows = rows.withColumn("move", F.round(F.try_divide(F.col("value") - F.col("before"), F.abs("before")), 6))
    rows = rows.withColumn("direction", direction(F.col("value"), F.col("before"), 0.01))
    w = Window.partitionBy(*owner).orderBy(F.desc(out_of_range()), F.desc(F.coalesce(F.abs("move"), F.lit(-1.0))), series)
    return rows.withColumn("rank", F.row_number().over(w))


def canonical_series(points: DataFrame, keys: list[str], order: list[str], units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points on one axis, and the counts of those that don't fit. units (series key, unit_key, factor, canonical_unit): rows in a
    known unit are converted (4 significant digits); a series without any keeps the unit that most of its points carry (of
    equal ones the first seen)."""
    last = keys[-1]
    canon = units.groupBy(last).agg(F.first("canonical_unit").alias("canonical_unit"))
    rows = points.withColumn("unit_key", unit_key(F.col("unit"))).join(units.select(last, "unit_key", "factor"), [last, "unit_key"], "left")
    rows = rows.join(canon, last, "left")
    blank = F.coalesce(F.col("unit"), F.lit("")) == ""
    factor = F.when(blank & F.col("canonical_unit").isNotNull(), 1.0).otherwise(F.col("factor"))
    rows = rows.withColumns({"factor": factor, "value": F.when(factor == 1, F.col("value")).when(factor.isNotNull(), significant(F.col("value") * factor)).otherwise(F.col("value"))})
    units_of = rows.groupBy(*keys, "unit_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("at"), F.max(F.col("factor").isNotNull()).alias("settled"), F.min_by("unit", F.struct(*order)).alias("unit"))
    lead = units_of.groupBy(*keys).agg(
        F.bool_or("settled").alias("any_settled"),
        F.max_by("unit_key", F.when(F.col("unit_key") != "", F.col("n"))).alias("_"),
        F.max(F.when(F.col("unit_key") != "", F.col("n"))).alias("most"),
    ).drop("_")
    first = units_of.join(lead, keys).where((F.col("n") == F.col("most")) & (F.col("unit_key") != ""))
    first = first.groupBy(*keys).agg(F.min_by(F.struct("unit_key", "unit"), "at").alias("major"))
    rows = rows.join(lead.select(*keys, "any_settled"), keys).join(first, keys, "left")
    axis = F.when(F.col("any_settled"), F.col("canonical_unit")).otherwise(F.coalesce("major.unit", F.lit("")))
    fits = F.col("factor").isNotNull() | blank | (~F.col("any_settled") & (F.col("unit_key") == F.col("major.unit_key")))
    rows = rows.withColumns({"axis": axis, "fits": fits})
    kept = rows.where("fits").select(*keys, *[c for c in order if c not in keys], "value", F.col("axis").alias("unit"))
    return kept, rows.where("not fits").groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("n"))


def majority_unit(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The unit that most points of a series carry; of equal ones the first seen."""
    rows = points.where(F.coalesce(F.col("unit"), F.lit("")) != "").groupBy(*keys, F.lower("unit").alias("_u"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("unit"), F.struct(*order)).alias("u"), F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "at")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, F.col("u.unit").alias("unit"), "n")


def derived(
    points: DataFrame, owner: list[str], series: str, report: str, inputs: list[str], formula, order: list[str], guard=None, least: int = 2, units: list[str] | None = None
) -> DataFrame:
    """A value computed from inputs of the same report, never of the nearest date: the last point of each input in a report.
    guard: a condition under which there is no value; units: those that the inputs (with unit) must have, as they are spelt, for
    nothing is converted silently. Reports with all inputs and no value are counted as skipped. Owners with fewer than `least`
    values have none."""
    at = F.struct(*order)
    said = F.struct(F.col("value").alias("v"), (F.coalesce("unit", F.lit("")) if units else F.lit("")).alias("u"))
    last = lambda i: F.max_by(F.when(F.col(series) == i, said), F.when(F.col(series) == i, at))
    wide = numeric(points).where(F.col(series).isin(inputs)).groupBy(*owner, report).agg(*[last(i).alias(i) for i in inputs], F.max("date").alias("date"))
    wide = wide.where(" and ".join(f"`{i}` is not null" for i in inputs))
    values = [F.col(f"`{i}`.v") for i in inputs]
    value = formula(*values)
    value = F.when(~guard(*values), value) if guard else value
    for i, unit in zip(inputs, units or []):
        value = F.when(F.col(f"`{i}`.u") == unit, value)
    rows = wide.withColumn("value", F.round(value, 6))
    enough = rows.groupBy(*owner).agg(F.count("value").alias("usable"), F.count_if(F.col("value").isNull()).alias("skipped")).where(F.col("usable") >= least)
    return rows.join(enough, owner).select(*owner, report, "date", "value", "usable", "skipped")


#: Computed series: inputs with their units, formula, where there is no value, and the reason that is told then.
FORMULAS = {
    "derived:non_hdl": ({"cholesterol": "mmol/l", "hdl": "mmol/l"}, lambda c, h: c - h, None, ""),
    "derived:ldl_friedewald": (
        {"cholesterol": "mmol/l", "hdl": "mmol/l", "triacylglyceroly": "mmol/l"}, lambda c, h, t: c - h - t / 2.2, lambda c, h, t: t > 4.5, "nad 4,5 mmol/l triacylglycerolů Friedewaldův výpočet neplatí",
    ),
    "derived:chol_hdl": ({"cholesterol": "mmol/l", "hdl": "mmol/l"}, lambda c, h: F.try_divide(c, h), lambda c, h: h <= 0, "HDL je nula"),
    "derived:ast_alt": ({"ast": "µkat/l", "alt": "µkat/l"}, lambda a, b: F.try_divide(a, b), lambda a, b: b <= 0, "ALT je nula"),
}


def computed_series(points: DataFrame, owner: list[str], series: str, report: str, order: list[str]) -> DataFrame:
    """The points of all computed series, with the name of each and the reason for what was skipped. Their flag is unknown: they
    have no interval."""
    found = None
    for name, (inputs, formula, guard, reason) in FORMULAS.items():
        rows = derived(points, owner, series, report, list(inputs), formula, order, guard, units=list(inputs.values()))
        rows = rows.where("value is not null").withColumns({series: F.lit(name), "flag": F.lit("unknown"), "reason": F.when((F.col("skipped") > 0) & F.lit(reason != ""), reason)})
        found = rows if found is None else found.unionByName(rows)
    return found


def observed(points: DataFrame, series: str) -> DataFrame:
    """Of each series: count, dates, extremes, mean, first and last date, and the upper median of its values (the element at
    half the count). Approximate percentiles around the middle bracket it, those below are only counted, and only the few
    distinct values between are ordered, so a series with a third of all points is no long sort."""
    p = numeric(points)
    near = F.percentile_approx("value", [0.495, 0.505], 10_000)
    agg = p.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("n_dates"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), near.alias("_near"),
    )
    inner = p.select(series, "value").join(agg.select(series, "_near"), series)
    counted = inner.groupBy(series, F.when(F.col("value") >= F.col("_near")[0], F.least("value", F.col("_near")[1])).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(series).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    half = F.floor(F.sum("c").over(Window.partitionBy(series)) / 2)
    ranked = counted.select(series, "value", "c", upto.alias("upto"), half.alias("half"))
    median = ranked.where("half >= upto - c and half < upto").select(series, F.col("value").alias("median_value"))
    return agg.drop("_near").join(median, series)


def overview(points: DataFrame, owner: list[str], series: str, order: list[str]) -> DataFrame:
    """Of each owner: distinct draw dates, the last one, series, and of those drawn then how many are out of range now, newly out, and back
    in range; and the series furthest beyond its limit."""
    keys = [*owner, series]
    two = latest_two(points, keys, order)
    pick = lambda age, c: F.max(F.when(F.col("age") == age, F.col(c)))
    last = two.groupBy(*keys).agg(pick(1, "date").alias("date"), pick(1, "flag").alias("flag"), pick(2, "flag").alias("before"), pick(1, "value").alias("value"), pick(1, "ref_low").alias("low"), pick(1, "ref_high").alias("high"))
    draws = points.groupBy(*owner).agg(F.count_distinct("date").alias("draws"), F.max("date").alias("last_draw"))
    rows = last.join(draws, owner)
    now, out, was = F.col("date") == F.col("last_draw"), out_of_range(), F.coalesce(F.col("before").isin("high", "low"), F.lit(False))
    beyond = F.round(beyond_limit(F.col("value"), F.col("low"), F.col("high")), 6)
    return rows.groupBy(*owner, "draws", "last_draw").agg(
        F.count(F.lit(1)).alias("n_series"), F.count_if(now & out).alias("out_now"), F.count_if(now & out & ~was).alias("newly_out"), F.count_if(now & ~out & was).alias("returned"),
        F.max_by(series, F.when(now & out, F.struct(beyond, series))).alias("furthest"),
    )
