"""Chart requests: a fixed set of fields, resolved against series, or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normal import in_window

_SPEC = "parameters array<string>, from string, to string, type string"


def listed(names: Column, most: int = 8) -> Column:
    """Names joined by commas, of more than `most` the first ones and a hint that there are others."""
    return F.when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" a další")))


def parsed_specs(rows: DataFrame, spec: str = "spec") -> DataFrame:
    """rows with parameters, from, to and type of a JSON request; other fields are dropped. parameters is NULL if the request is
    none: no JSON, no parameters, or a date that isn't YYYY-MM-DD (a window that was meant is never all time)."""
    rows = rows.withColumn("_s", F.from_json(spec, _SPEC))
    day = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    good = lambda c: F.coalesce(day(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(True))
    names = F.filter(F.transform("_s.parameters", lambda p: F.trim(p)), lambda p: F.coalesce(p != "", F.lit(False)))
    fine = good("_s.from") & good("_s.to") & (F.size(names) > 0)
    kind = F.when(F.col("_s.type") == "bar", "bar").otherwise("line")
    return rows.withColumns({"parameters": F.when(fine, names), "from": F.when(fine, day("_s.from")), "to": F.when(fine, day("_s.to")), "type": F.when(fine, kind)}).drop("_s")


def resolved_charts(specs: DataFrame, points: DataFrame, owner: str) -> DataFrame:
    """A row for each chart of a request (owner, spec_id, parameters, from, to, type), one chart for each unit, or one row with
    the reason of its refusal. points: owner, series, display_name, unit, date, value; parameters name a series or, whatever
    the case, its display name; repeated ones count once; a series needs two points with a number in the window.
    status: ok, or invalid, no data, not found, too few. missing and dropped are lists of names."""
    numeric = points.where("value is not null")
    series = points.groupBy(owner, "series").agg(F.min("display_name").alias("display_name"), F.min("unit").alias("unit"))
    asked = specs.where("parameters is not null").select(owner, "spec_id", "from", "to", "type", F.posexplode("parameters").alias("place", "name"))
    by_id = series.select(owner, F.col("series").alias("name"), F.col("series").alias("_a"))
    by_name = series.groupBy(owner, F.lower("display_name").alias("_low")).agg(F.min("series").alias("_b"))
    met = asked.join(by_id, [owner, "name"], "left").withColumn("_low", F.lower("name")).join(by_name, [owner, "_low"], "left")
    met = met.withColumn("series", F.coalesce("_a", "_b"))
    missing = met.where("series is null").groupBy(owner, "spec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("missing"))
    once = met.where("series is not null").groupBy(owner, "spec_id", "series").agg(F.min("place").alias("place"), F.first("from").alias("from"), F.first("to").alias("to"), F.first("type").alias("type"))
    inside = once.join(numeric.select(owner, "series", "date"), [owner, "series"], "left").withColumn("_in", in_window(F.date_format("date", "yyyy-MM-dd"), F.col("from"), F.col("to")))
    counted = inside.groupBy(owner, "spec_id", "series", "place", "type").agg(F.count_if(F.col("date").isNotNull() & F.col("_in")).alias("n")).join(series, [owner, "series"])
    ordered = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", F.col(c).alias("x"))))), lambda s: s["x"])
    drops = counted.groupBy(owner, "spec_id").agg(F.count_if(F.col("n") >= 2).alias("usable"), ordered(F.col("n") < 2, "display_name").alias("dropped"))
    charts = counted.where("n >= 2").groupBy(owner, "spec_id", "unit", "type").agg(ordered(F.lit(True), "series").alias("series"), F.sum("n").alias("points"), F.min("place").alias("_first"))
    any_data = series.select(owner).distinct().withColumn("_data", F.lit(True))
    out = specs.select(owner, "spec_id", F.col("parameters").isNull().alias("_bad")).join(any_data, owner, "left").join(missing, [owner, "spec_id"], "left").join(drops, [owner, "spec_id"], "left").join(charts, [owner, "spec_id"], "left")
    status = F.when(F.col("_bad"), "invalid").when(F.col("_data").isNull(), "no data").when(F.col("usable").isNull(), "not found").when(F.col("usable") == 0, "too few").otherwise("ok")
    number = F.row_number().over(Window.partitionBy(owner, "spec_id").orderBy("_first", "unit"))
    return out.select(
        owner, "spec_id", status.alias("status"), F.when(status == "ok", number).cast("long").alias("chart"), "unit", "type", F.array_join("series", ",").alias("series"), "points",
        F.when(F.col("_data").isNull(), "").otherwise(listed(F.coalesce("missing", F.array().cast("array<string>")))).alias("missing"), listed(F.coalesce("dropped", F.array().cast("array<string>"))).alias("dropped"),
    )
