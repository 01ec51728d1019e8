"""What is worth saying about an owner's series, and the sentences that say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.printing import plural, printed_date, printed_number
from .series import numeric, shapes


def _out(flag: str) -> Column:
    return F.col(flag).isin("high", "low")


def picks(points: DataFrame, owner: list[str], series: str, order: list[str], suspect: str | None = None) -> DataFrame:
    """owner, kind, place, series, first_value, last_value, rel_change and out_streak of what is picked, the greatest change first:
    out (all that are out of range at the owner's last draw), longest (of these the longest run of three or more), rising and
    falling (moving away from their range over more than a day, two each), drift (if there is none of these: the first inside its
    range that moves one way by 15 % or more), returned (out at first, inside now; two), recovering (if none returned: the first
    still out that moves back by 5 % or more)."""
    keys, at = [*owner, series], F.struct(*order)
    ends = numeric(points, suspect).groupBy(*keys).agg(F.min_by("flag", at).alias("first_flag"), F.max_by("flag", at).alias("last_flag"), F.max_by("date", at).alias("last_date"), F.max_by("value", at).alias("_last"))
    draws = points.groupBy(*owner).agg(F.max("date").alias("draw"))
    rows = ends.join(shapes(numeric(points, suspect), keys, order), keys, "left").join(draws, owner)
    size = F.coalesce(F.abs("rel_change"), F.abs("change"), F.lit(0.0))
    away = ((F.col("last_flag") == "high") & (F.col("direction") == "rising")) | ((F.col("last_flag") == "low") & (F.col("direction") == "falling"))
    back = ((F.col("last_flag") == "high") & (F.col("direction") == "falling")) | ((F.col("last_flag") == "low") & (F.col("direction") == "rising"))
    now = _out("last_flag") & (F.col("last_date") == F.col("draw"))
    streak = F.when(now, F.coalesce("out_streak", F.lit(1)))
    shaped, worse = F.col("n").isNotNull(), F.coalesce(away & (F.col("span_days") > 0), F.lit(False))
    rows = rows.withColumns({"size": size, "first_value": F.coalesce("first_value", "_last"), "last_value": F.coalesce("last_value", "_last"), "streak": streak})
    kinds = {
        "out": now, "longest": now & (streak >= 3), "rising": worse & (F.col("direction") == "rising"), "falling": worse & (F.col("direction") == "falling"),
        "drift": shaped & ~_out("last_flag") & F.col("monotone") & (size >= 0.15), "returned": shaped & _out("first_flag") & ~_out("last_flag"), "recovering": shaped & back & (size >= 0.05),
    }
    fits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull())
    rows = rows.withColumn("kind", F.explode(fits))
    whole = Window.partitionBy(*owner)
    has = lambda *ks: F.max(F.col("kind").isin(*ks).cast("int")).over(whole) == 1
    rows = rows.withColumns({"_worse": has("rising", "falling"), "_returned": has("returned")})
    rows = rows.where(~((F.col("kind") == "drift") & F.col("_worse")) & ~((F.col("kind") == "recovering") & F.col("_returned")))
    first = F.when(F.col("kind") == "longest", F.col("streak")).otherwise(F.lit(0))
    place = F.row_number().over(Window.partitionBy(*owner, "kind").orderBy(F.desc(first), F.desc("size"), series))
    most = F.when(F.col("kind").isin("rising", "falling", "returned"), 2).when(F.col("kind") == "out", F.lit(2**31 - 1)).otherwise(1)
    rows = rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)
    return rows.select(*owner, "kind", "place", series, "first_value", "last_value", "rel_change", F.coalesce("out_streak", F.lit(1)).cast("long").alias("out_streak"))


def _joined(names: Column) -> Column:
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" a "), F.element_at(names, -1)))


def sentences(points: DataFrame, owner: list[str], series: str, order: list[str], names: DataFrame, suspect: str | None = None) -> DataFrame:
    """owner and sentences (an array) that describe the owner's last draw and whole series; names: series, name and unit. What was
    held back at the last draw is named, so nothing is ever told to be in range that isn't known to be."""
    found = picks(points, owner, series, order, suspect).join(names, series, "left").withColumn("name", F.coalesce("name", series))
    percent = F.round(F.abs("rel_change") * 100, 0).cast("int")
    moved = F.when(percent > 0, F.concat(F.when(F.col("rel_change") > 0, "+").otherwise("−"), percent.cast("string"), F.lit(" % "))).otherwise("")
    unit = F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    item = F.concat("name", F.lit(" "), moved, F.lit("("), printed_number(F.col("first_value")), F.lit(" → "), printed_number(F.col("last_value")), unit, F.lit(")"))
    said = F.struct("place", F.col(series).alias("series"), "name", item.alias("item"), "out_streak")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, said))).alias(f"_{kind}")
    kinds = found.groupBy(*owner).agg(*[of(k) for k in ("out", "longest", "rising", "falling", "drift", "returned", "recovering")])
    dated = points.where("date is not null")
    draws = dated.groupBy(*owner).agg(F.max("date").alias("_draw"), F.count_distinct("date").alias("_draws"))
    shaped = numeric(points, suspect).groupBy(*owner, series).count().where("count > 1").groupBy(*owner).agg(F.count(F.lit(1)).alias("_shapes"))
    rows = draws.join(kinds, owner, "left").join(shaped, owner, "left")
    if suspect:
        held = dated.where(F.col(suspect).isNotNull()).join(draws, owner).where(F.col("date") == F.col("_draw")).join(names, series, "left")
        rows = rows.join(held.groupBy(*owner).agg(F.array_sort(F.collect_set(F.coalesce("name", series))).alias("_held")), owner, "left")
    none = F.array().cast("array<string>")
    part = lambda k, f: F.coalesce(F.transform(f"_{k}", lambda x: x[f]), none)
    held = F.coalesce("_held", none) if suspect else none
    check = F.when(F.size(held) > 0, F.concat(F.lit(" "), plural(F.size(held), "hodnota", "hodnoty", "hodnot"), F.lit(" k ověření: "), _joined(held), F.lit("."))).otherwise("")
    longest = F.get("_longest", F.lit(0))
    shown = F.transform(F.slice(F.coalesce("_out", F.array().cast("array<struct<place:bigint,series:string,name:string,item:string,out_streak:bigint>>")), 1, 4), lambda x: F.when(x["series"] == longest["series"], F.concat(x["name"], F.lit(" ("), plural(x["out_streak"], "odběr", "odběry", "odběrů"), F.lit(" po sobě)"))).otherwise(x["name"]))
    more = F.size(part("out", "name")) - 4
    listed = F.when(more > 0, F.concat(F.array_join(shown, ", "), F.lit(" a další "), more.cast("string"))).otherwise(_joined(shown))
    on = printed_date(F.col("_draw"))
    state = (
        F.when(F.size(part("out", "name")) > 0, F.concat(F.lit("Mimo referenční rozmezí k poslednímu odběru "), on, F.lit(": "), listed, F.lit("."), check))
        .when(F.size(held) > 0, F.concat(F.lit("K poslednímu odběru "), on, F.lit(" žádná ověřená hodnota mimo referenční rozmezí."), check))
        .otherwise(F.concat(F.lit("K poslednímu odběru "), on, F.lit(" žádná hodnota mimo referenční rozmezí.")))
    )
    few = F.when(F.col("_draws") <= 1, "Zatím jediný odběr: popis vývoje až od druhého.").otherwise("Zatím žádný parametr se dvěma porovnatelnými měřeními.")
    line = lambda k, lead: F.when(F.size(part(k, "item")) > 0, F.concat(F.lit(lead), F.array_join(part(k, "item"), ", "), F.lit(".")))
    whole = " napříč celou sérií, ne jen mezi posledními dvěma odběry: "
    told = F.array(
        state, F.when(F.col("_shapes").isNull(), few), line("rising", f"Nárůst{whole}"), line("falling", f"Pokles{whole}"), line("drift", "Nejvýraznější dlouhodobý posun v rámci rozmezí: "),
        line("returned", "Zpět v referenčním rozmezí oproti prvnímu odběru: "), line("recovering", "Pohyb zpět k rozmezí, zatím mimo ně: "),
    )
    return rows.select(*owner, F.filter(told, lambda x: x.isNotNull()).alias("sentences"))
