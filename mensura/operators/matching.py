"""Resolving printed names against a catalogue: ordered keys, scoped aliases, scored suggestions, trigram shortlist.

A catalogue (canonical_id, display_name, synonyms, canonical_unit, ord) grows with the vocabulary, not with the measurements; Spark
broadcasts it by its own size threshold, and shuffles by key beyond it. Printed names are resolved once per distinct name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import abbreviation_key, alias_key, alias_place, alias_unit, compatible, dice, grams, leading_code, leading_code_key, material_prefix, norm_key
from ..functions.numbers import unit_key


def name_index(catalogue: DataFrame) -> DataFrame:
    """key and id: of entries that claim one key the last one has it."""
    names = catalogue.select("canonical_id", "ord", F.explode(F.array_distinct(F.concat(F.array("canonical_id", "display_name"), "synonyms"))).alias("name"))
    return names.select(norm_key(F.col("name")).alias("key"), "canonical_id", "ord").where("key <> ''").groupBy("key").agg(F.max_by("canonical_id", F.struct("ord", "canonical_id")).alias("id"))


def collisions(catalogue: DataFrame) -> DataFrame:
    """Keys that several entries claim."""
    names = catalogue.select("canonical_id", F.explode(F.concat(F.array("canonical_id", "display_name"), "synonyms")).alias("name"))
    found = names.groupBy(norm_key(F.col("name")).alias("key")).agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
    return found.where(F.size("ids") > 1)


def lookup(names: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """Distinct names with id and the rule that found it: 1 full key, 2 bracketed abbreviation, 3 the name behind a code, 4 a
    code and a name that agree."""
    rows = names.select(name).distinct()
    keys = F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("key")) for k, c in enumerate((norm_key(F.col(name)), abbreviation_key(F.col(name)), leading_code_key(F.col(name))), 1)])
    code, rest = leading_code(F.col(name))
    pair = F.when(code != "", F.array(norm_key(code), norm_key(rest)))
    single = rows.select(name, F.explode(keys).alias("k")).select(name, "k.*").where("key is not null").join(index, "key").groupBy(name).agg(F.min_by(F.struct("rule", "id"), "rule").alias("found"))
    both = rows.select(name, F.explode(pair).alias("key")).join(index, "key").groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n = 2 and low = high")
    found = rows.join(single, name, "left").join(both.select(name, F.lit(4).alias("rule4"), F.col("low").alias("id4")), name, "left")
    return found.select(name, F.coalesce("found.rule", "rule4").alias("rule"), F.coalesce("found.id", "id4").alias("id"))


def resolve(rows: DataFrame, index: DataFrame, aliases: DataFrame, lab: str = "lab", name: str = "raw_name", unit: str = "unit_raw", materials: DataFrame | None = None) -> DataFrame:
    """rows with canonical_id and how it was found: a scoped alias (this lab and unit, this lab, this unit; its NULL target is a
    hit that says no entry), else the catalogue, unless materials (id, material) contradict the name's code. Aliases of one key
    are one, with the last target in order. Each distinct (lab, name, unit) is resolved once, and each part of its keys is
    computed once; rows only meet the result."""
    scoped = aliases.select(alias_key(F.col("alias_lab"), F.col("alias_name"), F.col("alias_unit")).alias("_k"), "target")
    scoped = scoped.groupBy("_k").agg(F.max("target").alias("_t"))
    asked = rows.select(F.col(lab).alias("_lab"), F.col(name).alias("_name"), F.col(unit).alias("_unit")).distinct()
    named = asked.select("_name").distinct().withColumn("_n", norm_key(F.col("_name")))
    found = lookup(asked, "_name", index).withColumnRenamed("id", "_id")
    entry = F.col("_id")
    if materials is not None:
        found = found.join(materials.select(F.col("canonical_id").alias("_id"), F.col("material").alias("_m")), "_id", "left")
        entry = F.when(F.coalesce(compatible(material_prefix(F.col("_name")), F.col("_m")), F.lit(True)), F.col("_id"))
    named = named.join(found.select("_name", entry.alias("_id")), "_name", "left")
    asked = asked.join(named, "_name").withColumns({"_place": alias_place(F.col("_lab")), "_u": alias_unit(F.col("_unit"))})
    for k, (place, of) in enumerate((("_place", "_u"), ("_place", None), (None, "_u"))):
        key = F.concat_ws("|", F.col(place) if place else F.lit("*"), "_n", F.col(of) if of else F.lit("*"))
        side = scoped.select(F.col("_k").alias(f"_k{k}"), F.col("_t").alias(f"_t{k}"), F.lit(True).alias(f"_h{k}"))
        asked = asked.join(side, key == F.col(f"_k{k}"), "left")
    via = F.when(F.col("_h0"), "lab+unit").when(F.col("_h1"), "lab").when(F.col("_h2"), "unit").when(F.col("_id").isNotNull(), "catalogue")
    target = F.when(F.col("_h0"), F.col("_t0")).when(F.col("_h1"), F.col("_t1")).when(F.col("_h2"), F.col("_t2")).otherwise(F.col("_id"))
    answer = asked.select("_lab", "_name", "_unit", target.alias("canonical_id"), via.alias("via"))
    same = rows[lab].eqNullSafe(answer["_lab"]) & rows[name].eqNullSafe(answer["_name"]) & rows[unit].eqNullSafe(answer["_unit"])
    return rows.join(answer, same, "left").select(*[rows[c] for c in rows.columns], "canonical_id", "via")


def ranges_compatible(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """Whether two intervals overlap by 0.3 of their union or more; NULL if one isn't known."""
    overlap = F.least(high, high2) - F.greatest(low, low2)
    union = F.greatest(high, high2) - F.least(low, low2)
    # least and greatest skip NULLs, so that is asked first
    known = low.isNotNull() & high.isNotNull() & low2.isNotNull() & high2.isNotNull()
    return F.when(known, F.when(overlap <= 0, False).otherwise((union <= 0) | (overlap / union >= 0.3)))


def suggestions(unmapped: DataFrame, catalogue: DataFrame, top: int = 3, floor: float = 0.45, cutoff: float = 0.28) -> DataFrame:
    """The best `top` entries for each distinct (name, unit, low, high, mean, material) of unmapped: the likeness of the name to
    the likest of an entry's names, with the evidence of units, intervals, values and materials added; what can't be compared
    (NULL) adds nothing. A unit fits if it is the entry's, the observed one where the entry has none, or one that converts.
    catalogue: canonical_id, display_name, synonyms, canonical_unit, conversions (array of units), ref_low and ref_high (curated,
    else NULL), and what was observed: seen_unit, seen_low, seen_high, min_value, max_value, materials. Candidates share a pair
    of characters: without one, names are not alike, so an inverted list of pairs takes the place of a cross join."""
    names = unmapped.select("name", norm_key(F.col("name")).alias("key"), "unit", "low", "high", "mean", "material").where("key <> ''")
    own = catalogue.select("canonical_id", F.explode(F.array_distinct(F.concat(F.array("canonical_id", "display_name"), "synonyms"))).alias("own"))
    own = own.select("canonical_id", norm_key(F.col("own")).alias("ckey")).where("ckey <> ''").distinct()
    gram = lambda df, key: df.select(key).distinct().select(key, F.explode(F.array_distinct(grams(F.col(key), 2))).alias("gram"))
    pairs = gram(names, "key").join(gram(own, "ckey"), "gram").select("key", "ckey").distinct()
    inside = (F.length("key") >= 3) & (F.length("ckey") >= 3) & (F.contains(F.col("key"), F.col("ckey")) | F.contains(F.col("ckey"), F.col("key")))
    alike = pairs.select("key", "ckey", dice(F.col("key"), F.col("ckey")).alias("sim"), inside.alias("inside"))
    best = alike.join(own, "ckey").groupBy("key", "canonical_id").agg(F.max("sim").alias("name_sim"), F.bool_or("inside").alias("inside")).where(F.col("name_sim") >= cutoff)
    rows = names.join(best, "key").join(catalogue, "canonical_id")
    printed, own_unit = F.trim(F.coalesce(F.col("unit"), F.lit(""))) != "", unit_key(F.col("canonical_unit"))
    wanted = F.when(own_unit != "", own_unit).otherwise(unit_key(F.col("seen_unit")))
    fits = (unit_key(F.col("unit")) == wanted) | F.exists("conversions", lambda u: unit_key(u) == unit_key(F.col("unit")))
    unit = F.when(printed & ((wanted != "") | (F.col("canonical_unit") == "")), fits)
    curated = F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()
    span = ranges_compatible(F.col("low"), F.col("high"), F.when(curated, F.col("ref_low")).otherwise(F.col("seen_low")), F.when(curated, F.col("ref_high")).otherwise(F.col("seen_high")))
    value = F.when((F.col("mean") > 0) & (F.col("min_value") > 0), F.col("mean").between(F.col("min_value") / 3, F.col("max_value") * 3)).when(
        F.col("mean").isNotNull() & F.col("min_value").isNotNull(), F.col("mean").between(F.col("min_value") - F.abs("max_value"), F.col("max_value") + F.abs("max_value"))
    )
    known = F.col("material").isNotNull() & (F.size("materials") > 0)
    material = F.when(known, F.exists("materials", lambda m: F.coalesce(compatible(m, F.col("material")), F.lit(True))))
    weigh = lambda c, yes, no: F.when(c, yes).when(~c, no).otherwise(0.0)
    total = F.col("name_sim") + F.when(F.col("inside"), 0.15).otherwise(0.0) + weigh(unit, 0.2, -0.25) + weigh(span, 0.3, -0.6) + weigh(value, 0.1, -0.35) + weigh(material, 0.05, -0.4)
    rows = rows.withColumns({"score": F.round(total, 6), "name_sim": F.round("name_sim", 6), "unit_match": unit, "range_match": span, "value_ok": value, "material_match": material})
    rows = rows.where((F.col("name_sim") >= floor) | (F.col("score") >= 0.45))
    w = Window.partitionBy("name", "unit", "low", "high", "mean", "material").orderBy(F.desc("score"), "canonical_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("name", "canonical_id", "name_sim", "score", "unit_match", "range_match", "value_ok", "material_match", "rank")


def shortlist(names: DataFrame, vocabulary: DataFrame, top: int = 5) -> DataFrame:
    """The entries that share most trigrams with each distinct name: an inverted list joined by trigram, scored by Dice."""
    tri = lambda df, key, id_: df.select(id_, F.explode(F.array_distinct(grams(F.concat(F.lit(" "), norm_key(F.col(key)), F.lit(" ")), 3))).alias("gram"))
    a, b = tri(names.select("name").distinct(), "name", "name"), tri(vocabulary.select("id", "label").distinct(), "label", "id")
    sizes = lambda df, key, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    shared = a.join(b, "gram").groupBy("name", "id").agg(F.count(F.lit(1)).alias("shared")).join(sizes(a, "name", "na"), "name").join(sizes(b, "id", "nb"), "id")
    rows = shared.withColumn("score", F.round(2.0 * F.col("shared") / (F.col("na") + F.col("nb")), 6))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("name", "id", "shared", "score", "rank")
