"""Decisions about names: unmapped and weak matches, verdicts, the gate for an external model's answers, changes of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import MATERIALS, alias_key, material_prefix, norm_key
from ..functions.numbers import unit_key
from ..functions.printing import slug


def unmapped(rows: DataFrame) -> DataFrame:
    """Rows (report_id, ord, date, canonical_id, raw_name, unit_raw, value, ref_low, ref_high, material) without an entry, by printed name: the
    first unit, interval and material that any row states, in order, and the number of occurrences and of dates."""
    at = F.struct("report_id", "ord")
    pair = F.when(F.col("ref_low").isNotNull() & F.col("ref_high").isNotNull(), F.struct("ref_low", "ref_high"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    found = rows.where(F.col("canonical_id").isNull()).groupBy("raw_name").agg(
        F.min_by("unit_raw", at).alias("unit_raw"), first(pair).alias("r"), first(F.col("material")).alias("material"), F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("n_dates"),
        F.count("value").alias("n_values"), F.avg("value").alias("mean"),
    )
    return found.select("raw_name", "unit_raw", F.col("r.ref_low").alias("low"), F.col("r.ref_high").alias("high"), "material", "n", "n_dates", "n_values", "mean")


def weak_matches(rows: DataFrame, catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows matched by name whose unit or material code the entry doesn't have, one per (lab, name, unit), unless a scoped alias has
    decided about them. catalogue: canonical_id, canonical_unit, synonyms, other_units."""
    taken = aliases.select(alias_key(F.col("alias_lab"), F.col("alias_name"), F.col("alias_unit")).alias("_k")).distinct()
    none = F.lit(None).cast("string")
    # rows printed alike are decided once
    left = rows.where(F.col("canonical_id").isNotNull()).groupBy("lab", "raw_name", "unit_raw", "canonical_id").agg(F.count(F.lit(1)).alias("_n"))
    for lab, unit in ((F.col("lab"), F.col("unit_raw")), (F.col("lab"), none), (none, F.col("unit_raw"))):
        left = left.join(taken, alias_key(lab, F.col("raw_name"), unit) == F.col("_k"), "left_anti")
    both = left.join(catalogue.select("canonical_id", "canonical_unit", "synonyms", "other_units"), "canonical_id")
    code, unit, own = material_prefix(F.col("raw_name")), unit_key(F.col("unit_raw")), unit_key(F.col("canonical_unit"))
    known = (unit == "") | (unit == own) | F.exists("other_units", lambda u: unit_key(u) == unit)
    odd = code.isNotNull() & ~code.isin(MATERIALS) & ~F.array_contains("synonyms", F.col("raw_name"))
    why = F.when(odd, "material").when(~known, "unit")
    return both.withColumn("why", why).where("why is not null").groupBy("lab", "raw_name", "unit_raw").agg(F.min("canonical_id").alias("canonical_id"), F.min("why").alias("why"), F.sum("_n").alias("n"))


def _is(c: Column, value: bool) -> Column:
    return F.coalesce(c == value, F.lit(False))


def verdict(name_weak: Column, unit: Column, span: Column, value: Column, material: Column, named_by_model: bool = False) -> Column:
    """contradicted if any known sign speaks against it, recommended if one speaks for it, else possible; NULL is neither."""
    signs = (unit, span, value, material)
    against = F.lit(False) if named_by_model else F.coalesce(name_weak, F.lit(False))
    for s in signs:
        against = against | _is(s, False)
    for_it = F.lit(False)
    for s in signs:
        for_it = for_it | _is(s, True)
    return F.when(against, "contradicted").when(for_it, "recommended").otherwise("possible")


def may_apply(unit: Column, span: Column, value: Column, material: Column) -> Column:
    """Whether a candidate that a model has named may be filed without asking: its unit is known to agree, and nothing speaks
    against it."""
    return _is(unit, True) & ~_is(span, False) & ~_is(value, False) & ~_is(material, False)


def accepted_answers(answers: DataFrame, asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Of a model's answers (ord, name, canonical_id, confidence): the first one for each name that was asked, if its entry exists. Quotes
    around a name are tolerated."""
    bare = F.trim(F.regexp_replace("name", "^[\"'„“”]+|[\"'„“”]+$", ""))
    rows = answers.withColumn("name", bare).join(asked.select("name").distinct(), "name", "left_semi").join(catalogue.select("canonical_id"), "canonical_id", "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).where("_n = 1").drop("_n")


def gated(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """apply or ask for each accepted answer: applied if it is sure and evidence (name, canonical_id, unit_match, range_match,
    value_ok, material_match) allows it."""
    rows = answers.join(evidence, ["name", "canonical_id"], "left")
    ok = (F.col("confidence") == "high") & may_apply(F.col("unit_match"), F.col("range_match"), F.col("value_ok"), F.col("material_match"))
    return rows.withColumn("decision", F.when(ok, "apply").otherwise("ask"))


def rematched(rows: DataFrame, index: DataFrame, splits: DataFrame) -> DataFrame:
    """Stored rows against a newer catalogue: rows without an entry are tried again; rows of an entry that was split (canonical_id,
    split_from) move to the new one if their name is its own; others stay."""
    out = rows.withColumn("_k", norm_key(F.col("raw_name"))).join(index.select(F.col("key").alias("_k"), F.col("id").alias("_id")), "_k", "left")
    out = out.join(splits.select(F.col("canonical_id").alias("_id"), F.col("split_from").alias("_from")), "_id", "left")
    new = F.when(F.col("canonical_id").isNull(), F.col("_id")).when(F.col("_from") == F.col("canonical_id"), F.col("_id")).otherwise(F.col("canonical_id"))
    return out.select(*[c for c in rows.columns if c != "canonical_id"], new.alias("canonical_id"), (~new.eqNullSafe(F.col("canonical_id"))).alias("changed"))


def overlaid(index: DataFrame, taught: DataFrame, forgotten: DataFrame, removed: DataFrame) -> DataFrame:
    """A name index with learnt names (name, id) over it, without forgotten ones (only learnt names can be) and without removed
    entries (id)."""
    learnt = taught.join(forgotten.select("name"), "name", "left_anti").select(norm_key(F.col("name")).alias("key"), "id", F.lit(1).alias("p"))
    rows = index.select("key", "id", F.lit(0).alias("p")).unionByName(learnt).join(removed.select("id"), "id", "left_anti")
    return rows.groupBy("key").agg(F.max_by("id", F.struct("p", "id")).alias("id"))


def founded_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Identifiers for new entries: the name's slug, with a number behind it where it is taken or given before."""
    base = names.withColumn("base", slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("ord"))
    used = taken.select(F.regexp_replace("canonical_id", r"_\d+$", "").alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("used"))
    rows = base.withColumn("n", n).join(used, "base", "left").withColumn("n", F.col("n") + F.coalesce("used", F.lit(0)))
    return rows.select("name", "ord", F.when(F.col("n") > 1, F.concat_ws("_", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("canonical_id"))


def by_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """rows (code) with the entry of a code list (id, methods, loinc): by its id, by a method's code, or by LOINC, in that order."""
    keys = codes.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("p"), F.col("id").alias("code"))), F.transform("methods", lambda m: F.struct(F.lit(1).alias("p"), m.alias("code"))), F.transform("loinc", lambda m: F.struct(F.lit(2).alias("p"), m.alias("code"))))).alias("k"))
    first = keys.groupBy("k.code").agg(F.min_by("id", F.struct("k.p", "id")).alias("id"))
    return rows.join(first, "code", "left")



def still_to_ask(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct names that haven't been asked about."""
    return names.select("name").distinct().join(asked.select("name"), "name", "left_anti")


def unrecognised(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows without an entry, or with one that isn't in the catalogue."""
    return rows.join(entries.select("canonical_id"), "canonical_id", "left_anti")


def aliases_in_use(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Scoped aliases that hold for a loaded row: by lab and unit, by lab, or by unit."""
    none = F.lit(None).cast("string")
    scopes = F.array(*[alias_key(lab, F.col("raw_name"), unit) for lab, unit in ((F.col("lab"), F.col("unit_raw")), (F.col("lab"), none), (none, F.col("unit_raw")))])
    keys = rows.select("lab", "raw_name", "unit_raw").distinct().select(F.explode(scopes).alias("_k")).distinct()
    return aliases.withColumn("_k", alias_key(F.col("alias_lab"), F.col("alias_name"), F.col("alias_unit"))).join(keys, "_k", "left_semi").drop("_k")


def name_decisions(aliases: DataFrame, learnt: DataFrame, rows: DataFrame) -> DataFrame:
    """What has been decided about names: aliases in use, and learnt names (name, id) that a row is filed under, unless an alias has the
    same name; by lab (blank last), then name."""
    own = aliases_in_use(aliases, rows).select(F.col("alias_lab").alias("lab"), F.col("alias_name").alias("name"), F.col("target").alias("id"), F.lit("alias").alias("kind"))
    filed = rows.select(norm_key(F.col("raw_name")).alias("_k"), F.col("canonical_id").alias("id")).distinct()
    names = learnt.withColumn("_k", norm_key(F.col("name"))).join(filed, ["_k", "id"], "left_semi")
    names = names.join(own.select(norm_key(F.col("name")).alias("_k")).distinct(), "_k", "left_anti").select(F.lit(None).cast("string").alias("lab"), "name", "id", F.lit("learnt").alias("kind"))
    every = own.unionByName(names)
    return every.orderBy(F.coalesce(F.trim("lab"), F.lit("")) == "", "lab", "name")


def rows_under(rows: DataFrame, entry: str) -> DataFrame:
    """The distinct (name, lab, unit) that are filed under an entry, with the first row of each."""
    key = alias_key(F.col("lab"), F.col("raw_name"), F.col("unit_raw"))
    return rows.where(F.col("canonical_id") == entry).groupBy(key.alias("scope")).agg(F.min_by(F.struct("lab", "raw_name", "unit_raw"), F.struct("report_id", "ord")).alias("r"), F.count(F.lit(1)).alias("n")).select("scope", "r.*", "n")
