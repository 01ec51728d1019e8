"""Looking up code tables: evidence of units and materials as ranks, and the ranked lookup of a printed name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import material_prefix, name_keys, norm_key
from ..functions.numbers import unit_key

#: Kinds of quantity that a printed unit can carry, by the pattern of its key; the first that fits holds.
UNIT_PROPS = [
    (r"^(%|ratio|index)?$", ["NFr", "SFr", "MFr", "VFr", "CFr", "RelTime", "pH", "PrThr", "Prid", "ACnc", "Titr", "RelSCnc"]),
    (r"^mmol/mol$", ["SFr"]),
    (r"^[kmµnpf]?mol/(l|kg)$", ["SCnc"]),
    (r"^[kmµnp]?g/(l|dl|ml)$", ["MCnc"]),
    (r"kat/l$", ["CCnc"]),
    (r"^(m|k)?i?u/(l|ml)$|^(au|ru|arb\.j\.|u)/ml$|^arb\.j\.$", ["CCnc", "ACnc", "Titr"]),
    (r"^10\^\d+/l$|^/(µl|nl|l)$", ["NCnc"]),
    (r"^fl$", ["EntVol"]),
    (r"^pg$", ["EntMass"]),
    (r"^(s|min|minuta)$", ["Time"]),
    (r"^(kpa|mmhg)$", ["PPres"]),
    (r"/(d|24h|den)$", ["SRat", "MRat", "CRat"]),
    (r"^mm/(h|hod)$", ["LENGTH"]),
]
#: Row materials that are blood, and what the prefixes of names mean as row materials.
ROW_BLOOD = ["s", "p", "b"]
PREFIX_MATERIALS = {"s": ["s"], "p": ["p"], "b": ["b"], "u": ["u"], "du": ["du"], "sp": ["s", "p"], "pk": ["b"], "k": ["b"], "pe": ["b"], "fw": ["b"], "fu": ["du"], "su": ["du"]}


def code_unit_key(unit: Column) -> Column:
    """A unit as compared in code tables; empty for dimensionless ones, NULL for none."""
    return F.when(unit.isNotNull(), F.when(unit_key(unit).isin("1", "-"), "").otherwise(unit_key(unit)))


def unit_props(unit: Column) -> Column:
    """The kinds of quantity of a printed unit; empty if it can't be read, NULL if there is none."""
    key = code_unit_key(unit)
    found = F.when(unit.isNull(), None).when(unit.rlike(r"^\s*[GT]/l\s*$"), F.array(F.lit("NCnc")))
    for pattern, props in UNIT_PROPS:
        found = found.when(key.rlike(pattern), F.array(*map(F.lit, props)))
    return found.otherwise(F.array().cast("array<string>"))


def unit_score(row_unit: Column, row_prop: Column, printed: Column) -> Column:
    """2 for the row's unit, or % for a fraction without one; 1 for the same kind of quantity, no unit or an unreadable one; else 0."""
    want, have, props = code_unit_key(printed), code_unit_key(row_unit), unit_props(printed)
    fraction = (want == "%") & (F.coalesce(have, F.lit("")) == "") & F.endswith(row_prop, F.lit("Fr"))
    return F.when(want.isNull(), 1).when((have == want) | fraction, 2).when(F.size(props) == 0, 1).when(F.array_contains(props, row_prop), 1).otherwise(0)


def material_score(row_material: Column, code: Column) -> Column:
    """Of a row's material against a printed code (several joined by commas): 2 if it is one of them, 1 in the same family, 0 without
    evidence (none printed and a blood row, or a code that says nothing), -1 if they contradict."""
    means = F.create_map(*[x for k, v in PREFIX_MATERIALS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    want = F.flatten(F.transform(F.split(code, ","), lambda c: F.coalesce(F.try_element_at(means, c), F.array().cast("array<string>"))))
    blood = row_material.isin(ROW_BLOOD)
    family = F.exists(want, lambda w: w.isin(ROW_BLOOD) == blood)
    return F.when(F.coalesce(code, F.lit("")) == "", F.when(blood, 0).otherwise(-1)).when(F.size(want) == 0, 0).when(F.array_contains(want, row_material), 2).when(family, 1).otherwise(-1)


def code_lookup(names: DataFrame, codes: DataFrame, top: int = 20) -> DataFrame:
    """The best `top` rows of a code table for each distinct (name, unit, material) of names: rows under one of the name's keys
    whose material doesn't contradict, by the full key (3) or another (2), unit, material, serum first and formula variants
    last; ties by id. codes: id, label (any of its names), unit, prop, material, method."""
    asked = names.select("name", "unit", "material").distinct()
    keys = asked.select("name", "unit", "material", F.posexplode(name_keys(F.col("name"))).alias("place", "key"))
    table = codes.select(norm_key(F.col("label")).alias("key"), "id", F.col("unit").alias("row_unit"), "prop", F.col("material").alias("row_material"), "method").where("key <> ''").distinct()
    met = keys.join(table, "key")
    material = material_score(F.col("row_material"), F.coalesce(material_prefix(F.col("name")), F.col("material")))
    met = met.withColumns({"unit_rank": unit_score(F.col("row_unit"), F.col("prop"), F.col("unit")), "material_rank": material}).where("material_rank >= 0")
    score = F.when(F.col("place") == 0, 3).otherwise(2) + F.col("unit_rank") + F.col("material_rank") + F.when(F.col("row_material") == "s", 0.1).otherwise(0.0) - F.when(F.col("method").isNotNull(), 0.2).otherwise(0.0)
    best = met.groupBy("name", "unit", "material", "id").agg(F.round(F.max(score), 6).alias("score"))
    w = Window.partitionBy("name", "unit", "material").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def specimen_agrees(entry_material: Column, code_material: Column, strict: bool = True) -> Column:
    """Whether a code's specimen suits an entry's: the same one; leniently also any of blood for blood, and whatever the entry
    doesn't say."""
    same = entry_material == code_material
    if strict:
        return F.coalesce(same, F.lit(False))
    return F.coalesce(same | (entry_material.isin(ROW_BLOOD) & code_material.isin(ROW_BLOOD)), F.lit(True))


def mapped_by_codes(names: DataFrame, codes: DataFrame, linked: DataFrame) -> DataFrame:
    """name, unit, material, code, canonical_id and confidence of each distinct name: the lookup's first row, if the second is
    behind it; high where that code is linked (code, canonical_id) to an entry; NULL where it has to be asked elsewhere."""
    ranked = code_lookup(names, codes, top=2)
    best = ranked.groupBy("name", "unit", "material").agg(F.max("score").alias("top"), F.min("score").alias("next"), F.count(F.lit(1)).alias("n"), F.min_by("id", "rank").alias("code"))
    sure = best.select("name", "unit", "material", F.when((F.col("n") == 1) | (F.col("next") < F.col("top")), F.col("code")).alias("code"))
    asked = names.select("name", "unit", "material").distinct()
    same = (asked["name"] == sure["name"]) & asked["unit"].eqNullSafe(sure["unit"]) & asked["material"].eqNullSafe(sure["material"])
    found = asked.join(sure, same, "left").select(asked["name"], asked["unit"], asked["material"], "code")
    found = found.join(linked, "code", "left")
    return found.select("name", "unit", "material", "code", "canonical_id", F.when(F.col("canonical_id").isNotNull(), "high").alias("confidence"))
