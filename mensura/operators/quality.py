"""Scoring against truth, integrity, cohorts, visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import BLOOD, MATERIALS, material_prefix, norm_key
from ..functions.text import strip_marks
from .rows import bare, printed_runs


def scored(truth: DataFrame, arm: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Truth and an arm met by keys and occurrence: matched, mismatch, missing, extra."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    a, b = nth(truth).select(*keys, "nth", F.struct(value).alias("t")), nth(arm).select(*keys, "nth", F.struct(value).alias("a"))
    both = a.join(b, [*keys, "nth"], "full_outer")
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("t").isNull(), "extra").when(F.col(f"t.{value}").eqNullSafe(F.col(f"a.{value}")), "matched").otherwise("mismatch")
    return both.select(*keys, "nth", verdict.alias("verdict"))


def paired_by_value(truth: DataFrame, arm: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Truth and an arm met inside keys, equal values first: the nth row of a value with the nth of that value, then what is left in order (ord).
    keys, truth_ord, arm_ord, truth and arm (their values), verdict as in scored. Null keys and values equal themselves; equal ords are
    ordered by value. So no row that has its value on the other side is given to another."""

    def round_of(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("_ord", "_value"))
        one = a.withColumn("_nth", nth).withColumns({"_t": F.lit(True), "truth_ord": F.col("_ord"), "truth": F.col("_value")}).drop("_ord")
        two = b.withColumn("_nth", nth).withColumns({"_a": F.lit(True), "arm_ord": F.col("_ord"), "arm": F.col("_value")}).drop("_ord")
        two = two.select(*(F.col(c).alias(f"{c}_b") for c in [*keys, "_value", "_nth"]), "_a", "arm_ord", "arm")
        met = one.join(two, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in [*by, "_nth"]], "full_outer")
        return met.select(*(F.when(F.col("_t"), F.col(k)).otherwise(F.col(f"{k}_b")).alias(k) for k in keys), "_t", "_a", "truth_ord", "arm_ord", "truth", "arm")

    slim = lambda df: df.select(*keys, F.col("ord").alias("_ord"), F.col(value).alias("_value"))
    equal = round_of(slim(truth), slim(arm), [*keys, "_value"])
    left = lambda has, hasnt, side: equal.where(F.col(has) & F.col(hasnt).isNull()).select(*keys, F.col(f"{side}_ord").alias("_ord"), F.col(side).alias("_value"))
    rest = round_of(left("_t", "_a", "truth"), left("_a", "_t", "arm"), keys)
    verdict = F.when(F.col("_a").isNull(), "missing").when(F.col("_t").isNull(), "extra").when(F.col("truth").eqNullSafe(F.col("arm")), "matched").otherwise("mismatch")
    both = equal.where("_t and _a").unionByName(rest)
    return both.select(*keys, "truth_ord", "arm_ord", "truth", "arm", verdict.alias("verdict"))


def confusion(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Counts of a yes-or-no rule against truth."""
    t, f = F.col(truth), F.col(found)
    return rows.agg(F.count_if(t & f).alias("caught"), F.count_if(t & ~f).alias("missed"), F.count_if(~t & f).alias("false_alarms"), F.count_if(~t & ~f).alias("clean"))


def unresolved(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose reference resolves to nothing; an empty result is what a sound store gives."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def cohort(summaries: DataFrame, patients: DataFrame, key: str, direction: str = "any", flag: str = "any", top: int = 25) -> DataFrame:
    """Summaries of known patients, filtered by direction and flag (`any`, or a value that isn't known, filters nothing), the latest
    first."""
    rows = summaries.join(patients, key)
    if direction in ("rising", "falling", "stable", "single"):
        rows = rows.where(F.col("direction") == direction)
    if flag in ("high", "low", "normal"):
        rows = rows.where(F.col("last_flag") == flag)
    return rows.orderBy(F.desc("last_date"), key, "series").limit(top)


def visit_counts(visits: DataFrame, points: DataFrame, owner: str, day: str) -> DataFrame:
    """Per visit: readings of its day, those with any flag but normal (unknown too), and those high or low; 0 without readings."""
    counts = points.groupBy(owner, F.col("date").alias(day)).agg(F.count(F.lit(1)).alias("labs"), F.count_if(F.col("flag") != "normal").alias("not_normal"), F.count_if(F.col("flag").isin("high", "low")).alias("out_of_range"))
    return visits.join(counts, [owner, day], "left").na.fill(0, ["labs", "not_normal", "out_of_range"])


#: Words of names, values and headings that put a row outside of blood results.
ANTHROPOMETRIC = r"\b(?:hmotnost|hmotnosti|vaha|vahy|vyska|vysky|telesna)\b"
AUXILIARY = r"\b(?:separace|separacia)\b.*\b(?:sera|seru)\b|\bpomocne\b"
TOXICOLOGY = r"\btoxikolog"
RECEIPT = r"^(?:prijato|prijate|prijata|prijaty|dorucen)"
#: Fixed value: a complete printed interval.
INTERVAL = r"-?\d+(?:[.,]\d+)?\s*(?:-|–|—|až)\s*-?\d+(?:[.,]\d+)?"


def scope_exclusion() -> Column:
    """Of a row (raw_name, value_raw, unit_raw, ref_range_raw, section, material): why it is no blood result, or NULL: receipt,
    anthropometric, auxiliary, toxicology, material (its name's code, else the printed material, isn't blood)."""
    words = lambda c: F.trim(F.regexp_replace(strip_marks(F.lower(F.coalesce(F.col(c), F.lit("")))), r"[^\p{L}\p{N}]+", " "))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    prefix = material_prefix(F.col("raw_name"))
    code = F.coalesce(F.when(prefix.isin(MATERIALS), prefix), F.col("material"))
    foreign = ~F.exists(F.split(code, ","), lambda m: m.isin(BLOOD))
    return (
        F.when(words("value_raw").rlike(RECEIPT) & blank("unit_raw") & blank("ref_range_raw"), "receipt").when(words("raw_name").rlike(ANTHROPOMETRIC), "anthropometric")
        .when(words("raw_name").rlike(AUXILIARY) | words("section").rlike(AUXILIARY), "auxiliary").when(words("section").rlike(TOXICOLOGY), "toxicology").when(foreign, "material")
    )


def fabricated(rows: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame:
    """page_id, ord, field and value of what a reader has given (rows: page_id, ord and fields) and no row of its page (page_id, cells)
    prints, as one cell or as adjacent ones, whatever the marks and blanks."""
    said = rows.select("page_id", "ord", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    said = said.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("_bare", bare(F.col("value")))
    # what a row prints is spelt once, not once for each value that is looked for on it
    printed = pages.select(F.col("page_id").alias("_page"), printed_runs(F.col("cells")).alias("_runs"))
    met = (F.col("page_id") == F.col("_page")) & (F.col("_bare") != "") & F.array_contains("_runs", F.col("_bare"))
    return said.join(printed, met, "left_anti").select("page_id", "ord", "field", "value")


def interval_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(INTERVAL))


def two_values(value: Column) -> Column:
    """Whether a cell has two numbers where one is expected; dates, intervals and groups of thousands are one thing."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(raw, r"[!*↑↓<>]", " "), r"(\d)\s(?=\d{3}(?!\d))", "$1")
    date = raw.rlike(r"\d{1,4}\s*[./]\s*\d{1,2}\s*[./]\s*\d{2,4}")
    return ~date & (interval_count(raw) == 0) & (F.regexp_count(bare, F.lit(r"-?\d+(?:[.,]\d+)?")) >= 2)


def merged_rows(arm: DataFrame, truth: DataFrame) -> DataFrame:
    """page_id, ord and reasons (joined by commas) of an arm's rows (page_id, ord, raw_name, value_raw, ref_range_raw) that fuse two printed
    rows: range (two intervals), value (two numbers), name (two names that the page's truth has, the whole name being none)."""
    keys = truth.select("page_id", norm_key(F.col("raw_name")).alias("key")).where("key <> ''").distinct()
    words = F.split(F.trim(F.coalesce("raw_name", F.lit(""))), r"\s+")
    halves = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(norm_key(F.array_join(F.slice(words, 1, i), " ")).alias("left"), norm_key(F.array_join(F.slice(words, i + 1, F.size(words)), " ")).alias("right"))))
    cut = arm.select("page_id", "ord", norm_key(F.col("raw_name")).alias("key"), F.explode(halves).alias("h")).select("page_id", "ord", "key", "h.left", "h.right").where("left <> '' and right <> '' and left <> right")
    side = lambda c: keys.select("page_id", F.col("key").alias(c))
    fused = cut.join(side("left"), ["page_id", "left"]).join(side("right"), ["page_id", "right"]).join(side("key"), ["page_id", "key"], "left_anti").select("page_id", "ord").distinct().withColumn("_name", F.lit(True))
    rows = arm.join(fused, ["page_id", "ord"], "left")
    reasons = F.array_join(F.filter(F.array(F.when(interval_count(F.col("ref_range_raw")) >= 2, "range"), F.when(two_values(F.col("value_raw")), "value"), F.when(F.col("_name"), "name")), lambda r: r.isNotNull()), ",")
    return rows.select("page_id", "ord", reasons.alias("reasons")).where("reasons <> ''")
