"""What an answer is founded on: reports of points, notes of visits, documents with their pages, and cleaned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_of_point(points: DataFrame, reports: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """points (owner, report_id, date) with found_report and how it was found: by its id, else the first report of the owner on
    that date (in `order`), else none."""
    ids = reports.select(owner, F.col("report_id"), F.col("report_id").alias("_a")).distinct()
    days = reports.where("date is not null").groupBy(owner, "date").agg(F.min_by("report_id", F.struct(*order)).alias("_b"))
    met = points.join(ids, [owner, "report_id"], "left").join(days, [owner, "date"], "left")
    via = F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "date")
    return met.select(*points.columns, F.coalesce("_a", "_b").alias("found_report"), via.alias("via"))


def cited_rows(points: DataFrame, rows: DataFrame) -> DataFrame:
    """points (found_report, canonical_id, display_name, value_raw, unit) with the page of the printed row and a label: name, value as
    printed and unit of the report's first such row, else of the point. A row that isn't found is cited without a page.
    rows: report_id, canonical_id, ord, value_raw, unit, page."""
    first = rows.groupBy(F.col("report_id").alias("found_report"), "canonical_id").agg(F.min_by(F.struct("value_raw", "unit", "page"), "ord").alias("_m"))
    met = points.join(first, ["found_report", "canonical_id"], "left")
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    label = F.concat_ws(" ", part(F.col("display_name")), part(F.coalesce("_m.value_raw", "value_raw")), part(F.coalesce("_m.unit", "unit")))
    return met.select(*points.columns, label.alias("label"), F.coalesce("_m.page", F.lit(1)).alias("page"), F.col("_m").isNotNull().alias("located"))


def note_of_point(points: DataFrame, visits: DataFrame, documents: DataFrame) -> DataFrame:
    """points (visit_id) with the document of their visit's note; without a visit, note or document it is NULL: an uncited point,
    never an invented source. visits: visit_id, note_id; documents: doc_id and what is wanted of them."""
    notes = visits.where("note_id is not null").select("visit_id", F.col("note_id").alias("doc_id"))
    return points.join(notes.join(documents, "doc_id"), "visit_id", "left")


def listed_documents(documents: DataFrame, owner: str) -> DataFrame:
    """doc_id, date, kind and title of each owner's documents, without their texts."""
    return documents.select(owner, "doc_id", "doc_date", "kind", "title")


def owned_documents(requests: DataFrame, documents: DataFrame, pages: DataFrame, owner: str) -> DataFrame:
    """requests (request_id, owner, doc_id) with found, title and the number and list of its pages in order: a document of
    another owner is refused in the same manner as one that doesn't exist."""
    sheets = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "image_url"))), lambda p: p["image_url"]).alias("pages"))
    own = documents.select(F.col("doc_id"), F.col(owner), "title", F.lit(True).alias("_found")).join(sheets, "doc_id", "left")
    met = requests.join(own, ["doc_id", owner], "left")
    return met.select("request_id", owner, "doc_id", F.coalesce("_found", F.lit(False)).alias("found"), "title", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.array_join("pages", ",").alias("pages"))


def scrubbed(text: Column, known: Column | None = None) -> Column:
    """A text without internal references: the known ones (an array) always, others only if they have a digit; runs of blanks
    become one."""
    out = text
    if known is not None:
        out = F.aggregate(F.filter(known, lambda r: F.coalesce(r != "", F.lit(False))), out, lambda t, r: F.replace(t, r, F.lit("")))
    return F.regexp_replace(F.regexp_replace(out, r"\bp-[a-z0-9-]*\d[a-z0-9-]*\b", ""), r"[ \t]{2,}", " ")


def cited_changes(changes: DataFrame, most: int = 6) -> DataFrame:
    """changes (with rank) and whether each is cited: only the first ones are."""
    return changes.withColumn("cited", F.col("rank") <= most)


def followups(tail: Column, most: int = 3, longest: int = 200) -> Column:
    """The questions in the JSON list of a text's end: strings only, trimmed, of at most `longest` signs, once whatever the case, the
    first `most`; none if there is no whole list."""
    inner = F.regexp_extract(tail, r"(?s)(\[.*\])", 1)
    items = F.try_variant_get(F.try_parse_json(inner), "$", "array<variant>")
    said = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.trim(F.try_variant_get(v, "$", "string")))
    fit = F.filter(said, lambda q: (q != "") & (F.length(q) <= longest))
    seen = lambda so_far, q: F.exists(so_far, lambda x: F.lower(x) == F.lower(q))
    once = F.aggregate(fit, F.array().cast("array<string>"), lambda so_far, q: F.when(seen(so_far, q), so_far).otherwise(F.concat(so_far, F.array(q))))
    return F.coalesce(F.slice(once, 1, most), F.array().cast("array<string>"))
