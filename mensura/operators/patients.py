"""Identities, visits, context tables and a facade of named tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import birth_number
from ..functions.names import sorted_tokens
from ..functions.printing import printed_number, printed_range
from . import charts, quality, series
from .documents import all_tokens, search


def _person(rows: DataFrame, *also: str) -> DataFrame:
    """also, with what a person (person_id, person_name) is compared by: a valid birth number or NULL, and the name's folded tokens
    in order, NULL without any."""
    number = F.when(birth_number(F.col("person_id"))["valid"], F.regexp_replace("person_id", r"[\s/]", ""))
    name = sorted_tokens(F.coalesce("person_name", F.lit("")))
    rows = rows.select(*also, number.alias("_number"), name.alias("_name"))
    return rows.withColumn("_name", F.when(F.col("_name") != "", F.col("_name")))


def identity_check(incoming: DataFrame, loaded: DataFrame, session: str) -> DataFrame:
    """ok, mismatch or unverifiable for incoming reports (session, report_id, person_id, person_name) against the identities loaded in the
    session; ok if nothing is loaded. Two persons are the same or different by valid birth numbers if both have one, else by names if both
    have one, else unknown. A report meets the loaded numbers and names that equal its own, and of the others only whether there are any, so a
    session with many identities costs no more than its rows."""
    known = _person(loaded, session).distinct()
    bare = F.col("_number").isNull()
    numbers = known.where(~bare).select(session, "_number", F.lit(True).alias("_met")).distinct()
    names = known.where("_name is not null").groupBy(session, "_name").agg(F.bool_or(bare).alias("_bare"))  # _bare: of one without a number
    named = F.col("_name").isNotNull()
    any_of = known.groupBy(session).agg(F.bool_or(~bare).alias("_numbers"), F.bool_or(named).alias("_names"), F.bool_or(named & bare).alias("_bares"))
    rows = _person(incoming, session, "report_id").join(numbers, [session, "_number"], "left").join(names, [session, "_name"], "left").join(any_of, session, "left")
    same = F.when(bare, F.col("_bare").isNotNull()).otherwise(F.col("_met").isNotNull() | F.coalesce("_bare", F.lit(False)))
    other = F.when(bare, named & F.col("_names")).otherwise(F.col("_numbers") | (named & F.col("_bares")))
    found = rows.groupBy(session, "report_id").agg(F.bool_or(same).alias("same"), F.bool_or(other).alias("different"), F.bool_or(F.col("_names").isNotNull()).alias("loaded"))
    verdict = F.when(~F.col("loaded") | F.col("same"), "ok").when(F.coalesce("different", F.lit(False)), "mismatch").otherwise("unverifiable")
    return found.select(session, "report_id", verdict.alias("verdict"))


def visits(artifacts: DataFrame, owner: str, prefer: list[str]) -> DataFrame:
    """The days on which an owner has any artifact (owner, date, kind, id): what kinds there are, and the note that is preferred by its
    kind, then its id."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in prefer]), F.col("kind")), F.lit(0))
    found = artifacts.groupBy(owner, "date").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.count(F.lit(1)).alias("n"), F.min_by("id", F.when(rank > 0, F.struct(rank, "id"))).alias("note_id"),
    )
    return found.withColumn("number", F.row_number().over(Window.partitionBy(owner).orderBy("date")).cast("long"))


def context_lines(points: DataFrame, owner: str, series: str, order: list[str], most: int = 500) -> DataFrame:
    """Lines of text for each series: name, interval of the last point, dated values with their flags; a line (part, from 0) has at
    most `most` values, so a long series is several lines and no unbounded row."""
    at = F.struct(*order)
    said = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(": "), printed_number(F.col("value")), F.lit(" ("), F.col("flag"), F.lit(")"))
    w = Window.partitionBy(owner, series).orderBy(*order)
    rows = points.where("value is not null").withColumn("part", F.floor((F.row_number().over(w) - 1) / most).cast("long"))
    last = F.last(F.struct("ref_low", "ref_high")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("r", last).groupBy(owner, series, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), said.alias("s")))), lambda x: x["s"]).alias("s"), F.first("r").alias("r"))
    return rows.select(owner, series, "part", F.concat_ws(" | ", F.col(series), printed_range(F.col("r.ref_low"), F.col("r.ref_high")), F.array_join("s", "; ")).alias("line"))


class Tools:
    """Named queries with checked arguments; an unknown tool or argument is an error, a refusal is a row of its own."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[..., DataFrame], set[str]]] = {}

    def add(self, name: str, run: Callable[..., DataFrame], *arguments: str) -> None:
        self.known[name] = run, set(arguments)

    def run(self, name: str, **arguments) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self.known))}")
        call, allowed = self.known[name]
        if odd := set(arguments) - allowed:
            raise TypeError(f"{name} has no {', '.join(sorted(odd))}")
        return call(**arguments)


def patient_tools(data: dict[str, DataFrame], order: list[str]) -> Tools:
    """The ten tools over tables: points (patient_id, series, display_name, unit, date, value, flag, ref_low, ref_high and order), patients
    (patient_id, name, birth_year), documents (doc_id, owner, doc_date, kind, title, text), performance (patient_id, metric, day,
    value). Each runs for one patient but find_patient and cohort_query."""
    tools, points, docs = Tools(), data["points"], data["documents"]
    keys = ["patient_id", "series"]
    own = lambda df, patient: df.where(F.col("patient_id") == patient)

    def find_patient(query: str, birth_year: int | None = None) -> DataFrame:
        found = data["patients"].where(all_tokens(F.col("name"), query))
        return found.where(F.col("birth_year") == birth_year) if birth_year is not None else found

    def get_document(patient, id=None) -> DataFrame:
        mine = docs.where(F.col("owner") == patient)
        return mine.select("doc_id", "doc_date", "kind", "title") if id is None else mine.where(F.col("doc_id") == id)

    def get_perf_trend(patient, metric: str | None = None) -> DataFrame:
        mine = own(data["performance"], patient)
        listed = mine.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"))
        return listed if metric is None else mine.where(F.col("metric") == metric).select("day", "value")

    def propose_chart(patient, spec: str) -> DataFrame:
        asked = points.sparkSession.range(1).select(F.lit(patient).cast(points.schema["patient_id"].dataType).alias("patient_id"), F.lit(1).alias("spec_id"), F.lit(spec).alias("spec"))
        return charts.resolved_charts(charts.parsed_specs(asked), own(points, patient), "patient_id")

    tools.add("find_patient", find_patient, "query", "birth_year")
    tools.add("cohort_query", lambda series_id, direction="any", flag="any": quality.cohort(series.summaries(points.where(F.col("series") == series_id), keys, order), data["patients"], "patient_id", direction, flag), "series_id", "direction", "flag")
    tools.add("search_documents", lambda patient, query: search(docs.where(F.col("owner") == patient), query), "patient", "query")
    tools.add("get_document", get_document, "patient", "id")
    tools.add("get_perf_trend", get_perf_trend, "patient", "metric")
    tools.add("list_analytes", lambda patient: own(points, patient).groupBy("series").agg(F.min("display_name").alias("display_name"), F.count("value").alias("n"), F.max("date").alias("last_date")), "patient")
    tools.add("get_trend", lambda patient, series_id: own(points, patient).where(F.col("series") == series_id).select("date", "value", "flag", "ref_low", "ref_high"), "patient", "series_id")
    tools.add("summarize_changes", lambda patient: series.change_summaries(own(points, patient), ["patient_id"], "series", order), "patient")
    tools.add("propose_chart", propose_chart, "patient", "spec")
    tools.add("computed_values", lambda patient, inputs, formula: series.derived(own(points, patient).withColumn("report", F.col("date")), ["patient_id"], "series", "report", inputs, formula, order), "patient", "inputs", "formula")
    return tools
