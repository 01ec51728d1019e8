"""Readers with explicit schemas, and sinks, for reports and tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASUREMENT = (
    "raw_analyte_name string, value_raw string, unit_raw string, ref_range_raw string, source_snippet string, row_index int, source_page int, "
    "confidence string, canonical_id string, disagreement string, escalated boolean, confirmed boolean, printed_on_page boolean, extracted_by string, bbox array<double>"
)
REPORT = (
    "id string, source_file string, report_date string, lab_name string, patient_name string, patient_id string, fingerprint string, date_doubt string, rev bigint, "
    "pages array<struct<page_num int, image_width int, image_height int, rows array<struct<cells array<string>>>>>, "
    f"measurements array<struct<{', '.join(f'{a}: {b}' for a, b in (x.rsplit(' ', 1) for x in MEASUREMENT.split(', ')))}>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON report per file of a folder."""
    return spark.read.schema(REPORT).option("multiLine", True).json(folder)


def write_reports(reports: DataFrame, folder: str) -> None:
    """Reports as JSON lines, one folder for each patient; a re-run replaces the patients that it writes, and no others."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient_id").json(folder)


def delete_reports(reports: DataFrame, ids: DataFrame) -> DataFrame:
    return reports.join(ids, "id", "left_anti")


def measurements(reports: DataFrame) -> DataFrame:
    """A row for each measurement, with its ordinal in the report."""
    rows = reports.select("id", "patient_id", "report_date", "lab_name", "date_doubt", F.posexplode("measurements").alias("ord", "m"))
    return rows.select(F.col("id").alias("report_id"), "patient_id", "report_date", "lab_name", "date_doubt", "ord", "m.*")


def payload_reports(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Reports kept as JSON strings in a column."""
    return rows.select(F.from_json(payload, REPORT).alias("r")).select("r.*")


def require_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows; reading one whose key isn't known raises, so that an unknown patient is an error and not an empty result."""
    found = rows.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    return found.where(F.coalesce(F.col("_known"), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast("boolean"))).drop("_known")


def csv_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The lines of an export: all fields quoted, quotes doubled, separated by semicolons. line_no is given by `order` inside
    each report."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return rows.select(*order, F.concat_ws(";", *quoted).alias("line"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A spreadsheet export: semicolons, quotes, CRLF."""
    rows.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").options(sep=";", quoteAll=True, header=True, lineSep="\r\n", escape='"').csv(path)


def csv_document(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """An export as lines in order (part, order, line): part 0 is the heading, which begins with a byte order mark; lines end as
    the writer is told (CRLF for spreadsheets)."""
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
    heading = "\ufeff" + ";".join(f'"{c}"' for c in columns)
    first = rows.sparkSession.range(1).select(F.lit(0).alias("part"), *nothing, F.lit(heading).alias("line"))
    return first.unionByName(csv_lines(rows, columns, order).withColumn("part", F.lit(1)))


def json_export(reports: DataFrame, by: str, order: str) -> DataFrame:
    """Each report as a JSON line with its number inside its patient, so that a patient with very many reports is no single row;
    a patient's lines in order, joined by commas in brackets, are the export's array."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return reports.select(by, n.cast("long").alias("n"), F.to_json(F.struct(*reports.columns)).alias("line"))


def sanitised(reports: DataFrame) -> DataFrame:
    """Reports without identity: name and number gone, the file named by its date, page sizes whole numbers from 0."""
    pages = F.transform("pages", lambda p: p.withField("image_width", F.greatest(p["image_width"], F.lit(0))).withField("image_height", F.greatest(p["image_height"], F.lit(0))))
    return reports.withColumns({"patient_name": F.lit(None).cast("string"), "patient_id": F.lit(None).cast("string"), "source_file": F.concat(F.coalesce("report_date", F.lit("undated")), F.lit(".pdf")), "pages": pages})


def shifted_dates(rows: DataFrame, key: str, columns: list[str], salt: str, most: int = 365) -> DataFrame:
    """Dates moved by a number of days that is the same for all rows of a key."""
    days = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(2 * most + 1)).cast("int") - most
    return rows.withColumns({c: F.date_add(F.col(c), days) for c in columns})


class PatientSource(Protocol):
    """What operators and tools ask of a source of one patient's measurements; each answer is a DataFrame."""

    def list_analytes(self) -> DataFrame: ...

    def get_trend(self, canonical_id: str) -> DataFrame: ...

    def reports(self) -> DataFrame: ...


class TableSource:
    """A patient's reports (report_id, patient_id, report_date, canonical_id, value, ...) in a table. The filter by patient goes down
    to the scan; an unknown patient is an error, not an empty result."""

    def __init__(self, rows: DataFrame, patients: DataFrame, patient_id):
        self.rows = rows.where(F.col("patient_id") == patient_id)
        self.patient = require_known(rows.sparkSession.range(1).select(F.lit(patient_id).cast(patients.schema["patient_id"].dataType).alias("patient_id")), patients, "patient_id")

    def reports(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.patient), "patient_id")  # one row

    def list_analytes(self) -> DataFrame:
        known = self.reports().where("canonical_id is not null")
        return known.groupBy("canonical_id").agg(F.count("value").alias("n"), F.max("report_date").alias("last_date"))

    def get_trend(self, canonical_id: str) -> DataFrame:
        return self.reports().where(F.col("canonical_id") == canonical_id).select("report_id", "report_date", "value")


class SessionSource(TableSource):
    """The same over reports that were never stored: rows of Python values of one patient."""

    def __init__(self, spark: SparkSession, rows: Iterable[tuple], schema: str, patient_id):
        loaded = spark.createDataFrame(list(rows), schema)
        super().__init__(loaded, spark.createDataFrame([(patient_id,)], ["patient_id"]), patient_id)


def seed(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables in their order, parents first; what stood there before is replaced, so a second run gives the same."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
