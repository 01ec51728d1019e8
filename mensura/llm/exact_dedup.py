"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Texts are equal when identical after each run of white space becomes one blank. One pass writes (doc_id, digest) to the
shared folder; all that follows moves digests, never texts. Misra-Gries counters (DataFrame.stat.freqItems) name every
digest that may hold a `support` share of the rows; an exact count verifies them. The verified winners are at most
1/support rows, a proven bound, so they are broadcast and their rows are settled on the map side. No digest left has
more than that share, so the rest shuffles evenly by digest.

Defined results: a null text counts as empty; the smallest non-null doc_id of equal texts stays; rows with a null doc_id
are kept only where all of their group's are null; rows that repeat a doc_id each count in group_size, and all rows of the
group with the kept doc_id are marked kept (deduplicate() returns one of them). Extra columns never enter: only doc_id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import SPACE, settled, with_rows, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the SHA-256 of the normalised text, in binary, and other columns."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), *others)


def heavy(rows: DataFrame, support: float, *kept: Column) -> DataFrame:
    """The digests that hold over a `support` share of the rows, with what is kept of each and their exact count; at most
    1/support rows."""
    total = rows.count()
    found = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = rows.join(F.broadcast(found), "digest", "left_semi").groupBy("digest")
    return verified.agg(*kept, F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > support * total)


def grouped(rows: DataFrame, support: float, *kept: Column) -> DataFrame:
    """rows (with digest) with what is kept of each group of a digest, and group_size."""
    winners = F.broadcast(written(heavy(rows, support, *kept), "heavy"))
    rest = rows.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*kept, F.count(F.lit(1)).alias("group_size"))
    return rows.join(winners, "digest").unionByName(rest.join(groups, "digest"))


def exact_groups(docs: DataFrame, support: float = 1e-3) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    return grouped(written(digests(docs), "digests"), support, F.min("doc_id").alias("keep_id")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, support: float = 1e-3) -> DataFrame:
    """One row of docs for each distinct text, all columns: the one with the smallest doc_id, null ids last. Rows are told
    apart by their place in the table, so a doc_id that is null or stands on several rows loses no text."""
    named, row = with_rows(docs)

    def decided() -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *row)).alias("first")
        groups = grouped(written(digests(named, *row), "digests"), support, first).where("group_size > 1")
        return groups.where(F.struct(*row) != F.struct(*[F.col(f"first.{x}") for x in row])).select(*row)

    return named.join(settled(docs.sparkSession, decided, "gone"), row, "left_anti").select(docs.columns)
