"""Reading inputs, and cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words, everywhere in this subpackage: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset (local tests), a new
    temporary folder, which is then set as the checkpoint folder of the context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='mensura-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Of the innermost settled() that runs in this thread: the tables written on the way.
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and a lost executor costs no recomputation of what
    stands before it."""
    path = f"{shared_dir(df.sparkSession)}/mensura/{name}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as such a table, without the tables that make() wrote on the way: the result no longer reads them."""
    own: list[str] = []
    token, path = _scope.set(own), None
    try:
        result = written(make(), name)
        path = own[-1]
    finally:
        _scope.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for gone in own:
            if gone != path:
                where = hadoop.Path(gone)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    outer = _scope.get()
    if outer is not None:
        outer.append(path)
    return result


def with_rows(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two long columns that name each of its rows, and their names: the hash of the row's file and its place in
    the file, so a doc_id that is null or stands on several rows doesn't mix them up. They are the same in each scan of the
    same files. What isn't read from files is written first."""
    names = ["_file", "_place"]
    while set(names) & set(docs.columns):
        names = [f"_{x}" for x in names]

    def named(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(place["file_path"]).alias(names[0]), place["row_index"].alias(names[1]))

    plan = docs._jdf.queryExecution().analyzed().toString().splitlines()
    scanned = all(re.match(r"[\s:+-]*(Relation|Project|Filter)\b", x) for x in plan)  # a join or an explode repeats rows of a file
    return named(docs if scanned else written(docs, "docs")), names


def among(df: DataFrame, ids: DataFrame, key: list[str], broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of df whose key is in ids (the key's columns and few others, one row a key), with the others. ids are counted first:
    at most broadcast_rows (some 12 MB) are broadcast, so that df's rows stay where they are; more are joined by a shuffle."""
    small = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(ids) if small else ids, key)


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with number, from 1 in the given order, without a sort in one task: ranges of the order are numbered by
    themselves, and begin after the rows of the ranges before (one count for each range)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_range").count()
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(starts), "_range").withColumn("number", within + F.col("_before")).drop("_range", "_before")
