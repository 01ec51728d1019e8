"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mensura-')}"
    return f"{base.rstrip('/')}/mensura/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: several readers don't compute it anew, and neither does the loss of an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """kept(), in buckets by a column, as many as a shuffle has partitions: what groups or joins its rows by that column, or by it and others, shuffles nothing.
    The table's name goes when it is written, its files stay."""
    spark = df.sparkSession
    path, n = shared_folder(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"mensura_{name}_{path[-32:]}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(table, format="parquet")
    found = spark.read.table(table)
    found.schema  # the plan is made while the table has a name
    spark.sql(f"DROP TABLE {table}")
    return found


def told_once(rows: DataFrame, texts: list[str], tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that tell() adds to their distinct texts (in place of columns of the same names): what many rows print alike is worked out once. The distinct texts are a
    table in the shared folder, so Spark knows its size and broadcasts it below its own threshold, and shuffles beyond. NULL is a text too."""
    told = kept(tell(rows.select(*texts).distinct()), "texts")
    rows = rows.drop(*[c for c in told.columns if c not in texts])
    told = told.withColumnsRenamed({t: f"__{t}" for t in texts})
    same = reduce(lambda a, b: a & b, [F.col(t).eqNullSafe(F.col(f"__{t}")) for t in texts])
    return rows.join(told, same, "left").drop(*[f"__{t}" for t in texts])
