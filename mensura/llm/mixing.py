"""Mixing sources to target weights by Sainte-Lague apportionment.

1. A source's target is its share of all tokens by weight, at most `repeats` times its size; what is over goes to the others
   by weight (solved as one level L with sum of min(L * weight, cap) = total).
2. Documents are dealt by hash into shards of about `shard_tokens` tokens of one source (at most `most_shards` a source), so
   a source with a third of all rows is many shards. A shard's votes are its part of the source's target.
3. The total is divided into blocks of `block` tokens, which go to shards by the highest quotients votes / (2k + 1): the
   divisor whose roundings give the number of blocks is searched with a few aggregations over the shards, each for 32
   candidates, and remaining ties go to the highest quotients. So each shard has an integer quota.
4. In a shard the documents stand in a seeded order, as one sequence of tokens cut into blocks; the quota is its first blocks,
   going round again after the end. A document's taken tokens are its part of them.

Nothing but (doc_id, source, size) is shuffled. Defined results: null texts have size 0 and take nothing; a null source is a
source, the last in order; rows that repeat a doc_id or have none count each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import WORD, numbered, settled, with_rows, written


def level(sources: DataFrame, total: int) -> float:
    """L such that min(L * weight, cap) of all sources (weight, cap) sum to total. Rises with each round, until no other
    source is capped."""
    found = -1.0
    while True:
        open_ = F.lit(found) * F.col("weight") <= F.col("cap")
        row = sources.agg(F.sum(F.when(~open_, F.col("cap"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return found
        now = (total - (row["full"] or 0)) / row["weight"]
        if now <= found:
            return found
        found = now


def sainte_lague(rows: DataFrame, votes: str, seats: int, order: list[str]) -> DataFrame:
    """rows with the column seats: `seats` seats by the highest quotients votes / (2k + 1), ties by `order`."""
    known = rows.agg(F.sum(votes).alias("all"), F.count(F.lit(1)).alias("n"), F.max(votes).alias("most")).first()
    if not known["n"] or not known["all"] or seats <= 0:
        return rows.withColumn("seats", F.lit(0).cast("long"))
    at = lambda d: F.floor(F.col(votes) / F.lit(float(d)) + 0.5)
    low = known["all"] / (seats + known["n"] / 2 + 1)
    high = known["all"] / (seats - known["n"] / 2) if seats > known["n"] / 2 + 1 else 2.1 * known["most"]
    for _ in range(10):
        tries = [low + (high - low) * k / 32 for k in range(1, 33)]
        given = rows.agg(*[F.sum(at(d)).alias(str(k)) for k, d in enumerate(tries)]).first()
        k = next((k for k, n in enumerate(given) if n <= seats), 31)
        low, high = tries[k - 1] if k else low, tries[k]
        if given[k] == seats or high - low < 1e-12 * high:
            break
    left = seats - given[k]
    rows = rows.withColumn("seats", at(high))
    if left <= 0:
        return rows
    nearest = rows.orderBy(F.desc(F.col(votes) / (F.col("seats") + 0.5)), *order).limit(left).select(*order, F.lit(1).alias("more"))
    return rows.join(written(nearest, "nearest"), order, "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("more")


def cycled_weight(number: Column) -> Column:
    """1, 2, 3, repeating, for numbers from 1."""
    return F.pmod(number - 1, F.lit(3)) + 1


def mix(docs: DataFrame, weight: Callable[[Column], Column] = cycled_weight, block: int = 8, repeats: int = 3, shard_tokens: int = 200_000, most_shards: int = 4096, seed: int = 7, others: list[str] = []) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and others (columns of docs) of every row of docs (doc_id, text, source). weight: of a source, by its number from 1
    in code point order."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # the seeded order is by id and text: rows that repeat an id, or have none, stand apart, and a rerun finds the same order
    seeded = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = written(docs.select("doc_id", "source", size.alias("size"), seeded.alias("_order"), *others), "sizes")
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"))
    sources = written(sources.withColumn("weight", weight(F.col("number"))).withColumn("cap", F.col("source_size") * repeats), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    top = level(sources, total)
    target = F.least(F.lit(top) * F.col("weight"), F.col("cap").cast("double"))
    shards = F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)))
    sources = sources.select("source", "number", "source_size", target.alias("target"), shards.alias("shards"))
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = written(joined.withColumn("shard", F.pmod(F.xxhash64("_order"), F.col("shards"))).drop("shards"), "sharded")
    shards = rows.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = written(shards.withColumn("votes", F.coalesce(F.try_divide(F.col("target") * F.col("shard_size"), "source_size"), F.lit(0.0))), "shards")
    quotas = sainte_lague(shards, "votes", round(total / block), ["number", "shard"])
    quotas = quotas.select("number", "shard", "shard_size", F.least(F.col("seats") * block, F.col("shard_size") * repeats).alias("quota"))
    order = Window.partitionBy("number", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(quotas, ["number", "shard"]).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = F.coalesce(F.floor(F.try_divide("quota", "shard_size")), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - whole * F.col("shard_size") - F.col("before")))
    return rows.select("doc_id", "size", "source", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), *others)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each row of docs as many times as it is taken; of a document taken in part (one a shard), its
    last time is given if half of it or more is taken. Rows are told apart by their place in the table."""
    named, row = with_rows(docs)
    times = "".join(row)

    def decided() -> DataFrame:
        rounded = F.floor(F.try_divide("taken", "size") + 0.5).cast("int")
        return mix(named, others=row, **how).select(*row, rounded.alias(times)).where(F.col(times) > 0)

    taken = settled(docs.sparkSession, decided, "taken")
    return named.join(taken, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
