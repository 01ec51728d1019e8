"""Ledgers, rate limits, transitions, retention, and folds of ordered writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spend(rows: DataFrame, keys: list[str], amount: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Sums of an append-only ledger, and whether warning and stop thresholds are reached."""
    out = rows.groupBy(*keys).agg(F.round(F.sum(amount), 6).alias("usd"), F.count(F.lit(1)).alias("n"))
    if limits:
        out = out.withColumn("state", F.when(F.col("usd") >= limits[1], "stop").when(F.col("usd") >= limits[0], "warn").otherwise("ok"))
    return out


def priced(usage: DataFrame, prices: DataFrame, model: str, at: str) -> DataFrame:
    """usage with the price that holds at its time: of the model's prices (model, since, usd_in, usd_out) the latest one begun. Prices are few: the
    steps of one model are an array, so each usage row looks its price up without a range join."""
    steps = prices.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("since", "usd_in", "usd_out"))).alias("_steps"))
    rows = usage.join(steps, model, "left")
    begun = F.filter("_steps", lambda s: s["since"] <= F.col(at))
    rows = rows.withColumn("_p", F.try_element_at(begun, F.lit(-1)))
    cost = F.col("tokens_in") * F.col("_p.usd_in") + F.col("cached") * F.col("_p.usd_in") * 0.1 + F.col("written") * F.col("_p.usd_in") * 1.25 + F.col("tokens_out") * F.col("_p.usd_out")
    return rows.withColumn("usd", cost / 1e6).drop("_steps", "_p")


def rate_limited(rows: DataFrame, key: str, ts: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """rows with, for each limit (seconds, most), how many rows of the key came in that time up to this one, and whether any limit is passed."""
    out, seconds = rows, F.unix_micros(F.col(ts).cast("timestamp"))
    over = F.lit(False)
    for name, (span, most) in limits.items():
        w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-span * 1_000_000, 0)
        out = out.withColumn(f"n_{name}", F.count(F.lit(1)).over(w))
        over = over | (F.col(f"n_{name}") > most)
    return out.withColumn("limited", over)


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """Rows at which the state of a key differs from the one before; the first state counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    return out.where(~F.col("state").eqNullSafe(F.col("before")))


def once_per(rows: DataFrame, keys: list[str], order: list[str], amount: str, thresholds: dict[str, float]) -> DataFrame:
    """The first row at which the running sum of a key reaches each threshold."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("total", F.sum(amount).over(w))
    marks = F.array(*[F.struct(F.lit(n).alias("alert"), F.lit(float(t)).alias("t")) for n, t in thresholds.items()])
    hit = total.withColumn("_m", F.explode(F.filter(marks, lambda m: F.col("total") >= m["t"])))
    return hit.groupBy(*keys, F.col("_m.alert").alias("alert")).agg(F.min(F.struct(*order)).alias("at"))


def retained(rows: DataFrame, ts: str, now: Column, days: int, keep: Column | None = None) -> DataFrame:
    kept = F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return rows.where(kept | keep if keep is not None else kept)


def first_writer(rows: DataFrame, key: list[str], owner: str, order: list[str]) -> DataFrame:
    """The first writer of a key owns it; the last write of the owner is the value."""
    at = F.struct(*order)
    owners = rows.groupBy(*key).agg(F.min_by(owner, at).alias("_owner"))
    own = rows.join(owners, key).where(F.col(owner) == F.col("_owner"))
    return own.groupBy(*key, owner).agg(F.max_by("value", at).alias("value"), F.count(F.lit(1)).alias("writes"))


def ordered_fold(rows: DataFrame, key: str, columns: list[str], step: Callable[[tuple | None, tuple], tuple], schema: str) -> DataFrame:
    """The state of each key after its rows, in the order of seq: step(state or None, row of columns) gives the next state, a tuple that is
    the result's columns behind the key. Rows without a key are one history, like those of a key. Partitions are sorted and read as
    a stream, so a key with a long history costs no memory."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            done = []
            for k, *row in part.itertuples(index=False, name=None):
                k = None if pd.isna(k) else k  # pandas gives NaN, which equals nothing
                if state is not None and k != now:
                    done.append((now, *state))
                    state = None
                now, state = k, step(state, tuple(row))
            yield pd.DataFrame(done, columns=names, dtype=object)
        yield pd.DataFrame([(now, *state)] if state is not None else [], columns=names, dtype=object)

    return rows.repartition(key).sortWithinPartitions(key, "seq").select(key, *columns).mapInPandas(run, schema)


def replay(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Optimistic writes (key, seq, owner, expected_rev, value): the first creates revision 1; later ones count if the owner is the same and
    expected_rev is the current revision; others are conflicts. State: rev, owner, value, conflicts."""

    def step(state: tuple | None, row: tuple) -> tuple:
        who, expected, value = row
        if state is None:
            return 1, who, value, 0
        rev, owner, old, conflicts = state
        return (rev + 1, owner, value, conflicts) if who == owner and expected == rev else (rev, owner, old, conflicts + 1)

    return ordered_fold(rows, key, ["owner", "expected_rev", "value"], step, schema)


def alias_writes(rows: DataFrame, key: str, schema: str, orphan: str = "demo") -> DataFrame:
    """Writes of scoped aliases (key, seq, target, source, taught_by): a writer replaces its own, but no model a person's; anyone replaces an
    orphan's; a person replaces a model's. State: target, source, taught_by."""

    def step(state: tuple | None, row: tuple) -> tuple:
        if state is None:
            return row
        (_, old, owner), (_, new, writer) = state, row
        own = owner == writer and not (old == "person" and new == "model")
        return row if own or owner is None or owner == orphan or (old == "model" and new == "person") else state

    return ordered_fold(rows, key, ["target", "source", "taught_by"], step, schema)


def allowance(rows: DataFrame, key: str, schema: str, most: int) -> DataFrame:
    """Guarded counter of events (key, seq, kind: claim or release): a claim counts while fewer than `most` are used, a release gives one
    back. State: used, refused."""

    def step(state: tuple | None, row: tuple) -> tuple:
        used, refused = state or (0, 0)
        if row[0] == "release":
            return max(0, used - 1), refused
        return (used + 1, refused) if used < most else (used, refused + 1)

    return ordered_fold(rows, key, ["kind"], step, schema)


def credited_once(rows: DataFrame, key: str, event: str, amount: str) -> DataFrame:
    """Sums of purchases, each event counted once however often it is told."""
    return rows.dropDuplicates([event]).groupBy(key).agg(F.sum(amount).alias("credit"), F.count(F.lit(1)).alias("n"))


def cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """What is left of parents and of their children (name: table and its reference) when the parents in gone (key) are deleted."""
    left = {"parents": parents.join(gone, key, "left_anti")}
    return left | {n: df.join(gone.select(F.col(key).alias(ref)), ref, "left_anti") for n, (df, ref) in children.items()}


def strikes(rows: DataFrame, key: str, ts: str, days: int = 30, every: int = 3) -> DataFrame:
    """Empty reads of each key with their number in the days before, and whether the slot is kept (every third one) or given back."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    out = rows.withColumn("strike", F.count(F.lit(1)).over(w))
    return out.withColumn("kept", F.col("strike") % every == 0)


def stale(rows: DataFrame, ts: str, now: Column, seconds: int = 3600) -> DataFrame:
    """Open slots that were claimed longer ago than that and never ended."""
    return rows.where(F.col("ended").isNull() & (F.col(ts) < now - F.make_interval(secs=F.lit(seconds))))


def pages_allowed(rows: DataFrame, key: str, schema: str, cap: int) -> DataFrame:
    """Pages of documents from events (key, seq, kind: send or fail): a page is taken while fewer than `cap` are out or read (a failed one
    can be sent again) and fewer than three times the cap were sent in all; a failure with no page sent that hasn't failed changes
    nothing, other kinds neither. State: sent, failed, refused."""

    def step(state: tuple | None, row: tuple) -> tuple:
        sent, failed, refused = state or (0, 0, 0)
        if row[0] == "fail":
            return sent, min(failed + 1, sent), refused
        if row[0] != "send":
            return sent, failed, refused
        return (sent + 1, failed, refused) if sent - failed < cap and sent < 3 * cap else (sent, failed, refused + 1)

    return ordered_fold(rows, key, ["kind"], step, schema)
