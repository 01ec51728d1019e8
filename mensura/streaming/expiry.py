"""Stateful stream operators that forget: each key's state is bounded and goes by an event-time timer once it can't matter any more.

They answer when a row arrives, in the order of time and id within a micro-batch. Rows that come in the order of their times
give the same answers in any batches; rows later than the watermark's delay are dropped by Spark. Rows without key are one key;
rows without time or id are left out, since nothing says when they came. They need the RocksDB state store (see run_to_end).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Expiring(StatefulProcessor):
    """Hands a key's rows on in order, with the state, and clears that state at the latest time that told() gave."""

    #: The state's fields, and the columns that are given out.
    fields, names = "", []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.fields)

    def told(self, key: tuple, row, state: tuple | None) -> tuple[list[tuple], tuple, int]:
        """What a row gives, the state after it, and when (in milliseconds) that state may go."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        out, until = [], 0
        for row in pd.concat(list(rows)).sort_values(["us", "id"]).itertuples(index=False):
            given, state, until = self.told(key, row, state)
            out += given
        self.state.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: Column, ts: str, id: str, delay: str, **more: Column) -> DataFrame:
    """key, id, us and more of rows, behind a watermark."""
    at = F.col(ts).cast("timestamp")
    known = rows.where(F.col(ts).isNotNull() & F.col(id).isNotNull())
    timed = known.select(key.alias("key"), F.col(id).cast("long").alias("id"), at.alias("at"), F.unix_micros(at).alias("us"), *(c.alias(n) for n, c in more.items()))
    return timed.withWatermark("at", delay)


class _Limiter(_Expiring):
    fields, names = "hits array<bigint>", ["key", "id", "limited"]

    def __init__(self, limits: dict[str, tuple[int, int]]):
        self.limits = [(span * 1_000_000, most) for span, most in limits.values()]
        self.keep, self.span = max(most for _, most in self.limits), max(span for span, _ in self.limits)

    def told(self, key, row, state):
        hits = [int(x) for x in state[0]] if state else []
        # a limit is passed if the last `most` hits before this one are all in its time
        limited = [k for k, (span, most) in enumerate(self.limits) if most < 1 or len(hits) >= most and hits[-most] >= row.us - span]
        hits = [*hits, int(row.us)][-self.keep :]
        return [(key[0], row.id, bool(limited))], (hits,), (row.us + self.span) // 1000 + 1


def limited(rows: DataFrame, key: Column, ts: str, id: str, limits: dict[str, tuple[int, int]], delay: str) -> DataFrame:
    """key, id and limited of each row of a stream: whether it passes any of the limits (seconds, most rows of its key in that time). The state
    is the key's last hits, as many as the largest limit, until the longest time after the last one."""
    out = f"key {_kind(rows, key)}, id long, limited boolean"
    return _timed(rows, key, ts, id, delay).groupBy("key").transformWithStateInPandas(_Limiter(limits), out, "append", "eventtime")


def _kind(rows: DataFrame, key: Column) -> str:
    return rows.select(key.alias("key")).schema["key"].dataType.simpleString()


class _Alerts(_Expiring):
    fields, names = "total bigint, alerts array<string>, until bigint", ["key", "alert", "id", "total"]

    def __init__(self, thresholds: dict[str, int], refunds: bool = True):
        self.thresholds, self.refunds = sorted(thresholds.items(), key=lambda x: (x[1], x[0])), refunds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.refunds:
            yield from super().handleInputRows(key, rows, timerValues)
            return
        total, alerts, until = tuple(self.state.get()) if self.state.exists() else (0, [], 0)
        held, later, top = None, 0, max((least for _, least in self.thresholds), default=0)
        for part in rows:
            part = part[["us", "id", "amount", "until"]].assign(amount=part["amount"].fillna(0).astype("int64"))
            if (part["amount"] < 0).any():
                raise ValueError("an amount below 0, where refunds are ruled out")
            # amounts only add, so behind the row that reaches the highest threshold their sum is all that counts
            held = (part if held is None else pd.concat([held, part])).sort_values(["us", "id"])
            reached = (total + held["amount"].cumsum() >= top).to_numpy()
            n = int(reached.argmax()) + 1 if reached.any() else len(held)
            later += int(held["amount"].iloc[n:].sum())
            held = held.iloc[:n]
        out, state = [], (total, list(alerts), until) if self.state.exists() else None
        for row in held.itertuples(index=False):
            given, state, until = self.told(key, row, state)
            out += given
        self.state.update((state[0] + later, *state[1:]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=self.names)

    def told(self, key, row, state):
        total, alerts, until = state or (0, [], int(row.until))
        total += 0 if pd.isna(row.amount) else int(row.amount)
        new = [name for name, least in self.thresholds if total >= least and name not in alerts]
        return [(key[0], name, row.id, total) for name in new], (total, [*alerts, *new], until), until


def month_alerts(rows: DataFrame, ts: str, id: str, amount: Column, thresholds: dict[str, int], delay: str, refunds: bool = True) -> DataFrame:
    """key (the month, yyyy-MM), alert, id and total of the row of a stream at which a month's amounts reach a threshold; each threshold is told once a
    month. amount: whole numbers, null counts as none. refunds: whether an amount may be below 0; if not, one is an error, and of a month's rows
    only those up to its highest threshold are held, else a micro-batch's rows of a month are held and ordered. A month's state goes when its last moment is past."""
    at = F.col(ts).cast("timestamp")
    end = F.unix_millis(F.date_trunc("month", at) + F.expr("interval 1 month"))
    timed = _timed(rows, F.date_format(at, "yyyy-MM"), ts, id, delay, amount=amount.cast("long"), until=end)
    return timed.groupBy("key").transformWithStateInPandas(_Alerts(thresholds, refunds), "key string, alert string, id long, total long", "append", "eventtime")


class _Fresh(_Expiring):
    fields, names = "us bigint", ["key", "id"]

    def __init__(self, within: int):
        self.within = within * 1_000_000

    def told(self, key, row, state):
        fresh = state is None or row.us - state[0] > self.within
        last = row.us if state is None else max(int(row.us), int(state[0]))
        return [(key[0], row.id)] if fresh else [], (int(last),), (int(last) + self.within) // 1000 + 1


def fresh(rows: DataFrame, key: Column, ts: str, id: str, within: int, delay: str) -> DataFrame:
    """key and id of the rows of a stream whose key hasn't been seen for `within` seconds, or never. The state is when it was seen last, for that long."""
    out = f"key {_kind(rows, key)}, id long"
    return _timed(rows, key, ts, id, delay).groupBy("key").transformWithStateInPandas(_Fresh(within), out, "append", "eventtime")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the input there is now, written to folder and read back; its state is in folder/state."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        begun = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        begun.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
