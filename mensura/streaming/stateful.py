"""Stateful stream operators: rows closed in a growing JSON array, admission of reports to a session, changes of state.

Each keeps a state of bounded size for its key and orders the rows of a micro-batch by their sequence, so a stream read in any
batches gives what one batch gives.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import TITLES


def _batch(parts: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order)


def _stateful(rows: DataFrame, keys: list[str], run, output: str, state: str) -> DataFrame:
    return rows.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def scan_rows(fragments: DataFrame, most: int = 32_768) -> DataFrame:
    """fragments (stream_id, seq, text) of one JSON array for each stream_id: a row for each object as soon as it is closed, n from
    0, with its size in characters; row is NULL for what is no JSON and for an object of over `most` characters, which is
    skipped to its own end, so that nothing inside it is taken for a row. The state is the open object, bounded by `most`."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, size, depth, quoted, escaped, n = state.get if state.exists else ("", 0, 0, False, False, 0)
        out: list[tuple] = []
        for text in _batch(parts, ["seq"])["text"]:
            kept = [held] if held else []
            for c in text or "":
                if quoted:
                    escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
                elif c == '"':
                    quoted = True
                elif c == "{":
                    depth += 1
                inside = depth > 0
                if c == "}" and not quoted and depth:
                    depth -= 1
                if inside:
                    size += 1
                    if size <= most:
                        kept.append(c)
                if inside and not depth:
                    row = None
                    if size <= most:
                        try:
                            row = json.dumps(json.loads("".join(kept)), sort_keys=True, ensure_ascii=False)
                        except ValueError:
                            row = None
                    out.append((key[0], n, size, row))
                    kept, size, n = [], 0, n + 1
            held = "".join(kept) if size <= most else ""
        state.update((held, size, depth, quoted, escaped, n))
        yield pd.DataFrame(out, columns=["stream_id", "n", "size", "row"])

    return _stateful(fragments, ["stream_id"], run, "stream_id string, n long, size long, row string", "held string, size long, depth long, quoted boolean, escaped boolean, n long")


def _pieces(fragments: DataFrame, end: str, most: int) -> DataFrame:
    """split_pieces, with each piece's size in characters."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, gone, n = state.get if state.exists else ("", 0, 0)
        out: list[tuple] = []
        for text in _batch(parts, ["seq"])["text"]:
            *whole, held = (held + (text or "")).split(end)
            for piece in whole:
                size = gone + len(piece)
                out.append((key[0], n, size, None if size > most else piece))
                gone, n = 0, n + 1
            if gone + len(held) > most:
                keep = held[-len(end) :]  # the end may have begun
                held, gone = keep, gone + len(held) - len(keep)
        state.update((held, gone, n))
        yield pd.DataFrame(out, columns=["stream_id", "n", "size", "piece"])

    return _stateful(fragments, ["stream_id"], run, "stream_id string, n long, size long, piece string", "held string, gone long, n long")


def split_pieces(fragments: DataFrame, end: str, most: int = 1_048_576) -> DataFrame:
    """fragments (stream_id, seq, text) as the pieces between `end`, n from 0, wherever the fragments were cut; what follows the last
    end waits. A piece of over `most` characters is NULL and skipped to its own end."""
    return _pieces(fragments, end, most).drop("size")


def encoded_frame(event: Column) -> Column:
    """A JSON event as one frame of a server-sent stream."""
    return F.concat(F.lit("data: "), event, F.lit("\n\n"))


def frames(fragments: DataFrame, most: int = 1_048_576) -> DataFrame:
    """The JSON events of a server-sent stream (stream_id, n, event), whatever its fragments; frames without data and those that
    are no JSON are left out. A frame of over `most` characters is told by a row without event."""
    pieces = _pieces(fragments, "\n\n", most)
    line = F.get(F.filter(F.split("piece", "\n"), lambda x: F.startswith(x, F.lit("data: "))), F.lit(0))
    event = F.substr(line, F.lit(7))
    return pieces.select("stream_id", "n", event.alias("event"), "size").where(F.try_parse_json("event").isNotNull() | (F.col("size") > most)).drop("size")


def response_lines(fragments: DataFrame, most: int = 1_048_576) -> DataFrame:
    """The lines of an answer in JSON lines (stream_id, n, kind, line): row, done or error by the line's type; blank lines and what is
    no JSON are left out. A line of over `most` characters is told as too long, without its text."""
    pieces = _pieces(fragments, "\n", most).where(F.try_parse_json("piece").isNotNull() | (F.col("size") > most))
    said = F.get_json_object("piece", "$.type")
    kind = F.when(F.col("size") > most, "too long").when(said.isin("done", "error"), said).otherwise("row")
    return pieces.select("stream_id", "n", kind.alias("kind"), F.col("piece").alias("line"))


@lru_cache(maxsize=65_536)
def _person(identity: str | None) -> tuple[str, str] | None:
    """What an identity is compared by: the digits of a birth number, else a name's folded words in order, without titles."""
    if identity is None or pd.isna(identity):
        return None
    digits = re.sub(r"[\s/]", "", identity)
    if re.fullmatch(r"\d{9,10}", digits):
        return "number", digits
    plain = "".join(c for c in unicodedata.normalize("NFD", identity.lower()) if not unicodedata.combining(c))
    words = sorted(w for w in re.sub("[^a-z]+", " ", plain).split() if w not in TITLES)
    return ("name", " ".join(words)) if words else None


class _Admitted:
    """The reports admitted to a session with their identities, and how many have each person and each kind of identity."""

    def __init__(self, reports: dict[str, str | None]):
        self.reports, self.persons, self.kinds, self.moved = {}, Counter(), Counter(), False
        for report, identity in reports.items():
            self.put(report, identity)
        self.moved = False

    def put(self, report: str, identity: str | None) -> None:
        """moved tells from now on whether who is admitted has changed."""
        was, now = _person(self.reports.get(report)), _person(identity)
        self.moved |= not self.reports
        self.reports[report] = identity
        if was == now:
            return
        if was:
            self.persons[was] -= 1
            self.kinds[was[0]] -= 1
            self.moved |= self.persons[was] == 0
        if now:
            self.persons[now] += 1
            self.kinds[now[0]] += 1
            self.moved |= self.persons[now] == 1

    def check(self, identity: str | None) -> str:
        """ok if nothing is admitted or the same person is; mismatch if another one is; unverifiable if nothing can be compared."""
        mine = _person(identity)
        if not self.reports or (mine and self.persons[mine]):
            return "ok"
        return "mismatch" if mine and self.kinds[mine[0]] else "unverifiable"


def admit(events: DataFrame) -> DataFrame:
    """events (session, seq, kind, report_id, identity): a row (session, report_id, decision) whenever what is decided about a
    report changes. kind report: a report, or a later page of one; the first of a session is admitted, then those of a person who
    is; another person's is a mismatch, asked about at once; one that can't be compared waits until it is done (kind done, for
    one report or, without report_id, for all), then is unverifiable, asked about. Each admission may settle others that wait,
    until none changes; reports that wait are looked at again only then, so one that comes costs no more in a long session. Answers to what is asked: keep admits, discard throws away for good, replace admits and dismisses all
    that was admitted before."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted, held, gone, told = json.loads(state.get[0]) if state.exists else ({}, {}, [], {})
        inside, gone = _Admitted(admitted), dict.fromkeys(gone)
        out: list[tuple] = []

        def tell(report: str, decision: str) -> None:
            if told.get(report) != decision:
                told[report] = decision
                out.append((key[0], report, decision))

        def settle(reports: list[str]) -> None:
            reports = list(held) if inside.moved else reports
            while reports:
                inside.moved = False
                for report in reports:
                    if report in held:
                        identity, done = held[report]
                        found = inside.check(identity)
                        if found == "ok":
                            inside.put(report, identity)
                            del held[report]
                            tell(report, "admitted")
                        elif found == "mismatch" or done:
                            tell(report, found)
                reports = list(held) if inside.moved else []

        for e in _batch(parts, ["seq"]).itertuples(index=False):
            report = None if pd.isna(e.report_id) else e.report_id
            identity = None if e.identity is None or pd.isna(e.identity) else e.identity
            touched: list[str] = []
            if e.kind == "report" and report in inside.reports:
                inside.put(report, identity or inside.reports[report])
            elif e.kind == "report" and report not in gone:
                before = held.get(report, (None, False))
                held[report] = (identity or before[0], before[1])
                touched = [report]
            elif e.kind == "done":
                touched = [r for r in ([report] if report is not None else held) if r in held]
                for r in touched:
                    held[r] = (held[r][0], True)
            elif e.kind in ("keep", "replace", "discard") and report in held:
                identity, _ = held.pop(report)
                if e.kind == "replace":
                    for r in inside.reports:
                        tell(r, "dismissed")
                    inside = _Admitted({})
                if e.kind == "discard":
                    gone[report] = None
                    tell(report, "discarded")
                else:
                    inside.put(report, identity)
                    tell(report, "admitted")
            settle(touched)
        state.update((json.dumps([inside.reports, held, list(gone), told]),))
        yield pd.DataFrame(out, columns=["session", "report_id", "decision"])

    return _stateful(events, ["session"], run, "session string, report_id string, decision string", "seen string")


def changes(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """rows (keys, at, id, state): a row whenever the state of a key is another than before; the first one counts."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        out = []
        for r in _batch(parts, ["at", "id"]).itertuples(index=False):
            if r.state != before:
                out.append((*key, r.id, r.state, before))
                before = r.state
        state.update((before,))
        yield pd.DataFrame(out, columns=[*keys, "id", "state", "before"])

    return _stateful(rows, keys, run, f"{schema}, id long, state string, before string", "before string")


def gate(fragments: DataFrame, sentinel: str) -> DataFrame:
    """fragments (stream_id, seq, text): the text up to the sentinel, no part of which is ever given out: an end that could be
    its beginning is held back until the next fragment."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, closed = state.get if state.exists else ("", False)
        out = []
        for f in _batch(parts, ["seq"]).itertuples(index=False):
            text = held + (f.text or "")
            if closed:
                continue
            if sentinel in text:
                text, held, closed = text[: text.index(sentinel)], "", True
            else:
                k = next((k for k in range(min(len(sentinel) - 1, len(text)), 0, -1) if text.endswith(sentinel[:k])), 0)
                text, held = text[: len(text) - k], text[len(text) - k :]
            if text:
                out.append((key[0], f.seq, text))
        state.update((held, closed))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return _stateful(fragments, ["stream_id"], run, "stream_id string, seq long, text string", "held string, closed boolean")


def first_seen(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first of rows with the same key, forgotten once they are older than the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the input there is now, written to folder and read back."""
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
