"""URL filter over a sorted array of digests.

Entries (host, directory, verdict) are written as `host/directory/`. An index has their 64-bit xxhash keys, sorted, and beside
them the full strings and verdicts. The files are made once, sent to all executors with SparkContext.addFile, and mapped into
memory there, so the Python workers of a machine share one copy and a task reads only the pages its searches touch. For a batch of
URLs the keys of all strings that could match (each suffix of the host at a dot with each prefix of the path at a slash, up to the
most labels and slashes of any entry, so a URL of any length costs little) are sought with one vectorised binary search; a
found key counts only if the stored string is the same, so two strings of one key are told apart. The longest entry that fits
decides.

Defined results: a null URL or one without :// has an empty host and path and is allowed. A path without a slash is matched
by no entry. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Rules of the query op8, as (host, directory, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of sites that the blocklist of the query op8 has under each of the domains below.
SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = ["example.com", "example.net", "example.org"]


def write_index(entries: Iterable[tuple[str, str, str, bool]], folder: str) -> list[str]:
    """Files of an index of (host, directory, verdict, is it a rule). Directories begin and end with a slash. Of entries of
    the same string a rule stands before others."""
    import xxhash

    rows = {}
    for host, directory, verdict, rule in entries:
        if not (directory.startswith("/") and directory.endswith("/")) or verdict not in ("allow", "block"):
            raise ValueError(f"not a host, a directory and a verdict: {(host, directory, verdict)}")
        name = host.lower() + directory
        if rule or name not in rows:
            rows[name] = (xxhash.xxh64_intdigest(name), name.encode(), (verdict == "block") + 2 * rule)
    ordered = sorted(rows.values())
    blob = b"".join(x[1] for x in ordered)
    parts = {
        "keys": np.array([x[0] for x in ordered], np.uint64),
        "ends": np.cumsum([0] + [len(x[1]) for x in ordered], dtype=np.int64),
        "kinds": np.array([x[2] for x in ordered], np.uint8),
        "names": np.frombuffer(blob, np.uint8),
        # the most labels of a host and the most slashes of a directory: longer candidates match no entry
        "most": np.array([max((x[1].partition(b"/")[0].count(b".") + 1 for x in ordered), default=0), max((x[1].count(b"/") for x in ordered), default=0)]),
    }
    paths = []
    for part, values in parts.items():
        paths.append(os.path.join(folder, f"{part}.npy"))
        np.save(paths[-1], values)
    return paths


class Index:
    """An index mapped into memory."""

    def __init__(self, paths: list[str]):
        self.keys, self.ends, self.kinds, self.names, most = (np.load(p, mmap_mode="r") if os.path.getsize(p) > 128 else np.load(p) for p in paths)
        self.labels, self.depth = map(int, most)

    def find(self, keys: np.ndarray, name) -> np.ndarray:
        """Of each key: the place of its entry, or -1. name(k) gives the string of the k-th key, and is asked only where the key
        is found."""
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(keys), -1)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else []:
            i = at[k]
            while i < len(self.keys) and self.keys[i] == keys[k]:  # entries of one key stand side by side
                if self.names[self.ends[i] : self.ends[i + 1]].tobytes() == name(k):
                    out[k] = i
                i += 1
        return out


def parts_of(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, cut)
    host, path = (rest[:cut], "") if slash < 0 else (rest[:slash], rest[slash:cut])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def candidates(host: str, path: str, labels: int, depth: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The xxhash keys of every string whose entry would fit, and where the host's suffix begins and the path's prefix ends:
    suffixes of the host of at most `labels` labels, with prefixes of the path up to each of the first `depth` slashes.
    Prefixes are hashed on from the shorter ones, so no such string is built."""
    import xxhash

    keys: list[int] = []
    places: list[tuple[int, int]] = []
    if not path.startswith("/"):
        return keys, places
    begins, at = [], len(host)
    while at >= 0 and len(begins) < labels:
        at = host.rfind(".", 0, at) if at > 0 else -1
        begins.append(at + 1)
    ends, at = [], 0
    while at >= 0 and len(ends) < depth:
        ends.append(at + 1)
        at = path.find("/", at + 1)
    for begin in begins:
        hashed, before = xxhash.xxh64(host[begin:].encode()), 0
        for end in ends:
            hashed.update(path[before:end].encode())
            keys.append(hashed.intdigest())
            places.append((begin, end))
            before = end
    return keys, places


_open: dict[tuple[str, ...], Index] = {}
#: By application and content: the files sent for an index, and the driver's folder of them, which goes with the driver.
_sent: dict[tuple[str, str], tuple[list[str], tempfile.TemporaryDirectory]] = {}


def sent(spark: SparkSession, entries: list[tuple[str, str, str, bool]]) -> list[str]:
    """Names under which the files of the index of entries are sent to all executors, once for each application."""
    which = spark.sparkContext.applicationId, hashlib.sha256(repr(entries).encode()).hexdigest()
    if which not in _sent:
        folder, names = tempfile.TemporaryDirectory(prefix="urls-"), []
        for path in write_index(entries, folder.name):  # each file under a name of its own: added files share one folder on the executors
            names.append(f"urls-{uuid.uuid4().hex}-{os.path.basename(path)}")
            own = os.path.join(folder.name, names[-1])
            os.rename(path, own)
            spark.sparkContext.addFile(own)
        _sent[which] = names, folder
    return _sent[which][0]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], blocked: Iterable[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url). rules: (host, directory, verdict);
    blocked: (host, directory) of the blocklist, which decides where no rule fits."""
    names = sent(pages.sparkSession, [*((h, d, v, True) for h, d, v in rules), *((h, d, "block", False) for h, d in blocked)])

    def run(batches):
        key = tuple(names)
        if key not in _open:
            _open.clear()
            _open[key] = Index([SparkFiles.get(n) for n in names])
        index = _open[key]
        for batch in batches:
            urls = batch.column("url").to_pylist()
            split = [parts_of(u) for u in urls]
            own = [candidates(h, p, index.labels, index.depth) for h, p in split]
            row = np.repeat(np.arange(len(urls)), [len(keys) for keys, _ in own])
            first = np.concatenate([[0], np.cumsum([len(keys) for keys, _ in own])])

            def name(k: int) -> bytes:
                (host, path), (begin, end) = split[row[k]], own[row[k]][1][k - first[row[k]]]
                return (host[begin:] + path[:end]).encode()

            at = index.find(np.array([x for keys, _ in own for x in keys], np.uint64), name)
            rule, best = [None] * len(urls), [(False, 0, 0)] * len(urls)
            for k in np.flatnonzero(at >= 0):
                kind, text = int(index.kinds[at[k]]), name(k).decode()
                rank = (kind >= 2, len(text), kind)  # rules before the blocklist, then the longest
                if rank > best[row[k]]:
                    best[row[k]] = rank
                    rule[row[k]] = text if kind >= 2 else None
            verdict = ["block" if kind & 1 else "allow" for _, _, kind in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
