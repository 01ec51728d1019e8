"""Shards of even size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. They begin dealt evenly over the shards; in each round every group looks at where its
members are, and those elsewhere want to move to the shards where most of their neighbours are. A shard takes them only
while it has room for linked documents, those that gain most neighbours first. Documents without links then fill each shard
up to its quota, so the law `rows` holds at any time: counts differ by one at most.

A group that fits into one shard wants one home. One that doesn't wants the fewest shards whose room and own members hold
it, so a group with a third of all rows fills a third of the shards. Which moves are let in is decided on counts by shard left,
shard entered, gain (in powers of two) and part of the movers (by a hash): at most shards * shards * 64 * parts numbers, never
a sort of all movers. As many may enter a full shard as leave it. Rows meet their group's plan by a broadcast of the large
groups (each over a thousandth of all rows, so a thousand at most) and by a shuffle for the others.

Defined results: a null text counts as empty; null and repeated doc_ids and repeated rows are told apart by file and place.
Fewer documents than shards leave shards empty; an empty table gives no rows. Other columns aren't read. Ties are broken by
hashes of group, shard, file and place: reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import numbered, settled, with_rows, written


def _by_group(rows: DataFrame, groups: DataFrame, large: int) -> DataFrame:
    """rows with their group's columns (group, m: its number of rows, others); rows without such a group go."""
    heavy, light = groups.filter(F.col("m") > large), groups.filter(F.col("m") <= large)
    few = rows.join(F.broadcast(heavy.select("group")), "group", "left_anti")
    return rows.join(F.broadcast(heavy), "group").unionByName(few.join(light, "group"))


def _list(values: list[int]):
    return F.array(*[F.lit(int(v)) for v in values])


def _homes(share: DataFrame, room: list[int], quota: int, by_room: bool) -> DataFrame:
    """Each group's homes, the best first, and how many of its rows each shard holds. share: group, m, shard, here. by_room: shards that have room
    for a whole group come before those that hold most of it."""
    space = F.col("here") + F.greatest(F.lit(0), F.get(_list(room), F.col("shard")))
    fits = (space >= F.col("m")) & (F.lit(by_room) | (F.col("m") > quota))
    order = Window.partitionBy("group").orderBy(fits.desc(), F.desc("here"), F.xxhash64("group", "shard"))
    before = F.coalesce(F.sum("_space").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = share.withColumn("_space", space).withColumn("_rank", F.row_number().over(order)).withColumn("_before", before)
    is_home = F.when(F.col("m") <= quota, F.col("_rank") == 1).otherwise(F.col("_before") < F.col("m"))
    home = F.when(is_home, F.struct("_rank", "shard", "here"))
    listed = ranked.groupBy("group", "m").agg(F.sort_array(F.collect_list(home)).alias("homes"), F.map_from_entries(F.collect_list(F.struct("shard", "here"))).alias("here"))  # at most a row for each shard
    return listed.filter(F.size("here") > 1)


def _let_in(wanted: list, room: list[int]) -> list:
    """Of counted moves (from, to, gain, part, n), those after which no shard holds more than it has room for: of each shard that would, the least
    gains are turned away until none would."""
    waiting: dict[int, list] = {}
    net = [0] * len(room)
    for x in sorted(wanted, key=lambda x: (-x.gain, x.part, x["from"])):
        waiting.setdefault(x.to, []).append(x)
        net[x.to] += x.n
        net[x["from"]] -= x.n
    full = [s for s in range(len(room)) if net[s] > room[s]]
    while full:
        s = full.pop()
        while net[s] > room[s]:
            x = waiting[s].pop()
            net[s] -= x.n
            net[x["from"]] += x.n
            if net[x["from"]] > room[x["from"]]:
                full.append(x["from"])
    return [tuple(x)[:4] for some in waiting.values() for x in some]


def _moves(linked: DataFrame, homes: DataFrame, row: list[str], large: int, parts: int) -> DataFrame:
    """Rows of `linked` that aren't in one of their group's homes: where they want to go, and by what they are let in."""
    at = _by_group(linked.drop("m"), homes, large)
    key = F.when(F.size("homes") > 1, F.xxhash64(*row)).otherwise(F.xxhash64("group", F.lit(1)))
    to = F.get("homes", F.when(F.size("homes") > 1, F.pmod(F.xxhash64(*row, F.lit(2)), F.size("homes"))).otherwise(F.lit(0)).cast("int"))
    out = at.filter(~F.exists("homes", lambda x: x["shard"] == F.col("shard"))).withColumn("_to", to)
    gain = F.greatest(F.lit(0), F.col("_to.here") - F.element_at("here", F.col("shard")))
    return out.select(*row, F.col("shard").alias("from"), F.col("_to.shard").alias("to"), F.floor(F.log2(gain + 1)).cast("int").alias("gain"), F.pmod(key, F.lit(parts)).cast("int").alias("part"))


def assign(docs: DataFrame, shards: int = 40, rounds: int = 10, parts: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text)."""
    return settled(docs.sparkSession, lambda: _assign(docs, shards, rounds, parts), "shards")


def _assign(docs: DataFrame, shards: int, rounds: int, parts: int) -> DataFrame:
    docs, row = with_rows(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("group"), *row)
    lot = F.xxhash64(*row)
    rows = written(numbered(slim, lot, *row).withColumn("shard", ((F.col("number") - 1) % shards).cast("int")).drop("number"), "dealt")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    large = max(1000, n // 1000)
    groups = written(rows.groupBy("group").agg(F.count("*").alias("m")).filter("m > 1"), "groups")
    linked = written(_by_group(rows.select("group", "shard", *row), groups, large), "linked")
    by = ["from", "to", "gain", "part"]
    for k in range(rounds):
        share = written(linked.groupBy("group", "m", "shard").agg(F.count("*").alias("here")), "share")
        load = dict(share.groupBy("shard").agg(F.sum("here")).collect())  # a number for each shard
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        moves = written(_moves(linked, _homes(share, room, min(quota), k % 2 == 1), row, large, parts), "moves")
        let_in = _let_in(moves.groupBy(*by).agg(F.count("*").alias("n")).collect(), room)
        if let_in:
            allowed = docs.sparkSession.createDataFrame(let_in, "`from` int, to int, gain int, part int")
            moved = moves.join(F.broadcast(allowed), by).select(*row, "to")
            linked = written(linked.join(moved, row, "left").select("group", "m", F.coalesce("to", "shard").alias("shard"), *row), "linked")
        elif k % 2 == 1:
            break
    load = dict(linked.groupBy("shard").count().collect())
    upto = [0]
    for s, q in enumerate(quota):
        upto.append(upto[-1] + q - load.get(s, 0))
    alone = numbered(rows.join(linked.select(*row), row, "left_anti").drop("shard"), lot, *row)
    fill = (F.size(F.filter(_list(upto[1:]), lambda end: end < F.col("number")))).cast("int")
    placed = alone.withColumn("shard", fill).drop("number").unionByName(rows.drop("shard").join(linked.select("shard", *row), row))
    begin = [sum(quota[:s]) for s in range(shards)]
    slots = numbered(placed, "shard", lot, *row).withColumn("slot", F.col("number") - 1 - F.get(_list(begin), F.col("shard")))
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
