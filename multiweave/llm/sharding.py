"""Sharding by balanced label propagation.

Documents with equal texts are linked. A shard is a label. Every linked document starts with a label of its own, a seeded
hash of its row; those of one group and one first label are a fragment, at most as many a group as there are shards.
Then rounds, each a pass over the fragments: neighbours (the other fragments of the group) vote by their bytes for the
shards they are in, and a fragment wants the shard with most votes among those that have room. What all of them want sums
up to a matrix of bytes between shards; that is cut down until no shard takes in more than its quota with some slack, and
of each pair of shards the fragments that come first in a seeded order move, up to the bytes allowed. Rounds end when none wants to move.

Groups of more than a part of a shard, in bytes or rows, are few; they are cut into blocks that start apart, and the
driver holds their votes: all blocks follow to the shard with most of them that has room for the whole group, and only
where none has do they fill the fewest shards. Shards over their quota then give up documents without links first, then
whole small groups, and shards under it take them in, along seeded orders cut by prefix sums, so that each shard's bytes
come to its quota within about a document; linked documents are moved singly only if that does not suffice. Cut edges are
the links between two shards.

All state is a row a document of ids and sizes; texts are read once. Prefix sums use histograms and then the rows of one
bucket, so no task sees a whole shard. Rows of large groups and of null texts meet no shuffle by group.

Law: `bytes`. grown_shard is null. Defined results: a null text has size 1 and the checksum of no bytes, and null texts are no
group; empty texts are a group like others. Repeated rows are rows of the same group. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, doc_hash, table

SHARDS, SEED, ROUNDS = 16, 8, 4
#: A group of more than this part of a shard's bytes or rows is large: at most 2 / BLOCK of them a shard. They are cut into blocks of about that size, as few, which the driver holds.
BLOCK = 0.125
#: What a shard may take in beyond its quota while labels move, so that groups can pass each other; whole groups even it out afterwards.
SLACK = 0.25
#: Rows of a bucket of the last ordering, about.
BUCKET = 4096


def _base(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(t.isNotNull(), doc_hash(t, seed=SEED)).alias("g1"),
        F.when(t.isNotNull(), doc_hash(t, F.lit(SEED), t, seed=-SEED)).alias("g2"),
    )


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("size")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def _moves(loads: list[int], quota: float) -> list[tuple[int, int, int, int]]:
    """(from, low, high, to): of what a shard gives up, the bytes from low to high in its order go to shard `to`."""
    over = [(s, int(x - quota)) for s, x in enumerate(loads) if x - quota >= 1]
    under = [[s, int(quota - x)] for s, x in enumerate(loads) if quota - x >= 1]
    out, k = [], 0
    for s, give in over:
        low = 0
        while give > 0 and k < len(under):
            n = min(give, under[k][1])
            out.append((s, low, low + n, under[k][0]))
            low, give = low + n, give - n
            under[k][1] -= n
            k += under[k][1] == 0
    return out


def _prefix(units: DataFrame, key: Column, by: str = "shard") -> DataFrame:
    """units with `upto`, the bytes of those of the same shard up to and with it, in the order of key (a seeded number below 2**62).

    Sums over 4,096 buckets of the key first, then within each bucket.
    """
    rows = units.withColumn("__key", key).withColumn("__bucket", F.shiftright("__key", 50))
    sums = rows.groupBy(by, "__bucket").agg(F.sum("size").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__bucket")) - F.col("__n")).drop("__n")
    inside = F.sum("size").over(Window.partitionBy(by, "__bucket").orderBy("__key", "unit").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, [by, "__bucket"]).withColumn("upto", F.col("__before") + inside).drop("__before", "__bucket", "__key")


def _relieve(units: DataFrame, loads: list[int], quota: float, free: Column) -> DataFrame:
    """units after those of overfull shards that are free to go, in a seeded order, went where there is room."""
    moves = _moves(loads, quota)
    if not moves:
        return units
    spark = units.sparkSession
    small = F.broadcast(spark.createDataFrame(moves, "shard int, low long, high long, to int"))  # at most two rows a shard
    key = doc_hash(F.col("unit"), seed=SEED + 1).bitwiseAND(F.lit((1 << 62) - 1))
    sources = sorted({m[0] for m in moves})
    going = _prefix(units.filter(free & F.col("shard").isin(sources)), key)
    middle = F.col("upto") - F.col("size") / 2
    sent = going.join(small.withColumnRenamed("shard", "from"), (F.col("shard") == F.col("from")) & (middle >= F.col("low")) & (middle < F.col("high")), "left")
    changed = sent.withColumn("shard", F.coalesce("to", "shard")).select(units.columns)
    return units.filter(~(free & F.col("shard").isin(sources))).unionByName(changed)


def _follow(held: list[tuple[int, int, int, int]], quota: float, shards: int, grain: float) -> list[tuple[int, int, int]]:
    """(group, block, to) of the blocks that change shards, of (group, block, shard, bytes).

    Groups come by falling bytes. A group goes whole to the shard with most of its bytes among those with room for it; if
    there is none, its blocks fill the shards with most room in turn. grain: bytes that a shard can be over its quota.
    """
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for group, block, at, n in sorted(held):
        groups.setdefault(group, []).append((block, at, n))
    room, out = [quota + grain] * shards, []
    for group, blocks in sorted(groups.items(), key=lambda x: (-sum(n for *_, n in x[1]), x[0])):
        votes, k = [0] * shards, 0
        for _, at, n in blocks:
            votes[at] += n
        while k < len(blocks):
            left = sum(n for *_, n in blocks[k:])
            whole = [s for s in range(shards) if room[s] >= left]
            to = max(whole, key=lambda s: (votes[s], room[s], -s)) if whole else max(range(shards), key=lambda s: (room[s], votes[s], -s))
            first = k
            while k < len(blocks) and (k == first or room[to] >= blocks[k][2]):
                block, at, n = blocks[k]
                room[to] -= n
                k += 1
                if at != to:
                    out.append((group, block, to))
    return out


def _allowed(wanted: dict[tuple[int, int], float], loads: list[float], room: list[float]) -> dict[tuple[int, int], float]:
    """Of the bytes wanted between shards (from, to), as many as leave no shard over its room that was not over it before."""
    out = dict(wanted)
    for _ in range(64):
        at = list(loads)
        for (s, t), n in out.items():
            at[s] -= n
            at[t] += n
        over = {t: at[t] - room[t] for t in range(len(at)) if at[t] > room[t] + 1}
        coming = {t: sum(n for (_, to), n in out.items() if to == t) for t in over}
        if not any(coming.values()):
            break
        for (s, t), n in out.items():
            if t in over and coming[t]:
                out[s, t] = n * max(0.0, 1 - over[t] / coming[t])
    return out


def propagate(fragments: DataFrame, room: list[float], rounds: int) -> DataFrame:
    """fragments (g1, g2, first, size, n, shard) after the rounds; room: bytes of linked documents that each shard may hold."""
    group = Window.partitionBy("g1", "g2")
    for _ in range(rounds):
        loads = _loads(fragments, len(room))
        free = [s for s, n in enumerate(loads) if n < room[s]]
        may = F.col("shard").isin(free) if free else F.lit(False)
        votes = F.sum("size").over(Window.partitionBy("g1", "g2", "shard"))
        place = F.struct("votes", doc_hash("g1", "g2", "shard", seed=SEED + 5).alias("tie"), "shard")
        best = F.max(F.when(may, place)).over(group)
        asked = fragments.withColumn("votes", votes).withColumn("best", best).withColumn("want", F.when(F.col("best") > place, F.col("best.shard")))
        moving = asked.filter("want is not null").groupBy("g1", "g2", "shard", "want").agg(F.sum("size").alias("size")).withColumn("unit", doc_hash("g1", "g2", seed=SEED + 6))
        moving = cut(moving.withColumn("lane", F.col("shard") * len(room) + F.col("want")))
        wanted = {(r["shard"], r["want"]): float(r["size"]) for r in moving.groupBy("shard", "want").agg(F.sum("size").alias("size")).collect()}
        allowed = {k: n for k, n in _allowed(wanted, loads, room).items() if n >= 1}
        if not allowed:
            break
        most = F.broadcast(fragments.sparkSession.createDataFrame([(s * len(room) + t, n) for (s, t), n in allowed.items()], "lane int, most double"))
        ordered = _prefix(moving.join(most, "lane"), F.col("unit").bitwiseAND(F.lit((1 << 62) - 1)), "lane")
        go = ordered.filter(F.col("upto") - F.col("size") / 2 < F.col("most")).select("g1", "g2", "shard", "want")
        fragments = cut(fragments.join(go, ["g1", "g2", "shard"], "left").withColumn("shard", F.coalesce("want", "shard")).select(fragments.columns))
    return fragments


def shard(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, n_linked) of each document: n_linked counts its group's rows, itself included."""
    hashed = lambda *c, seed=SEED: F.pmod(doc_hash(*c, seed=seed), F.lit(shards)).cast("int")
    base = cut(_base(docs, text, doc_id).withColumn("unit", F.monotonically_increasing_id()).withColumn("first", hashed("unit")))
    spark = base.sparkSession
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    quota = total / shards

    # Fragments of groups, and the few large groups.
    parts = cut(base.filter(F.col("g1").isNotNull()).groupBy("g1", "g2", "first").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    groups = parts.groupBy("g1", "g2").agg(F.sum("n").alias("n_linked"), F.sum("size").alias("group_size")).filter("n_linked > 1")
    is_large = (F.col("group_size") > quota * BLOCK) | (F.col("n_linked") > n / shards * BLOCK)
    large = sorted(groups.filter(is_large).collect(), key=lambda r: (r["g1"], r["g2"]))  # at most 2 * shards / BLOCK
    grain = max((r["group_size"] / r["n_linked"] for r in large), default=0.0)  # rows of a group are of one size
    sized = [(r["g1"], r["g2"], k, m, r["group_size"] / m, r["n_linked"]) for k, r in enumerate(large) for m in [math.ceil(r["group_size"] / (quota * BLOCK))]]
    named = F.broadcast(spark.createDataFrame(sized, "g1 long, g2 long, big int, blocks int, part double, of_big long"))
    marked = base.join(named, ["g1", "g2"], "left")
    order = doc_hash("unit", seed=SEED + 2).bitwiseAND(F.lit((1 << 62) - 1))
    block = F.least(F.col("blocks") - 1, F.floor((F.col("upto") - F.col("size") / 2) / F.col("part"))).cast("int")
    of_big = cut(_prefix(marked.filter("big is not null"), order, "big").withColumn("block", block).withColumn("shard", hashed("big", "block")))

    # Propagation: large groups take their room, then fragments move under what is left of the quotas.
    moved = []
    if large and rounds:
        held = of_big.groupBy("big", "block", "shard").agg(F.sum("size").alias("size")).collect()  # a row for each block
        moved = _follow([tuple(r) for r in held], quota, shards, grain)
    to = F.broadcast(spark.createDataFrame(moved, "big int, block int, new int"))
    of_big = of_big.join(to, ["big", "block"], "left").withColumn("shard", F.coalesce("new", "shard"))
    taken = _loads(of_big, shards) if large else [0] * shards
    fragments = parts.join(groups.filter(~is_large), ["g1", "g2"]).select("g1", "g2", "first", "size", "n", F.col("first").alias("shard"))
    fragments = propagate(cut(fragments), [max(0.0, quota * (1 + SLACK) - x) for x in taken], rounds)
    found = fragments.groupBy("g1", "g2").agg(F.sum("n").alias("n_linked"), F.map_from_entries(F.collect_list(F.struct("first", "shard"))).alias("places"))  # a place for each first label at most
    cols = ["unit", "doc_id", "size", "text_crc32", "g1", "g2", "n_linked", "big", "shard"]
    others = marked.filter("big is null")
    linked = others.filter(F.col("g1").isNotNull()).join(found, ["g1", "g2"], "left").withColumn("shard", F.coalesce(F.col("places")[F.col("first")], F.col("first")))
    without = others.filter(F.col("g1").isNull()).withColumn("n_linked", F.lit(None).cast("long")).withColumn("shard", F.col("first"))
    state = cut(linked.select(cols).unionByName(without.select(cols)).unionByName(of_big.withColumn("n_linked", F.col("of_big")).select(cols)))

    # Quotas: documents without links leave overfull shards first, then whole small groups, then single documents.
    alone, small = F.col("n_linked").isNull(), F.col("n_linked").isNotNull() & F.col("big").isNull()
    enough = max(1.0, quota * 0.0005, total / max(1, n))  # a shard may be so far off: a two-thousandth, or a document
    loads = _loads(state, shards)
    if max(loads, default=0) - quota > 0:
        state = cut(_relieve(state, loads, quota, alone))
        loads = _loads(state, shards)
    if max(loads, default=0) > quota + enough:
        units = state.filter(small).groupBy("g1", "g2", "shard").agg(F.sum("size").alias("size")).withColumn("unit", doc_hash("g1", "g2", "shard", seed=SEED + 3)).withColumn("was", F.col("shard"))
        gone = _relieve(units, loads, quota, F.lit(True)).filter("shard <> was").select("g1", "g2", F.col("was").alias("shard"), F.col("shard").alias("new"))
        here = state.filter(small).join(gone, ["g1", "g2", "shard"], "left").withColumn("shard", F.coalesce("new", "shard")).select(state.columns)
        state = cut(state.filter(~small).unionByName(here))
        loads = _loads(state, shards)
        if max(loads) - min(loads) > enough:  # groups are coarse: documents without links even out what they left
            state = cut(_relieve(state, loads, quota, alone))
    for free, over in ((small, enough), (F.lit(True), max(enough, grain))):  # last: single documents of groups, so that the sizes are near equal
        loads = _loads(state, shards)
        if max(loads, default=0) - quota > over:
            state = cut(_relieve(state, loads, quota, free))
    buckets = max(1, -(-n // (shards * BUCKET)))
    rows = state.withColumn("bucket", F.pmod(doc_hash("unit", seed=SEED + 4), F.lit(buckets)))
    sums = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("unit")) - 1
    return rows.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), F.coalesce("n_linked", F.lit(1)).alias("n_linked"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_linked")
