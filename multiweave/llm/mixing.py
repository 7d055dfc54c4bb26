"""Mixing sources to target weights by min-cost flow.

Documents belong to one or more sources. They are aggregated by membership pattern (the set of their sources), so that
the flow problem has a node for each pattern and source, not for each document: a pattern offers its words once for each
time they may be repeated, at a cost that rises with every repetition; a source asks for its target. The cheapest
maximal flow says how many words each pattern gives. Where a source has no document in common with another, its part of
the network is one path, whose flow is the lesser of what is asked and offered; these parts are solved in a table, however
many they are, and the driver solves the parts in which patterns overlap. A pattern that gives e times its words repeats
all its documents floor(e) times, and once more those that come first in a seeded order of hashes, up to the document
where the rest is met. That document is found through two levels of histograms over the hash, each of a bounded number of
rows a pattern.

Targets: sources ordered by code point, null last, weigh 5, 2, 1, 5, 2, 1, ...; they share all words by weight, at most
3 times their own, and what is cut off is shared again by weight among those below their limit.

Defined results: null and empty texts have size 0 and are never taken. A null source is a source of its own. Documents
that share an id share its place in the order: they are taken together. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import NOT_SPACE, cut, doc_hash, give_back, join_few, release, small_batches, table, text_buffer, tidy, with_rows, word_counts

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 4
#: Cost of a word taken for the first, second and third time; each over the one before.
COSTS = (0, 1, 3)
#: Patterns that share sources with others, of which the driver makes the flow; more is an error. Sources by themselves have no limit.
MAX_PATTERNS = 200_000
BITS = 12


def min_cost_flow(offers: dict, members: dict, asks: dict, costs: tuple = COSTS) -> dict:
    """{(pattern, source): words}: a flow of most words at least cost. offers: words of a pattern; members: its sources; asks: words a source wants.

    Successive cheapest paths with potentials, for each connected part of the graph by itself.
    """
    by_source = defaultdict(list)
    for p, sources in members.items():
        for s in sources:
            by_source[s].append(p)
    out: dict = {}
    seen: set = set()
    for start in members:
        if start in seen:
            continue
        seen.add(start)
        part, todo = [], [start]
        while todo:
            p = todo.pop()
            part.append(p)
            for s in members[p]:
                for q in by_source[s]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
        out |= _flow(part, offers, members, asks, costs)
    return out


def _flow(patterns: list, offers: dict, members: dict, asks: dict, costs: tuple) -> dict:
    to, room, cost, arcs = [], [], [], defaultdict(list)

    def arc(a, b, cap, c):
        for x, y, r, k in ((a, b, cap, c), (b, a, 0, -c)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    sources = sorted({s for p in patterns for s in members[p]})
    between = {}
    for p in patterns:
        for c in costs:
            arc("in", ("p", p), offers[p], c)
        for s in members[p]:
            between[p, s] = len(to)
            arc(("p", p), ("s", s), offers[p] * len(costs), 0)
    for s in sources:
        arc(("s", s), "out", asks[s], 0)
    height: dict = defaultdict(int)
    while True:
        dist, by, n, heap = {"in": 0}, {}, 0, [(0, 0, "in")]
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for a in arcs[x]:
                if room[a] > 0 and (e := d + cost[a] + height[x] - height[to[a]]) < dist.get(to[a], 1 << 60):
                    dist[to[a]], by[to[a]], n = e, a, n + 1
                    heapq.heappush(heap, (e, n, to[a]))
        if "out" not in dist:
            break
        far = dist["out"]
        for x in {*arcs}:
            height[x] += min(dist.get(x, far), far)
        path, x = [], "out"
        while x != "in":
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[a] for a in path)
        for a in path:
            room[a] -= push
            room[a ^ 1] += push
    return {k: room[a ^ 1] for k, a in between.items()}


def targets(sizes: dict, weights: tuple = WEIGHTS, limit: int = REPEATS) -> dict:
    """Words that each source shall give; sizes in the order of the weights."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    out, free, rest = {}, dict(weight), float(sum(sizes.values()))
    while free and rest > 0:
        share = rest / sum(free.values())
        over = [s for s, w in free.items() if w * share > limit * sizes[s]]
        if not over:
            out |= {s: w * share for s, w in free.items()}
            return out | {s: out.get(s, 0.0) for s in sizes}
        for s in over:
            out[s] = float(limit * sizes[s])
            rest -= out[s]
            del free[s]
    return {s: out.get(s, 0.0) for s in sizes}


def sizes_of(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep and `size`, the words of the text."""
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            raw, off, _ = text_buffer(batch.column(batch.num_columns - 1))
            n = word_counts(raw[off[0] : off[-1]], off - off[0], NOT_SPACE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "size"])
            give_back()

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("size", T.LongType())]))


def source_key(source: str) -> Column:
    """A source as a string that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def order_key(doc_id: str, seed: int) -> Column:
    """A document's place in the seeded order, 0 to 2**63 - 1."""
    return doc_hash(F.col(doc_id), seed=seed).bitwiseAND(F.lit((1 << 63) - 1))


def target_table(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = REPEATS) -> tuple[DataFrame, float]:
    """((key, source_size, target) of rows (key, size), as targets() has it, and the sum of the targets). Sources are numbered by a sort, not in one task."""
    ordered = cut(sizes.orderBy("key").withColumn("at", F.monotonically_increasing_id()))
    part, before, number = F.shiftright("at", 33), 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        number.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(number, "part long, before long"))
    place = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1).cast("long")
    table_ = cut(ordered.withColumn("part", part).join(offsets, "part").select("key", F.col("size").alias("source_size"), weight.alias("weight")))
    total, all_weight = table_.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    over = lambda share: F.col("weight") * share > limit * F.col("source_size")
    share, count, given, rest = (total / all_weight if all_weight else 0.0), 0, 0, all_weight
    while True:  # what is cut off raises the share of the others, so those over their limit only grow in number
        n, held, w = table_.filter(over(share)).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == count:
            break
        count, given, rest = n, limit * held, all_weight - w
        share = max(0, total - given) / rest if rest else 0.0
        if not rest:
            break
    full = F.lit(float(limit)) * F.col("source_size")
    target = F.when(over(share), full).otherwise(F.col("weight") * share) if rest else full
    return table_.select("key", "source_size", target.alias("target")), given + share * rest


def plan(sized: DataFrame, *, weights: tuple = WEIGHTS, limit: int = REPEATS, costs: tuple = COSTS) -> tuple[DataFrame, DataFrame]:
    """((pattern, times, last place taken once more), (key, source_size, target)) of rows (sources: array of keys, place, size)."""
    spark = sized.sparkSession
    rows = sized.select(F.array_sort(F.array_distinct("sources")).alias("pattern"), "place", "size").filter(F.size("pattern") > 0)
    patterns = cut(rows.groupBy("pattern").agg(F.sum("size").alias("offer")))
    by_key = patterns.select(F.explode("pattern").alias("key"), "offer", (F.size("pattern") > 1).alias("shared"))
    asked, over = target_table(by_key.groupBy("key").agg(F.sum("offer").alias("size")), weights, limit)
    several = patterns.filter(F.size("pattern") > 1)
    alone = patterns.filter(F.size("pattern") == 1).withColumn("key", F.col("pattern")[0])
    given = None
    if not several.isEmpty():
        words = patterns.agg(F.sum("offer")).first()[0]
        asked = cut(asked.withColumn("target", F.col("target") * (words / over if over else 0.0)))  # words of two sources are there once
        shared = cut(by_key.filter("shared").select("key").distinct())
        near = several.unionByName(alone.join(shared, "key", "left_semi").select("pattern", "offer")).limit(MAX_PATTERNS + 1).collect()
        if len(near) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns share sources")
        offers = {tuple(r["pattern"]): int(r["offer"]) for r in near}
        asks = {r["key"]: round(r["target"]) for r in asked.join(shared, "key").collect()}  # their sources
        gives: dict = defaultdict(int)
        for (p, _), x in min_cost_flow(offers, {p: p for p in offers}, asks, costs[:limit]).items():
            gives[p] += x
        given = spark.createDataFrame([(list(p), n, gives[p]) for p, n in offers.items()], "pattern array<string>, offer long, gives long")
        alone = alone.join(shared, "key", "left_anti")
    gives_ = F.least(F.rint("target").cast("long"), F.col("offer") * limit)
    solved = alone.join(asked, "key").select("pattern", "offer", gives_.alias("gives"))
    solved = cut(solved if given is None else solved.unionByName(given))
    times = F.when(F.col("offer") > 0, F.floor(F.col("gives") / F.col("offer"))).otherwise(0).cast("long")
    solved = solved.select("pattern", times.alias("times"), F.when(F.col("offer") > 0, F.col("gives") - times * F.col("offer")).otherwise(0).cast("long").alias("want"))
    last = _last_places(rows, solved.filter("want > 0").select("pattern", "want"))
    return cut(solved.join(last, "pattern", "left").select("pattern", "times", F.coalesce("last", F.lit(-1).cast("long")).alias("last"))), asked


def _width() -> Column:
    """Bytes of a row of a pattern."""
    return F.octet_length(F.array_join("pattern", "")) + F.lit(64)


def _last_places(rows: DataFrame, want: DataFrame) -> DataFrame:
    """(pattern, last): the place up to which a pattern's documents sum to the words wanted as nearly as whole documents can."""
    at = cut(want.withColumn("prefix", F.lit(0).cast("long")))  # the place's bits known so far, and words still wanted
    order = Window.partitionBy("pattern").orderBy("key")
    for level in (1, 2, 3):
        found = join_few(rows, at, ["pattern"], _width(), F.col("place"))
        if level > 1:
            found = found.filter(F.shiftright("place", 63 - BITS * (level - 1)) == F.col("prefix"))
        key = F.shiftright("place", 63 - BITS * level) if level < 3 else F.col("place")
        run = found.groupBy("pattern", "want", "prefix", key.alias("key")).agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(order))
        if level < 3:
            at = cut(run.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("size") < F.col("want"))).select("pattern", (F.col("want") - (F.col("upto") - F.col("size"))).alias("want"), F.col("key").alias("prefix")))
    taken = run.filter(F.col("upto") - F.col("size") / 2 <= F.col("want")).groupBy("pattern").agg(F.max("key").alias("key"))
    none = F.shiftleft("prefix", 63 - 2 * BITS) - 1
    return at.join(taken, "pattern", "left").select("pattern", F.coalesce("key", none).alias("last"))


def _with_plan(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """rows (pattern, place, ...) with __times, how often the mix takes a document."""
    joined = join_few(rows, plan_, ["pattern"], _width(), F.col("place"))
    return joined.withColumn("__times", F.col("times") + (F.col("place") <= F.col("last")).cast("long")).drop("times", "last")


def _planned(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of docs, plan, targets)."""
    with small_batches(spark):
        sized = cut(sizes_of(docs, "text", [F.col("doc_id"), source_key("source").alias("key")]))
    return sized, *plan(sized.select(F.array("key").alias("sources"), order_key("doc_id", SEED).alias("place"), "size"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan_, asked = _planned(spark, table(spark, sf_dir, "documents"))
    rows = sized.withColumn("pattern", F.array("key")).withColumn("place", order_key("doc_id", SEED))
    out = join_few(_with_plan(rows, plan_), cut(asked), ["key"], F.octet_length("key") + 64, F.col("place"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them: a document repeated as often as the plan says, or gone."""
    tidy(spark)
    _, plan_, _ = _planned(spark, docs)
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    taken = _with_plan(with_rows(docs, pattern=F.array(source_key("source")), place=order_key("doc_id", SEED), worded=worded), plan_)
    return taken.filter(F.col("worded") & (F.col("__times") > 0)).select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select("__row.*")
