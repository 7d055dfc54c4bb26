"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component, the root of what their squared length lacks of the greatest one, so that the nearest by
inner product of a query is the nearest by distance (the query's own extra component is 0). Centroids come from a
balanced splitting of a bounded sample: a part is cut in two at the median of its difference from two centres, until no
part is large. Every vector is posted to its nearest list, and to others that are nearly as near (closure), unless such a
centroid is nearly one that the vector has already. Centroids are found by a best-first search of a graph in memory that
joins each centroid to its nearest ones, for vectors and queries alike. A query takes the centroids that the graph gives
it up to a number, and of those the ones whose distance is at most a ratio of the nearest's; number and ratio are
calibrated on sampled queries, from the lists that hold their true neighbours in the sample, to a target recall. Queries
whose lists hold fewer than k others ask the graph for more.

The index (centroids and graph) is of bounded size. Consecutive lists, which are near each other, share a block; long
lists have several. A query meets each block of its lists once, in a join by block, and blocks with many queries are
dealt in turns. Each meeting gives a query's best k there, and the best k of all are merged, a bounded number of queries
at once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, or have a null id, are neither
queries nor candidates. Vectors are searched among those of as many components, an index for each. A row is not its own
candidate; another row with the same id and vector is. Fewer than k candidates: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import blocks_of, dimensions, distances, kmeans, list_column, matrix, sample, to_blocks, turns_of, with_bytes

K, EVERY, SEED = 20, 20, 3
#: Vectors that the index is fitted on at most, and to a list at least; sampled queries of the calibration; share of true neighbours whose lists the calibration covers.
SAMPLE, PER_LIST, TRIALS, TARGET = 16_384, 4, 300, 0.95
#: Vectors to a list, about; lists at least and at most.
LIST, MIN_LISTS, MAX_LISTS = 256, 8, 16_384
#: Lists that hold a vector at most, how much farther than the nearest they may be, and how near two of them (share of the squared distance).
REPLICAS, CLOSURE, APART = 2, 1.15, 0.1
DEGREE, POSTED, ASKED = 24, 2048, 8192
#: Queries whose best are merged at once, about.
MERGED = 64


class Index:
    """Centroids, the graph that joins them, and the number and ratio that select lists."""

    def __init__(self, centroids: np.ndarray):
        self.c, self.most, self.ratio = centroids, len(centroids), np.inf
        n = len(centroids)
        near, far = [], np.zeros(n)
        for i in range(0, n, 512):
            d = distances(centroids[i : i + 512], centroids)
            near.append(np.argsort(d, axis=1, kind="stable")[:, : min(n, DEGREE + 1)])
            far[i : i + 512] = d.sum(1)
        ring = np.arange(n)[:, None]  # one round through all, so that each can be reached
        self.near = np.concatenate([*[np.concatenate(near)], np.full((n, 1), far.argmin()), (ring + 1) % n, (ring - 1) % n], 1)
        self.entry = np.linspace(0, n - 1, min(n, 16)).astype(int)

    def search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances), nearest first, of at most `most` centroids of each query, by best-first search."""
        n, k = len(q), len(self.c)
        most = min(most, k)
        if not n:
            return np.empty((0, most), np.int64), np.empty((0, most))
        if n > 256:
            parts = [self.search(q[i : i + 256], most) for i in range(0, n, 256)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        known = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        width = min(8, k)
        at = np.broadcast_to(self.entry, (n, len(self.entry)))
        norms, own = (self.c * self.c).sum(1), (q * q).sum(1)
        live = np.arange(n)
        while True:
            d = np.maximum(0.0, own[live, None] - 2 * np.einsum("nd,nmd->nm", q[live], self.c[at]) + norms[at])
            known[live[:, None], at] = d
            beam = np.partition(known[live], most - 1, axis=1)[:, most - 1]  # the worst of the best so far
            todo = np.where(done[live], np.inf, known[live])
            pick = np.argpartition(todo, width - 1, axis=1)[:, :width]
            worth = np.take_along_axis(todo, pick, 1) <= beam[:, None]
            worth &= np.isfinite(np.take_along_axis(todo, pick, 1))
            done[live[:, None], pick] |= worth
            go = worth.any(1)
            live, pick, worth = live[go], pick[go], worth[go]
            if not len(live):
                break
            at = np.where(worth[:, :, None], self.near[pick], pick[:, :1, None]).reshape(len(live), -1)
        order = np.argsort(known, 1, kind="stable")[:, :most]
        return order, np.take_along_axis(known, order, 1)

    def routes(self, q: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list): the lists that each query reads. held: vectors of which a list is the nearest; those read surely hold k others."""
        out, todo, most = [], np.arange(len(q)), self.most
        while len(todo):
            lists, d = self.search(q[todo], most)
            within = d <= self.ratio * d[:, :1]
            before = np.cumsum(held[lists], 1) - held[lists]
            row, at = np.nonzero(within | (before < k + 1))
            enough = (before[:, -1] + held[lists[:, -1]] >= k + 1) | (lists.shape[1] == len(self.c))
            mine = enough[row]
            out.append((todo[row[mine]], lists[row[mine], at[mine]]))
            todo, most = todo[~enough], 2 * most
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))

    def postings(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists that hold each vector; the first of a row is its nearest."""
        lists, d = self.search(x, 4 * REPLICAS)
        held = np.zeros(lists.shape, bool)
        held[:, 0] = True
        for k in range(1, lists.shape[1]):
            may = (d[:, k] <= CLOSURE**2 * d[:, 0]) & (held.sum(1) < REPLICAS)
            for b in range(k):
                between = ((self.c[lists[:, k]] - self.c[lists[:, b]]) ** 2).sum(1)
                may &= ~(held[:, b] & (between < APART * d[:, k]))
            held[:, k] = may
        row, k = np.nonzero(held)
        return row, lists[row, k]


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of nearly equal size, made by halving."""
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        two = kmeans(x[own], 2, SEED, rounds=6)
        if len(two) < 2:
            parts.append(own)
            break
        order = np.argsort(distances(x[own], two) @ np.array([1.0, -1.0]), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return np.stack([x[p].mean(0) for p in parts])


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """x with the component that makes all vectors as long as the longest."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(1)))[:, None]], 1)


def asked(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def lists_for(n: int) -> int:
    return int(np.clip(n // LIST, MIN_LISTS, MAX_LISTS))


def fit(x: np.ndarray, n: int, longest: float, k: int) -> Index:
    """An index for n vectors from a sample, calibrated."""
    up = lift(x, longest)
    index = Index(balanced_centroids(up, min(lists_for(n), len(x))))
    rng = np.random.default_rng(SEED)
    trial = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    score = x[trial] @ x.T
    score[np.arange(len(trial)), trial] = -np.inf
    near = np.argsort(-score, 1, kind="stable")[:, : min(k, len(x) - 1)]
    if near.shape[1] == 0:
        return index
    row, list_ = index.postings(up)
    first = np.searchsorted(row, np.arange(len(x) + 1))
    d = distances(asked(x[trial]), index.c)
    rank = np.argsort(np.argsort(d, 1, kind="stable"), 1, kind="stable")
    ratio = d / np.maximum(d.min(1, keepdims=True), 1e-300)
    best = lambda of: [of[t, list_[first[j] : first[j + 1]]].min() for t in range(len(trial)) for j in near[t]]
    index.most = int(np.quantile(best(rank), TARGET)) + 1
    index.ratio = float(np.quantile(best(ratio), TARGET))
    return index


def search(base: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is a query, among all other rows."""
    spark = base.sparkSession
    clean = cut(with_bytes(base, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()))
    takes = clean.filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dimensions(takes):
        out = out.unionByName(_search(takes.filter(F.octet_length("vec") == 8 * dim), is_query, dim, k))
    return out


def _search(takes: DataFrame, is_query: Column, dim: int, k: int) -> DataFrame:
    """search() among (row, vec_id, vec) of one dimension."""
    spark, n = takes.sparkSession, takes.count()

    def longest(batches):
        for batch in batches:
            x = matrix(batch.column(0), dim)
            yield pa.record_batch([pa.array([float(np.sqrt((x * x).sum(1)).max())] if len(x) else [], pa.float64())], ["longest"])

    most = takes.select("vec").mapInArrow(longest, "longest double").agg(F.max("longest")).first()[0]
    drawn = sample(takes, "row", dim, max(SAMPLE, PER_LIST * lists_for(n)), SEED)
    shared = spark.sparkContext.broadcast(index := fit(drawn, n, most, k))  # at most MAX_LISTS centroids

    def post(batches):
        for batch in batches:
            row, list_ = shared.value.postings(lift(matrix(batch.column(2), dim), most))
            at = pa.array(row, pa.int64())
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(list_, pa.int32()), pa.array(first), *(c.take(at) for c in batch.columns)], names=["list", "first", "row", "vec_id", "vec"])

    posted = cut(takes.select("row", "vec_id", "vec").mapInArrow(post, "list int, first boolean, row long, vec_id long, vec binary"))
    sizes = {r["list"]: (r["n"], r["own"]) for r in posted.groupBy("list").agg(F.count("*").alias("n"), F.count(F.when(F.col("first"), 1)).alias("own")).collect()}  # a row for each list
    count = lambda which: np.array([sizes.get(j, (0, 0))[which] for j in range(len(index.c))])
    held = spark.sparkContext.broadcast(count(1))
    dealt = spark.sparkContext.broadcast(blocks_of(count(0), POSTED))

    def route(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                row, list_ = shared.value.routes(asked(matrix(own.column(2), dim)), held.value, k)
                order = np.lexsort((list_, row))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=own.num_rows))])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list_[order], pa.int32()))], names=["row", "vec_id", "vec", "lists"])

    routed = cut(takes.filter(is_query).select("row", "vec_id", "vec").mapInArrow(route, "row long, vec_id long, vec binary, lists array<int>"))
    turns = spark.createDataFrame([(b, int(t)) for b, t in turns_of(routed, "lists", dealt, ASKED).items()], "block long, turns int")

    def ask(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                row, block, lists, ends = to_blocks(*list_column(own.column(3)), dealt.value)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(c.take(at) for c in own.columns[:3]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists, pa.int32()))], names=["block", "row", "vec_id", "vec", "lists"])

    def hold(batches):
        for batch in batches:
            first, number = dealt.value
            list_, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[list_] + row % number[list_]), *batch.columns], names=["block", "list", "row", "vec_id", "vec"])

    plan = F.broadcast(turns)  # a row for each block
    left = routed.mapInArrow(ask, "block long, row long, vec_id long, vec binary, lists array<int>").join(plan, "block")
    left = left.select("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("turns")).cast("int").alias("turn"), "row", "vec_id", "vec", "lists")
    right = posted.select("list", "row", "vec_id", "vec").mapInArrow(hold, "block long, list int, row long, vec_id long, vec binary").join(plan, "block")
    right = right.select("block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "row", "vec_id", "vec")

    def meet(key, q: pa.Table, p: pa.Table) -> pa.Table:
        names = ["row", "query_id", "best"]
        types = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
        if not len(q) or not len(p):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], types)], names)
        rows, once, back = np.unique(p["row"].to_numpy(), return_index=True, return_inverse=True)  # a vector can be in several lists of the block
        here, at = np.unique(p["list"].to_numpy(), return_inverse=True)
        holds = np.zeros((len(here), len(rows)), np.float32)
        holds[at, back] = 1
        y, ids = matrix(p["vec"].take(pa.array(once)), dim), p["vec_id"].to_numpy()[once]
        ends, lists = list_column(q["lists"])
        wants = np.zeros((len(q), len(here)), np.float32)
        place = np.searchsorted(here, lists).clip(0, len(here) - 1)
        known = here[place] == lists
        wants[np.repeat(np.arange(len(q)), np.diff(ends))[known], place[known]] = 1
        own, x = q["row"].to_numpy(), matrix(q["vec"], dim)
        parts = [_best(x[i : i + 512], own[i : i + 512], wants[i : i + 512] @ holds > 0, y, ids, rows, k) for i in range(0, len(q), 512)]
        return pa.table([q["row"], q["vec_id"], pa.chunked_array(parts, types)], names)

    on = ["block", "turn"]
    met = left.groupBy(on).cogroup(right.groupBy(on)).applyInArrow(meet, "row long, query_id long, best array<struct<less:double,vec_id:long,row:long>>")
    buckets = -(-routed.count() // MERGED) or 1

    def merge(t: pa.Table) -> pa.Table:
        best = t["best"].combine_chunks()
        found = best.flatten()
        less, ids, rows = (found.field(j).to_numpy(zero_copy_only=False) for j in range(3))
        meeting = np.repeat(np.arange(len(t)), best.value_lengths().to_numpy(zero_copy_only=False))
        own, asks = t["row"].to_numpy()[meeting], t["query_id"].to_numpy()[meeting]
        order = np.lexsort((rows, ids, less, own))
        less, ids, rows, own, asks = (c[order] for c in (less, ids, rows, own, asks))
        once = np.ones(len(own), bool)
        once[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])  # a row has one score, so its repeats are neighbours
        less, ids, own, asks = (c[once] for c in (less, ids, own, asks))
        _, first, n = np.unique(own, return_index=True, return_counts=True)
        rank = np.arange(len(own)) - np.repeat(first, n) + 1
        top = rank <= k
        return pa.table([asks[top], pa.array(rank[top], pa.int32()), ids[top], -less[top]], ["query_id", "rank", "vec_id", "score"])

    return met.withColumn("bucket", F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(buckets))).groupBy("bucket").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _best(x: np.ndarray, own: np.ndarray, may: np.ndarray, y: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.Array:
    """For each query the best k of the vectors that it may take, not its own row: (minus the score, id, row), sorted."""
    score = x @ y.T
    score[~may | (own[:, None] == rows[None, :])] = -np.inf
    keep = min(k + 4, len(y))  # a few more: ties and last digits are settled on sums that do not depend on the block
    top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
    kept = np.take_along_axis(score, top, 1)
    exact = np.stack([(x * y[top[:, j]]).sum(1) for j in range(keep)], 1)
    exact[~np.isfinite(kept)] = -np.inf
    order = np.lexsort((rows[top], ids[top], -exact), axis=1)[:, :k]
    at, less = np.take_along_axis(top, order, 1), -np.take_along_axis(exact, order, 1)
    worst = kept.min(1)
    close = score >= (worst - 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(worst), worst, 0.0))))[:, None]
    for i in np.flatnonzero(np.isfinite(worst) & (close.sum(1) > keep)):  # more ties at the end than were kept
        some = np.flatnonzero(close[i])
        sums = (x[i] * y[some]).sum(1)
        first = np.lexsort((rows[some], ids[some], -sums))[:k]
        at[i], less[i] = some[first], -sums[first]
    real = np.isfinite(less)
    ends = np.concatenate([[0], np.cumsum(real.sum(1))])
    at, less = at[real], less[real]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(less), pa.array(ids[at]), pa.array(rows[at])], ["less", "vec_id", "row"]))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
