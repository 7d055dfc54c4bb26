"""Near-duplicate documents by BagMinHash: weighted Jaccard of multisets of five-word shingles, at 0.8 or more.

Signature. The weight of a shingle is how often it stands in the document. For each shingle a Poisson process of points
runs over the discretised weights [0, 1), [1, 2), [2, 4), [4, 8), ...; a point carries a time and one of the signature's
places at random, and a document keeps for each place the earliest point below its weights. Two documents then agree in
a place with probability equal to their weighted Jaccard similarity, without bias. Within an interval of weights the
process is hierarchical: an interval's first point is passed to one of its halves, the other half starts its own after
it, and halves at or above the weight are dropped. A process ends at the latest earliest point that is still open, so
a document costs little more than its shingles, whatever the weights and the number of places.

Documents with equal multisets are one node. Signatures are cut into bands; nodes that share a band are candidates.
A band never gives all its pairs: first each node is compared with one of the band, then what is not yet in one
component with three more (in large bands with those that have least of their own), and at last only nodes outside a
band's main component with the nodes of other components there, each pair once, and in large bands only if counts of
shared shingles by part of their hash leave room for the overlap that is asked. Every comparison is of the whole
multisets. No candidate link between different components is lost.

Words are runs of ASCII letters, digits and all characters beyond ASCII, Latin capitals made small. A text of one to
four words is one shingle. Node ids are 64-bit hashes of multisets.

Defined results: a null text, or one without words, links with nothing. Rows with a null id link with nothing either.
Repeated rows are copies: of rows with the same smallest id one stays. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, HUB, at_nodes, components, cut, doc_chunks, give_back, lower_bytes, mix, over_texts, release, small_batches, table, text_buffer, tidy, word_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: Places of a signature are BANDS * ROWS: documents of similarity 0.8 share a band with a probability of 1 - 5e-8.
BANDS, ROWS = 32, 4
#: Rows of ids, of eight bytes each, that are broadcast at most; beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Bands of more nodes than this have their nodes sketched, so that hopeless pairs are known without their multisets; parts of a sketch.
LARGE, PARTS = 16, 64

_STEP, _TIME, _PLACE, _SIDE, _LEFT, _RIGHT, _BAND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C))


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the multisets of rows, sorted by row and shingle; off starts at 0."""
    buf = lower_bytes(raw)
    starts, ends, row = word_spans(buf, off, ALNUM)
    words = word_hashes(buf, starts, ends)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    long = np.flatnonzero(row[: max(0, len(row) - SHINGLE + 1)] == row[SHINGLE - 1 :]) if len(row) >= SHINGLE else np.empty(0, np.int64)
    value = np.zeros(len(long), np.uint64)
    for k in range(SHINGLE):
        value = mix(value * np.uint64(31) + words[long + k] + np.uint64(k))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    own = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = n[short] > k
        own[has] = mix(own[has] * np.uint64(31) + words[first[short][has] + k] + np.uint64(k))
    rows, values = np.concatenate([row[long], short]), np.concatenate([value, own])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], np.diff(np.append(at, len(rows)))


def elements(rows: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets of hashes (shingle, how many of it came before)."""
    total = int(counts.sum())
    before = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(rows, counts), mix(np.repeat(values, counts) + before.astype(np.uint64) * _STEP)


def _draw(seed: np.ndarray, rate, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(waiting time at this rate, place)."""
    u = (mix(seed ^ _TIME) >> np.uint64(11)).astype(float) * 2.0**-53
    return -np.log1p(-u) / rate, (mix(seed ^ _PLACE) & np.uint64(places - 1)).astype(np.int64)


def bag_minhash(rows: np.ndarray, values: np.ndarray, counts: np.ndarray, n: int, places: int) -> np.ndarray:
    """The earliest times, a row of `places` for each of n documents; infinite for a document without shingles. places is a power of two."""
    out = np.full(n * places, np.inf)
    seed, low, size = [mix(values)], [np.zeros(len(rows), np.int64)], [np.ones(len(rows), np.int64)]
    item = [np.arange(len(rows))]
    k = 1
    while len(more := np.flatnonzero(counts > (1 << (k - 1)))):  # the interval of weights from 2**(k - 1) to 2**k
        seed.append(mix(values[more] + np.uint64(k * int(_BAND) % (1 << 64))))
        low.append(np.full(len(more), 1 << (k - 1), np.int64))
        size.append(np.full(len(more), 1 << (k - 1), np.int64))
        item.append(more)
        k += 1
    seed, low, size, item = (np.concatenate(x) for x in (seed, low, size, item))
    time, place = _draw(seed, places * size, places)
    doc, weight, drawn = rows[item], counts[item], np.zeros(len(item), np.uint64)
    open_ = np.ones(len(item), bool)
    while True:
        seed, low, size, time, place, doc, weight, drawn = (x[open_] for x in (seed, low, size, time, place, doc, weight, drawn))
        if not len(seed):
            return out.reshape(n, places)
        inside = low + size <= weight
        np.minimum.at(out, doc[inside] * places + place[inside], time[inside])
        latest = out.reshape(n, places).max(axis=1)
        unit = size == 1
        if unit.all() and len(seed) < 8192:  # few are left: several points of each at once
            many = np.arange(1, 17, dtype=np.uint64)
            wait, places_ = _draw(mix(seed[:, None] + (drawn[:, None] + many) * _STEP), places, places)
            times = np.cumsum(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]  # added one by one, so that the digits do not depend on the batch
            np.minimum.at(out, (doc[:, None] * places + places_).ravel(), times.ravel())
            time, place, drawn = times[:, -1], places_[:, -1], drawn + np.uint64(16)
            open_ = time < out.reshape(n, places).max(axis=1)[doc]
            continue
        going = time < latest[doc]
        u, s = np.flatnonzero(going & unit), np.flatnonzero(going & ~unit)
        drawn_u = drawn[u] + np.uint64(1)
        wait, place_u = _draw(mix(seed[u] + drawn_u * _STEP), places, places)
        half = size[s] >> 1
        kept_left = (mix(seed[s] ^ _SIDE) & np.uint64(1)).astype(bool)
        parts = [(seed[u], low[u], size[u], time[u] + wait, place_u, doc[u], weight[u], drawn_u)]
        for side, start in ((_LEFT, low[s]), (_RIGHT, low[s] + half)):
            child = mix(seed[s] + side)
            wait, own = _draw(child, places * half, places)
            keeps = kept_left if side is _LEFT else ~kept_left
            parts.append((child, start, half, np.where(keeps, time[s], time[s] + wait), np.where(keeps, place[s], own), doc[s], weight[s], np.zeros(len(s), np.uint64)))
        seed, low, size, time, place, doc, weight, drawn = (np.concatenate(x) for x in zip(*parts, strict=True))
        open_ = (low < weight) & (time < latest[doc])


def band_hashes(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _BAND, (len(times), bands)).copy()
    for k in range(rows):
        out = mix(out * np.uint64(31) + bits[:, :, k])
    return out


def _blocks(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, off, _ = text_buffer(arr)
    for i, j in doc_chunks(off, 1 << 19):
        at = off[i : j + 1]
        yield i, j, *shingles(raw[at[0] : at[-1]], at - at[0])
    give_back()


def _node(n: int, rows: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, size) of n documents, and their elements (row, hash)."""
    row, element = elements(rows, values, counts)
    size = np.bincount(row, minlength=n)
    node = np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        node[full] = np.add.reduceat(mix(element ^ _PLACE), (np.cumsum(size) - size)[full])
    return mix(node + size.astype(np.uint64)), size, row, element


def signatures(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, size, bands) of each row; size is the number of shingles, and without any bands is empty."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i, j, row, value, count in _blocks(batch.column(1)):
                node, size, _, _ = _node(j - i, row, value, count)
                some = size > 0
                times = bag_minhash((np.cumsum(some) - 1)[row], value, count, int(some.sum()), bands * rows)
                flat = band_hashes(times, bands, rows).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * bands, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(node.view(np.int64)), pa.array(size), lists], names=["doc_id", "node", "size", "bands"])

    return source.mapInArrow(run, "doc_id long, node long, size long, bands array<long>")


def bags(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(node, bag): the multisets as arrays of distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, value, count in _blocks(batch.column(0)):
                node, size, _, element = _node(j - i, row, value, count)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "bag"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "node long, bag array<long>")


def sketches(known: DataFrame) -> DataFrame:
    """(node, sketch, common) of (node, bag): how many elements that stand in another bag too, by PARTS parts of their hash, and in all.

    The overlap of two of the bags is at most the sum over the parts of the smaller of the two counts.
    """
    flat = known.select("node", F.explode("bag").alias("element"))
    twice = flat.groupBy("element").agg(F.count("*").alias("n")).filter("n > 1").select("element")
    parts = flat.join(twice, "element").groupBy("node", F.pmod("element", F.lit(PARTS)).alias("part")).agg(F.count("*").cast("int").alias("n"))
    counted = parts.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"), F.sum("n").alias("common"))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.col("m")[k.cast("long")], F.lit(0)))
    small = lambda c: F.transform(c, lambda n: F.least(n, F.lit((1 << 15) - 1)).cast("short"))
    whole = F.coalesce(F.array_max(sketch) < (1 << 15), F.lit(True))  # else its counts do not fit, and it has no sketch
    return known.select("node").join(counted, "node", "left").select("node", F.when(F.col("m").isNull(), small(F.array_repeat(F.lit(0), PARTS))).when(whole, small(sketch)).alias("sketch"), F.coalesce("common", F.lit(0)).alias("common"))


#: Pairs of a node that meet its multiset in one task, at least; and the share of all pairs beyond which it is a hub.
MEETS, HUBS = 1000, 1 / 256


def _with_bags(pairs: DataFrame, known: DataFrame, side: str, plain: DataFrame, count: int) -> DataFrame:
    """pairs with bag_<side>, the multiset of that side. The pairs of a hub are dealt to several copies of its multiset. plain: the `count` pairs alone."""
    most = max(float(MEETS), HUBS * count)
    hubs = F.broadcast(plain.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("node", F.ceil(F.col("n") / most).cast("int").alias("parts")))  # at most 1 / HUBS
    bags_ = known.select("node", "bag").join(hubs, "node", "left").select(F.col("node").alias(side), F.col("bag").alias(f"bag_{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = pairs.join(hubs.withColumnRenamed("node", side), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(bags_, [side, "part"]).drop("part")


def near_components(docs: DataFrame, signed: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that have a link to another; signed is what signatures() gave, already cut."""
    nodes = signed.filter((F.col("size") > 0) & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "size", "doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low < high").select("band", "n")
    members = cut(banded.join(shared, "band"))
    ids = members.select(F.col("doc").alias("__doc")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    known = cut(bags(docs.join(ids, F.col(doc_id) == F.col("__doc"), "left_semi"), text=text).join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    sketched = cut(sketches(known.join(members.filter(F.col("n") > LARGE).select("node").distinct(), "node", "left_semi")))
    members = cut(members.join(sketched.select("node", "common"), "node", "left").select("band", "node", "size", (1 - F.coalesce("common", F.lit(0)) / F.col("size")).alias("own"), "n"), total := members.count())
    tidy(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), which are cut, whose multisets are similar."""
        n = pairs.count()
        both = _with_bags(_with_bags(pairs, known, "a", pairs, n), known, "b", pairs, n)
        overlap = F.size(F.array_intersect("bag_a", "bag_b"))
        return both.filter(overlap >= F.lit(similarity) * (F.size("bag_a") + F.size("bag_b") - overlap)).select("a", "b")

    labels, links = None, None
    tested: list[DataFrame] = []
    near = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")
    for step in ("one", "three", "rest"):
        placed = members
        placed = placed.withColumn("label", F.col("node")) if labels is None else placed.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        if step == "rest":
            per = placed.groupBy("band", "label").agg(F.count("*").alias("of"))
            main = per.groupBy("band").agg(F.max_by("label", F.struct("of", "label")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("band", "main")
            hope = F.col("own") <= 1 - similarity + 1e-9  # less in common with others than that is too little for any of them
            placed = placed.filter(hope | (F.col("n") <= LARGE))
            with_bands = cut(placed.join(main, "band").join(nodes.select("node", "bands"), "node").join(sketched, "node", "left"), total)
            left = with_bands.filter("label <> main").select("band", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("label").alias("label_a"), F.col("main").alias("main_a"), F.col("bands").alias("bands_a"), F.col("sketch").alias("sketch_a"), F.col("common").alias("common_a"))
            right = with_bands.select(F.col("band").alias("band_b"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"), F.col("bands").alias("bands_b"), F.col("sketch").alias("sketch_b"), F.col("common").alias("common_b"))
            earlier = lambda c: F.slice(c, 1, F.greatest(F.array_position(c, F.col("band")).cast("int") - 1, F.lit(0)))
            once = (F.col("label_b") == F.col("main_a")) | (F.col("a") < F.col("b"))
            most = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x.cast("int"))
            room = lambda n: F.coalesce(n * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")), F.lit(True))  # noqa: E731  the overlap that similarity takes
            may = F.col("common_a").isNull() | F.col("common_b").isNull() | (room(F.least("common_a", "common_b")) & room(most))  # the bound is for two sketched nodes
            on = (F.col("band") == F.col("band_b")) & (F.col("label_a") != F.col("label_b")) & once & near & may & ~F.arrays_overlap(earlier("bands_a"), earlier("bands_b"))
            pairs = left.join(right, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            noise = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20)) / (50 << 20)  # noqa: E731  of 0.02 at most
            picks = [F.min_by(F.struct("node", "label", "size"), F.struct("own", "node"))] if step == "one" else [F.min_by(F.struct("node", "label", "size"), F.struct((F.col("own") + noise(k)).alias("x"), F.col("node"))) for k in (1, 2, 3)]
            picked = placed.groupBy("band").agg(F.array(*picks).alias("picks"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("band", F.explode(F.array_distinct("picks")).alias("pick"))
            joined = placed.join(picked, "band").select("node", "label", F.col("size").alias("size_a"), F.col("pick.node").alias("other"), F.col("pick.label").alias("label_b"), F.col("pick.size").alias("size_b"))
            pairs = joined.filter((F.col("label") != F.col("label_b")) & near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = cut(pairs, total)
        tested.append(pairs)
        found = cut(verified(pairs))
        if not found.isEmpty() or labels is None:
            links = found if links is None else links.unionByName(found)
            labels = cut(components(links), total)
        del pairs
        tidy(docs.sparkSession)
    return labels


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest id with the same multiset), component_id (smallest id reachable by links of `similarity`), kept (one row of each component), node (of its multiset)."""
    with small_batches(docs.sparkSession):
        signed = cut(signatures(docs, text=text, doc_id=doc_id, bands=bands, rows=rows).withColumn("row", F.monotonically_increasing_id()))
        labels = near_components(docs, signed, text=text, doc_id=doc_id, similarity=similarity)
    linked = F.col("size").isNotNull() & (F.col("size") > 0) & F.col("doc_id").isNotNull()
    rows_ = signed.filter(linked).select("doc_id", "node", "row")
    every = signed.count()
    hub = max(64.0, 2 * HUB * every)
    classes = rows_.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"))
    classes = classes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    firsts = classes.groupBy(F.col("label").alias("node")).agg(F.min("first").alias("m"), F.count("*").alias("degree"))
    placed = at_nodes(classes.select("label", F.col("node").alias("own"), "class_id", "n"), "label", firsts, hub)
    placed = cut(placed.select(F.col("own").alias("node"), F.struct("class_id", F.col("m").alias("stays")).alias("m"), F.col("n").alias("degree")), every)
    own = at_nodes(rows_, "node", placed, hub).select("doc_id", "m.class_id", F.col("m.stays.doc_id").alias("component_id"), (F.col("row") == F.col("m.stays.row")).alias("kept"), "node")
    alone = signed.filter(~linked).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "node")
    return own.unionByName(alone)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def _nodes(texts: pa.Array) -> tuple[list[pa.Array], None]:
    """The node of each text, as signatures() has it."""
    parts = [_node(j - i, row, value, count)[0] for i, j, row, value, count in _blocks(texts)]
    return [pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))], None


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each component. Of rows that share an id, those go whose text is not that of a kept row; of equal ones of these, one stays."""
    result = cut(near_duplicates(docs.select("doc_id", "text")))
    stay = result.filter("kept and doc_id is not null").select("doc_id").distinct()
    gone = result.filter("not kept").select("doc_id").distinct().join(stay, "doc_id", "left_anti").select(F.col("doc_id").alias("__gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    key = F.col("doc_id").cast("long")
    left = docs.join(gone, key == F.col("__gone"), "left_anti")
    again = result.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(~F.col("kept"), 1)).alias("out")).filter("n > 1 and out > 0").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    kept = result.filter("kept").select(F.col("doc_id").alias("__again"), F.col("node").alias("__node")).join(again, "__again", "left_semi").distinct()
    several = left.join(again, key == F.col("__again"), "left_semi")
    seen = over_texts(several, "text", [F.col(f"`{c}`") for c in several.columns], _nodes, "node long")
    own = seen.withColumn("id", F.col("__row.doc_id").cast("long")).join(kept, (F.col("id") == F.col("__again")) & (F.col("node") == F.col("__node"))).dropDuplicates(["id", "node"]).select("__row.*")
    return left.join(again, key == F.col("__again"), "left_anti").unionByName(own)
