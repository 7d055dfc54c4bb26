"""Near-duplicate embeddings by an inverted multi-index, at a cosine of 0.9 or more.

Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own, and the product of the two is a
grid of cells that costs only two small codebooks. Every vector is stored in its cell. It then visits cells in the order
of their distance (the sum of the halves' distances) by multi-sequence traversal: the cells that can be next are those
all of whose predecessors were visited. It goes on until its target recall, which is where a cell is farther than the
nearest one by more than a slack; how many cells that is depends on the vector. The slack is calibrated: sampled vectors
are turned by just the angle of the least similarity that links, in random directions, and the cells in which their turned
copies lie give it. In the cells visited all vectors are compared. A link can be found from either end.

Equal vectors are one class with a multiplicity, so copies are not expanded. Consecutive cells share a block, and large
cells have several; a vector goes once to each block of the cells that it visits, and blocks with many visitors are dealt
in turns. No pairs come out, but of each vector in a cell the number of its links there, each link counted where its
smaller end visits or else where only its larger end does, and the smallest vector that links reach within the cell, which
is all that connected components need. Cosines are taken in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0,
component_id their own id, kept. Vectors link with those of as many components, an index for each. Rows with a null id
have no links, and null in component_id; they are kept. Repeated rows are copies of each other. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HUB, at_nodes, components, cut, table
from .vectors import blocks_of, dimensions, distances, kmeans, list_column, matrix, sample, to_blocks, turns_of, with_bytes

COSINE, SEED = 0.9, 5
#: Vectors that the codebooks are fitted on at most; share of links that a visit from one end alone shall find.
SAMPLE, ONE_SIDED = 16_384, 0.97
MIN_CODES, MAX_CODES = 4, 512
#: Stored vectors and visitors of a block, about.
STORED, VISITORS = 2048, 4096


def traverse(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(ends, cells): row i of x visits cells[ends[i]:ends[i + 1]], as i * codes + j, nearest first, up to `slack` beyond the nearest.

    Multi-sequence traversal of all rows at once: of each row, every code of the first half points to the code of the
    second half that is its next, and is a candidate if the code before it is farther on.
    """
    half, codes = x.shape[1] // 2, len(books[1])
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    n, wide = d1.shape
    at = np.zeros((n, wide), np.int64)
    best = np.full((n, wide), np.inf)
    best[:, 0] = d1[:, 0] + d2[:, 0]
    limit, live = best[:, 0] + slack, np.arange(n)
    rows, cells = [], []
    while len(live):
        r = best[live].argmin(1)
        go = best[live, r] <= limit[live]
        live, r = live[go], r[go]
        s = at[live, r]
        rows.append(live)
        cells.append(o1[live, r] * codes + o2[live, s])
        at[live, r] = s + 1
        to = np.minimum(s + 1, codes - 1)
        may = (s + 1 < codes) & ((r == 0) | (at[live, r - 1] > s + 1))
        best[live, r] = np.where(may, d1[live, r] + d2[live, to], np.inf)
        k = np.flatnonzero(r + 1 < wide)  # the next code may go as far as this one has
        own, below = live[k], r[k] + 1
        s = at[own, below]
        k = np.flatnonzero(s < at[own, below - 1])
        own, below, s = own[k], below[k], s[k]
        best[own, below] = d1[own, below] + d2[own, s]
    row, cell = np.concatenate(rows), np.concatenate(cells)
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), cell[order]


def codes_for(n: int) -> int:
    return int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n) / 6))), MIN_CODES, MAX_CODES))


def fit(x: np.ndarray, n: int, cosine: float) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """(codebooks, slack) from a sample of unit vectors, for n vectors in all."""
    half, codes = x.shape[1] // 2, codes_for(n)
    books = kmeans(x[:, :half], codes, SEED), kmeans(x[:, half:], codes, SEED + 1)
    rng = np.random.default_rng(SEED)
    own = x[rng.choice(len(x), 2048, replace=len(x) < 2048)]
    noise = rng.standard_normal(own.shape)
    noise -= (noise * own).sum(1, keepdims=True) * own
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    turned = cosine * own + np.sqrt(1 - cosine * cosine) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)
    beyond = np.zeros(len(own))
    for part, book in ((slice(None, half), books[0]), (slice(half, None), books[1])):
        d, lies = distances(own[:, part], book), distances(turned[:, part], book).argmin(1)
        beyond += d[np.arange(len(own)), lies] - d.min(1)
    return books, float(np.quantile(beyond, ONE_SIDED)) + 1e-12


def links(classes: DataFrame, dim: int, *, cosine: float = COSINE) -> DataFrame:
    """(cls, others, rep) of rows (cls, n, vec) of distinct vectors of one dimension: parts of the number of rows linked to a class, and a class that links reach."""
    spark, n = classes.sparkSession, classes.count()
    drawn = sample(classes, "cls", dim, SAMPLE, SEED)
    books, slack = fit(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), n, cosine)
    shared = spark.sparkContext.broadcast((books, slack))  # two codebooks of at most MAX_CODES rows

    def walk(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                x = matrix(own.column(2), dim)
                ends, cells = traverse(x / np.linalg.norm(x, axis=1, keepdims=True), *shared.value)
                visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells[ends[:-1]], pa.int32()), visits], names=["cls", "n", "vec", "cell", "visits"])

    walked = cut(classes.select("cls", "n", "vec").mapInArrow(walk, "cls long, n long, vec binary, cell int, visits array<int>"))
    stored = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in walked.groupBy("cell").count().collect():  # a row for each cell at most
        stored[r["cell"]] = r["count"]
    dealt = spark.sparkContext.broadcast(blocks_of(stored, STORED))
    turns = F.broadcast(spark.createDataFrame([(b, int(t)) for b, t in turns_of(walked, "visits", dealt, VISITORS).items()], "block long, turns int"))  # a row for each block

    def visit(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                row, block, cells, ends = to_blocks(*list_column(own.column(4)), dealt.value)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(c.take(at) for c in own.columns[:4]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int32()))], names=["block", *own.schema.names])

    def store(batches):
        for batch in batches:
            first, number = dealt.value
            cell, cls = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + cls % number[cell]), *batch.columns], names=["block", *batch.schema.names])

    schema = "block long, cls long, n long, vec binary, cell int, visits array<int>"
    left = walked.mapInArrow(visit, schema).join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("cls"), F.col("turns")).cast("int")).drop("turns")
    right = walked.mapInArrow(store, schema).join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")

    def compare(key, visitors: pa.Table, held: pa.Table) -> pa.Table:
        x, y = (matrix(t["vec"], dim) for t in (visitors, held))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        (cls_x, n_x), (cls_y, n_y) = ((t["cls"].to_numpy(), t["n"].to_numpy().astype(float)) for t in (visitors, held))
        ends, asked = list_column(visitors["visits"])
        by_cell, row = np.argsort(asked, kind="stable"), np.repeat(np.arange(len(x)), np.diff(ends))
        asked, row = asked[by_cell], row[by_cell]
        lies, stored_order = held["cell"].to_numpy(), np.argsort(held["cell"].to_numpy(), kind="stable")
        out = [[np.empty(0, np.int64)] for _ in range(3)]
        for c, first, n in zip(*np.unique(lies[stored_order], return_index=True, return_counts=True), strict=True):
            i, j = row[np.searchsorted(asked, c) : np.searchsorted(asked, c, "right")], stored_order[first : first + n]
            near = (x[i] @ y[j].T >= cosine) & (cls_x[i][:, None] != cls_y[j][None, :])
            some_i, some_j = near.any(1), near.any(0)
            if not some_i.any():
                continue
            i, j, near = i[some_i], j[some_j], near[np.ix_(some_i, some_j)]
            own = visitors["cell"].take(pa.array(i)).to_numpy()
            again = (cls_x[i][:, None] > cls_y[j][None, :]) & _visited(held["visits"].take(pa.array(j)), own).T  # counted from the other end
            count = (near & ~again).astype(float)
            rep_x, rep_y, most, state = cls_x[i].copy(), cls_y[j].copy(), np.iinfo(np.int64).max, None
            while state != (state := (rep_x.tobytes(), rep_y.tobytes())):
                rep_x = np.minimum(rep_x, np.where(near, rep_y[None, :], most).min(1))
                rep_y = np.minimum(rep_y, np.where(near, rep_x[:, None], most).min(0))
            for to, parts in zip(out, ((cls_x[i], cls_y[j]), (count @ n_y[j], n_x[i] @ count), (rep_x, rep_y)), strict=True):
                to += [part.astype(np.int64) for part in parts]
        return pa.table([np.concatenate(parts) for parts in out], ["cls", "others", "rep"])

    on = ["block", "turn"]
    return left.groupBy(on).cogroup(right.groupBy(on)).applyInArrow(compare, "cls long, others long, rep long")


def _visited(visits: pa.ChunkedArray, cells: np.ndarray) -> np.ndarray:
    """Whether each row of visits has each of the cells."""
    ends, flat = list_column(visits)
    kinds, back = np.unique(cells, return_inverse=True)
    place = np.searchsorted(kinds, flat).clip(0, len(kinds) - 1)
    known = kinds[place] == flat
    out = np.zeros((len(ends) - 1, len(kinds)), bool)
    out[np.repeat(np.arange(len(ends) - 1), np.diff(ends))[known], place[known]] = True
    return out[:, back]


def near_duplicates(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    clean = cut(with_bytes(rows, vec_id, embedding))
    takes = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    out = clean.filter(~takes).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for dim in dimensions(clean.filter(takes)):
        out = out.unionByName(_placed(clean.filter(takes & (F.octet_length("vec") == 8 * dim)), dim, cosine))
    return out


def _placed(clean: DataFrame, dim: int, cosine: float) -> DataFrame:
    """near_duplicates() of (vec_id, vec) of one dimension. Classes have numbers, as equal ids may stand for different vectors."""
    classes = cut(clean.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    kinds, rows = classes.agg(F.count("*"), F.sum("n")).first()
    found = cut(links(classes, dim, cosine=cosine))
    degree = found.groupBy("cls").agg(F.sum("others").alias("others"))
    named = components(found.select(F.col("cls").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("node", "cls")
    placed = classes.join(degree, "cls", "left").join(named, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = cut(placed.select("vec", "least", "n", "component", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    ids = placed.groupBy(F.col("component").alias("node")).agg(F.min("least").alias("m"), F.count("*").alias("degree"))
    known = at_nodes(placed, "component", ids, max(64.0, 2 * HUB * kinds)).select(F.col("vec").alias("node"), F.struct("n_links", F.col("m").alias("component_id")).alias("m"), F.col("n").alias("degree"))
    own = at_nodes(clean, "vec", cut(known), max(64.0, 2 * HUB * rows))
    return own.select("vec_id", "m.n_links", "m.component_id", (F.col("vec_id") == F.col("m.component_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
