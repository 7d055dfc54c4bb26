"""Exact nearest neighbours, and an approximate stage for large collections that is ranked again exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput
from ..functions.scalar import METRICS


def check(vector: list[float], dim: int | None, metric: str) -> None:
    if metric not in METRICS:
        raise InvalidInput(f"no metric: {metric}")
    if dim is not None and len(vector) != dim:
        raise InvalidInput(f"{len(vector)} components, not {dim}")
    if not all(map(math.isfinite, vector)):
        raise InvalidInput("components must be finite")
    if metric == "cosine" and not any(vector):
        raise InvalidInput("a zero vector has no direction")


def valid(v: Column, dim: int | Column, metric: str = "cosine") -> Column:
    """Whether a stored vector can be searched: of the dimension, finite, and not zero for cosine."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    ok = v.isNotNull() & (F.size(v) == dim) & finite
    return ok & F.exists(v, lambda x: x != 0) if metric == "cosine" else ok


def knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """vectors with distance, the k nearest, ties by id. Each task keeps its own k, so k rows a task are moved. Vectors that are null, of another dimension, not finite or (for cosine) zero are no candidates."""
    check(query, None, metric)
    rows = (vectors if where is None else vectors.filter(where)).filter(valid(F.col(vec_col), len(query), metric))
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", METRICS[metric](F.col(vec_col), q)).orderBy("distance", id_col).limit(max(0, k))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str, id_col: str, vec_col: str = "embedding", metric: str = "cosine", most: int | None = None, block: int = 4_096) -> DataFrame:
    """(query_id, id, rank, distance): the k nearest of each query, exactly, ties by id. Both sides are dealt in blocks, of about `block` queries and four times as many vectors; a task holds one block of each and keeps its own k of each query. More than `most` queries, if it is given, are an error."""
    if metric not in METRICS:
        raise InvalidInput(f"no metric: {metric}")
    usable = lambda df, i: df.filter(valid(F.col(vec_col), F.size(vec_col), metric) & F.col(i).isNotNull())  # noqa: E731  others are neither queries nor candidates
    queries, vectors = usable(queries, query_id), usable(vectors, id_col)
    n = queries.count()
    if most is not None and n > most:
        raise InvalidInput(f"{n} queries; an exact join takes {most} at most")
    parts = max(1, -(-n // block)), max(1, -(-vectors.count() // (4 * block)))

    def dealt(df: DataFrame, i: str, name: str, side: int) -> DataFrame:
        """Each row with the number of its block, once for each block of the other side, of its dimension."""
        own, other = F.pmod(F.xxhash64(i, vec_col), F.lit(parts[side])), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1 - side] - 1).cast("long")))
        rows = df.select(F.col(i).alias(name), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).alias("dim"), own.alias("own")).withColumn("other", other)
        return rows.select(name, "v", "dim", *([F.col("own").alias("q"), F.col("other").alias("b")] if side == 0 else [F.col("other").alias("q"), F.col("own").alias("b")]))

    q, v = dealt(queries, query_id, "query_id", 0), dealt(vectors, id_col, "id", 1)
    kinds = dict(q.dtypes)["query_id"], dict(v.dtypes)["id"]
    # a task for each pair of blocks, so that AQE puts no hundred of these small inputs into one
    pair, tasks = ["dim", "q", "b"], parts[0] * parts[1]
    q, v = (x.repartition(tasks, *pair) for x in (q, v))
    near = q.groupBy(*pair).cogroup(v.groupBy(*pair)).applyInArrow(lambda a, b: _nearest(a, b, k, metric), f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def _nearest(queries, vectors, k: int, metric: str):
    """The k nearest of each query in one block of vectors: chosen by matrix products with more than their error to spare, then measured as METRICS do, term by term, so distances are the same to the last bit."""
    import numpy as np
    import pyarrow as pa

    if not (queries.num_rows and vectors.num_rows and k > 0):
        return pa.table({"query_id": queries["query_id"].slice(0, 0), "id": vectors["id"].slice(0, 0), "distance": pa.array([], pa.float64())})
    vectors = vectors.sort_by("id")  # a place in the block then stands for the order of ids
    matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    q, v = matrix(queries), matrix(vectors)
    ids = vectors["id"].combine_chunks()
    codes = pa.concat_arrays([ids, queries["query_id"].combine_chunks().cast(ids.type)]).dictionary_encode().indices.to_numpy()
    own = codes[len(v) :]
    first, last = (np.searchsorted(codes[: len(v)], own, side) for side in ("left", "right"))  # ids are coded in the order in which they come

    def added(a, b):  # sum of products, in the order of the components
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
        return out

    norms = [np.sqrt(added(x, x)) for x in (q, v)]
    sizes = [np.einsum("ij,ij->i", x, x) for x in (q, v)]
    spare = 32 * (q.shape[1] + 8) * np.finfo(float).eps
    out = [[], [], []]
    for at in range(0, len(q), 256):
        some = slice(at, at + 256)
        with np.errstate(all="ignore"):
            near = q[some] @ v.T
            if metric == "l2":
                near = sizes[0][some, None] + sizes[1] - 2 * near
                slack = spare * (sizes[0][some] + sizes[1].max())
            elif metric == "inner":
                near, slack = -near, spare * norms[0][some] * norms[1].max()
            else:
                near, slack = 1 - near / norms[0][some, None] / norms[1], np.full(len(near), spare)
            odd = ~np.isfinite(near).all(axis=1) | ~np.isfinite(slack)  # too large for products: all are measured
            for i in np.flatnonzero(first[some] < last[some]):
                near[i, first[at + i] : last[at + i]] = np.inf
            bound = np.partition(near, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1] + 2 * slack + 1e-290
            bound[odd] = np.nan
            rows, places = np.nonzero(~(near > bound[:, None]))
        taken = (places < first[at + rows]) | (places >= last[at + rows])  # a query is no neighbour of itself
        rows, places = rows[taken], places[taken]
        found = np.empty(len(rows))
        for i in range(0, len(rows), 65_536):
            part = slice(i, i + 65_536)
            a, b = q[at + rows[part]], v[places[part]]
            if metric == "l2":
                d = a - b
                found[part] = np.sqrt(added(d, d))
            elif metric == "inner":
                found[part] = -added(a, b)
            else:
                found[part] = 1 - added(a, b) / (norms[0][at + rows[part]] * norms[1][places[part]])
        order = np.lexsort((places, found, rows))
        rows, places, found = rows[order], places[order], found[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        for held, x in zip(out, (at + rows[kept], places[kept], found[kept]), strict=True):
            held.append(x)
    rows, places, found = (np.concatenate(x) for x in out)
    return pa.table({"query_id": queries["query_id"].take(pa.array(rows, pa.int64())), "id": ids.take(pa.array(places, pa.int64())), "distance": pa.array(found, pa.float64())})


def lsh_knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "id", vec_col: str = "embedding", candidates: int | None = None, tables: int = 8, bucket: float = 0.5, seed: int = 7) -> DataFrame:
    """Near neighbours by distance: candidates of random projections, then ranked exactly; all rows if those are fewer than k."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    check(query, None, "l2")
    rows = vectors.filter(valid(F.col(vec_col), len(query), "l2")).withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", numHashTables=tables, bucketLength=bucket, seed=seed).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), candidates or max(10 * k, 100), distCol="__d").drop("__v", "__h", "__d")
    few = near.limit(k).count() < k
    return knn(vectors if few else near, query, k, id_col=id_col, vec_col=vec_col, metric="l2")
