"""Vectors as bytes and matrices, and k-means, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_hash


def with_bytes(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec): the vector as little-endian doubles, or null where it is null, empty, zero or holds a null or non-finite component."""
    source = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            nulls = flat.is_null().to_numpy(zero_copy_only=False)
            x = np.where(nulls, np.nan, flat.to_numpy(zero_copy_only=False).astype(float)) + 0.0
            size = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            ok = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[e - n : e].tobytes() if good else None for e, n, good in zip(ends, size, ok, strict=True)], pa.binary())], names=["vec_id", "vec"])

    return source.mapInArrow(run, "vec_id long, vec binary")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column of bytes without nulls, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)


def dimensions(rows: DataFrame) -> list[int]:
    """The numbers of components of the vectors; each gets an index of its own."""
    return sorted(r["dim"] for r in rows.filter("vec is not null").select((F.octet_length("vec") / 8).cast("int").alias("dim")).distinct().collect())


def sample(rows: DataFrame, key: str | Column, dim: int, most: int, seed: int) -> np.ndarray:
    """At most `most` vectors, those first in a seeded order of their ids."""
    got = rows.select("vec", doc_hash(F.col(key) if isinstance(key, str) else key, seed=seed).alias("__order")).orderBy("__order", "vec").limit(most).toArrow()
    return matrix(got["vec"], dim)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and c."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres or as many as there are rows; a centre without rows moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, c)
        own = d.argmin(1)
        far = d[np.arange(len(x)), own]
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for empty in np.flatnonzero(n == 0):
            c[empty] = x[far.argmax()]
            far[far.argmax()] = -1
    return c




# ------------------------------------------------------------------ lists in blocks

def blocks_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each list: consecutive short lists share a block of `most` rows, a longer list has several to itself."""
    first, number = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, fill = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if fill and fill + n > most:
            block, fill = block + 1, 0
        first[j] = block
        if n > most:
            number[j] = -(-n // most)
            block, fill = block + int(number[j]), 0
        else:
            fill += n
    return first, number


def to_blocks(ends: np.ndarray, lists: np.ndarray, dealt: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row i asks for lists[ends[i]:ends[i + 1]]. (row, block, lists asked for there, their ends), a pair of row and block once."""
    first, number = dealt
    row, times = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), number[lists]
    total = int(times.sum())
    within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    row, list_, block = np.repeat(row, times), np.repeat(lists, times), np.repeat(first[lists], times) + within
    order = np.lexsort((list_, block, row))
    row, list_, block = row[order], list_[order], block[order]
    new = np.ones(total, bool)
    new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    return row[at], block[at], list_, np.append(at, total)


def list_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a column of lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def turns_of(asked: DataFrame, lists: str, dealt, most: int) -> dict[int, int]:
    """For each block, into how many parts of about `most` rows those that ask for it are dealt; a row for each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, block, _, _ = to_blocks(*list_column(batch.column(0)), dealt.value)
            some, n = np.unique(block, return_counts=True)
            yield pa.record_batch([pa.array(some), pa.array(n.astype(np.int64))], ["block", "n"])

    got = asked.select(lists).mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()
    return {r["block"]: -(-r["n"] // most) for r in got}
