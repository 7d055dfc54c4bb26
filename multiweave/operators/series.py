"""Time series of (series, timestamp_millis, value)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import time_bucket

TS = "timestamp_millis"


def upsert(points: DataFrame, *, order: str) -> DataFrame:
    """The last written value of each (series, time); order says which was later. Values that are not finite are left out."""
    ok = points.filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    return ok.groupBy("series", TS).agg(F.max_by("value", order).alias("value"))


def ts_range(points: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """Points of [start, end) in order of time; none if the end is not after the start."""
    return points.filter((F.col("series") == series) & (F.col(TS) >= start) & (F.col(TS) < end)).orderBy(TS)


def latest(points: DataFrame, *, order: str | None = None) -> DataFrame:
    """The newest point of each series; of those of one time the one written last by `order`, or without it the greatest."""
    last = F.struct(TS, order or "value")
    return points.groupBy("series").agg(F.max(TS).alias(TS), F.max_by("value", last).alias("value"))


def retain(points: DataFrame, retention_ms: int, bucket_ms: int) -> DataFrame:
    """points without the whole buckets that start before the bucket of (newest time - retention) of their series."""
    newest = points.groupBy("series").agg(F.max(TS).alias("__newest"))
    return points.join(newest, "series").filter(time_bucket(bucket_ms, F.col(TS)) >= time_bucket(bucket_ms, F.col("__newest") - retention_ms)).drop("__newest")


def downsample(points: DataFrame, bucket_ms: int) -> DataFrame:
    return points.groupBy("series", time_bucket(bucket_ms, F.col(TS)).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.min_by("value", TS).alias("first"), F.max_by("value", TS).alias("last"))


def gap_fill(points: DataFrame, bucket_ms: int) -> DataFrame:
    """A row for every bucket between a series' first and last, with its last value or that of the last bucket before."""
    had = downsample(points, bucket_ms).select("series", "bucket", F.col("last").alias("value"))
    every = had.groupBy("series").agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"), F.lit(bucket_ms).cast("long"))).alias("bucket"))
    return every.join(had, ["series", "bucket"], "left").withColumn("value", F.last("value", ignorenulls=True).over(Window.partitionBy("series").orderBy("bucket")))


def rate(points: DataFrame) -> DataFrame:
    """Change of value a second since the point before."""
    w = Window.partitionBy("series").orderBy(TS)
    return points.withColumn("rate", (F.col("value") - F.lag("value").over(w)) * 1000 / (F.col(TS) - F.lag(TS).over(w)))


# ------------------------------------------------------------------ codec

def _zigzag(n: int) -> int:
    return (n << 1) if n >= 0 else ((-n) << 1) - 1


def _varint(n: int, out: bytearray) -> None:
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return n, at


def encode(points: list[tuple[int, float]]) -> bytes:
    """Points in order of time: differences of differences of the times, and each value's bits against the last one's."""
    out, last, step, bits = bytearray(), 0, 0, 0
    _varint(len(points), out)
    for t, v in points:
        d = t - last
        now = struct.unpack("<Q", struct.pack("<d", v))[0]
        x = bits ^ now
        _varint(_zigzag(d - step) << 1 | (x != 0), out)  # one byte if time and value go on as before
        if x:
            low = (x & -x).bit_length() - 1
            out.append(low)
            _varint(x >> low, out)
        last, step, bits = t, d, now
    return bytes(out)


def decode(data: bytes) -> list[tuple[int, float]]:
    n, at = _read(data, 0)
    out, last, step, bits = [], 0, 0, 0
    for _ in range(n):
        z, at = _read(data, at)
        changed, z = z & 1, z >> 1
        step += z >> 1 if z & 1 == 0 else -((z + 1) >> 1)
        last += step
        if changed:
            x, end = _read(data, at + 1)
            bits ^= x << data[at]
            at = end
        out.append((last, struct.unpack("<d", struct.pack("<Q", bits))[0]))
    return out


def codec_stats(points: DataFrame, chunk_ms: int) -> DataFrame:
    """(series, chunk, n, raw_bytes, encoded_bytes) of the points encoded by chunks of time; the chunk bounds a task's group."""
    chunked = points.withColumn("chunk", time_bucket(chunk_ms, F.col(TS)))

    def run(key, t):
        own = sorted(zip(t[TS].to_pylist(), t["value"].to_pylist(), strict=True))
        return pa.table({"series": [key[0].as_py()], "chunk": [key[1].as_py()], "n": [len(own)], "raw_bytes": [16 * len(own)], "encoded_bytes": [len(encode(own))]})

    return chunked.groupBy("series", "chunk").applyInArrow(run, "series string, chunk long, n long, raw_bytes long, encoded_bytes long")
