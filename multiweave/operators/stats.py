"""Column statistics: samples, distinct counts, histograms, common values, selectivity, and what file statistics skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distinct values whose ranks are broadcast, at most.
RANKED = 100_000
SAMPLE, BUCKETS, COMMON, RANGE_DEFAULT = 30_000, 10, 32, 0.30


def sample(df: DataFrame, key: str, n: int = SAMPLE) -> DataFrame:
    """The n rows first in the order of a hash of their key: the same rows on every run."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, column: str, *, rows: int | None = None) -> DataFrame:
    """One row: n_rows, null_fraction, low, high, ndv. With `rows`, df is a sample of so many, and the distinct count is widened by what was seen once and twice (Chao1)."""
    whole = df.agg(F.count("*").alias("n"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"), F.min(column).cast("string").alias("low"), F.max(column).cast("string").alias("high"))
    kinds = value_counts(df, column).agg(F.count("*").alias("d"), F.count(F.when(F.col("n") == 1, 1)).alias("f1"), F.count(F.when(F.col("n") == 2, 1)).alias("f2"))
    more = F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2 * F.col("f2"))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2.0)
    total = F.lit(rows).cast("long") if rows is not None else F.col("n")
    ndv = F.col("d") if rows is None else F.least(total, F.round(F.col("d") + more).cast("long"))
    null_fraction = F.when(F.col("n") > 0, F.col("nulls") / F.col("n")).otherwise(0.0)
    return whole.join(F.broadcast(kinds)).select(F.lit(column).alias("column_name"), total.alias("n_rows"), null_fraction.alias("null_fraction"), "low", "high", ndv.alias("ndv"))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n): at most `buckets` of nearly equal numbers of rows, none of which parts equal values.

    The running count is over distinct values, pre-aggregated; values are ranged over partitions by their own order first.
    """
    counts = value_counts(df, column)
    part = counts.repartitionByRange("value").withColumn("__part", F.spark_partition_id())
    sums = part.groupBy("__part").agg(F.sum("n").alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    inside = F.sum("n").over(Window.partitionBy("__part").orderBy("value"))
    total = counts.agg(F.sum("n").alias("__total"))
    upto = part.join(F.broadcast(before), "__part").withColumn("__upto", F.col("__before") + inside).join(F.broadcast(total))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("__upto") - 1) * buckets / F.col("__total"))).cast("int")
    return upto.groupBy(bucket.alias("bucket")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n"))


def ranks(df: DataFrame, keys: list[str], by: str, *, rank: str = "rank", dense: str = "dense") -> DataFrame:
    """df with the rank and the dense rank of each row among those of its keys, smallest first: counted over distinct values, so no task holds the rows of a group. Few of those are broadcast."""
    w = Window.partitionBy(*keys).orderBy(by)
    counts = df.groupBy(*keys, by).agg(F.count("*").alias("__n"))
    few = counts.count() <= RANKED
    places = counts.select(*[F.col(c).alias(f"__{c}") for c in (*keys, by)], (F.sum("__n").over(w) - F.col("__n") + 1).alias(rank), F.row_number().over(w).cast("long").alias(dense))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, by)]
    return df.join(F.broadcast(places) if few else places, same).select(*df.columns, rank, dense)


def common_values(df: DataFrame, column: str, n: int = COMMON) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(n)


def eq_selectivity(stats: dict, common: dict, value) -> float:
    """Share of rows equal to a value: from the common values, else what is left spread over the distinct ones."""
    if value in common:
        return common[value] / stats["n_rows"] if stats["n_rows"] else 0.0
    return (1 - stats["null_fraction"]) / max(1, stats["ndv"])


def range_selectivity(buckets: list[tuple], low, high, n_rows: int) -> float:
    """Share of rows in [low, high], from (low, high, n) of each bucket, evenly spread in those partly covered."""
    if not buckets or not n_rows:
        return RANGE_DEFAULT
    rows = 0.0
    for a, b, n in buckets:
        lo, hi = max(a, low) if low is not None else a, min(b, high) if high is not None else b
        if lo <= hi:
            try:
                rows += n * ((hi - lo) / (b - a) if b > a else 1.0)
            except TypeError:  # strings have no lengths between
                rows += n
    return min(1.0, rows / n_rows)


def segments(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, segment, n, bytes, low, high) of each row group, from the footers alone; low and high are null without statistics."""
    kind = spark.read.parquet(path).schema[column].dataType
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def footers(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
                with system.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                held = [next(c for c in (g.column(j) for j in range(g.num_columns)) if c.path_in_schema == column).statistics for g in groups]
                low, high = ([getattr(x, part) if x is not None and x.has_min_max else None for x in held] for part in ("min", "max"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(groups)), pa.array(range(len(groups)), pa.int32()), pa.array([g.num_rows for g in groups], pa.int64()), pa.array([g.total_byte_size for g in groups], pa.int64()), pa.array(low), pa.array(high)], ["file", "segment", "n", "bytes", "low", "high"])

    return files.mapInArrow(footers, f"file string, segment int, n long, bytes long, low {kind.simpleString()}, high {kind.simpleString()}")


def segment_report(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """(scanned_segments, skipped_segments, scanned_bytes, skipped_bytes) of row groups for `column = value`; one without statistics is scanned."""
    hit: Column = F.coalesce(F.lit(value).between(F.col("low"), F.col("high")), F.lit(True))
    sums = [f(F.when(c, F.col("bytes"))).alias(f"{name}_{unit}") for name, c in (("scanned", hit), ("skipped", ~hit)) for f, unit in ((F.count, "segments"), (F.sum, "bytes"))]
    return segments(spark, path, column).agg(*sums).na.fill(0)
