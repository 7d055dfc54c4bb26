"""Joins that need help at scale: ranges through bins, as-of through one pass, and hot keys through salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(points: DataFrame, ranges: DataFrame, *, at: str, low: str, high: str, width: float) -> DataFrame:
    """points with the ranges that hold them (low <= at < high): an equi-join on bins of a width, so never all pairs."""
    binned = points.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))
    spans = ranges.filter(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return binned.join(spans, "__bin").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")


def asof_join(left: DataFrame, right: DataFrame, *, key: str, left_at: str, right_at: str, value: list[str]) -> DataFrame:
    """left with the columns of the last right row of its key at or before its time, null if there is none: one sort of both, no pairs."""
    kinds = dict(right.dtypes)
    own = [c for c in left.columns if c not in (key, left_at)]
    a = left.select(F.col(key), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in own]).alias("__l") if own else F.lit(1).alias("__l"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in value) + ">").alias("__r"))
    b = right.select(F.col(key), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(dict(a.dtypes)["__l"]).alias("__l"), F.struct(*[F.col(c) for c in value]).alias("__r"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(key, F.col("__at").alias(left_at), *[F.col(f"__l.{c}").alias(c) for c in own], *[F.col(f"__last.{c}").alias(c) for c in value])


def salted_join(big: DataFrame, small: DataFrame, key: str, *, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on a key of which some values hold most rows: big is dealt over salts, small repeated for each."""
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    return dealt.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "__salt"], how).drop("__salt")


def distinct_count(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """How many values other than null each group has: groups of key and value first, combined before they are moved, so a hot key is dealt by its values."""
    once = rows.groupBy(*keys, value).agg(F.lit(1).alias("__one"))
    return once.groupBy(*keys).agg(F.count(value).alias(name))


def two_step_agg(rows: DataFrame, keys: list[str], first: list[Column], last: list[Column], *, salts: int = 16) -> DataFrame:
    """Aggregation in two shuffles, for aggregates that Spark cannot combine before the first (distinct counts, collected lists)."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    return dealt.groupBy(*keys, "__salt").agg(*first).groupBy(*keys).agg(*last)
