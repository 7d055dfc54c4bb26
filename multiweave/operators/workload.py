"""What statements cost, by their normal form, and advice that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY_ROWS, SELECTIVE = 100, 0.1
SAMPLE_SCHEMA = "at long, fingerprint string, table_name string, column_name string, latency_ms double, rows_returned long, rows_examined long, uses_index boolean"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SAMPLE_SCHEMA)


def report(samples: DataFrame, since: int | None = None) -> DataFrame:
    """One row a normal form: executions, latencies and rows."""
    rows = samples if since is None else samples.filter(F.col("at") >= since)
    return rows.groupBy("fingerprint").agg(F.count("*").alias("executions"), F.sum("latency_ms").alias("latency_sum_ms"), F.max("latency_ms").alias("latency_max_ms"), F.sum("rows_returned").alias("rows_returned"), F.sum("rows_examined").alias("rows_examined"))


def advice(samples: DataFrame, sorted_columns: DataFrame) -> DataFrame:
    """(action, table_name, column_name, reason): cluster by columns whose filters examine many rows and return few; unsort what no filter uses.

    sorted_columns: (table_name, column_name) by which tables are clustered now.
    """
    used = samples.filter("column_name is not null").groupBy("table_name", "column_name").agg(F.sum("rows_examined").alias("examined"), F.sum("rows_returned").alias("returned"))
    heavy = used.filter((F.col("examined") >= HEAVY_ROWS) & (F.col("returned") / F.col("examined") <= SELECTIVE)).join(sorted_columns, ["table_name", "column_name"], "left_anti")
    make = heavy.select(F.lit("cluster").alias("action"), "table_name", "column_name", F.format_string("%d rows examined for %d returned", "examined", "returned").alias("reason"))
    idle = sorted_columns.join(used, ["table_name", "column_name"], "left_anti").select(F.lit("release").alias("action"), "table_name", "column_name", F.lit("no filter uses it").alias("reason"))
    return make.unionByName(idle)


def feedback(estimated: float, actual: float, ratio: float = 10) -> bool:
    """Whether an estimate was off by the ratio or more."""
    a, b = max(1.0, estimated), max(1.0, actual)
    return max(a / b, b / a) >= ratio
