"""Sessions with the settings the engine assumes, and tables of a directory as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Named presets of session settings, for the kinds of work the engine is put to.
PROFILES = {
    "general": {},
    "analytical": {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.statistics.histogram.enabled": "true"},
    "ingest": {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.files.maxRecordsPerFile": "5000000"},
    "streaming": {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"},
}


def session(app: str = "multiweave", *, master: str | None = None, profile: str = "general", **conf: str) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution, which splits skewed joins and joins small partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | PROFILES[profile] | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers those tables of the directory that the statement names as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            read(spark, sf_dir, name).createOrReplaceTempView(name)
