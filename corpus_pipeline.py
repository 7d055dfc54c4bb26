"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read again by the next.

Language ID leaves out documents that no learnt language explains; the quality classifier those whose score is low;
near-duplicate detection all but one of each group; mixing repeats or leaves out documents so that sources meet their
targets; packing gives the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from multiweave.llm.common import delete_path, shared_path, table
from multiweave.llm.language_id import stage_language_id
from multiweave.llm.mixing import stage_mixing
from multiweave.llm.near_dedup import stage_near_dedup
from multiweave.llm.packing import stage_packing
from multiweave.llm.quality import stage_quality

STAGES = [
    ("language ID", stage_language_id),
    ("quality classifier", stage_quality),
    ("MinHash near-dedup", stage_near_dedup),
    ("mixing sources to target weights", stage_mixing),
    ("best-fit packing", stage_packing),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing keeps what it needs
    delete_path(spark, folder)
    return out
