"""Foreign tables: files with declared schemas, and remote databases. Filters and columns are pushed down by Spark."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, Unsupported
from ..schema import TableSchema

REMOTE_LIMIT = 10_000


@dataclass(frozen=True)
class ForeignTable:
    """A source: kind parquet, csv, jsonl or jdbc; options of its kind."""

    schema: TableSchema
    kind: str
    path: str = ""
    options: dict = field(default_factory=dict)


def read(spark: SparkSession, t: ForeignTable) -> DataFrame:
    """The rows of a foreign table. A cell or line that does not parse is an error, as is a line of CSV with too many or few cells; an empty CSV cell is null."""
    struct = t.schema.struct()
    if t.kind == "parquet":
        return spark.read.schema(struct).parquet(t.path)
    if t.kind == "csv":
        reader = spark.read.schema(struct).option("header", str(t.options.get("header", False)).lower()).option("mode", "FAILFAST").option("columnPruning", "false").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("enforceSchema", "true").option("ignoreLeadingWhiteSpace", "false")
        return reader.csv(t.path).select(*[(F.when(F.col(c.name) != "", F.col(c.name)) if c.type == "str" else F.col(c.name)).alias(c.name) for c in t.schema.columns])
    if t.kind == "jsonl":
        return spark.read.schema(struct).option("mode", "FAILFAST").json(t.path)
    if t.kind == "jdbc":
        return jdbc(spark, t)
    raise Unsupported(f"no foreign source: {t.kind}")


def jdbc_options(t: ForeignTable) -> dict:
    """Options of Spark's JDBC source. The password comes from an environment variable that is named, never from the descriptor."""
    o = dict(t.options)
    if {"password", "secret"} & o.keys():
        raise InvalidInput("name an environment variable in password_env")
    if "url" not in o or "table" not in o:
        raise InvalidInput("url and table are needed")
    out = {"url": o["url"], "dbtable": f"(SELECT {', '.join(t.schema.names)} FROM {o['table']} LIMIT {int(o.get('limit', REMOTE_LIMIT))}) AS remote", "pushDownPredicate": "true", "pushDownLimit": "true"}
    for k in ("user", "driver", "partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize"):
        if k in o:
            out[k] = str(o[k])
    if "partitionColumn" in o:  # read in parallel, so the whole table; a limit that was asked for cannot hold then
        if "limit" in o:
            raise InvalidInput("a remote limit and partitionColumn exclude each other")
        out["dbtable"] = o["table"]
    if name := o.get("password_env"):
        if name not in os.environ:
            raise InvalidInput(f"the environment has no {name}")
        out["password"] = os.environ[name]
    return out


def jdbc(spark: SparkSession, t: ForeignTable) -> DataFrame:
    return t.schema.conform(spark.read.format("jdbc").options(**jdbc_options(t)).load())
