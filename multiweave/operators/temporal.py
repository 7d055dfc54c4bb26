"""Reads of a change log (lsn, at, op, key, columns...) at a point in time, and its history.

op is 'upsert' or 'delete'. lsn orders commits; at is the commit's time in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import Expired, NotFound

SYSTEM = ["valid_from_lsn", "valid_to_lsn", "valid_from", "valid_to"]


def columns_of(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("lsn", "at", "op")]


def lsn_at(log: DataFrame, ts: int) -> int:
    """The last commit at or before a time."""
    got = log.filter(F.col("at") <= ts).agg(F.max("lsn")).first()[0]
    if got is None:
        raise NotFound(f"no commit at or before {ts}")
    return got


def check_kept(log: DataFrame, lsn: int, *, min_lsn: int | None) -> None:
    if min_lsn is not None and lsn < min_lsn:
        raise Expired(f"commits before {min_lsn} are not kept")


def as_of(log: DataFrame, key: str, lsn: int, *, min_lsn: int | None = None) -> DataFrame:
    """The rows as they stood after a commit: of each key the newest version by then, if that is no delete.

    A grouped maximum, so each task reduces its keys before the shuffle.
    """
    check_kept(log, lsn, min_lsn=min_lsn)
    return last_changes(log.filter(F.col("lsn") <= lsn), key).filter("op <> 'delete'").select(columns_of(log))


def last_changes(log: DataFrame, key: str) -> DataFrame:
    """(op and the log's own columns) of the newest change of each key."""
    cols = columns_of(log)
    newest = log.groupBy(key).agg(F.max_by(F.struct("op", *[c for c in cols if c != key]), "lsn").alias("v"))
    return newest.select(F.col("v.op").alias("op"), *[F.col(key) if c == key else F.col(f"v.{c}").alias(c) for c in cols])


def history(log: DataFrame, key: str) -> DataFrame:
    """One row a version, with the commits and times between which it held; the end of what still holds is null. A delete ends its key's version and is no row."""
    w = Window.partitionBy(key).orderBy("lsn")
    spans = log.withColumn("valid_from_lsn", F.col("lsn")).withColumn("valid_to_lsn", F.lead("lsn").over(w)).withColumn("valid_from", F.col("at")).withColumn("valid_to", F.lead("at").over(w))
    return spans.filter("op <> 'delete'").select(*columns_of(log), *SYSTEM)
