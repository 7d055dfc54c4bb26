"""Change streams over a change log: pages of commits, events, subscriptions, and the log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import Expired

#: Numbers of commits that are gathered on the driver at once; of larger pages the end is looked for by counts.
GATHERED = 10_000


def page(log: DataFrame, token: int, *, max_commits: int, target: str | None = None, earliest: int | None = None, markers: bool = True) -> tuple[DataFrame, int, bool]:
    """(events, next token, whether more follow): the commits after a token, at most max_commits of them.

    Events are (lsn, at, target, op, key, kind): an upsert, delete or ddl, between a begin and a commit marker for each
    commit that has any. The token moves past commits of which nothing is wanted.
    """
    if earliest is not None and token + 1 < earliest:
        raise Expired(f"commits before {earliest} are not kept")
    later = log.filter(F.col("lsn") > token)
    last, more = _end(later, max_commits)
    if last is None:
        return _events(later.limit(0), markers), token, False
    own = later.filter(F.col("lsn") <= last)
    if target is not None:
        own = own.filter(F.col("target") == target)
    return _events(own, markers), last, more


def _end(later: DataFrame, most: int) -> tuple[int | None, bool]:
    """(the number of the commit that ends a page of `most` commits, whether more follow); the driver holds GATHERED numbers at most."""
    if most > GATHERED:
        whole = later.agg(F.count("*").alias("n"), F.max("lsn").alias("last")).first()
        if whole["n"] <= most:  # no more commits than changes
            return whole["last"], False
    commits, after = later.select("lsn").distinct(), lambda lsn: not later.filter(F.col("lsn") > lsn).isEmpty()
    while most > GATHERED:  # into the 1,024th part of the numbers that holds the end
        span = commits.agg(F.count("*").alias("n"), F.min("lsn").alias("low"), F.max("lsn").alias("high")).first()
        if span["n"] <= most:
            return span["high"], after(span["high"])
        low, width = span["low"], (span["high"] - span["low"]) // 1024 + 1
        for part in commits.groupBy(F.expr(f"(lsn - {low}L) div {width}L").alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect():  # 1,024 rows
            if part["n"] >= most:
                break
            most -= part["n"]
        low += part["at"] * width
        commits = commits.filter((F.col("lsn") >= low) & (F.col("lsn") < low + width))
    ends = commits.orderBy("lsn").limit(most + 1).collect()  # most + 1 numbers
    if not ends:
        return None, False
    last = ends[min(len(ends), most) - 1]["lsn"]
    return last, len(ends) > most or after(last)


def _events(rows: DataFrame, markers: bool) -> DataFrame:
    kinds = F.when(F.col("op") == "delete", "delete").when(F.col("op") == "ddl", "ddl").otherwise("upsert")
    events = rows.select("lsn", "at", "target", "op", F.col("key").cast("string").alias("key"), kinds.alias("kind"))
    if not markers:
        return events.orderBy("lsn", "key")
    edge = lambda k: events.groupBy("lsn", "at").agg(F.lit(None).cast("string").alias("target")).select("lsn", "at", "target", F.lit(k).alias("op"), F.lit(None).cast("string").alias("key"), F.lit(k).alias("kind"))
    order = F.when(F.col("kind") == "begin", 0).when(F.col("kind") == "commit", 2).otherwise(1)
    return events.unionByName(edge("begin")).unionByName(edge("commit")).orderBy("lsn", order, "key")


def on_timeline(tokens: DataFrame, forks: DataFrame) -> DataFrame:
    """tokens (timeline, lsn) mapped to child timelines: one that is beyond its fork (parent, child, fork_lsn) goes back to it."""
    return tokens.join(forks, tokens.timeline == forks.parent).select(F.col("child").alias("timeline"), F.least("lsn", "fork_lsn").alias("lsn"))


def net_changes(log: DataFrame, key: str = "key") -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("lsn"))
    return log.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def stream(spark, path: str, schema) -> DataFrame:
    """The change log as a stream: each new file of the append-only log once, by the reader's checkpoint."""
    return spark.readStream.schema(schema).parquet(path)


def deliver(changes: DataFrame, sink, *, checkpoint: str, once: bool = True):
    """Sends batches of a stream to sink(batch, batch_id); the checkpoint holds what was sent. Returns the query."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def outbox(events: DataFrame, sent: DataFrame | None, connector: str) -> DataFrame:
    """events as rows of a connector's outbox, each (connector, lsn, key) once, without those that were sent."""
    rows = events.filter("kind in ('upsert', 'delete')").select(F.lit(connector).alias("connector"), "lsn", "key", "op").dropDuplicates(["connector", "lsn", "key"])
    return rows if sent is None else rows.join(sent, ["connector", "lsn", "key"], "left_anti")


def after_commit(events: DataFrame, hook: str) -> DataFrame:
    """One row a commit: what a hook after commits is told."""
    return events.filter("kind in ('upsert', 'delete', 'ddl')").groupBy("lsn").agg(F.count("*").alias("events")).select(F.lit(hook).alias("hook"), "lsn", "events")
