"""Queries that go through the facade: statements, writes, time travel, change streams, catalog. Each makes a database of its own from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import DuplicateKey, Expired, InvalidInput
from ..operators import documents, policy, stats, workload
from ..schema import TableSchema
from ..session import read
from ..streaming import changes
from ..streaming.views import View
from .domain import _HAV, _LOG, _PLACE, _bm25, _docs, _folder, _log, _places, query

_BUYERS = TableSchema.of("id", id="int!", name="str", balance="float", segment="str")
_OLD = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer"
_NEW = "(900001, 'New ''one''', 1.5, 'BUILDING'), (900002, NULL, -2.0, NULL)"


def _buyers(spark: SparkSession, d: str) -> Engine:
    db = Engine(spark, _folder(spark, "db"))
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    db.create_table("buyers", _BUYERS).insert(own)
    return db


# ------------------------------------------------------------------ statements


@query(f"SELECT segment, count(*) AS n, count(name) AS named, min(balance) AS low FROM ({_OLD} UNION ALL VALUES {_NEW}) GROUP BY segment")
def stmt_insert(spark, d) -> DataFrame:
    """A script: rows are added, and the last statement's rows come back."""
    return _buyers(spark, d).sql(f"insert into buyers values {_NEW}; select segment, count(*) as n, count(name) as named, min(balance) as low from buyers group by segment")


@query(f"SELECT true AS refused, count(*) AS n FROM ({_OLD})")
def stmt_insert_is_atomic(spark, d):
    """One key that is there already, and nothing is written."""
    db, refused = _buyers(spark, d), False
    try:
        db.sql("insert into buyers values (900001, 'x', 1.5, 'A'), (1, 'y', 1.5, 'A')")
    except DuplicateKey:
        refused = True
    return db.sql("select count(*) as n from buyers").withColumn("refused", F.lit(refused))


@query(f"SELECT CAST(id AS BIGINT) AS k, name, segment FROM (VALUES (1, 'one', 'A'), (900001, 'new', 'B'), (2, 'two', 'C')) AS v(id, name, segment) WHERE id NOT IN (SELECT id FROM ({_OLD}))")
def stmt_conflict_nothing(spark, d):
    return _buyers(spark, d).sql("insert into buyers (id, name, segment) values (1, 'one', 'A'), (900001, 'new', 'B'), (2, 'two', 'C') on conflict (id) do nothing returning id as k, name, segment")


@query(f"SELECT id, CASE id WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE name END AS name, balance, CASE WHEN id IN (1, 2) THEN 'X' ELSE segment END AS segment FROM ({_OLD}) UNION ALL SELECT 900001, 'new', 3.5, 'B'")
def stmt_conflict_update(spark, d):
    db = _buyers(spark, d)
    db.sql("insert into buyers values (1, 'one', 0.5, 'A'), (900001, 'new', 3.5, 'B'), (2, 'two', 0.5, 'C') on conflict (id) do update set name = excluded.name, segment = 'X'")
    return db.sql("select id, name, balance, segment from buyers")


def _changed(spark, d) -> tuple[Engine, int]:
    """(database, its first commit): rows of two segments leave, are changed, and come."""
    db = _buyers(spark, d)
    first, t = db.last_lsn(), db.table("buyers")
    t.delete("segment = 'BUILDING'")
    t.upsert(t.scan().filter("segment = 'MACHINERY'").withColumn("balance", F.col("balance") + 1000))
    db.sql(f"insert into buyers values {_NEW}")
    return db, first


_AFTER = f"SELECT id, name, CASE WHEN segment = 'MACHINERY' THEN balance + 1000 ELSE balance END AS balance, segment FROM ({_OLD}) WHERE segment <> 'BUILDING' UNION ALL VALUES {_NEW}"


@query(_AFTER)
def stmt_changes_merged(spark, d):
    """The rows as they stand: a snapshot with what came after it."""
    return _changed(spark, d)[0].sql("select * from buyers")


@query(f"SELECT segment, count(*) AS n, max(balance) AS top FROM ({_OLD}) GROUP BY segment")
def stmt_as_of(spark, d):
    db, first = _changed(spark, d)
    return db.sql(f"select segment, count(*) as n, max(balance) as top from buyers group by segment AS OF LSN {first}")


@query(f"WITH a AS (SELECT *, 1 AS f, CASE segment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 END AS t FROM ({_OLD})) SELECT id, balance, f AS valid_from_lsn, t AS valid_to_lsn FROM a UNION ALL SELECT id, balance + 1000, 3, NULL FROM a WHERE segment = 'MACHINERY' UNION ALL SELECT id, b, 4, NULL FROM (VALUES {_NEW}) v(id, n, b, s)")
def stmt_history(spark, d):
    db, _ = _changed(spark, d)
    return db.sql(f"select id, balance, cast(valid_from_lsn as int) as valid_from_lsn, cast(valid_to_lsn as int) as valid_to_lsn from {db.enable_system_versioning('buyers')}")


@query("SELECT true AS expired")
def stmt_as_of_expired(spark, d):
    db, first = _changed(spark, d)
    db.enable_system_versioning("buyers", min_lsn=first + 1)
    try:
        db.sql_as_of("select * from buyers", lsn=first)
    except Expired:
        return spark.createDataFrame([(True,)], "expired boolean")
    return spark.createDataFrame([(False,)], "expired boolean")


@query(f"SELECT segment, count(*) AS n FROM ({_OLD}) WHERE balance > 5000 GROUP BY segment")
def stmt_call(spark, d):
    db = _buyers(spark, d)
    db.register_procedure("rich", lambda e, least: e.sql(f"select segment, count(*) as n from buyers where balance > {least} group by segment"))
    return db.sql("call rich(5000)")


@query(f"SELECT id, balance * 2 + 1 AS twice, upper(substr(name, 1, 3)) AS short FROM ({_OLD})")
def stmt_functions(spark, d):
    """A function of SQL and one of Python, by Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    db = _buyers(spark, d)
    db.register_sql_function("create function twice_more(x double) returns double return x * 2 + 1")
    db.register_function("short_name", pandas_udf(lambda s: s.str[:3].str.upper(), "string"))
    return db.sql("select id, twice_more(balance) as twice, short_name(name) as short from buyers")


@query("SELECT 'buyers' AS table_name, CASE column_name WHEN 'c_custkey' THEN 'id' WHEN 'c_name' THEN 'name' WHEN 'c_acctbal' THEN 'balance' ELSE 'segment' END AS column_name, CASE data_type WHEN 'BIGINT' THEN 'int8' WHEN 'DOUBLE' THEN 'float8' ELSE 'text' END AS data_type, CASE column_name WHEN 'c_custkey' THEN 'NO' ELSE 'YES' END AS is_nullable FROM information_schema.columns WHERE table_name = 'customer' AND column_name <> 'c_nationkey'")
def stmt_catalog(spark, d):
    return _buyers(spark, d).sql("select table_name, column_name, data_type, is_nullable from information_schema.columns")


@query(f"SELECT c AS column_name, count(*) AS n_rows, count(DISTINCT v) AS ndv, round(1 - count(v) / count(*), 6) AS null_fraction FROM (SELECT unnest(['id', 'name', 'balance', 'segment']) AS c, unnest([id::VARCHAR, name, balance::VARCHAR, segment]) AS v FROM ({_OLD} UNION ALL VALUES {_NEW})) GROUP BY c")
def stmt_analyze(spark, d):
    db = _buyers(spark, d)
    db.sql(f"insert into buyers values {_NEW}")
    return db.sql("analyze full table buyers").select("column_name", "n_rows", "ndv", F.round("null_fraction", 6).alias("null_fraction"))


@query(f"SELECT item, CAST(value AS BIGINT) AS value FROM (SELECT 'rows' AS item, count(*) AS value FROM ({_OLD}) WHERE segment = 'BUILDING' UNION ALL SELECT 'rows_examined', count(*) FROM ({_OLD}) UNION ALL SELECT 'rows_estimated', round(count(*) / count(DISTINCT segment)) FROM ({_OLD}))")
def stmt_explain_analyze(spark, d):
    """What a plan was thought to give, from the statistics, against what it gave."""
    db = _buyers(spark, d)
    db.sql("analyze full table buyers")
    return db.sql("explain analyze select * from buyers where segment = 'BUILDING'").filter("item like 'rows%'").select("item", F.col("value").cast("long").alias("value"))


@query(f"SELECT 'cluster' AS action, 'buyers' AS table_name, 'id' AS column_name, count(*) AS examined, CAST(1 AS BIGINT) AS returned FROM ({_OLD})")
def stmt_index_advice(spark, d):
    """A filter that examines all rows and returns one asks for a clustered copy."""
    db = _buyers(spark, d)
    db.sql("explain analyze select name from buyers where id = 7")
    number = lambda k: F.regexp_extract("reason", "^([0-9]+) rows examined for ([0-9]+) ", k).try_cast("long")
    return db.sql("select * from system.index_advice").select("action", "table_name", "column_name", number(1).alias("examined"), number(2).alias("returned"))


@query(_bm25(["license", "version"], 12))
def stmt_match(spark, d):
    """match() as a table of a statement, over a stored index that followed a later write."""
    db = Engine(spark, _folder(spark, "db"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    t = db.create_table("notes", TableSchema.of("id", id="int!", body="str"))
    t.insert(docs.filter("id % 2 = 0"))
    db.create_full_text_index("notes_text", "notes", id_col="id", text_col="body")
    t.insert(docs.filter("id % 2 <> 0"))
    return db.sql("select id, round(score, 6) as score from match('notes_text', 'license version', 12)")


@query("SELECT 'n' || b.n_nationkey AS node FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey = 3 AND b.n_nationkey <> 3 UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 3")
def stmt_graph_neighbors(spark, d):
    db = Engine(spark, _folder(spark, "db"))
    db.create_graph("world")
    at = [(f"n{r[0]}", f"r{r[1]}") for r in read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]  # 25 rows
    db.add_edges("world", [(n, "in", r) for n, r in at] + [(r, "has", n) for n, r in at])
    return db.sql("select node from graph_neighbors('world', 'n3', null, 2) where node <> 'n3'")


@query(f"SELECT id, round({_HAV.format(lon=10.0, lat=50.0)}, 2) AS meters FROM {_PLACE} WHERE {_HAV.format(lon=10.0, lat=50.0)} <= 6000000 AND id % 2 = 1")
def stmt_within_radius(spark, d):
    db = Engine(spark, _folder(spark, "db"))
    places = _places(spark, d).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    db.create_table("places", TableSchema.of("id", id="int!", lon="float", lat="float")).insert(places)
    db.create_geo_index("places_geo", "places")
    return db.sql("select id, round(distance_meters, 2) as meters from within_radius('places_geo', 10.0, 50.0, 6000000) where id % 2 = 1")


# ------------------------------------------------------------------ rules around writes


@query(f"SELECT true AS refused, count(*) AS n FROM ({_OLD})")
def hook_before_commit(spark, d):
    db, refused = _buyers(spark, d), False
    db.register_hook("buyers", policy.Hook("has_segment", "empty"))
    try:
        db.table("buyers").insert([(900001, "x", 1.0, "A"), (900002, "y", 1.0, "")])
    except InvalidInput:
        refused = True
    return db.sql("select count(*) as n from buyers").withColumn("refused", F.lit(refused))


@query(f"SELECT id, name, balance, segment FROM ({_OLD}) UNION ALL SELECT 900001, 'X', 0.0, 'A'")
def trigger_before_insert(spark, d):
    db = _buyers(spark, d)
    db.register_trigger("buyers", lambda rows: rows.withColumn("name", F.upper("name")).withColumn("balance", F.greatest("balance", F.lit(0.0))))
    db.table("buyers").insert([(900001, "x", -5.0, "A")])
    return db.sql("select * from buyers")


@query("SELECT id, reason FROM (SELECT event_id AS id, CASE WHEN event_id % 50 + CASE WHEN event_type = 'error' THEN 8 ELSE 13 + length(CAST(user_id AS VARCHAR)) END > 40 THEN 'too large' WHEN event_type = 'error' THEN 'no k' END AS reason FROM events) WHERE reason IS NOT NULL")
def policy_validation(spark, d):
    """Documents without a field that is required, or of more than 40 bytes."""
    fields = F.struct(F.when(F.col("event_type") != "error", F.col("user_id")).alias("k"), F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")).alias("s"))
    return policy.rejects(read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(fields).alias("doc")), required=["k"], max_bytes=40).select("id", "reason")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_id = 17")
def doc_get(spark, d):
    return _docs(spark, d).filter("id = 17").select("id", documents.typed(F.col("doc"), "what.event_type", "str").alias("kind"))


# ------------------------------------------------------------------ change streams


@query(f"SELECT 'delete' AS kind, CAST(id AS VARCHAR) AS key, 'buyers' AS target, 2 AS lsn FROM ({_OLD}) WHERE segment = 'BUILDING' UNION ALL SELECT 'upsert', CAST(id AS VARCHAR), 'buyers', 3 FROM ({_OLD}) WHERE segment = 'MACHINERY' UNION ALL SELECT 'upsert', CAST(id AS VARCHAR), 'buyers', 4 FROM (VALUES {_NEW}) v(id, n, b, s) UNION ALL SELECT k, NULL, NULL, l FROM (VALUES ('begin'), ('commit')) x(k), (VALUES (2), (3), (4)) y(l)")
def cdc_subscription(spark, d):
    """What a durable subscription has left to read once it has said that it has the first commit."""
    db, first = _changed(spark, d)
    db.create_subscription("copy", target="buyers")
    _, token, more = db.poll("copy", max_commits=1)
    assert token == first and more
    db.ack("copy", token)
    return db.poll("copy")[0].select("kind", "key", "target", F.col("lsn").cast("int").alias("lsn"))


@query("SELECT true AS expired")
def cdc_token_expired(spark, d):
    try:
        changes.page(_log(spark, d).withColumn("target", F.lit("users")), 3, max_commits=5, earliest=10)
    except Expired:
        return spark.createDataFrame([(True,)], "expired boolean")
    return spark.createDataFrame([(False,)], "expired boolean")


@query(f"SELECT DISTINCT child AS timeline, least(lsn, fork) AS lsn FROM (SELECT key % 3 AS timeline, lsn FROM {_LOG}) JOIN (VALUES (0, 10, 500), (1, 11, 50), (1, 12, 900)) AS f(parent, child, fork) ON timeline = parent")
def cdc_timeline_forks(spark, d):
    tokens = _log(spark, d).select((F.col("key") % 3).cast("int").alias("timeline"), "lsn")
    return changes.on_timeline(tokens, spark.createDataFrame([(0, 10, 500), (1, 11, 50), (1, 12, 900)], "parent int, child int, fork_lsn long")).distinct()


@query(f"SELECT 'mail' AS connector, lsn, CAST(key AS VARCHAR) AS key, op FROM {_LOG} WHERE lsn > 40 AND lsn % 7 <> 0")
def cdc_outbox(spark, d):
    events = changes.page(_log(spark, d).withColumn("target", F.lit("users")), 40, max_commits=1 << 30)[0]
    sent = events.filter("lsn % 7 = 0 and key is not null").select(F.lit("mail").alias("connector"), "lsn", "key")
    return changes.outbox(events, sent, "mail")


@query(f"SELECT 'tell' AS hook, lsn, count(*) AS events FROM {_LOG} GROUP BY lsn")
def hook_after_commit(spark, d):
    return changes.after_commit(changes.page(_log(spark, d).withColumn("target", F.lit("users")), -1, max_commits=1 << 30)[0], "tell")


@query(f"SELECT 'upsert' AS op, count(*) + (SELECT count(*) FROM ({_OLD}) WHERE segment = 'MACHINERY') + 2 AS n FROM ({_OLD}) UNION ALL SELECT 'delete', count(*) FROM ({_OLD}) WHERE segment = 'BUILDING'")
def cdc_continuous_query(spark, d):
    """A query over the changes of a table that is run twice: it takes up where it stopped."""
    db, out = _buyers(spark, d), _folder(spark, "sink")
    run = lambda: db.continuous_query("all", "buyers", lambda s: s.select("op", "id"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    run()
    t = db.table("buyers")
    t.delete("segment = 'BUILDING'")
    t.upsert(t.scan().filter("segment = 'MACHINERY'"))
    db.sql(f"insert into buyers values {_NEW}")
    run()
    return spark.read.schema("op string, id long").parquet(f"{out}/*").groupBy("op").agg(F.count("*").alias("n"))


@query(f"SELECT segment, count(*) AS count, round(sum(balance), 4) AS sum_balance FROM ({_AFTER}) GROUP BY segment")
def mv_through_engine(spark, d):
    """A view made at the first commit and refreshed from the log after three more."""
    db = _buyers(spark, d)
    db.create_materialized_view(View("by_segment", "buyers", "id", "segment", (("count", None), ("sum", "balance"))))
    t = db.table("buyers")
    t.delete("segment = 'BUILDING'")
    t.upsert(t.scan().filter("segment = 'MACHINERY'").withColumn("balance", F.col("balance") + 1000))
    db.sql(f"insert into buyers values {_NEW}")
    db.refresh("by_segment")
    return db.sql("select segment, count, round(sum_balance, 4) as sum_balance from by_segment")


# ------------------------------------------------------------------ workload and estimates


@query("SELECT event_type AS fingerprint, count(*) AS executions, CAST(sum(user_id) AS BIGINT) AS rows_returned, CAST(sum(event_id) AS BIGINT) AS rows_examined, max(value) AS latency_max_ms FROM events GROUP BY 1")
def workload_report(spark, d):
    seen = read(spark, d, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("fingerprint"), F.lit("t").alias("table_name"), F.lit("c").alias("column_name"), F.col("value").alias("latency_ms"), F.col("user_id").alias("rows_returned"), F.col("event_id").alias("rows_examined"), F.lit(False).alias("uses_index"))
    return workload.report(seen).select("fingerprint", "executions", "rows_returned", "rows_examined", "latency_max_ms")


@query("WITH c AS (SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 32), s AS (SELECT sum(n) AS total, count(*) AS ndv FROM c) SELECT c.value, round(coalesce(t.n / total, 1 / ndv), 9) AS share FROM c LEFT JOIN t USING (value), s")
def stats_eq_selectivity(spark, d):
    """The share of rows that each value is thought to have: of the 32 commonest as counted, of the others an even one."""
    rows = read(spark, d, "lineitem")
    known = stats.column_stats(rows, "l_suppkey").first().asDict()
    common = {r["value"]: r["n"] for r in stats.common_values(rows, "l_suppkey").collect()}  # 32 rows
    others = stats.eq_selectivity(known, common, None)
    listed = spark.createDataFrame([(v, stats.eq_selectivity(known, common, v)) for v in common], "value long, share double")
    values = rows.select(F.col("l_suppkey").cast("long").alias("value")).distinct()
    return values.join(F.broadcast(listed), "value", "left").select("value", F.round(F.coalesce("share", F.lit(others)), 9).alias("share"))
