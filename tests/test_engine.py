"""The facade: writes, statements, time travel, change streams, views, policies, indexes."""

import pytest
from pyspark.sql import functions as F

from multiweave.engine import Engine
from multiweave.errors import Denied, DuplicateKey, Exists, Expired, InvalidInput, LimitExceeded, NotFound, Unsupported
from multiweave.operators import documents, policy
from multiweave.schema import TableSchema
from multiweave.sources import foreign
from multiweave.streaming.views import View, recompute

USERS = TableSchema.of("id", id="int!", name="str!", age="int!", active="bool")
ORDERS = TableSchema.of("id", id="int!", user_id="int!", amount="float!")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_table("users", USERS).insert([(1, "Ada", 37, True), (2, "Grace", 85, None)])
    e.create_table("orders", ORDERS).insert([(10, 1, 5.5), (11, 1, 7.0), (12, 2, 3.0)])
    return e


def test_queries(engine):
    assert rows(engine.sql("select u.name, o.amount from users u join orders o on u.id = o.user_id where o.amount > 5.0")) == [("Ada", 5.5), ("Ada", 7.0)]
    assert rows(engine.sql("select user_id, count(*) n from orders group by user_id")) == [(1, 2), (2, 1)]
    assert rows(engine.sql("select name from users where age + 1 = 38")) == [("Ada",)]
    assert rows(engine.sql("select name from users where active = null")) == []
    assert rows(engine.sql("select 1 as a; select 2 as b")) == [(2,)]
    t = engine.table("users")
    assert rows(t.get(2)) == rows(t.query_eq("name", "Grace")) and t.scan_page(1, 1).first()["id"] == 2


def test_insert_is_atomic_and_strict(engine):
    with pytest.raises(DuplicateKey):
        engine.sql("insert into users values (3, 'Eve', 20, true), (1, 'Ada', 1, true)")
    assert engine.table("users").scan().count() == 2
    for bad in ("(3, 'Eve', 1.5, true)", "(3, null, 1, true)", "(null, 'x', 1, true)", "('3', 'x', 1, true)"):
        with pytest.raises(InvalidInput):
            engine.sql(f"insert into users values {bad}")
    with pytest.raises(InvalidInput):
        engine.table("orders").insert([(1, 1, float("nan"))])
    assert rows(engine.sql("insert into users (name, id, age) values ('O''Hara', 4, -3) returning id as k, name, active")) == [(4, "O'Hara", None)]


def test_conflicts(engine):
    assert rows(engine.sql("insert into users values (1, 'X', 1, true), (5, 'Y', 2, false) on conflict (id) do nothing returning *")) == [(5, "Y", 2, False)]
    engine.sql("insert into users values (1, 'New', 40, false), (6, 'Z', 3, false) on conflict (id) do update set name = excluded.name, age = 99")
    assert rows(engine.table("users").get(1)) == [(1, "New", 99, True)]
    assert rows(engine.table("users").get(6)) == [(6, "Z", 3, False)]
    with pytest.raises(Unsupported):
        engine.sql("insert into users values (1, 'X', 1, true) on conflict (name) do nothing")


def test_time_travel_equals_what_was(engine):
    before = engine.last_lsn()
    was = rows(engine.sql("select * from users"))
    engine.sql("insert into users values (1, 'Ada', 38, true) on conflict (id) do update set age = excluded.age")
    engine.table("users").delete(F.col("id") == 2)
    assert rows(engine.sql("select * from users")) == [(1, "Ada", 38, True)]
    assert rows(engine.sql(f"select * from users AS OF LSN {before}")) == was
    assert rows(engine.sql_as_of("select age from users where id = 1", lsn=before)) == [(37,)]
    with pytest.raises(NotFound):
        engine.sql("select * from users AS OF TIMESTAMP 5")
    name = engine.enable_system_versioning("users", min_lsn=before + 1)
    assert [(r["age"], r["valid_to_lsn"]) for r in engine.sql(f"select * from {name} where id = 1 order by valid_from_lsn").collect()] == [(37, before + 1), (38, None)]
    with pytest.raises(Expired):
        engine.sql_as_of("select * from users", lsn=before)


def test_changefeed_and_subscriptions(engine):
    events, token, more = engine.changefeed(0, target="users", max_commits=1)
    assert [(r["kind"], r["key"]) for r in events.collect()] == [("begin", None), ("upsert", "1"), ("upsert", "2"), ("commit", None)] and token == 1 and more
    events, token, more = engine.changefeed(token, target="users", max_commits=10)
    assert events.isEmpty() and token == 2 and not more
    engine.create_subscription("s", target="users")
    engine.table("users").delete(F.col("id") == 1)
    _, token, _ = engine.poll("s")
    engine.ack("s", token)
    assert engine.subscription("s")["lsn"] == token and engine.poll("s")[0].isEmpty()


def test_view_equals_recompute(engine):
    view = View("by_user", "orders", "id", "user_id", (("count", None), ("sum", "amount"), ("avg", "amount")))
    engine.create_materialized_view(view)
    orders = engine.table("orders")
    for write in (lambda: orders.insert([(13, 3, 1.0)]), lambda: orders.upsert([(10, 2, 100.0)]), lambda: orders.delete(F.col("user_id") == 3), lambda: orders.delete(F.col("id") == 11)):
        write()
        engine.refresh("by_user")
        assert rows(engine.read_view("by_user")) == rows(recompute(orders.scan(), view))
    assert rows(engine.sql("select user_id from by_user")) == [(2,)]


def test_documents_never_coerce(engine):
    f = documents.DocField
    docs = engine.create_collection("profiles", [f("user_id", "user_id", "int"), f("city", "profile.city", "str"), f("score", "score", "float")])
    docs.insert([("a", '{"user_id": 1, "profile": {"city": "Oslo"}, "score": 1}'), ("b", '{"user_id": "2", "profile": {}, "score": 2.0}'), ("c", '{"user_id": 3.0}')])
    assert rows(engine.sql("select user_id, city, score from profiles")) == sorted([(1, "Oslo", None), (None, None, 2.0), (None, None, None)], key=str)
    assert rows(engine.sql("select u.name, p.city from users u join profiles p on p.user_id = u.id")) == [("Ada", "Oslo")]
    assert [r["id"] for r in engine.find("profiles", documents.eq(F.col("doc"), "profile.city", "Oslo")).collect()] == ["a"]
    assert [r["id"] for r in engine.find("profiles", documents.between(F.col("doc"), "user_id", 0, 2)).collect()] == ["a"]


def test_domain_objects(engine, spark):
    engine.create_table("posts", TableSchema.of("id", id="int!", body="str", lon="float", lat="float")).insert([(1, "Rust database storage engine", 179.9, 0.0), (2, "Cooking with herbs", 21.0122, 52.2297), (3, " ", -0.1276, 51.5072)])
    engine.create_full_text_index("idx", "posts", id_col="id", text_col="body")
    assert [r["id"] for r in engine.sql("select * from match('idx', 'rust database')").collect()] == [1]
    assert rows(engine.sql("select p.id, m.score > 0 from match('idx', 'herbs', 5) m join posts p on p.id = m.id")) == [(2, True)]
    engine.create_geo_index("geo", "posts")
    assert [r["id"] for r in engine.within_radius("geo", -179.9, 0.0, 50_000).collect()] == [1]
    assert [r["id"] for r in engine.sql("select id from within_radius('geo', 21.0, 52.0, 2000000) where id > 2").collect()] == [3]
    engine.create_graph("g")
    engine.add_edges("g", [("a", "knows", "b"), ("b", "knows", "c"), ("a", "likes", "c")])
    assert [r["node"] for r in engine.k_hop("g", "a", "knows", max_depth=2).collect()] == ["b", "c"]
    assert engine.shortest_path("g", "a", "c", "knows") == ["a", "b", "c"] and engine.shortest_path("g", "c", "a") is None
    assert rows(engine.sql("select node from graph_neighbors('g', 'a', 'knows', 2)")) == [("b",), ("c",)]
    engine.create_time_series("ts", retention_ms=1000, bucket_ms=1000)
    engine.insert_points("ts", [("cpu", 1000, 1.5), ("cpu", 1250, 2.5), ("cpu", 2000, 3.5)])
    assert engine.ts_range("ts", "cpu", 1000, 2000).count() == 2 and engine.ts_latest("ts").first()["timestamp_millis"] == 2000
    engine.insert_points("ts", [("cpu", 3100, 0.5)])
    assert engine.points("ts").count() == 2


def test_catalog_and_tools(engine, tmp_path):
    assert ("users",) in rows(engine.sql("select table_name from information_schema.tables where table_type = 'BASE TABLE'"))
    assert rows(engine.sql("select column_name from information_schema.columns where table_name = 'orders' and is_nullable = 'NO'")) == [("amount",), ("id",), ("user_id",)]
    assert engine.sql("select * from pg_class").count() == 2 and engine.sql("select * from system.status").count() == 4
    assert {r["column_name"]: r["ndv"] for r in engine.sql("analyze full table users").collect()} == {"id": 2, "name": 2, "age": 2, "active": 1}
    assert engine.sql("explain analyze select * from users").filter("item = 'rows'").first()["value"] == "2"
    engine.register_procedure("grow", lambda e, a, b: a + b)
    assert rows(engine.sql("call grow(1, 2)")) == [("3",)]
    engine.register_function("twice", lambda x: x * 2, "long")
    assert rows(engine.sql("select twice(age) from users where id = 1")) == [(74,)]
    engine.register_sql_function("create function add1(x bigint) returns bigint return x + 1")
    assert rows(engine.sql("select add1(id) from users where id = 2")) == [(3,)]
    engine.record_workload(fingerprint="f", table="orders", column="user_id", latency_ms=5, returned=1, examined=1000)
    assert [(r["action"], r["column_name"]) for r in engine.index_advice().collect()] == [("cluster", "user_id")]
    assert engine.workload_report().filter("fingerprint = 'f'").first()["executions"] == 1


def test_rules(engine):
    engine.policies = policy.Policies(rows=[policy.RowPolicy("users", "name")], masks=[policy.Mask("users", "name")])
    assert rows(engine.sql("select id, name from users", principal="Ada")) == [(1, "***")]
    assert engine.sql("select * from users u join orders o on u.id = o.user_id", principal="Ada").count() == 2
    engine.grant("Ada", "read", "users")
    with pytest.raises(Denied):
        engine.sql("select * from orders", principal="Ada")
    with pytest.raises(Denied):
        engine.sql("insert into users values (9, 'x', 1, true)", principal="Ada")
    engine.register_hook("users", policy.Hook("no_empty", "empty"))
    with pytest.raises(InvalidInput):
        engine.table("users").insert([(9, "", 1, True)])
    engine.unregister_hook("no_empty")
    engine.register_trigger("users", lambda df: df.withColumn("age", F.col("age") + 1))
    engine.table("users").insert([(9, "", 1, True)])
    assert engine.table("users").get(9).first()["age"] == 2


def test_fails_closed(engine):
    for text in ("update users set age = 1", "delete from users", "create table x (a int)", "drop table users", "explain insert into users values (1)"):
        with pytest.raises(Unsupported):
            engine.sql(text)
    with pytest.raises(LimitExceeded):
        engine.sql("select 1;" * 40)
    with pytest.raises(LimitExceeded):
        engine.sql("select " + "(" * 200 + "1" + ")" * 200)
    with pytest.raises(NotFound):
        engine.table("nothing")
    with pytest.raises(Exists):
        engine.create_table("users", USERS)
    with pytest.raises(InvalidInput):
        TableSchema.of("x", id="int")


def test_continuous_query(engine):
    seen = []
    for _ in range(2):
        engine.continuous_query("c", "orders", lambda s: s.filter("op = 'upsert'"), lambda b, n: seen.extend(r["id"] for r in b.collect())).awaitTermination()
    assert sorted(seen) == [10, 11, 12]
    engine.table("orders").insert([(20, 1, 1.0)])
    engine.continuous_query("c", "orders", lambda s: s.filter("op = 'upsert'"), lambda b, n: seen.extend(r["id"] for r in b.collect())).awaitTermination()
    assert sorted(seen) == [10, 11, 12, 20]


def test_foreign_table(engine, tmp_path):
    (tmp_path / "u.csv").write_text('1,Ada,37\n2,"Gr ""ace""",\n')
    engine.create_foreign_table("ext", foreign.ForeignTable(TableSchema.of("id", id="int!", name="str", age="int"), "csv", f"file://{tmp_path}/u.csv"))
    assert rows(engine.sql("select name, age from ext where id = 2")) == [('Gr "ace"', None)]
    with pytest.raises(InvalidInput):
        engine.create_foreign_table("pg", foreign.ForeignTable(TableSchema.of("id", id="int"), "jdbc", options={"url": "jdbc:x", "table": "t", "password": "p"}))


def test_text_index_follows_its_table(engine):
    """A stored index is brought up to date from the change log, and gives what a scan of the texts gives."""
    from multiweave.operators import fulltext

    t = engine.create_table("notes", TableSchema.of("id", id="int!", body="str"))
    t.insert([(1, "rust engine"), (2, "herbs and engine"), (3, "..."), (4, None)])
    engine.create_full_text_index("nidx", "notes", id_col="id", text_col="body")
    for step in (lambda: None, lambda: t.upsert([(2, "no more"), (5, "an engine, an engine")]), lambda: t.delete("id = 1"), lambda: t.upsert([(6, "engine rust")])):
        step()
        want = fulltext.bm25(t.scan(), "engine rust", id_col="id", text_col="body")
        assert [tuple(r) for r in engine.search("nidx", "engine rust").collect()] == [tuple(r) for r in want.collect()]


def test_what_a_dead_writer_left_is_no_commit(engine):
    t = engine.create_table("dead", TableSchema.of("id", id="int!", v="int"))
    lsn = t.insert([(1, 1)])
    t.log().withColumn("lsn", F.lit(lsn + 5).cast("long")).write.parquet(f"{t.path}/log/{lsn + 5:020d}")
    assert [r["lsn"] for r in t.log().collect()] == [lsn]


def test_small_writes_leave_the_snapshot(engine):
    """A write adds its changes alone; a new snapshot comes once they are a large part of the table. Rows and pasts are the same throughout."""
    t = engine.create_table("big", TableSchema.of("id", id="int!", v="str"), clustered=True)
    first = t.insert(engine.spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    base, want = t.head()["base"], {r["id"]: r["v"] for r in t.scan().collect()}
    assert base == first
    for k in range(3):
        t.upsert([(k, "new"), (30_000 + k, "more")])
        t.delete(F.col("id") == 100 + k)
        want |= {k: "new", 30_000 + k: "more"}
        want.pop(100 + k)
    assert t.head()["base"] == base and dict(map(tuple, t.scan().collect())) == want
    assert [r["v"] for r in t.get(1).collect()] == ["new"] and t.get(101).isEmpty()
    lsn = t.upsert(t.scan().withColumn("v", F.upper("v")))
    assert t.head()["base"] == lsn and dict(map(tuple, t.scan().collect())) == {k: v.upper() for k, v in want.items()}
    assert engine.sql_as_of("select count(*) from big", lsn=first).first()[0] == 20_000
    with pytest.raises(InvalidInput):
        t.upsert(engine.spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))
    assert t.head()["lsn"] == lsn


def test_a_later_commit_does_not_revive_what_a_dead_writer_left(engine):
    t = engine.create_table("dead2", TableSchema.of("id", id="int!", v="int"))
    lsn = t.insert([(1, 1)])
    left = f"{t.path}/log/{lsn + 1:020d}"
    t.log().withColumn("id", F.lit(9).cast("long")).withColumn("lsn", F.lit(lsn + 1).cast("long")).write.parquet(left)
    engine._next_lsn()
    t.insert([(2, 2)])
    assert rows(t.scan()) == [(1, 1), (2, 2)] and {r["id"] for r in t.log().collect()} == {1, 2}


def test_far_estimates_are_logged(engine):
    engine.sql("analyze full table orders")
    engine.table("orders").upsert(engine.spark.range(100, 300).select("id", F.lit(1).cast("long").alias("user_id"), F.lit(1.0).alias("amount")))
    got = dict(map(tuple, engine.sql("explain analyze select id from orders where user_id = 1").collect()))
    assert (got["rows_estimated"], got["rows"], got["rows_examined"]) == ("2", "202", "203")
    assert [(r["table_name"], r["misses"]) for r in engine.sql("select * from system.reprofile_jobs").collect()] == [("orders", 1)]
    assert engine.sql("select * from system.tuning_log").first()["rows_returned"] == 202


def test_postings_of_a_frequent_term_are_many_tasks(engine, spark, monkeypatch):
    monkeypatch.setattr("multiweave.engine.POSTINGS", 100, raising=False)
    t = engine.create_table("texts", TableSchema.of("id", id="int!", body="str"))
    t.insert([(i, "same") for i in range(1000)])
    engine.create_full_text_index("texts_idx", "texts", id_col="id", text_col="body")
    stored = spark.read.parquet(f"{engine.root}/text/texts_idx/{t.head()['lsn']}/postings")
    held = [r["n"] for r in stored.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 1000 and len(held) > 5 and max(held) < 400
    assert [r[0] for r in engine.search("texts_idx", "same", 3).select("id").collect()] == [0, 1, 2]
