"""Domain operators on small inputs made by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from multiweave.errors import Expired, InvalidInput, LimitExceeded
from multiweave.functions import geo, scalar
from multiweave.operators import documents, fulltext, geosearch, graph, joins, knn, policy, series, stats, temporal, workload
from multiweave.schema import TableSchema
from multiweave.sources import foreign, transfer
from multiweave.streaming import changes, views, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_series(spark):
    p = spark.createDataFrame([("cpu", 1000, 1.5, 1), ("cpu", 1250, 2.5, 2), ("cpu", 2000, 3.5, 3), ("cpu", 1250, 9.0, 4), ("cpu", 5, math.nan, 5)], "series string, timestamp_millis long, value double, n long")
    up = series.upsert(p, order="n")
    assert sorted(rows(up)) == [("cpu", 1000, 1.5), ("cpu", 1250, 9.0), ("cpu", 2000, 3.5)]
    assert series.ts_range(up, "cpu", 1000, 2000).count() == 2 and series.ts_range(up, "cpu", 5, 5).count() == 0
    assert rows(series.latest(up)) == [("cpu", 2000, 3.5)]
    assert sorted(r["timestamp_millis"] for r in series.retain(up, 500, 1000).collect()) == [1000, 1250, 2000]
    assert [r["value"] for r in series.gap_fill(up.filter("timestamp_millis <> 1250"), 250).orderBy("bucket").collect()] == [1.5, 1.5, 1.5, 1.5, 3.5]
    with pytest.raises(InvalidInput):
        scalar.time_bucket(0, F.col("x"))


def test_codec():
    flat = [(1000 * i, 42.0) for i in range(2048)]
    assert series.decode(series.encode(flat)) == flat and 16 * 2048 / len(series.encode(flat)) >= 8
    odd = [(-5, 1.0), (3, -0.0), (10**12, math.pi), (10**12 + 1, 1e300)]
    assert series.decode(series.encode(odd)) == odd and series.decode(series.encode([])) == []


def test_text(spark):
    docs = spark.createDataFrame([(1, "Rust database storage engine"), (2, "Cooking with herbs"), (3, " "), (4, None)], "id long, t string")
    best = rows(fulltext.bm25(docs, "rust database", id_col="id", text_col="t"))
    assert [r[0] for r in best] == [1]
    twice = rows(fulltext.bm25(docs, "rust rust", id_col="id", text_col="t"))[0][1]
    assert twice == pytest.approx(2 * rows(fulltext.bm25(docs, "rust", id_col="id", text_col="t"))[0][1])
    assert fulltext.bm25(docs, "...", id_col="id", text_col="t").count() == 0 and fulltext.bm25(docs, "rust", id_col="id", text_col="t", limit=0).count() == 0
    index = fulltext.postings(docs, id_col="id", text_col="t")
    assert [r[0] for r in rows(fulltext.search(index, fulltext.corpus_stats(docs, id_col="id", text_col="t"), "herbs"))] == [2]


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    texts = [(1, "b a b, C a b"), (2, "..."), (3, None), (4, " "), (5, "one"), (6, "e\u0301 \U0001f600 \ufb01 z\u00e9 Z\u00c9"), (None, "x x"), (None, "x y")]
    twice = [(7, "u v u"), (7, "v u w"), (7, "u")]
    for docs in (texts, texts[:6], texts + twice):
        df = spark.createDataFrame(docs, "id long, t string")
        got = fulltext.postings(df, id_col="id", text_col="t")
        words = df.filter(~fulltext.blank(F.col("t"))).select("id", fulltext.tokenize(F.col("t")).alias("w"))
        want = words.select("id", F.size("w").cast("long").alias("doc_len"), F.explode("w").alias("term")).groupBy("id", "term", "doc_len").agg(F.count("*").alias("tf"))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
        if docs == texts[:6]:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(fulltext, "BROADCAST_IDS", 0)


def test_knn_join_takes_any_number_of_queries(spark):
    v = spark.range(1001).select("id", F.array((F.col("id") * 37 % 1001).cast("double"), F.lit(1.0)).alias("embedding"))
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in knn.knn_join(v, v, 2, query_id="id", id_col="id", metric="l2").collect()}
    place = {i: i * 37 % 1001 for i in range(1001)}
    ids = {p: i for i, p in place.items()}
    want = {}
    for i, p in place.items():
        near = sorted((abs(p - o), ids[o]) for o in range(max(0, p - 2), min(1001, p + 3)) if o != p)
        want |= {(i, k): (near[k - 1][1], float(near[k - 1][0])) for k in (1, 2)}
    assert got == want


def test_knn_join_by_blocks_is_exact(spark):
    """Against all pairs by column expressions: other dimensions, copies, ties, numbers too large for squares, and no pairs in the plan."""
    e = F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 7 == 0, 3).otherwise(5)), lambda i: (F.xxhash64(F.col("id") % 150, i) % 4).cast("double") / 3)
    v = spark.range(400).select("id", e.alias("embedding")).filter("exists(embedding, x -> x <> 0)")
    v = v.unionByName(spark.createDataFrame([(900, [1e200] * 5), (901, [2e200] * 5), (902, None), (903, [math.nan] * 5), (None, [1.0] * 5)], "id long, embedding array<double>"))
    for metric, cost in scalar.METRICS.items():
        u = v.filter("id < 900" if metric == "cosine" else "true")
        got = knn.knn_join(u.filter("id % 3 = 0"), u, 4, query_id="id", id_col="id", metric=metric, block=16)
        assert not re.search("CartesianProduct|NestedLoop", got._jdf.queryExecution().executedPlan().toString())
        fine = u.filter(knn.valid(F.col("embedding"), F.size("embedding"), metric) & F.col("id").isNotNull())
        a, b = fine.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), fine.select("id", F.col("embedding").alias("w"))
        pairs = a.crossJoin(b).filter("id <> query_id and size(q) = size(w)").select("query_id", "id", cost(F.col("q"), F.col("w")).alias("distance"))
        want = {}
        for r in pairs.collect():
            want.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
        want = sorted((x, i, n + 1, d) for x, near in want.items() for n, (d, i) in enumerate(sorted(near)[:4]))
        assert sorted((r["query_id"], r["id"], r["rank"], r["distance"]) for r in got.collect()) == want


def test_vectors(spark):
    v = spark.createDataFrame([(1, [10.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 4.0])], "id long, embedding array<float>")
    assert knn.knn(v, [1.0, 0.0], 1).first()["id"] == 1 and knn.knn(v, [1.0, 0.0], 1, metric="l2").first()["id"] == 2
    assert knn.knn(v.filter("id = 3"), [0.0, 0.0], 1, metric="l2").first()["distance"] == 5.0
    assert knn.knn(v, [1.0, 0.0], 2, where=F.col("id") > 1).first()["id"] == 2
    for bad, metric in (([math.nan, 1.0], "l2"), ([0.0, 0.0], "cosine"), ([1.0, 1.0], "no")):
        with pytest.raises(InvalidInput):
            knn.knn(v, bad, 1, metric=metric)
    with pytest.raises(InvalidInput):
        knn.knn_join(v, v, 1, query_id="id", id_col="id", most=2)
    assert rows(v.filter("id = 2").select(scalar.scalar_quantize(F.col("embedding")), scalar.product_quantize(F.col("embedding"), 1)))[0] == ([127, 127], [16])


def test_geo(spark):
    p = spark.createDataFrame([(1, 179.9, 0.0), (2, 21.0122, 52.2297), (3, -0.1276, 51.5072), (4, 0.0, 89.9), (5, 180.0, 89.9)], "id long, lon double, lat double")
    assert [r["id"] for r in geosearch.within_radius(p, -179.9, 0.0, 50_000).collect()] == [1]
    assert [r["id"] for r in geosearch.within_radius(p, 90.0, 89.95, 30_000).collect()] == [4, 5]
    far = p.filter("id = 2").select(geo.haversine_m(F.lit(-0.1276), F.lit(51.5072), F.col("lon"), F.col("lat")).alias("m")).first()["m"]
    assert 1_400_000 < far < 1_500_000
    assert geo.middle_lon(170, -170) == 180 and geo.box_around(0, 0, 1000)[0] < 0
    with pytest.raises(InvalidInput):
        geo.box_around(181, 0, 1)


def test_graph(spark):
    e = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("a", "likes", "long")], "src string, label string, dst string")
    assert rows(graph.k_hop(e, "a", "knows", max_depth=5)) == [("b", 1), ("c", 2)]
    assert [r[0] for r in rows(graph.neighbors(e, "a"))] == ["b", "long"]
    assert graph.shortest_path(e, "a", "c") == ["a", "b", "c"] and graph.shortest_path(e, "a", "c", max_depth=1) is None and graph.shortest_path(e, "a", "a") == ["a"]
    with pytest.raises(LimitExceeded):
        graph.k_hop(e, "a", max_expansion=1)
    assert graph.upsert_edges(e, e.limit(1)).count() == 4


def test_temporal(spark):
    log = spark.createDataFrame([(1, 10, "upsert", 1, 37), (2, 20, "upsert", 1, 38), (3, 30, "delete", 1, None), (3, 30, "upsert", 2, 5)], "lsn long, at long, op string, key long, age long")
    assert rows(temporal.as_of(log, "key", 1)) == [(1, 37)] and rows(temporal.as_of(log, "key", 3)) == [(2, 5)]
    assert temporal.lsn_at(log, 25) == 2
    assert sorted((r["age"], r["valid_to_lsn"]) for r in temporal.history(log, "key").collect() if r["key"] == 1) == [(37, 2), (38, 3)]
    with pytest.raises(Expired):
        temporal.as_of(log, "key", 1, min_lsn=2)


def test_changes(spark):
    log = spark.createDataFrame([(1, 1, "upsert", 1, "t"), (2, 2, "upsert", 2, "u"), (3, 3, "delete", 1, "t")], "lsn long, at long, op string, key long, target string")
    events, token, more = changes.page(log, 0, max_commits=2, target="t")
    assert [r["kind"] for r in events.collect()] == ["begin", "upsert", "commit"] and token == 2 and more
    with pytest.raises(Expired):
        changes.page(log, 0, max_commits=1, earliest=5)
    sent = changes.outbox(changes.page(log, 0, max_commits=9)[0], None, "c")
    assert sent.count() == 3 and changes.outbox(changes.page(log, 0, max_commits=9)[0], sent, "c").count() == 0
    assert changes.after_commit(changes.page(log, 0, max_commits=9)[0], "h").count() == 3
    forks = spark.createDataFrame([("a", "b", 2)], "parent string, child string, fork_lsn long")
    assert rows(changes.on_timeline(spark.createDataFrame([("a", 9)], "timeline string, lsn long"), forks)) == [("b", 2)]


def test_pages_of_many_commits_are_not_gathered(spark, monkeypatch):
    log = spark.range(3000).selectExpr("id * id div 7 as lsn", "id as at", "'upsert' as op", "id as key", "'t' as target")
    commits, most, collect = sorted({i * i // 7 for i in range(3000)}), [], type(log).collect

    def counted(df):
        most.append(len(out := collect(df)))
        return out

    monkeypatch.setattr(type(log), "collect", counted)
    for n in (1, 5, 700, len(commits) - 1, len(commits), 1 << 30):
        events, token, more = changes.page(log, -1, max_commits=n)
        assert (token, more) == (commits[min(n, len(commits)) - 1], n < len(commits))
    assert most[-1] <= 1
    monkeypatch.setattr(changes, "GATHERED", 4)
    most.clear()
    for n in (5, 700, len(commits) - 1):
        events, token, more = changes.page(log, 2, max_commits=n)
        later = [c for c in commits if c > 2]
        assert (token, more) == (later[min(n, len(later)) - 1], n < len(later))
        assert events.filter("kind = 'begin'").count() == min(n, len(later))
    assert max(most) <= 1024
    assert changes.page(log.limit(0), 2, max_commits=700)[1:] == (2, False)


def test_view_retracts(spark):
    view = views.View("v", "t", "id", "g", (("count", None), ("sum", "x")), ("on", True))
    source = spark.createDataFrame([(1, "a", 10.0, True), (2, "b", 20.0, True), (4, "b", 1.0, False)], "id long, g string, x double, on boolean")
    state = views.initial(source, view)
    steps = spark.createDataFrame([(1, "upsert", 3, "a", 30.0, True), (2, "upsert", 2, "b", 20.0, False), (3, "upsert", 4, "c", 1.0, True), (4, "delete", 4, None, None, None)], "lsn long, op string, id long, g string, x double, on boolean")
    assert rows(views.result(views.apply(*state, steps, view)[1], view)) == [("a", 2, 40.0)]
    with pytest.raises(Exception, match="null"):
        views.apply(*state, spark.createDataFrame([(1, "upsert", 9, "a", None, True)], steps.schema), view)[1].collect()


def test_documents(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": 1}, "f": 1.0, "s": "x", "t": true}'), (2, "no json"), (3, '{"a": 5}')], "id long, doc string")
    f = documents.DocField
    got = rows(documents.project(d, [f("id", None), f("b", "a.b", "int"), f("bf", "a.b", "float"), f("f", "f", "float"), f("fi", "f", "int"), f("s", "s"), f("t", "t", "bool")]).orderBy("id"))
    assert got == [(1, 1, None, 1.0, None, "x", True), (2, None, None, None, None, None, None), (3, None, None, None, None, None, None)]


def test_joins(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 7)], "k long, t long")
    b = spark.createDataFrame([(1, 3, "x"), (1, 5, "y"), (3, 1, "z")], "k long, u long, v string")
    assert sorted(rows(joins.asof_join(a, b, key="k", left_at="t", right_at="u", value=["v"])), key=str) == [(1, 1, None), (1, 5, "y"), (2, 7, None)]
    r = spark.createDataFrame([(0, 10, "wide"), (4, 5, "thin"), (5, 5, "none")], "lo long, hi long, n string")
    assert sorted(x["n"] for x in joins.range_join(a, r, at="t", low="lo", high="hi", width=3).collect()) == ["wide", "wide", "wide"]


def test_policy_and_rules(spark):
    d = spark.createDataFrame([(1, '{"email": "a"}'), (2, "{}"), (3, '{"email": "' + "x" * 60 + '"}')], "id long, doc string")
    assert [(r["id"], r["reason"]) for r in policy.rejects(d, required=["email"], max_bytes=50).orderBy("id").collect()] == [(2, "no email"), (3, "too large")]
    with pytest.raises(LimitExceeded):
        policy.check_batch(2000)
    assert d.filter(policy.Hook("h", "object").violates(F.col("id"), F.col("doc"))).count() == 0 and d.filter(policy.Hook("h", "prefix", "2").violates(F.col("id"), F.col("doc"))).count() == 1


def test_stats(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("x"), F.when(F.col("id") % 4 == 0, None).otherwise(1).alias("y"))
    one = stats.column_stats(df, "y").first()
    assert (one["n_rows"], one["null_fraction"], one["ndv"]) == (1000, 0.25, 1)
    assert stats.histogram(df, "x").count() == 10 and stats.common_values(df, "x", 3).count() == 3
    assert stats.eq_selectivity({"n_rows": 10, "null_fraction": 0.5, "ndv": 5}, {1: 4}, 1) == 0.4 and stats.eq_selectivity({"n_rows": 10, "null_fraction": 0.5, "ndv": 5}, {}, 9) == 0.1
    assert stats.range_selectivity([(0, 10, 50), (10, 20, 50)], 5, 10, 100) == pytest.approx(0.25, abs=0.3) and stats.range_selectivity([], 0, 1, 0) == 0.3
    assert workload.feedback(1, 10) and not workload.feedback(5, 10)
    assert scalar.fingerprint("SELECT a FROM t WHERE b = 'x''y' AND c > 1.5") == "select|t|select a from t where b = ? and c > ?"


def test_ranks_without_a_sort_of_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else "ab"[i % 2], None if i % 13 == 0 else -0.0 if i % 5 == 0 else math.nan if i % 7 == 0 else float(i % 4)) for i in range(300)], "id int, k string, v double")
    df.createOrReplaceTempView("ranked")
    want = spark.sql("select *, cast(rank() over (partition by k order by v) as bigint) as rank, cast(dense_rank() over (partition by k order by v) as bigint) as dense from ranked")
    for few in (100_000, 0):
        monkeypatch.setattr(stats, "RANKED", few)
        got = stats.ranks(df, ["k"], "v")
        assert got.dtypes == want.dtypes and sorted(map(str, rows(got))) == sorted(map(str, rows(want)))  # nan equals nan


def test_collations(spark):
    names = spark.createDataFrame([("file10",), ("file2",), ("File1",)], "n string")
    assert [r["n"] for r in names.orderBy(scalar.collate(F.col("n"), "case_insensitive")).collect()] == ["File1", "file10", "file2"]
    assert [r["n"] for r in names.orderBy(scalar.collate(F.lower("n"), "numeric")).collect()] == ["File1", "file2", "file10"]


def test_transfer(spark, tmp_path):
    schema = TableSchema.of("id", id="int!", s="str", f="float", b="bytes", t="bool")
    rows_ = [(1, 'a "q", b', 1.5, b"\x00\xff", True), (2, None, None, None, None), (3, "", -2.0, b"\x01", False)]
    df = spark.createDataFrame(rows_, schema.struct())
    transfer.export_csv(df, f"{tmp_path}/c")
    transfer.export_jsonl(df, f"{tmp_path}/j")
    good, bad = transfer.import_jsonl(spark, f"{tmp_path}/j", schema)
    assert sorted(rows(good)) == sorted(rows_) and bad.isEmpty()
    good, bad = transfer.import_csv(spark, f"{tmp_path}/c", schema)
    assert {r[0]: r[2] for r in rows(good)} == {1: 1.5, 2: None, 3: -2.0} and bad.isEmpty()
    (tmp_path / "x.csv").write_text("id,s,f,b,t\n1,a,x,,\n2,b\n3,c,1,00,true\n")
    good, bad = transfer.import_csv(spark, f"file://{tmp_path}/x.csv", schema)
    assert [r[0] for r in rows(good)] == [3] and bad.count() == 2
    (tmp_path / "d.sql").write_text("CREATE TABLE t;\nCOPY public.t (id, s) FROM stdin;\n1\ta\\tb\n2\t\\N\n\\.\nCOPY u (id) FROM stdin;\n9\n\\.\n")
    lines = transfer.dump_blocks(spark, f"file://{tmp_path}/d.sql", "t")
    good, _ = transfer.import_copy(lines, TableSchema.of("id", id="int!", s="str"))
    assert sorted(rows(good), key=str) == [(1, "a\tb"), (2, None)]


def test_foreign(spark, tmp_path, monkeypatch):
    schema = TableSchema.of("id", id="int!", n="str")
    (tmp_path / "a.csv").write_text("1,Ada\n2,\n")
    assert rows(foreign.read(spark, foreign.ForeignTable(schema, "csv", f"file://{tmp_path}/a.csv"))) == [(1, "Ada"), (2, None)]
    (tmp_path / "b.csv").write_text("x,Ada\n")
    with pytest.raises(Exception):
        foreign.read(spark, foreign.ForeignTable(schema, "csv", f"file://{tmp_path}/b.csv")).collect()
    t = foreign.ForeignTable(schema, "jdbc", options={"url": "jdbc:postgresql://h/d", "table": "t", "password_env": "PW_HERE"})
    with pytest.raises(InvalidInput):
        foreign.jdbc_options(t)
    monkeypatch.setenv("PW_HERE", "x")
    assert foreign.jdbc_options(t)["password"] == "x" and "LIMIT 10000" in foreign.jdbc_options(t)["dbtable"]


def test_windows(spark):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 02:00:00", 3.0)], "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    n = [F.count("*").alias("n")]
    assert sorted(r["n"] for r in windows.tumbling(e, at="ts", size="1 hour", keys=["k"], aggregates=n).collect()) == [1, 2]
    assert sorted(r["n"] for r in windows.sessions(e, at="ts", gap="30 minutes", keys=["k"], aggregates=n).collect()) == [1, 2]
    assert windows.distinct(e, at="ts", keys=["k"]).count() == 1


def test_one_count_of_documents(spark):
    """Texts of punctuation count, those of white space do not, whichever way a search goes."""
    docs = spark.createDataFrame([(1, "a b"), (2, "..."), (3, "\n\t"), (4, "b c"), (5, None), (6, "\u2003")], "id long, t string")
    own = {"id_col": "id", "text_col": "t"}
    one = rows(fulltext.bm25(docs, "a", **own).select("id", "score"))
    index, lengths = fulltext.postings(docs, **own), fulltext.lengths(docs, **own)
    assert one == rows(fulltext.search(index, fulltext.stats_of(lengths), "a")) and fulltext.stats_of(lengths).first()["n_docs"] == 3
    changed = spark.createDataFrame([(1, None), (2, "a a"), (7, "a"), (4, "  ")], "id long, t string")
    after = spark.createDataFrame([(2, "a a"), (3, "\n\t"), (5, None), (6, "\u2003"), (7, "a")], "id long, t string")
    index, lengths = fulltext.refresh(index, lengths, changed, **own)
    assert rows(fulltext.search(index, fulltext.stats_of(lengths), "a b")) == rows(fulltext.bm25(after, "a b", **own).select("id", "score"))


def test_stored_vectors_that_cannot_be_searched(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0])], "id long, embedding array<double>")
    for metric, want in (("cosine", [1, 6]), ("l2", [1, 3, 6])):
        assert sorted(r["id"] for r in knn.knn(e, [1.0, 0.5], 10, metric=metric).collect()) == want
        assert {r["query_id"] for r in knn.knn_join(e, e, 3, query_id="id", id_col="id", metric=metric).collect()} == set(want)
    assert [r["id"] for r in knn.lsh_knn(e, [1.0, 0.5], 3).collect()] == [1, 3, 6]


def test_approximate_stage_recalls(spark):
    """Of the exact neighbours of twenty queries the approximate stage finds nine in ten."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").cache()
    hit = 0
    for r in e.orderBy("vec_id").limit(20).collect():
        want = {x["vec_id"] for x in knn.knn(e, list(r["embedding"]), 5, id_col="vec_id", metric="l2").collect()}
        hit += len(want & {x["vec_id"] for x in knn.lsh_knn(e, list(r["embedding"]), 5, id_col="vec_id", candidates=200).collect()})
    assert hit >= 90


def test_row_groups_are_skipped(spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/zones"
    spark.range(40_000).selectExpr("id * 7 % 40000 as k", "cast(id as string) as v").repartitionByRange(3, "k").sortWithinPartitions("k").write.option("parquet.block.size", 16 << 10).option("parquet.block.size.row.check.min", 100).parquet(path)
    groups = [(f.row_group(i).column(0).statistics, f.row_group(i).total_byte_size) for f in (pq.ParquetFile(p).metadata for p in tmp_path.glob("zones/*.parquet")) for i in range(f.num_row_groups)]
    hit = [b for s, b in groups if s.min <= 12_345 <= s.max]
    got = stats.segment_report(spark, path, "k", 12_345).first()
    assert len(groups) > 6 and (got["scanned_segments"], got["skipped_segments"]) == (len(hit), len(groups) - len(hit)) == (1, len(groups) - 1) and got["scanned_bytes"] == sum(hit)


def test_latest_of_one_time(spark):
    p = spark.createDataFrame([("a", 5, 1.0, 1), ("a", 5, 0.5, 2), ("a", 4, 9.0, 3)], "series string, timestamp_millis long, value double, at int")
    assert series.latest(p, order="at").first()["value"] == 0.5 and series.latest(p.drop("at")).first()["value"] == 1.0
