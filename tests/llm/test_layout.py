"""Operators on vectors and layouts: neighbours, embedding duplicates, mixing, packing, shards, archives; and the pipeline."""

import base64
import collections
import hashlib
import io
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from multiweave.llm import embedding_dedup, mixing, nearest, packing, sharding, warc

DATA = "/root/testdata"
BAD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [math.nan]), (904, [1.0] * 7 + [math.inf]), (905, [1.0] * 7 + [None]), (906, [1.0] * 3), (None, [1.0] * 8)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit("clash"))


# ------------------------------------------------------------------ neighbours

def test_recall(spark):
    e = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = nearest.op3_nearest(spark, f"{DATA}/sf0.1").toPandas()
    hit, of = 0, {k: g for k, g in got.groupby("query_id")}
    asked = np.flatnonzero(ids % 20 == 0)
    for i in asked:
        score = x @ x[i]
        score[i] = -np.inf
        own = of[ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hit >= 0.9 * 20 * len(asked)


def test_neighbours_edges(spark):
    rows = [(20, [1.0] + [0.0] * 7), (40, [3.0] + [0.0] * 7), (1, [0.5] + [0.0] * 7), (2, [0.5] + [0.0] * 7), (2, [0.5] + [0.0] * 7), (20, [1.0] + [0.0] * 7), *BAD]
    got = nearest.search(embeddings(spark, rows), F.col("vec_id") == 40).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 20, 3.0), (2, 20, 3.0), (3, 1, 1.5), (4, 2, 1.5), (5, 2, 1.5)]
    assert nearest.search(embeddings(spark, BAD), F.lit(True)).count() == 0
    assert nearest.search(embeddings(spark, []), F.lit(True)).count() == 0
    same = nearest.search(embeddings(spark, [(i, [1.0, 2.0]) for i in range(60)]), F.col("vec_id") == 59).orderBy("rank").collect()
    assert [r["vec_id"] for r in same] == list(range(20))


def test_queries_read_few_lists(spark):
    """Recall on clustered vectors with over 80 lists, which only the graph gives, and the share of them that is read."""
    rng = np.random.default_rng(6)
    n, centres = 21_000, rng.standard_normal((300, 24))
    x = (centres[rng.integers(0, 300, n)] + 0.35 * rng.standard_normal((n, 24))).astype(np.float32).astype(float)
    assert nearest.lists_for(n) > 80
    frame = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(n), "embedding": list(x)}))
    got = nearest.search(frame, F.col("vec_id") % 100 == 0, k=10).toPandas()
    ids = np.arange(0, n, 100)
    score = x[ids] @ x.T
    score[np.arange(len(ids)), ids] = -np.inf
    want = np.argsort(-score, 1)[:, :10]
    of = {k: set(g.vec_id) for k, g in got.groupby("query_id")}
    assert sum(len(of[i] & set(w)) for i, w in zip(ids, want)) >= 0.9 * 10 * len(ids)
    longest = np.sqrt((x * x).sum(1)).max()
    index = nearest.fit(x[rng.choice(n, nearest.SAMPLE, replace=False)], n, longest, 10)
    _, lists = index.routes(nearest.asked(x[ids]), np.full(len(index.c), n // len(index.c)), 10)
    assert len(lists) < 0.5 * len(ids) * len(index.c)


def test_routes_ask_for_more_until_lists_hold_enough():
    rng = np.random.default_rng(2)
    index = nearest.Index(rng.standard_normal((60, 5)))
    index.most, index.ratio = 2, 1.0
    held = np.where(np.arange(60) % 6 == 0, 4, 0)
    row, lists = index.routes(rng.standard_normal((30, 5)), held, 9)
    assert all(held[lists[row == i]].sum() >= 10 for i in range(30))
    row, lists = index.routes(rng.standard_normal((5, 5)), np.zeros(60, int), 9)
    assert all(sorted(lists[row == i]) == list(range(60)) for i in range(5))


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(0)
    index = nearest.Index(rng.standard_normal((400, 16)))
    q = rng.standard_normal((50, 16))
    lists, d = index.search(q, 20)
    exact = np.argsort(nearest.distances(q, index.c), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(lists.tolist(), exact.tolist())]) > 18 and (np.diff(d, axis=1) >= 0).all()
    parts = nearest.balanced_centroids(rng.standard_normal((1000, 4)), 16)
    assert len(parts) == 16


# ------------------------------------------------------------------ embedding duplicates

def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 8))
    x = np.concatenate([base, base[:150] + 0.12 * rng.standard_normal((150, 8)), base[:20], base[:5] * 7]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + BAD
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(embeddings(spark, rows)).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * (near.sum() - len(x)) <= found <= near.sum() - len(x)
    for i in range(len(x)):
        assert got[i]["n_links"] <= near[i].sum() - 1 and got[i]["kept"] == (got[i]["component_id"] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in BAD[:7])


def test_traversal_visits_nearest_cells():
    """Cells come in the order of their distance, as many of them as the slack reaches, which depends on the vector."""
    rng = np.random.default_rng(1)
    books, x = (rng.random((12, 4)), rng.random((9, 4))), rng.random((40, 8))
    ends, cells = embedding_dedup.traverse(x, books, 0.3)
    for i in range(len(x)):
        d = (embedding_dedup.distances(x[i : i + 1, :4], books[0])[0][:, None] + embedding_dedup.distances(x[i : i + 1, 4:], books[1])[0][None, :]).ravel()
        order = np.argsort(d)
        assert cells[ends[i] : ends[i + 1]].tolist() == order[d[order] <= d.min() + 0.3].tolist()
    assert len(set(np.diff(ends))) > 3
    whole = embedding_dedup.traverse(x, books, 100.0)
    assert (np.diff(whole[0]) == 108).all() and all(sorted(whole[1][k * 108 : k * 108 + 108]) == list(range(108)) for k in range(len(x)))


def brute_links(x, cosine=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= cosine
    least, state = np.arange(len(x)), None
    while state != (state := least.tobytes()):
        least = np.array([least[n].min() for n in near])
    return near.sum(1) - 1, least


def test_dense_groups_are_counted_whole(spark, monkeypatch):
    """A third of all vectors near each other, in many blocks and cells: each link is counted once from both ends, and no pair comes out."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + 0.12 * rng.standard_normal((900, 16)), rng.standard_normal((900, 16)), np.repeat(rng.standard_normal((3, 16)), 300, 0)])
    x = x[rng.permutation(len(x))].astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "STORED", 100)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 150)
    monkeypatch.setattr(embedding_dedup, "ONE_SIDED", 1.0)
    n, least = brute_links(x)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(embeddings(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == n.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == least.tolist()


def test_each_dimension_has_an_index(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100 + i, [1.0, float(i % 3), 2.0]) for i in range(30)] + [(200, [1.0]), (201, [2.0]), (202, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(embeddings(spark, rows)).collect()}
    assert got[200] == got[201] == (1, 200) and got[202] == (0, 202)
    for at, d in ((0, 2), (100, 3)):
        x = np.array([e for i, e in rows if len(e) == d])
        n, least = brute_links(x)
        assert [got[at + i] for i in range(len(x))] == [(a, at + b) for a, b in zip(n.tolist(), least.tolist())]
    near = nearest.search(embeddings(spark, rows), F.col("vec_id").isin(3, 105, 201), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in near) == [(3, 1, 6), (3, 2, 13), (105, 1, 102), (105, 2, 108), (201, 1, 200), (201, 2, 202)]


def test_embedding_edges(spark):
    assert embedding_dedup.near_duplicates(embeddings(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(embeddings(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [2.0, 4.0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]


# ------------------------------------------------------------------ mixing

def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 187.5, "b": 75, "c": 37.5})
    assert mixing.targets({"a": 10, "b": 100, "c": 100}) == pytest.approx({"a": 30, "b": 120, "c": 60})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flow_is_cheapest():
    """Against every whole flow of a small net of overlapping sources."""
    offers, members, asks = {"p": 2, "q": 1, "r": 2}, {"p": ("a",), "q": ("a", "b"), "r": ("b",)}, {"a": 5, "b": 4}
    price = lambda p, x: sum(mixing.COSTS[k // offers[p]] for k in range(x))
    flow = mixing.min_cost_flow(offers, members, asks)
    got = collections.Counter()
    for (p, _), x in flow.items():
        got[p] += x
    best = (-1, 0)
    for pa_, qa, qb, rb in itertools.product(range(7), range(4), range(4), range(7)):
        if qa + qb <= 3 and pa_ + qa <= 5 and qb + rb <= 4:
            best = max(best, (pa_ + qa + qb + rb, -(price("p", pa_) + price("q", qa + qb) + price("r", rb))))
    assert (sum(flow.values()), -sum(price(p, x) for p, x in got.items())) == best


def test_mix_of_a_table(spark):
    got = mixing.op4_mixing(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (got["size"] == [len(t.split()) for t in got.text]).all() and (got.taken <= 3 * got["size"]).all()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = mixing.targets(dict(sorted(sizes.items())))
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= max(g["size"].max(), 0.02 * want[s])
    again = mixing.op4_mixing(spark, f"{DATA}/sf0.01").toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(got.doc_id, got.taken))


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_many_sources_need_no_limit(spark, monkeypatch, broadcast):
    """Targets and takes of a thousand sources are those of the plain formula; only overlapping patterns count towards the limit."""
    from multiweave.llm import common

    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(1)
    sizes = {f"0{k:04d}": int(rng.integers(1, 50) * (60 if k == 7 else 1)) for k in range(1000)}
    rows = [([s], int(p), 1) for s, n in sizes.items() for p in rng.integers(0, 1 << 62, n)] + [(["1"], 5, 0)]
    plan_, asked = mixing.plan(spark.createDataFrame(rows, "sources array<string>, place long, size long").repartition(7))
    want = mixing.targets(dict(sorted(sizes.items())) | {"1": 0})
    got = {r["key"]: r["target"] for r in asked.collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    taken = collections.Counter()
    by = {r["pattern"][0]: r for r in plan_.collect()}
    for (s,), place, n in rows:
        taken[s] += n * (by[s]["times"] + (place <= by[s]["last"]))
    assert all(taken[s] == round(want[s]) for s in want)


def test_overlapping_patterns_beside_lone_sources(spark):
    """The driver's flow and the table's part give together what the whole network gives."""
    rng = np.random.default_rng(2)
    patterns = {("0a",): 40, ("0a", "0b"): 30, ("0b", "0c"): 50, ("0d",): 70, ("0e",): 10}
    rows = [(list(p), int(x), 1) for p, n in patterns.items() for x in rng.integers(0, 1 << 62, n)]
    plan_, asked = mixing.plan(spark.createDataFrame(rows, "sources array<string>, place long, size long"))
    asks = {r["key"]: round(r["target"]) for r in asked.collect()}
    flow = collections.Counter()
    for (p, _), x in mixing.min_cost_flow(patterns, {p: p for p in patterns}, asks).items():
        flow[p] += x
    by = {tuple(r["pattern"]): r for r in plan_.collect()}
    assert by.keys() == patterns.keys()
    got = {p: sum(by[p]["times"] + (place <= by[p]["last"]) for q, place, _ in rows if tuple(q) == p) for p in patterns}
    price = lambda x: sum(mixing.COSTS[k // patterns[p]] for p in patterns for k in range(x[p]))
    assert sum(got.values()) == sum(flow.values()) and price(got) == price(flow) and (got["0d",], got["0e",]) == (flow["0d",], flow["0e",])


def test_mix_stage_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b c {i}", "en", f"s{i % 2}") for i in range(40)], "doc_id long, text string, lang string, source string")
    for c in ("__key", "__times", "__copy", "__row", "keys", "place", "worded"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = mixing.stage_mixing(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() > 0 and {r["__times"] for r in got.collect()} == {"clash"}


def test_mix_edges(spark, tmp_path):
    rows = [(1, "a b c", "en", "x", 1), (2, None, "en", None, 1), (3, "a b  c", "en", None, 1), (3, "a b  c", "en", None, 1), (None, "d", "en", "Z", 1), (5, "", None, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit(9))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op4_mixing(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in got) == [("1", 3, 3), ("2", 0, 4), ("3", 2, 4), ("3", 2, 4), ("5", 0, 3), ("None", 1, 1)]
    out = mixing.stage_mixing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    taken = {str(r["doc_id"]): r["taken"] // max(1, r["size"]) for r in got}
    assert out.columns == frame.columns and collections.Counter(str(r["doc_id"]) for r in out.collect()) == {k: n * (2 if k == "3" else 1) for k, n in taken.items() if n}
    frame.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert mixing.op4_mixing(spark, f"{tmp_path}/e").count() == 0


# ------------------------------------------------------------------ packing

def test_bounds_hold():
    """Bounds never exceed, and best fit never beats, the least number of bins."""
    rng = np.random.default_rng(2)

    def fewest(sizes, c):
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= c:
                    bins[k] += sizes[i]
                    place(i + 1, bins)
                    bins[k] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best

    for _ in range(60):
        sizes = sorted(rng.integers(1, 20, 8).tolist(), reverse=True)
        x = np.array(sizes)
        least = fewest(sizes, 20)
        where = packing.best_fit(x, 20)
        assert packing.bin_bound(*np.unique(x, return_counts=True), 20) <= least <= where.max() + 1
        assert (np.bincount(where, x) <= 20).all()
    assert packing.bin_bound(np.array([11]), np.array([6]), 20) == 6


def test_words_encode_like_texts():
    e = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    for t in ["", "a\x1cb  c", "İstanbul ΣΑΣ ς", "x<|endoftext|>y <|startoftext|>", "é ́a", "don't DON'T we'll 12345 ½ 'S''t", " em nb\u0085x ×a÷b ẞß Ǆǅ", "日本語 テスト 🙂🙂 naïve... Ünï-cødé!!"]:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_the_memory_of_words_is_bounded(monkeypatch):
    """Words are forgotten, long ones never remembered, and ids stay those of the whole text."""
    monkeypatch.setattr(packing, "REMEMBERED", 100_000)
    code = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)) + " " + "word" * 400 + " \u4e2d\u6587"
        assert np.frombuffer(code.ids(text), "<u4").tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids
        assert code.known.held < 400_000 and sum(len(w) > packing.LONG for w in code.known) == 0
    many = " ".join(f"w{i}" for i in range(120_000))
    assert code.ids(many) == b"".join(code.ids(f"w{i}") for i in range(120_000)) and code.known.held < 50_000 * 250


def test_packing_round_trip(spark, tmp_path):
    texts = [None, "", "Hello, world", "long words " * 3000, "x", "x"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(100 + i, "some more words here " * (i % 50)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack(frame, group=64).toPandas()
    tok = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER)).tokenizer
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in own.start]
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    assert -(-got.length.sum() // 2048) <= got.least_sequences.iloc[0] <= got.sequence_id.nunique()
    assert packing.pack(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ shards

@pytest.mark.parametrize("hot", [0, 700])
def test_shards(spark, hot):
    rng = np.random.default_rng(5)
    rows = [(i, "w" * int(rng.integers(1, 400)) + str(i)) for i in range(1200)] + [(2000 + i, f"group {i % 40} " * 9) for i in range(200)] + [(5000 + i, "the hot text " * 12) for i in range(hot)] + [(None, None), (9000, ""), (9000, ""), (9001, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))).join(spark.createDataFrame(rows, "doc_id long, text string").distinct().withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).toPandas()
    assert len(got) == len(rows) and (got["size"] == [len(t.encode()) + 1 if t is not None else 1 for t in got.text]).all()
    assert all(c == zlib.crc32(t.encode()) for c, t in zip(got.text_crc32, got.text) if t is not None)
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 2 * got["size"].max() and len(load) == 16
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    spread = got[got.text.str.startswith("group", na=False)].groupby("text").shard.nunique()
    assert (spread == 1).mean() > 0.8


def test_shard_edges(spark):
    few = sharding.shard(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["size"], r["slot"]) for r in few.collect())[0][:2] == (1, 2) and few.count() == 2
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("part", "least"), [(0.5, 1), (5, 5)])
def test_shards_of_a_large_group(spark, part, least):
    """A group that a shard can hold is in one shard, and one of five shards in five."""
    copies, size = round(part * 200), 50
    rows = [(i, "c" * (size - 1)) for i in range(copies)] + [(10_000 + i, f"{i:049d}") for i in range(16 * 200 - copies)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(load) == 16 and load.max() - load.min() <= 2 * size
    assert got[got.n_linked > 1].shard.nunique() == least


def cut_edges(got):
    """Links between two shards, of all pairs of equal texts."""
    return sum(len(g) * (len(g) - 1) // 2 - sum(n * (n - 1) // 2 for n in g.shard.value_counts()) for _, g in got.groupby("text_crc32"))


@pytest.mark.parametrize("lone", [1500, 20])
def test_propagation_lowers_cut_edges(spark, lone):
    """Groups whose documents start apart gather; with room everywhere, each where most of its bytes were."""
    sizes = np.random.default_rng(8).integers(2, 9, 300)
    rows = [(k * 100 + i, f"group {k} " * (3 + k % 5)) for k, n in enumerate(sizes) for i in range(n)] + [(100_000 + i, f"lone {i} " * 6) for i in range(lone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before, after = (sharding.shard(docs, rounds=k).toPandas() for k in (0, sharding.ROUNDS))
    load = after.groupby("shard")["size"].sum()
    assert len(after) == len(rows) and load.max() - load.min() <= 2 * after["size"].max()
    assert cut_edges(after) < 0.1 * cut_edges(before)
    if lone > 1000:
        assert cut_edges(after) == 0
        start = before[before.n_linked > 1].groupby(["text_crc32", "shard"])["size"].sum()
        for crc, g in after[after.n_linked > 1].groupby("text_crc32"):
            assert start[crc][g.shard.iloc[0]] == start[crc].max()


def test_moves_are_cut_down_to_the_room():
    wanted = {(0, 1): 50.0, (2, 1): 50.0, (1, 0): 10.0, (3, 2): 5.0}
    got = sharding._allowed(wanted, [60.0, 60.0, 60.0, 60.0], [80.0] * 4)
    assert got[1, 0] == 10 and got[3, 2] == 5 and got[0, 1] + got[2, 1] == pytest.approx(30, abs=2)
    assert sharding._allowed({(0, 1): 5.0}, [10.0, 90.0], [50.0, 80.0])[0, 1] == 0


def test_copies_without_bytes_are_a_large_group(spark):
    """A third of all rows with an empty text, and a third without any, are dealt without a shuffle by their text."""
    rows = [(i, "") for i in range(400)] + [(1000 + i, None) for i in range(400)] + [(2000 + i, f"text {i} " * 20) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and got[got.doc_id < 400].shard.nunique() <= 2 and (got[got.doc_id.between(1000, 1999)].n_linked == 1).all()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 2 * got["size"].max()


def test_blocks_follow_their_group():
    held = [(0, b, b % 4, 10) for b in range(8)] + [(1, 0, 2, 10), (1, 1, 3, 15)]
    to = {(g, b): s for g, b, s, _ in held} | {(g, b): s for g, b, s in sharding._follow(held, 100, 4, 0)}
    assert len({to[0, b] for b in range(8)}) == 1 and to[1, 0] == to[1, 1] == 3
    assert not sharding._follow([(g, b, to[g, b], n) for g, b, _, n in held], 100, 4, 0)
    assert len({s for *_, s in sharding._follow([(0, b, 0, 10) for b in range(25)], 100, 4, 0)} | {0}) == 3


# ------------------------------------------------------------------ archives

class Held(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_ranges_own_records_once():
    rng = np.random.default_rng(4)
    bodies = [b"", b"\x1f\x8b\x08" * 40, bytes(rng.integers(0, 256, 5000, np.uint8)), b"a" * 100_000, warc.member(1, "u", b"inner", "X", None, False)]
    data = b"".join(warc.member(i, f"http://x/{i}", b, warc.sha1_32(b), None, False) for i, b in enumerate(bodies))
    for split in (1, 37, 1000, len(data)):
        found = [(at, h["warc-record-id"], block.split(b"\r\n\r\n", 1)[1]) for s in range(0, len(data), split) for at, h, block in warc.records_in(Held(data), len(data), s, min(s + split, len(data)))]
        assert [x[1] for x in found] == [warc.record_id(i) for i in range(5)] and [x[2] for x in found] == bodies


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "a b\nc", ""), (5, "x", "é" * 40_000), (6, "x", "same"), (7, "y", "\x1f\x8b\x08 text"), (None, "z", "same"), (8, "r", "twice"), (8, "r", "twice")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"]): r for r in warc.op9_warc(spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i]["payload_bytes"] == len(body) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None), 8: ("response", None)}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert warc.op9_warc(spark, f"{tmp_path}/e").count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of it, on what the stage before kept."""
    from multiweave.llm import language_id
    from tests.llm.test_text import SlowQuality, brute_components

    d = f"{DATA}/sf0.001"
    docs = first = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == first.columns
        seen.append((docs.toPandas(), out.toPandas()))
        docs = out
    ids = lambda frame: collections.Counter(frame.doc_id)

    given, kept = seen[0]
    model = language_id.fit(spark.createDataFrame(given), train=~language_id.held_out())
    langs, _, rate = language_id.predict(__import__("pyarrow").array(given.text), model["langs"], [language_id.Coder(model)])
    assert ids(kept) == ids(given[[lang != "und" and r <= language_id.MAX_BITS for lang, r in zip(langs, rate)]])

    given, kept = seen[1]
    rows = list(zip(given.doc_id, given.text, given.source, given.lang))
    slow = SlowQuality()
    slow.fit(rows, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()})
    assert ids(kept) == ids(given[[score >= 0.5 for *_, score in slow.scores(rows)]])

    given, kept = seen[2]
    part = brute_components(list(zip(given.doc_id, given.text)))
    assert ids(kept) == collections.Counter(i for i in part if part[i] == i)

    given, kept = seen[3]
    size = {i: len(t.split()) for i, t in zip(given.doc_id, given.text)}
    taken = ids(kept)
    assert set(taken) <= set(size) and max(taken.values()) <= 3
    own = given.assign(n=[size[i] for i in given.doc_id], got=[size[i] * taken[i] for i in given.doc_id]).groupby("source")[["n", "got"]].sum()
    want = mixing.targets(dict(sorted(own.n.items())))
    assert all(abs(own.got[s] - want[s]) <= max(size[i] for i in given[given.source == s].doc_id) for s in own.index)

    got = corpus_pipeline.run(spark, d).toPandas()
    assert ids(got[got.piece == 0]) == taken
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("kind", ["varied", "alike"])
def test_long_headers_are_read(spark, tmp_path, kind):
    """Headers of more than the bytes inflated at once (long urls) are found, whether they shrink or not."""
    rng = np.random.default_rng(3)
    tail = rng.bytes(1_200_000).hex() if kind == "varied" else "a" * 2_000_000
    rows = [(i, f"http://x/{i}" if i % 2 else f"data:text/plain,{i}{tail[: warc.HEAD - 200 + i * 37]}", f"<p>{i}</p>") for i in range(12)] + [(50, f"data:{tail}", "<p>long</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op9_warc(spark, str(tmp_path))
    assert sorted(r["page_id"] for r in got.collect()) == sorted(r[0] for r in rows)


def test_lost_records_are_an_error(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(5)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = warc.read
    monkeypatch.setattr(warc, "read", lambda *a, **b: whole(*a, **b).filter("record_id <> '<urn:page:3>'"))
    with pytest.raises(ValueError, match="5 records were written, and 4 read"):
        warc.op9_warc(spark, str(tmp_path))


def test_ranges_are_dealt_to_tasks(spark, tmp_path):
    """The read plan has as many tasks as there are ranges, up to a few for each core."""
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w").collect()
    for split, least in ((512, 4 * spark.sparkContext.defaultParallelism), (1 << 30, 3)):
        got = warc.read(spark, f"file://{tmp_path}/w", split=split, payload=False)
        assert got.rdd.getNumPartitions() >= least and sorted(warc.page_of(r["record_id"]) for r in got.collect()) == list(range(200))
