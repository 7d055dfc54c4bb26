"""Operators on texts: language ID, near-duplicates, quality, licences."""

import collections
import gc
import math
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from multiweave.llm import common, language_id, licenses, near_dedup, quality

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_tidy_returns_native_memory_of_the_driver(spark):
    """Buffers are freed between others that stay, so that the C library keeps what they took until it is asked."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    rss = lambda: int(re.search(r"RssAnon:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) // 1024
    stay, go = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for _ in range(1000):
        for to in (stay, go):
            to.add(jvm.java.nio.ByteBuffer.allocateDirect(96 << 10))
    go = to = None
    gc.collect()  # Python's references
    time.sleep(1)
    for _ in range(2):
        jvm.System.gc()
        time.sleep(1)  # the JVM's cleaner frees them
    before = rss()
    common.tidy(spark)
    assert before - rss() > 40 and stay.size() == 1000


# ------------------------------------------------------------------ bytes

def test_words_and_hashes():
    texts = ["a bb\tccc", None, "", "  x y  ", "bb a"]
    raw, off, valid = common.text_buffer(pa.array(texts).slice(0))
    assert valid.tolist() == [True, False, True, True, True]
    assert common.word_counts(raw, off, common.NOT_SPACE).tolist() == [3, 0, 0, 1, 2]
    starts, ends, row = common.word_spans(raw, off, common.NOT_SPACE)
    h = common.word_hashes(raw, starts, ends)
    words = [bytes(raw[a:b]) for a, b in zip(starts, ends)]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    sliced = pa.array(["zz", *texts]).slice(1)
    raw, off, _ = common.text_buffer(sliced)
    assert common.word_counts(raw[off[0] : off[-1]], off - off[0], common.NOT_SPACE).tolist() == [3, 0, 0, 1, 2]


# ------------------------------------------------------------------ language ID

def model_of(texts):
    out = {"langs": [], "grams": [], "counts": [], "lower": []}
    for lang in sorted(texts):
        raw, off, _ = common.text_buffer(pa.array(texts[lang]))
        g, n = np.unique(language_id._grams(raw, off), return_counts=True)
        three, back = np.unique(g & np.uint32(0xFFFFFF), return_inverse=True)
        out["langs"].append(lang)
        out["grams"].append(g)
        out["counts"].append(n)
        out["lower"].append((three, np.bincount(back, n).astype(np.int64)))
    return out


class Slow:
    """The context tree, symbol by symbol."""

    def __init__(self, texts):
        self.n = collections.defaultdict(collections.Counter)
        for t in texts:
            b = b"\n\n\n" + bytes(language_id._fold(np.frombuffer(t.encode(), np.uint8)))
            for i in range(3, len(b)):
                for k in range(4):
                    self.n[b[i - k : i]][b[i]] += 1

    def p(self, context, symbol):
        seen = self.n.get(context)
        if context == b"":
            total, kinds = sum(seen.values()), len(seen)
            return seen[symbol] / (total + kinds) if symbol in seen else kinds / (total + kinds) / (256 - kinds)
        if not seen:
            return self.p(context[1:], symbol)
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        return kinds / (total + kinds) * self.p(context[1:], symbol) / (1 - sum(self.p(context[1:], s) for s in seen))

    def bits(self, t):
        b = b"\n\n\n" + bytes(language_id._fold(np.frombuffer(t.encode(), np.uint8)))
        return -sum(math.log2(self.p(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def test_code_lengths_are_exact():
    texts = {"en": ["the cat sat on the mat", "This and that, and the other"], "fr": ["le chat est sur la table", "Écoute, c'est l'été"]}
    coder, slow = language_id.Coder(model_of(texts)), [Slow(texts[k]) for k in sorted(texts)]
    ask = ["the hat", "l'été est là", "zzz 999 qqq", "a", "ÉTÉ", "the cat sat on the mat"]
    raw, off, _ = common.text_buffer(pa.array(ask))
    assert np.allclose(coder.bits(raw, off), [[s.bits(t) for s in slow] for t in ask], rtol=1e-4)
    for context in (b"", b"e", b"th", b"the", b"xyz"):
        assert abs(sum(slow[0].p(context, s) for s in range(256)) - 1) < 1e-9


def test_tables_of_many_languages(spark, monkeypatch):
    """With more languages than a table holds, code lengths and verdicts are the same; none is left out."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{'xyz'[k % 3]} " for k in range(300)]
    rows = [(2 * k, w * 6, f"l{k:03d}", "s", 1) for k, w in enumerate(words)]
    model = language_id.fit(docs_of(spark, rows))
    assert len(model["langs"]) == 300 and len(language_id.tables(model)) == -(-300 // language_id.LANGS)
    ask = pa.array([w * 3 for w in words])
    whole = language_id.predict(ask, model["langs"], [language_id.Coder(model)])
    parts = language_id.predict(ask, model["langs"], [language_id.Coder({k: v[p] for k, v in model.items()}) for p in language_id.tables(model)])
    assert whole[0] == parts[0] == model["langs"] and np.allclose(whole[2], parts[2]) and np.allclose(whole[1], parts[1])
    got = language_id.verdicts(spark.createDataFrame([(k, w * 3) for k, w in enumerate(words)], "k int, text string"), model, [F.col("k")]).orderBy("__row.k").toPandas()
    assert got.lang_pred.tolist() == model["langs"]


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(2 * k, f"the text of number {k} " * 20, "en" if k % 2 else "de", "s", 1) for k in range(600)]
    counts = lambda **b: sum(n.sum() for n in language_id.fit(docs_of(spark, rows), **b)["counts"])
    whole = sum(len(r[1]) for r in rows)
    assert counts() == whole and 0.05 * whole < counts(sample_bytes=whole // 10) < 0.2 * whole


def test_language_accuracy_and_split(spark):
    got = language_id.op1_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_edges(spark, tmp_path):
    rows = [(1, "the cat and the dog", "en", "s", 1), (3, "le chat et le chien", "fr", "s", 1), (4, None, "en", "s", 1), (5, "", None, None, None), (6, "123 !!", "en", "s", 1), (7, "the dog", None, "s", 1), (7, "the dog", None, "s", 1), (None, "le chien", None, "s", 1), (8, "the cat " * 50_000, None, "s", 1)]
    docs_of(spark, rows).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.op1_language_id(spark, str(tmp_path)).collect()), key=str)
    by = collections.defaultdict(list)
    for i, lang, score in got:
        by[i].append((lang, score))
    assert by[4] == by[5] == by[6] == [("und", 0.0)] and len(by[7]) == 2 and by[7][0][0] == "en" and by[None][0][0] == "fr" and by[8][0][0] == "en"
    docs_of(spark, []).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert language_id.op1_language_id(spark, f"{tmp_path}/e").count() == 0
    kept = language_id.stage_language_id(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns[-1] == "score" and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "7", "7", "8", "None"]


# ------------------------------------------------------------------ near-duplicates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall


def brute_components(rows, least=0.8):
    """Smallest id reachable through pairs of weighted Jaccard similarity `least`, of all pairs."""
    bags = {}
    for i, t in rows:
        w = WORD((t or "").lower())
        if w and i is not None:
            bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = sum((bags[a] & bags[b]).values())
            if o >= least * (sum(bags[a].values()) + sum(bags[b].values()) - o):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_bag_minhash_is_unbiased_and_stable():
    rng = np.random.default_rng(0)
    for top in (2, 30):
        a = collections.Counter({int(k): int(c) for k, c in zip(rng.integers(0, 50, 40), rng.integers(1, top, 40))})
        b = collections.Counter({int(k): int(c) for k, c in zip(rng.integers(0, 50, 40), rng.integers(1, 2 * top, 40))})
        rows, values, counts = [], [], []
        for r in range(300):
            for d, bag in ((0, a), (1, b)):
                for k, c in sorted(bag.items()):
                    rows.append(2 * r + d), values.append(k + 1 + 1000 * r), counts.append(c)
        args = np.array(rows), near_dedup.mix(np.array(values, np.uint64)), np.array(counts)
        h = near_dedup.bag_minhash(*args, 600, 64)
        truth = sum((a & b).values()) / sum((a | b).values())
        assert abs((h[::2] == h[1::2]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / (300 * 64)) + 1e-9
    one = np.concatenate([near_dedup.bag_minhash(np.zeros((args[0] == k).sum(), int), args[1][args[0] == k], args[2][args[0] == k], 1, 64) for k in range(600)])
    assert (one == h).all()  # whatever a batch holds


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgé"), 6))
    base = [[word() for _ in range(n)] for n in (120, 60, 300, 3)]
    rows, i = [], 0
    for b in base:
        for _ in range(25):  # copies with changes that spread similarities around 0.8
            w = list(b)
            for _ in range(int(rng.integers(0, max(1, len(b) // 25)))):
                w[int(rng.integers(len(w)))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, rows[0][1].upper()), (i + 1, ""), (i + 2, None), (i + 3, "..."), (i + 4, "..."), (i + 5, "x " * 4000), (i + 6, "x " * 3990)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = near_dedup.near_duplicates(frame).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(rows)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_near_duplicates_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.op2_near_dedup(spark, f"{DATA}/sf0.001").toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(rows)


def test_near_dedup_edges(spark):
    same = "one two three four five six seven"
    docs = docs_of(spark, [(1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "en", "b", 1), (None, same, "en", "b", 1), (3, None, None, None, None), (4, "solo", "en", "b", 1)]).withColumn("node", F.lit("x"))
    got = near_dedup.near_duplicates(docs)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got.collect()) == [("1", "1", False), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("4", "4", True), ("None", "None", True)]
    kept = near_dedup.stage_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (1, 1), (None, 3), (20, 21), (22, 21), (22, 23), (23, 24)], "a long, b long")
    assert {r["node"]: r["component"] for r in common.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_components_with_hubs(spark):
    """Nodes of very many edges, as centres, as leaves of many and in a chain of stars."""
    edges = [(0, i) for i in range(1, 400)] + [(5000, i) for i in range(300, 700)] + [(2000 + i, 2001 + i) for i in range(0, 60, 2)] + [(3000, 2000), (3000, 2001)]
    want = {x: x for e in edges for x in e}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


# ------------------------------------------------------------------ quality

def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    w = quality.fit(docs, labels.filter("doc_id % 4 <> 2"))
    got = quality.with_evidence(docs, w, [F.col("doc_id"), F.col("text")]).select("__row.*", F.col("evidence").alias("__evidence")).join(labels.filter("doc_id % 4 = 2"), "doc_id").toPandas()
    good = got.quality == 1
    assert (got["__evidence"] > 0)[good].mean() > 0.98 and (got["__evidence"] <= 0)[~good].mean() > 0.6


def kind_of_bad(text):
    words = re.findall(r"\w+", text)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    if repeats > 0.2:
        return "words"
    if len(re.findall(r"[#$%&*]{3}", text)) > 0.1 * len(words):
        return "symbols"
    return "bars" if text.count(" | ") > 0.1 * len(words) else "capitals" if sum(c.isupper() for c in text) > 0.2 * len(text) else "other"


def test_the_fit_holds_few_doubles():
    """The sample stays as it is given, in single precision; steps make doubles of a part of it."""
    random = np.random.default_rng(5)
    x = random.random((8000, quality.FEATURES), np.float32)
    x[:, -1] = 1
    y = (x[:, 0] + 0.3 * random.standard_normal(8000) > 0.5).astype(float)
    tracemalloc.start()
    w = quality.fit_logistic(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    p, penalty = 1 / (1 + np.exp(-x.astype(float) @ w)), np.array([0.02] * (x.shape[1] - 1) + [1e-6]) / 100
    assert np.abs(x.astype(float).T @ (p - y) / len(y) + penalty * w).max() < 1e-6


def test_quality_by_kind(spark):
    """Held-out low-quality documents of every kind are rejected, those of repeated words too."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    w = quality.fit(docs, labels.filter("doc_id % 4 <> 2"))
    got = quality.with_evidence(docs, w, [F.col("doc_id"), F.col("text")]).select("__row.*", F.col("evidence").alias("__evidence")).join(labels.filter("doc_id % 4 = 2"), "doc_id").toPandas()
    bad = got[got.quality == 0]
    rejected = (bad["__evidence"] <= 0).groupby(bad.text.map(kind_of_bad)).agg(["mean", "size"])
    print(rejected, (got["__evidence"] > 0)[got.quality == 1].mean())
    assert (bad["__evidence"] <= 0).mean() > 0.9 and rejected["mean"]["words"] > 0.9
    assert (got["__evidence"] > 0)[got.quality == 1].mean() > 0.98


def test_repetition_of_words():
    texts = ["a b a b", "Der Der Der Der", None, "", "one two three", "x " * 700_000 + "y"]
    raw, off, _ = common.text_buffer(pa.array(texts))
    got = quality.repetition(raw, off)
    assert np.allclose(got[:5], [[0, 0.5, 1 / 3, 0.5], [1, 0.75, 2 / 3, 1], [0] * 4, [0] * 4, [0, 0, 0, 1 / 3]])
    assert np.allclose(got[5], [699_999 / 700_000, 699_999 / 700_001, 699_998 / 700_000, 700_000 / 700_001])


class SlowQuality:
    """The operator again, a document at a time and without its functions: byte-class shares and repetition counted in dictionaries, rates summed in loops."""

    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",;:", "!?", "|", "#$%&*@^~", "'\"()-", "<>{}[]=/\\_+`")

    def features(self, text):
        b = (text or "").encode()
        kind = [13 if x >= 128 else next((k for k, g in enumerate(self.groups) if chr(x) in g), 12) for x in b]
        pairs = collections.Counter(zip(kind, kind[1:]))
        shares = [math.sqrt(pairs[i, j] / max(1, len(b) - 1)) for i in range(14) for j in range(14)]
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)
        two = list(zip(words, words[1:]))
        n, m = max(1, len(words)), max(1, len(words) - 1)
        repeats = [sum(x == y for x, y in two) / m, (len(words) - len(set(words))) / n, (len(two) - len(set(two))) / m, max(collections.Counter(words).values(), default=0) / n]
        return [*shares, *repeats, min(1.0, len(b) / 200), math.log1p(len(b)) / 10, 1.0]

    def fit(self, docs, labels):
        x, y = np.array([self.features(t) for i, t, *_ in docs if i in labels]), np.array([labels[i] for i, *_ in docs if i in labels], float)
        penalty = np.array([0.02] * (x.shape[1] - 1) + [1e-6]) / 100
        self.w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ self.w))
            self.w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(penalty), x.T @ (p - y) / len(y) + penalty * self.w)

    def scores(self, docs):
        """(evidence, host rate, path rate, score) of rows (id, text, host, path)."""
        e = [float(np.dot(self.features(t), self.w)) for _, t, _, _ in docs]
        p = [1 / (1 + math.exp(-x)) for x in e]
        hosts, paths = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
        for (_, _, h, a), x in zip(docs, p):
            for site, key in ((hosts, h), (paths, (h, a))):
                site[key][0] += 1
                site[key][1] += x
        n, near = len(docs), lambda r: min(1 - 1e-4, max(1e-4, r))
        mean = near(sum(p) / n)

        def strength(squares, groups):
            excess = (squares - groups * mean * (1 - mean)) / n
            return min(1e4, max(1.0, mean * (1 - mean) / excess - 1)) if excess > 0 else 1e4

        s_host = strength(sum(k * (t / k - mean) ** 2 for k, t in hosts.values()), len(hosts))
        rate = {h: (t + s_host * mean) / (k + s_host) for h, (k, t) in hosts.items()}
        s_path = strength(sum(k * (t / k - rate[h]) ** 2 for (h, _), (k, t) in paths.items()), len(paths))
        out = []
        for (_, _, h, a), x, q in zip(docs, e, p):
            of_host = near((hosts[h][1] - q + s_host * mean) / (hosts[h][0] - 1 + s_host))
            of_path = near((paths[h, a][1] - q + s_path * of_host) / (paths[h, a][0] - 1 + s_path))
            odds = x + math.log(of_path / (1 - of_path)) - math.log(mean / (1 - mean))
            out.append((x, of_host, of_path, 1 / (1 + math.exp(-odds))))
        return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_quality_equals_brute_force(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = [(900, None, None, "s", 1), (901, "", "en", None, 1), (902, "Ein Satz. Noch ein Satz.", "de", None, 1), (902, "Ein Satz. Noch ein Satz.", "de", None, 1)]
    docs.unionByName(docs_of(spark, extra)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()}
    slow = SlowQuality()
    slow.fit(rows, labels)
    want = sorted((r[0], *x) for r, x in zip(rows, slow.scores(rows)))
    got = sorted((r["doc_id"], r["evidence"], r["host_rate"], r["path_rate"], r["score"]) for r in quality.op6_quality(spark, str(tmp_path)).collect())
    assert len(got) == len(want) and np.allclose(np.array(got, float), np.array(want, float), atol=1e-3)


def test_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9)] * 400 + [("bad", "p", 0.1)] * 400 + [("tiny", "p", 0.0)] + [("mid", "q", 0.5)] * 100
    rates, prior = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    frame = spark.createDataFrame([(h, p, math.log(max(x, 1e-9) / (1 - x))) for h, p, x in rows], "host string, path string, evidence double")
    by = {r["host"]: r["host_rate"] for r in quality._scored(frame, rates, prior).collect()}
    assert by["big"] > 0.85 and by["bad"] < 0.15 and 0.0 < by["tiny"] <= prior["mean"] and abs(prior["mean"] - 450 / 901) < 1e-9


def test_quality_edges(spark, tmp_path):
    good, bad = "Plain words stand here in a row. " * 5, "### $$$ %%% &&& *** " * 9
    rows = [(i, good if i % 2 else bad, "en" if i % 3 else None, "s" if i % 5 else None, 1) for i in range(40)] + [(98, None, "en", "s", 1), (99, "", None, None, None), (99, "", None, None, None), (None, good, "en", "s", 1)]
    docs_of(spark, rows).withColumn("host", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op6_quality(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and all(k == (i % 2 == 1) for i, k in zip(got.doc_id, got.kept) if i < 40)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality.stage_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    docs_of(spark, []).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert quality.op6_quality(spark, f"{tmp_path}/e").count() == 0
    assert quality.stage_quality(spark, docs, f"{tmp_path}/e").count() == len(rows)


def test_pairs_of_a_hub_meet_its_copies(spark, monkeypatch):
    """A node that is in most pairs has its multiset in several tasks, and every pair meets it once."""
    monkeypatch.setattr(near_dedup, "MEETS", 10)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 500) for i in range(1, 100)], "a long, b long")
    known = spark.createDataFrame([(i, [i, -i]) for i in [*range(200), 500]], "node long, bag array<long>")
    got = near_dedup._with_bags(near_dedup._with_bags(pairs, known, "a", pairs, 298), known, "b", pairs, 298).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((r["a"], r["b"]) for r in pairs.collect()) and all(r["bag_a"][0] == r["a"] and r["bag_b"][0] == r["b"] for r in got)


def test_rows_of_one_id_with_other_texts(spark, tmp_path):
    """Of an id's rows, a copy of another document goes and the text of its own stays."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    docs = docs_of(spark, [(1, text(1), "en", "s", 1), (2, text(1), "en", "s", 1), (2, text(2), "en", "s", 1), (2, text(2), "de", "s", 1), (3, text(3), "en", "s", 1), (4, None, "en", "s", 1), (4, text(3), "en", "s", 1)])
    got = near_dedup.stage_near_dedup(spark, docs.withColumn("node", F.lit("clash")), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (4, None)], key=str) and got.columns[-1] == "node"


# ------------------------------------------------------------------ licences

def test_licence_scan_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/sf0.001/documents.parquet'")
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(f"select {', '.join(cols)} from ({licenses.ORACLE})").fetchall()
    got = [tuple(r) for r in licenses.op10_license_scan(spark, f"{DATA}/sf0.001").select(cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("changed, found", [("", True), ("free", True), ("sell copies of the software and", True), ("half", False)])
def test_changed_notices(spark, changed, found):
    notice = licenses.NOTICES[0][1]
    text = " ".join(notice.split()[:40]) if changed == "half" else notice.replace(changed, "") if changed else notice.title()
    r = licenses.scan(spark.createDataFrame([(1, f"Before, it. {text}! After")], "doc_id long, text string")).first()
    assert (r["labels"] == "mit") == found and r["base_labels"] == "" and r["first_word"] is None and 0 <= r["score"] <= 1


def test_spans_are_verified_by_their_words(spark):
    """A fragment does not stand for a notice however often it is repeated, and does not hide one beside it."""
    words = licenses.NOTICES[0][1].split()
    fragment = " ".join(words[:8])
    texts = [" ".join([fragment] * 13), " ".join([fragment] * 400), " ".join([fragment] * 40 + words + [fragment] * 40), " ".join(words[:70] + ["and so on"] * 4 + words[70:]), " ".join(words[40:] + words[:40]), " ".join(reversed(words))]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "mit", 3: "mit", 4: "", 5: ""}


def test_capitals_beyond_ascii_stay(spark):
    rows = [(0, "MIT LICENSE"), (1, "M\u0130T LICENSE"), (2, "\u212a MIT license \u212a"), (3, "k mit license \u00c9")]
    got = {r["doc_id"]: (r["n_words"], r["first_word"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (2, 0), 1: (2, None), 2: (4, 1), 3: (4, 1)}


def test_licence_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "MIT-license MIT License mit licenses"), (4, "a"), (4, "a"), (None, "Apache\nLicense"), (5, "GNU GENERAL public License " + "x " * 50_000)], "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    assert len(got) == 6 and licenses.scan(docs).count() == 7
    assert (got[3, 6]["n_base"], got[3, 6]["first_word"], got[3, 6]["last_word"]) == (2, 0, 2)
    assert got[5, 50_004]["base_labels"] == "gpl" and got[None, 2]["base_labels"] == "apache" and got[1, 0]["labels"] == ""
    assert licenses.scan(docs.limit(0)).count() == 0
