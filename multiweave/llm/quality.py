"""Quality by hierarchical empirical Bayes: evidence of the text, and posteriors of its host and path.

Evidence is the log-odds of a logistic model over byte-class bigrams and the repetition of words in the whole text,
fitted on a bounded sample of labelled documents. Documents' probabilities are summed by path and by host in grouped aggregations over all rows. The
rate of a host is shrunk towards the global rate, and that of a path towards its host's, each by a strength estimated
from how much rates differ beyond chance (moments of a beta-binomial), so that sparse sites follow the level above.
A document's score is its evidence plus the log-odds by which its path differs from the whole; its own probability is
taken out of the sums of its path and of its host first, so nothing counts twice. Strengths are kept within STRENGTH, and
rates within RATE of 0 and 1, so that a site of a few documents of one kind is no proof.

For `documents`, the host is the source and the path is the language within it.

Defined results: a null text is an empty one; a null host or path is one of its own; without labels of both kinds every
document has evidence 0 and score 0.5 and is kept. Repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, cut, doc_chunks, doc_hash, join_few, mix, over_texts, release, table, text_buffer, trim, word_hashes, word_spans

#: Labelled documents that the model is fitted on, about.
SAMPLE = 20_000
#: Rows of the sample that a step of the fit has as doubles at once.
FIT_ROWS = 1024
#: Least and greatest prior rows that a level above is worth; how near rates come to 0 and 1.
STRENGTH, RATE = (1.0, 1e4), 1e-4
#: A document stays if its score is no less.
KEEP = 0.5

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",;:", "!?", "|", "#$%&*@^~", "'\"()-", "<>{}[]=/\\_+`")
CLASSES = len(_GROUPS) + 2  # and control characters, and all bytes beyond ASCII
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = len(_GROUPS) + 1
REPEATS = 4
FEATURES = CLASSES * CLASSES + REPEATS + 3


def _pieces(raw: np.ndarray, a: int, b: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of raw[a:b] of `most` bytes or more that cut no word."""
    while a < b:
        to = min(b, a + most)
        while to < b and ALNUM[raw[to - 1]] and ALNUM[raw[to]]:
            inside = ALNUM[raw[to : min(b, to + most)]]
            to += len(inside) if inside.all() else int(inside.argmin())
        yield a, to
        a = to


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, times of the commonest one) of each of n rows."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[first], np.diff(np.r_[first, len(h)]))
    return np.bincount(row[first], minlength=n), most


def repetition(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Four shares for each text: words equal to the one before, words and pairs of words that are repeats, and the commonest word."""
    out = np.zeros((len(off) - 1, REPEATS))
    for i, j in doc_chunks(off):
        a, b, m = int(off[i]), int(off[j]), j - i
        hashes, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for x, y in [(a, b)] if m > 1 else _pieces(raw, a, b):
            starts, ends, row = word_spans(raw[x:y], off[i : j + 1] - a if m > 1 else np.array([0, y - x]), ALNUM)
            hashes.append(word_hashes(raw[x:y], starts, ends))
            rows.append(row)
        h, row = np.concatenate(hashes), np.concatenate(rows)
        words, near = np.bincount(row, minlength=m), row[1:] == row[:-1]
        distinct, most = _distinct(h, row, m)
        pairs, _ = _distinct((mix(h[:-1]) + h[1:])[near], row[1:][near], m)
        n, n_pairs = np.maximum(1, words), np.maximum(1, words - 1)
        same = np.bincount(row[1:][near & (h[1:] == h[:-1])], minlength=m)
        out[i:j] = np.stack([same / n_pairs, (words - distinct) / n, np.maximum(0, words - 1 - pairs) / n_pairs, most / n], 1)
    return out


def features(arr: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text: roots of the shares of byte-class bigrams, the repetition, and of the length."""
    raw, off, _ = text_buffer(arr)
    out = np.zeros((len(arr), FEATURES))
    for i in range(len(arr)):
        a, b = int(off[i]), int(off[i + 1])
        n = b - a
        counts = np.zeros(CLASSES * CLASSES)
        for at in range(a, b - 1, 1 << 20):
            kind = _CLASS[raw[at : min(at + (1 << 20) + 1, b)]]
            counts += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        out[i, : CLASSES * CLASSES] = np.sqrt(counts / max(1, n - 1))
        out[i, -3:] = min(1.0, n / 200), np.log1p(n) / 10, 1.0
    out[:, CLASSES * CLASSES : -3] = repetition(raw, off)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton steps; the last feature is constant and free. Rows are made doubles FIT_ROWS at a time."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * 1.0)
    penalty[-1] = 1e-6
    for _ in range(steps):
        h, g = np.diag(penalty / 100 * len(y)), penalty / 100 * len(y) * w
        for i in range(0, len(y), FIT_ROWS):
            part = x[i : i + FIT_ROWS].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h += (part * (p * (1 - p))[:, None]).T @ part
            g += part.T @ (p - y[i : i + FIT_ROWS])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> np.ndarray | None:
    """The weights, or None if the labels are not of both kinds."""
    known = labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).dropna().groupBy("__id").agg(F.min("__y").alias("__y"))
    n = known.count()
    if not n:
        return None
    drawn = known.filter(F.pmod(doc_hash("__id", seed=6), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    own = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    joined = own.join(F.broadcast(drawn), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    got = joined.mapInArrow(run, "y int, x binary").toArrow()
    y = got["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    x = np.empty((len(y), FEATURES), np.float32)
    for i, r in enumerate(got["x"]):
        x[i] = np.frombuffer(r.as_buffer(), np.float32)
    del got, r
    order = np.lexsort((*x.T[:8], y))  # the same sums whatever order the rows came in
    x = x[order]
    weights = fit_logistic(x, y[order].astype(float))
    del x
    trim(docs.sparkSession)
    return weights


def with_evidence(docs: DataFrame, weights: np.ndarray | None, keep: list[Column], text: str = "text") -> DataFrame:
    """`__row`, a struct of the columns keep, with evidence, the log-odds of the text alone."""
    w = np.zeros(FEATURES) if weights is None else weights

    def of_texts(texts: pa.Array) -> tuple[list[pa.Array], None]:
        release()
        return [pa.array(features(texts) @ w)], None

    return over_texts(docs, text, keep, of_texts, "evidence double")


def site_rates(rows: DataFrame) -> tuple[DataFrame, dict]:
    """(host, path, n, total, host_n, host_total) of rows (host, path, p), and the global rate and strengths: mean, of_hosts, of_paths."""
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    n, total, k, squares = hosts.agg(F.sum("host_n"), F.sum("host_total"), F.count("*"), F.sum(F.col("host_total") * F.col("host_total") / F.col("host_n"))).first()
    mean = min(1 - RATE, max(RATE, total / n)) if n else 0.5
    of_hosts = _strength(mean, n or 0, k, (squares or 0) - (n or 0) * mean * mean)
    joined = cut(paths.join(hosts, "host"))
    rate = (F.col("host_total") + of_hosts * mean) / (F.col("host_n") + of_hosts)
    k, squares = joined.agg(F.count("*"), F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - rate, 2))).first()
    return joined, {"mean": mean, "of_hosts": of_hosts, "of_paths": _strength(mean, n or 0, k, squares or 0)}


def _strength(mean: float, n: float, groups: int, squares: float) -> float:
    """Prior rows worth: from the sum of n (rate - mean)**2 over groups, beyond what chance gives."""
    chance = mean * (1 - mean)
    excess = (squares - groups * chance) / max(1.0, n)
    return float(min(STRENGTH[1], max(STRENGTH[0], chance / excess - 1))) if excess > 0 else STRENGTH[1]


def _keys(host: Column, path: Column) -> list[Column]:
    key = lambda c: F.coalesce(F.concat(F.lit("0"), c.cast("string")), F.lit("1"))
    return [key(host).alias("host"), key(path).alias("path")]


def _scored(rows: DataFrame, rates: DataFrame, prior: dict) -> DataFrame:
    """rows (host, path, evidence, ...) with host_rate, path_rate and score, each without the document's own part."""
    joined = join_few(rows, rates, ["host", "path"], F.octet_length("host") + F.octet_length("path") + 64, F.col("evidence"))
    mean, of_hosts, of_paths = prior["mean"], prior["of_hosts"], prior["of_paths"]
    p = _probability()
    near = lambda rate: F.least(F.lit(1 - RATE), F.greatest(F.lit(RATE), rate))
    host = near((F.col("host_total") - p + of_hosts * mean) / (F.col("host_n") - 1 + of_hosts))
    path = near((F.col("total") - p + of_paths * F.col("host_rate")) / (F.col("n") - 1 + of_paths))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(mean / (1 - mean)))
    return joined.withColumn("host_rate", host).withColumn("path_rate", path).withColumn("score", 1 / (1 + F.exp(-odds)))


def _probability() -> Column:
    return 1 / (1 + F.exp(-F.col("evidence")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels")
    seen = cut(with_evidence(docs, fit(docs, labels), [F.col("doc_id"), *_keys(F.col("source"), F.col("lang"))]).select("__row.*", "evidence"))
    rates, prior = site_rates(seen.select("host", "path", _probability().alias("p")))
    return _scored(seen, rates, prior).select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("kept"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score is below KEEP. Evidence is computed twice, so that no text is shuffled."""
    weights = fit(docs, table(spark, sf_dir, "labels"))
    rates, prior = site_rates(with_evidence(docs, weights, _keys(F.col("source"), F.col("lang"))).select("__row.*", _probability().alias("p")))
    rows = with_evidence(docs, weights, [F.col(f"`{c}`") for c in docs.columns])
    return _scored(rows.select("__row", "evidence", *_keys(F.col("__row.source"), F.col("__row.lang"))), rates, prior).filter(F.col("score") >= KEEP).select("__row.*")
