"""Full-text search by BM25 over postings that are an ordinary table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Ids that come more than once are broadcast up to so many.
BROADCAST_IDS = 100_000


def tokenize(text: Column) -> Column:
    """Small-lettered runs of letters and digits; no stems, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def blank(text: Column) -> Column:
    """Whether a text is null or has white space alone; such documents are none of the corpus. Others count even if they hold no word."""
    return ~F.coalesce(text.rlike(r"[^\s\x{85}\p{Z}]"), F.lit(False))


def postings(docs: DataFrame, *, id_col: str, text_col: str, unique: bool = False) -> DataFrame:
    """(id, term, tf, doc_len): one row for each term of a document that is not blank.

    The terms of a text are counted in its row, from their sorted list, so nothing is shuffled. Only texts whose id comes
    more than once are counted together; those ids are looked for first, unless ids are known to be unique.
    """
    words = docs.filter(~blank(F.col(text_col))).select(F.col(id_col).alias("id"), F.sort_array(tokenize(F.col(text_col))).alias("terms"))
    if unique:
        return _counted(words)
    again = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    n = again.count()
    if n == 0:
        return _counted(words)
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    match = words["id"].eqNullSafe(again["id"])
    both = _counted(words.join(again, match, "left_semi")).groupBy("id", "term", "doc_len").agg(F.sum("tf").alias("tf"))
    return _counted(words.join(again, match, "left_anti")).unionByName(both)


def _counted(words: DataFrame) -> DataFrame:
    """Postings of rows (id, terms), the terms sorted: a term's count is the way from its first place to that of the next one."""
    starts = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: (i == 1) | (F.get("terms", i - 1) != F.get("terms", i - 2)))
    firsts = words.filter(F.size("terms") > 0).select("id", "terms", F.size("terms").alias("n"), starts.alias("at"))
    found = F.transform("at", lambda i, j: F.struct(F.get("terms", i - 1).alias("term"), (F.coalesce(F.get("at", j + 1), F.col("n") + 1) - i).cast("long").alias("tf")))
    return firsts.select("id", F.col("n").cast("long").alias("doc_len"), F.explode(found).alias("p")).select("id", "p.term", "doc_len", "p.tf")


def lengths(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, doc_len) of each document of the corpus, of those without words too."""
    return docs.filter(~blank(F.col(text_col))).select(F.col(id_col).alias("id"), F.size(tokenize(F.col(text_col))).cast("long").alias("doc_len"))


def stats_of(lengths_: DataFrame) -> DataFrame:
    """One row: documents of the corpus, and their average number of terms, 1 at least."""
    return lengths_.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg("doc_len"), F.lit(1.0))).alias("avg_len"))


def corpus_stats(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    return stats_of(lengths(docs, id_col=id_col, text_col=text_col))


def refresh(index: DataFrame, lengths_: DataFrame, changed: DataFrame, *, id_col: str, text_col: str, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """An index (postings, lengths) after documents changed; a null or blank text is a document that is gone. Only changed texts are read."""
    ids = changed.select(F.col(id_col).alias("id")).distinct()
    own = {"id_col": id_col, "text_col": text_col}
    return index.join(ids, "id", "left_anti").unionByName(postings(changed, **own, unique=unique)), lengths_.join(ids, "id", "left_anti").unionByName(lengths(changed, **own))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5) + 1))


def tf_part(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def bm25(docs: DataFrame, query: str, *, id_col: str, text_col: str, limit: int = 10) -> DataFrame:
    """(id, score, text) of the best `limit` documents that hold any term; a term asked twice counts twice. Score first, then id.

    One pass: every document's length and the frequencies of the query's terms alone, so postings of other words are never made.
    """
    terms = query_terms(query)
    if not terms or limit <= 0:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.col(text_col).alias("text")).limit(0)
    asked = sorted(set(terms))
    words = docs.filter(~blank(F.col(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tokenize(F.col(text_col)).alias("terms"))
    tf = [(F.size("terms") - F.size(F.array_remove("terms", t))).alias(f"tf{i}") for i, t in enumerate(asked)]
    counted = words.select("id", "text", F.size("terms").alias("doc_len"), *tf)
    stats = counted.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg("doc_len"), F.lit(1.0))).alias("avg_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(asked))])
    score = sum((terms.count(t) * idf(F.col("n_docs"), F.col(f"df{i}")) * tf_part(F.col(f"tf{i}"), F.col("doc_len"), F.col("avg_len")) for i, t in enumerate(asked)), F.lit(0.0))
    hit = sum((F.col(f"tf{i}") for i in range(len(asked))), F.lit(0)) > 0
    return counted.filter(hit).join(F.broadcast(stats)).select("id", score.alias("score"), "text").orderBy(F.desc("score"), "id").limit(limit)


def search(index: DataFrame, stats: DataFrame, query: str, *, limit: int = 10) -> DataFrame:
    """(id, score) of the best documents of stored postings and their stored stats (n_docs, avg_len), for many searches of one corpus: only postings of the query's terms are read."""
    terms = query_terms(query)
    if not terms or limit <= 0:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    asked = index.sparkSession.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times int")
    hits = index.filter(F.col("term").isin(sorted(set(terms)))).join(F.broadcast(asked), "term")
    dfs = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(dfs), "term").join(F.broadcast(stats))
    part = F.col("times") * idf(F.col("n_docs"), F.col("df")) * tf_part(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return scored.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
