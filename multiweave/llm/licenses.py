"""Licence scans by diagonal voting, in DataFrame functions alone.

Templates are word sequences. Every rolling word pair of a text is hashed and joined to the positions of the templates'
pairs (a broadcast of fixed size: the templates are a parameter); long templates also need the third word to agree, so
that they vote by word triples. A hit at word i of the text and j of the template votes for the diagonal i - j. Votes are
gathered by document, template and diagonal before anything is shuffled. A phrase stands where its diagonal has all its
votes. For long templates neighbouring diagonals (words put in or left out shift them) are merged: from each diagonal on,
all those by which a span no longer than STRETCH times the template can shift. A merged span is verified by its words: it
must hold SHARE of the template's triples, each place of the template counted once however often it was hit.

Capitals A-Z are made small, and words are runs of ASCII letters, digits and characters beyond ASCII.

Defined results: null and empty texts have no words and empty labels with score 0. Every row of the table gives one row,
repeated rows too. Any length of text is scanned whole. score is the best span's share of its template found, 1 for a phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, base, words): base phrases, and phrases of the method's own. A phrase must stand whole.
PHRASES = (
    ("mit", True, "mit license"),
    ("apache", True, "apache license"),
    ("gpl", True, "general public license"),
    ("cc-by", False, "under cc by 4 0"),
    ("cc-by-nc", False, "under cc by nc 4 0"),
    ("cc-by-sa", False, "under cc by sa 4 0"),
    ("cc0", False, "under cc0 1 0"),
    ("bsd", False, "bsd license"),
    ("mpl", False, "mozilla public license"),
)

#: (label, words) of notices that may be changed a little where they stand.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
)

#: Verified spans whose diagonals are this near are one; the share of a notice's triples that a span must hold; its length over the notice's at most.
NEAR, SHARE, STRETCH = 8, 0.7, 1.5
#: Diagonals are counted in thousandths of their template, so that one frame fits all.
UNIT = 1000


def template_rows(phrases: tuple = PHRASES, notices: tuple = NOTICES) -> list[tuple]:
    """(template, label, base, needed, n_words, at, first, second, third): a row for each pair of a phrase and triple of a notice."""
    out = []
    for t, (label, base, text, exact) in enumerate([(*p, True) for p in phrases] + [(label, False, text, False) for label, text in notices]):
        words = text.split()
        k = 2 if exact else 3
        for i in range(len(words) - k + 1):
            out.append((t, label, base, exact, len(words) - k + 1, len(words), i, words[i], words[i + 1], None if exact else words[i + 2]))
    return out


TEMPLATE_SCHEMA = "template int, label string, base boolean, exact boolean, needed int, t_words int, t_at int, t_first string, t_second string, t_third string"


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, with the capitals A-Z made small.

    Only two characters beyond ASCII have ASCII letters as their small ones; texts without them can take the quicker
    function, as other words beyond ASCII are in no template whatever their case.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    slow = whole.contains("\u0130") | whole.contains("\u212a")
    return F.array_remove(F.split(F.when(slow, F.translate(whole, _CAPITALS, _CAPITALS.lower())).otherwise(F.lower(whole)), SEPARATOR), "")


def votes(docs: DataFrame, templates: list[tuple], *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, n_words, template, label, base, exact, needed, t_words, diagonal, spots): the places of the template hit on the diagonal.

    A document without votes has one row with nulls. Templates bound the spots.
    """
    small = F.broadcast(docs.sparkSession.createDataFrame(templates, TEMPLATE_SCHEMA).withColumn("t_hash", F.xxhash64("t_first", "t_second")))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    shifted = words.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"), F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))).alias("c"))).alias("at", "w"))
    grams = shifted.select("row", "doc_id", "n_words", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.c").alias("c"), F.xxhash64("w.a", "w.b").alias("hash"))
    same = (F.col("hash") == F.col("t_hash")) & (F.col("a") == F.col("t_first")) & (F.col("b") == F.col("t_second")) & (F.col("t_third").isNull() | (F.col("c") == F.col("t_third")))
    hits = grams.join(small, same, "left").filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    return hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "exact", "needed", "t_words", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("t_at").alias("spots"))


def spans(voted: DataFrame) -> DataFrame:
    """(row, label, base, start, score) of the phrases and notices that stand in each document."""
    found = voted.filter(F.col("template").isNotNull())
    exact = found.filter(F.col("exact") & (F.size("spots") == F.col("needed"))).select("row", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    shift = F.floor(F.col("diagonal") * UNIT / F.col("t_words")).cast("long")
    on = Window.partitionBy("row", "template").orderBy("shift").rangeBetween(0, int(UNIT * (STRETCH - 1)))
    merged = found.filter(~F.col("exact")).withColumn("shift", shift).withColumn("held", F.size(F.array_distinct(F.flatten(F.collect_list("spots").over(on)))))
    good = merged.withColumn("share", F.col("held") / F.col("needed")).filter(F.col("share") >= SHARE)
    per = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(per) > NEAR).cast("int"), F.lit(1))
    runs = good.withColumn("new", new).withColumn("run", F.sum("new").over(per))
    near = runs.groupBy("row", "template", "label", "run").agg(F.max_by("diagonal", F.struct("share", "diagonal")).alias("start"), F.max("share").alias("score"))
    return exact.unionByName(near.select("row", "label", F.lit(False).alias("base"), "start", "score"))


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    voted = cut(votes(docs, template_rows(phrases, notices), text=text, doc_id=doc_id))
    none = F.lit(None)
    whole = voted.select("row", "doc_id", "n_words").distinct().select("row", "doc_id", "n_words", none.cast("string").alias("label"), F.lit(False).alias("base"), none.cast("int").alias("start"), F.lit(0.0).alias("score"))
    found = spans(voted).select("row", none.cast("long").alias("doc_id"), none.cast("int").alias("n_words"), "label", "base", "start", "score")
    base = F.col("base")
    return (
        whole.unionByName(found)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("score").alias("score"),
        )
        .drop("row")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    """The same results another way: phrases as joined words that are searched, notices by pairs of hits on two diagonals, no hashes."""
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    phrases = ",\n".join(f"({', '.join(map(quote, p))}, {len(p[2].split())})" for p in PHRASES)
    notices = ",\n".join(f"({t}, {quote(label)}, string_split({quote(text)}, ' '))" for t, (label, text) in enumerate(NOTICES))
    return f"""
WITH p(label, base, phrase, n) AS (VALUES
{phrases}),
t(template, label, words) AS (VALUES
{notices}),
k AS (SELECT template, label, len(words) AS size, unnest(range(1, len(words) - 1)) AS j, words FROM t),
three AS (SELECT template, label, size, j, words[j] || ' ' || words[j + 1] || ' ' || words[j + 2] AS gram FROM k),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
g AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d),
e AS (SELECT r, label, base, i - 1 AS start, 1.0::DOUBLE AS score FROM g JOIN p ON words[i] = split_part(phrase, ' ', 1) AND list_aggregate(words[i:i + n - 1], 'string_agg', ' ') = phrase),
h AS (SELECT r, template, label, size, i, j FROM g JOIN three ON len(words) >= i + 2 AND words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] = gram),
a AS (SELECT DISTINCT r, template, label, size, i - j AS d, (i - j) * {UNIT} // size - CASE WHEN (i - j) < 0 AND (i - j) * {UNIT} % size <> 0 THEN 1 ELSE 0 END AS s FROM h),
s AS (SELECT a.r, a.label, count(DISTINCT b.j)::DOUBLE / (a.size - 2) AS share
      FROM a JOIN (SELECT DISTINCT h.r, h.template, h.j, a.s FROM h JOIN a ON a.r = h.r AND a.template = h.template AND a.d = h.i - h.j) b
      ON a.r = b.r AND a.template = b.template AND b.s BETWEEN a.s AND a.s + {int(UNIT * (STRETCH - 1))}
      GROUP BY a.r, a.template, a.label, a.size, a.d),
f AS (SELECT * FROM e UNION ALL SELECT r, label, false, NULL, share FROM s WHERE share >= {SHARE})
SELECT d.doc_id, len(any_value(words))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
       (min(start) FILTER (base))::BIGINT AS first_word, (max(start) FILTER (base))::BIGINT AS last_word,
       coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (base)), 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), 'string_agg', ','), '') AS labels,
       coalesce(max(score), 0.0::DOUBLE) AS score
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id
"""


ORACLE = _oracle()
