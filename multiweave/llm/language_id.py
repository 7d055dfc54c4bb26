"""Language identification by prediction by partial matching.

For each language a context tree over bytes holds the counts of every symbol after contexts of 0 to 3 bytes. With
frozen statistics a symbol costs -log2 P bits, where P is n / (T + q) for a symbol seen n times among T in its context
(q distinct ones), and otherwise the escape mass q / (T + q) of the context times the shorter context's probability,
renormalised over the symbols not seen in the longer one (full exclusion). The probabilities of each context sum to 1,
so a text's sum of bits is its exact code length; the language with the shortest code wins.

Texts are folded before both steps: ASCII capitals and two-byte Latin capitals become small, digits become 0. Trees of a
bounded number of contexts are tabled at once; with more languages, each batch of texts meets one table after another.
The score is the winner's share of two to the minus bits a byte, times eight roots of the length, as evidence grows less
than the text: neighbouring symbols are not independent.

Defined results: a null text, one without a letter, or no language learnt gives `und` with score 0. Ties go to the
language first by code point. Equal rows get equal results. Languages are those of labelled rows; an empty table has none.
Every text is scored whole, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_chunks, doc_hash, held, over_texts, table, text_buffer

#: Fitting: labelled documents of a language, and bytes of all languages, that are learnt from at most, about; drawn by a hash of their id.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 32 << 20
#: Contexts of three bytes, and languages, of a table; one language may have more.
CONTEXTS, LANGS = 65_536, 16
#: Bits a byte beyond which no learnt language explains a text.
MAX_BITS = 7.0
UND = "und"


def _fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[49:58] = 48
    out[[9, 11, 12, 13]] = 32
    return out


_FOLD = _fold_table()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _fold(raw: np.ndarray) -> np.ndarray:
    out = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        second = out[lead]
        out[lead] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    return out


def _grams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, the four bytes that end with it as one number; a row begins after three line feeds."""
    b = _fold(raw).astype(np.uint32)
    out = b.copy()
    starts, size = off[:-1], off[1:] - off[:-1]
    for k in (1, 2, 3):
        prev = np.full(len(b), 10, np.uint32)
        prev[k:] = b[:-k]
        for d in range(k):
            prev[starts[size > d] + d] = 10
        out |= prev << np.uint32(8 * k)
    return out


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each run of four folded bytes ends somewhere in the texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_buffer(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(langs)):
                parts = [raw[off[i] : off[i + 1]] for i in np.flatnonzero(langs == name)]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                gram, n = np.unique(_grams(np.concatenate(parts), ends), return_counts=True) if ends[-1] else (np.empty(0, np.uint32), np.empty(0, int))
                yield pa.record_batch([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Counts of four-grams by language, of a bounded sample: {"langs": [...], "grams": [...], "counts": [...], "lower": [...]}."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if train is None else train)).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # a row for each language, as in the model
    if not sizes:
        return {"langs": [], "grams": [], "counts": [], "lower": []}
    shares = [(r["lang"], int(min(1.0, sample_docs / r["n"], sample_bytes / len(sizes) / max(1, r["size"])) * (1 << 20))) for r in sizes]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, __share long"))
    drawn = known.join(share, "lang").filter(F.pmod(doc_hash(F.col("doc_id"), seed=11), F.lit(1 << 20)) < F.col("__share"))
    got = gram_counts(drawn, "text", "lang").toArrow()
    names, grams, counts = got["lang"].combine_chunks().dictionary_encode(), got["gram"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    which, kinds = names.indices.to_numpy(), names.dictionary.to_pylist()
    order = np.lexsort((grams, which))
    grams, counts, ends = grams[order], counts[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(kinds)))])
    out = {"langs": [], "grams": [], "counts": [], "lower": []}
    for k in sorted(range(len(kinds)), key=kinds.__getitem__):
        g, n = grams[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
        three, back = np.unique(g & np.uint32(0xFFFFFF), return_inverse=True)
        for name, x in (("langs", kinds[k]), ("grams", g), ("counts", n), ("lower", (three, np.bincount(back, n).astype(np.int64)))):
            out[name].append(x)
    return out


def tables(model: dict) -> list[slice]:
    """The languages of each table: as many as fit."""
    out, first, held_ = [], 0, 0
    for k, (three, _) in enumerate(model["lower"]):
        if k > first and (held_ + len(three) > CONTEXTS or k - first == LANGS):
            out.append(slice(first, k))
            first, held_ = k, 0
        held_ += len(three)
    return out + [slice(first, len(model["langs"]))] * bool(model["langs"])


class Coder:
    """The frozen costs of a fitted model as tables: bits of a symbol after its context, a column for each language."""

    def __init__(self, model: dict):
        self.langs, n_langs = model["langs"], len(model["langs"])
        threes = np.unique(np.concatenate([three for three, _ in model["lower"]]))
        fours = np.unique(np.concatenate(model["grams"]))
        contexts = np.unique(np.concatenate([threes, fours >> np.uint32(8)]))  # rows of the table of three bytes; as symbol-ends and as contexts
        # The row of three bytes through that of the first two, and of four through that of the first three; 0 for what is unknown.
        twos = np.unique(contexts >> np.uint32(8))
        self.row2 = np.zeros(1 << 16, np.int32)
        self.row2[twos] = np.arange(1, len(twos) + 1, dtype=np.int32)
        self.after2 = np.zeros((len(twos) + 1) * 256, np.int32)
        self.after2[self.row2[contexts >> np.uint32(8)] * 256 + (contexts & np.uint32(255))] = np.arange(1, len(contexts) + 1, dtype=np.int32)
        self.row4 = np.zeros((len(contexts) + 1) * 256, np.int32)
        self.row4[self.row3(fours >> np.uint32(8)).astype(np.int64) * 256 + (fours & np.uint32(255))] = np.arange(1, len(fours) + 1, dtype=np.int32)
        self.cost1 = np.zeros((1 << 16, n_langs), np.float32)
        self.escape2 = np.zeros((1 << 16, n_langs), np.float32)
        self.cost2 = np.zeros((len(contexts) + 1, n_langs), np.float32)
        self.escape3 = np.zeros((len(contexts) + 1, n_langs), np.float32)
        self.cost3 = np.zeros((len(fours) + 1, n_langs), np.float32)
        for k in range(n_langs):
            three, n3 = model["lower"][k]
            two, back = np.unique(three & np.uint32(0xFFFF), return_inverse=True)
            n2 = np.bincount(back, n3)
            n1 = np.bincount(two & np.uint32(255), n2, 256)
            total, kinds = n1.sum(), (n1 > 0).sum()
            p0 = np.where(n1 > 0, n1 / (total + kinds), kinds / (total + kinds) / max(1, 256 - kinds))
            p0 /= p0.sum()
            p1 = np.tile(p0, (256, 1))
            seen, escape = self._order(two >> np.uint32(8), n2, p0[two & np.uint32(255)], 256)
            p1 *= escape[:, None]
            p1[two >> np.uint32(8), two & np.uint32(255)] = seen
            p1 = p1.ravel()
            seen2, escape2 = self._order(three >> np.uint32(8), n3, p1[three & np.uint32(0xFFFF)], 1 << 16)
            p2 = np.concatenate([[1.0], escape2[contexts >> np.uint32(8)] * p1[contexts & np.uint32(0xFFFF)]])
            p2[self.row3(three)] = seen2
            four, n4 = model["grams"][k], model["counts"][k]
            seen3, escape3 = self._order(self.row3(four >> np.uint32(8)), n4, self._lower(p2, escape2, p1, four), len(contexts) + 1)
            p3 = np.concatenate([[1.0], escape3[self.row3(fours >> np.uint32(8))] * self._lower(p2, escape2, p1, fours)])
            p3[np.searchsorted(fours, four) + 1] = seen3
            for to, p in ((self.cost1, p1), (self.escape2, escape2), (self.cost2, p2), (self.escape3, escape3), (self.cost3, p3)):
                to[:, k] = -np.log2(np.maximum(p, 1e-30))

    def row3(self, three: np.ndarray) -> np.ndarray:
        return self.after2[self.row2[three >> np.uint32(8)] * 256 + (three & np.uint32(255))]

    def _lower(self, p2: np.ndarray, escape2: np.ndarray, p1: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each gram after the two bytes before it."""
        row = self.row3(grams & np.uint32(0xFFFFFF))
        return np.where(row > 0, p2[row], escape2[(grams >> np.uint32(8)) & np.uint32(0xFFFF)] * p1[grams & np.uint32(0xFFFF)])

    @staticmethod
    def _order(context: np.ndarray, n: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each seen symbol, factor of the shorter context's probability for the others, 1 in an unseen context)."""
        total, kinds, taken = np.bincount(context, n, size), np.bincount(context, minlength=size), np.bincount(context, shorter, size)
        rest = 1 - taken
        known = kinds > 0
        full = known & (rest < 1e-9)  # nothing is left to escape to
        escape = np.ones(size)
        open_ = known & ~full
        escape[open_] = kinds[open_] / (total[open_] + kinds[open_]) / rest[open_]
        escape[full] = 1e-9
        return n / np.where(full[context], total[context], total[context] + kinds[context]), escape

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each row in each language; off starts at 0."""
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)))
        for i, j in doc_chunks(off, 1 << 17):
            at = off[i : j + 1]
            if at[-1] == at[0]:
                continue
            gram = _grams(raw[at[0] : at[-1]], at - at[0])
            context = self.row3(gram >> np.uint32(8)).astype(np.int64)
            row = self.row4[context * 256 + (gram & np.uint32(255))]
            cost = self.cost3[row]
            miss = np.flatnonzero(row == 0)
            if len(miss):
                g = gram[miss]
                shorter = self.row3(g & np.uint32(0xFFFFFF))
                lower = np.where((shorter > 0)[:, None], self.cost2[shorter], self.escape2[(g >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost1[g & np.uint32(0xFFFF)])
                cost[miss] = self.escape3[context[miss]] + lower
            full = np.flatnonzero(at[1:] > at[:-1])
            out[i + full] = np.add.reduceat(cost, (at - at[0])[full], axis=0, dtype=np.float64)
        return out


def predict(texts: pa.Array, langs: list[str], coders: Iterable[Coder]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits a byte) of each text; coders have the languages in their order, one after another."""
    raw, off, valid = text_buffer(texts)
    n, score, rate = len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if not langs or not n:
        return [UND] * n, score, rate
    raw, off = raw[off[0] : off[-1]], off - off[0]
    size = off[1:] - off[:-1]
    letter = np.zeros(n, bool)
    for i, j in doc_chunks(off):
        full = i + np.flatnonzero(size[i:j])
        if len(full):
            letter[full] = np.logical_or.reduceat(_ASCII_LETTER[raw[off[i] : off[j]]], off[full] - off[i])
    for i in np.flatnonzero(valid & (size > 0) & ~letter):
        letter[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    mean = np.concatenate([c.bits(raw, off) for c in coders], axis=1) / np.maximum(size, 1)[:, None]
    best = mean.argmin(axis=1)
    rate = np.where(size > 0, mean.min(axis=1), 0.0)
    weight = np.exp2(-(mean - mean.min(axis=1, keepdims=True)) * 8 * np.sqrt(size)[:, None])
    score = np.where(letter, 1 / weight.sum(axis=1), 0.0)
    return [langs[b] if ok else UND for b, ok in zip(best, letter, strict=True)], score, rate


class _Ref:
    """A broadcast with the id that executors know it by."""

    def __init__(self, spark: SparkSession, model: dict):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = hash((id(model), len(model["langs"]), sum(map(len, model["grams"])), self.broadcast._jbroadcast.id()))

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> dict:
        return self.broadcast.value


def verdicts(docs: DataFrame, model: dict, keep: list[Column], *, text: str = "text", known_only: bool = False) -> DataFrame:
    """`__row`, a struct of the columns keep, with lang_pred, score and bits_per_byte; known_only: of documents that a learnt language explains."""
    ref = _Ref(docs.sparkSession, model)

    def table_of(part: slice) -> Coder:
        """The tables of some languages; those of the last are kept in the worker."""
        return held(("coder", ref.id, part.start), lambda: Coder({k: v[part] for k, v in ref.value.items()}))

    def of_texts(texts: pa.Array) -> tuple[list[pa.Array], pa.Array | None]:
        langs, score, rate = predict(texts, ref.value["langs"], map(table_of, tables(ref.value)))
        stay = pa.array([lang != UND and r <= MAX_BITS for lang, r in zip(langs, rate, strict=True)], pa.bool_()) if known_only else None
        return [pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], stay

    return over_texts(docs, text, keep, of_texts, "lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id counts as neither learnt from nor held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = verdicts(docs, fit(docs, train=~held_out()), [F.col("doc_id")])
    return found.select("__row.doc_id", "lang_pred", "score", "bits_per_byte").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that no learnt language explains: no letter, or a code of over MAX_BITS bits a byte."""
    model = fit(docs.select("doc_id", "text", "lang"), train=~held_out())
    return verdicts(docs, model, [F.col(f"`{c}`") for c in docs.columns], known_only=True).select("__row.*")
