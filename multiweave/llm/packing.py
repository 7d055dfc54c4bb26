"""Best-fit packing of tokenised documents, certified by bounds, with exchange between partitions.

Documents become runs of token ids; a run longer than the capacity is cut into full pieces and a rest. Full pieces are
sequences of their own. The rest are dealt evenly to groups of bounded size by a hash of their row; each group is packed
by best-fit decreasing, and a lower bound from dual feasible functions (rounding by a threshold, and the family
u(k) of k-fold rounding) certifies how many sequences its pieces need at least. Where a group uses more than its bound,
the pieces of its loose sequences, and everywhere those of the emptiest sequence, are exchanged: pooled over all groups,
dealt anew and packed again, until the total meets the bound of all pieces together or the rounds are used up.

Defined results: a null text is an empty one, and each document has at least its end id, so every row gives a piece.
Repeated rows are packed each. An empty table gives no rows. doc_id may be null.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, doc_hash, give_back, held, small_batches, table

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Pieces dealt to a group; rounds of exchange.
GROUP, ROUNDS = 4096, 2
#: Bytes, about, of the words and parts of words whose ids a worker remembers; longer words than this are encoded each time.
REMEMBERED, LONG = 80 << 20, 256
#: What an entry takes beside its word and ids.
ENTRY = 180
#: str.split() parts words here, the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of characters that the tokenizer's normaliser changes one by one; small, the pattern below has the parts it encodes by themselves.
SIMPLE = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+").fullmatch
#: The characters that stand for bytes other than printable ones in the vocabulary.
BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u024f0-9]+").findall


class Memory:
    """Ids by word or part, of a bounded number of bytes: beyond it the newer half goes, as frequent words come early."""

    def __init__(self):
        self.of: dict[str, bytes] = {}
        self.held = 0

    def __iter__(self) -> Iterator[str]:
        return iter(self.of)

    def add(self, key: str, ids: bytes) -> bytes:
        """Remembers a word that is not there yet."""
        self.of[key] = ids
        self.held += ENTRY + len(key) + len(ids)
        return ids

    def shrink(self) -> None:
        if self.held > REMEMBERED:
            for _ in range(len(self.of) // 2):
                x, ids = self.of.popitem()
                self.held -= ENTRY + len(x) + len(ids)


class Encoder:
    """Ids of whole texts.

    The tokenizer drops white space and never looks across it, so each word is encoded once and remembered. Words of
    plain Latin characters are taken apart further, by the tokenizer's own pattern, and the parts remembered too: a part
    is a word with the same ids, as the pattern takes it whole wherever it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Memory()
        self.merge = self.tokenizer.model.tokenize  # what is left to do for a part that is normal already

    def _encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for i in range(0, len(texts), 5000):
            own = texts[i : i + 5000]
            for x, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                yield x, array("I", e.ids).tobytes()

    def _part(self, x: str) -> bytes:
        return array("I", [t.id for t in self.merge(x if x.isascii() else x.encode().decode("latin-1").translate(BYTES))]).tobytes()

    def _learn(self, words: list[str]) -> None:
        known, of, others = self.known, self.known.of, []
        for w in words:
            if w in of:  # as a part of one before
                continue
            if not SIMPLE(w) or "<|" in w:
                others.append(w)
                continue
            own = PARTS(w.lower())
            if len(own) == 1:
                known.add(w, of.get(own[0]) or self._part(own[0]))
            else:
                known.add(w, b"".join([of.get(x) or known.add(x, self._part(x)) for x in own]))
        for w, ids in self._encode(others):
            known.add(w, ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in SEPARATORS):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split()
        return b"".join([self._some(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]) if len(words) > 50_000 else self._some(words)

    def _some(self, words: list[str]) -> bytes:
        """Ids of words that the memory surely holds together."""
        of = self.known.of
        self.known.shrink()
        if new := set(words).difference(of):
            long = {w: ids for w, ids in self._encode([w for w in new if len(w) > LONG])}
            self._learn([w for w in new if w not in long] if long else new)
            if long:
                return b"".join([of[w] if w in of else long[w] for w in words])
        return b"".join(map(of.__getitem__, words))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; an absolute path is its own place."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def pieces(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the runs of at most `capacity` ids of each document."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        code, end = held(("encoder", path), lambda: Encoder(path)), array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.ids(text_.as_py() or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    own = ids[4 * at : 4 * (at + capacity)]
                    out.append((key, k, at, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item by best-fit decreasing: the fullest bin that still holds it; ties to the one opened last."""
    where = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    room, n = 0, 0  # bit r of room: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = room >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                room &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        where[i] = b
        if r > size:
            free[r - size].append(b)
            room |= 1 << (r - size)
    return where


def bin_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that items of these lengths need at least, by dual feasible functions."""
    if not len(lengths):
        return 0
    order = np.argsort(lengths)
    x, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    size, number = np.concatenate([[0], np.cumsum(x * n)]), np.concatenate([[0], np.cumsum(n)])
    best = -(-size[-1] // capacity)
    small = np.unique(np.concatenate([[0], x[x <= capacity // 2], (capacity - x[x > capacity // 2] + 1)]))
    small = small[small <= capacity // 2]
    lo, hi = np.searchsorted(x, small, "left"), np.searchsorted(x, capacity - small, "right")
    best = max(best, int((-(-((number[-1] - number[hi]) * capacity + size[hi] - size[lo]) // capacity)).max()))
    for k in range(1, 33):  # u(k): (k + 1) x / c if that is whole, else its floor over k
        whole = (k + 1) * x % capacity == 0
        weight = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((weight * n).sum()) // (k * capacity)))
    return int(best)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"


def _pack_groups(items: DataFrame, groups: int, capacity: int, first_id: int, seed: int) -> DataFrame:
    """items dealt to `groups` groups and packed. loose: the piece's sequence is worth opening again."""
    dealt = items.withColumn("group", F.pmod(doc_hash(F.monotonically_increasing_id(), seed=seed), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        lengths = t["length"].to_numpy()
        where = best_fit(lengths, capacity)
        fill = np.bincount(where, lengths)
        gap = len(fill) > bin_bound(*np.unique(lengths, return_counts=True), capacity)
        loose = (fill < capacity * 0.995) & gap
        loose[fill.argmin()] = fill.min() < capacity
        order = np.lexsort((-lengths, where))
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]])
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - before[first][where[order]]
        group = int(t["group"][0].as_py())
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(first_id + group * (1 << 20) + where)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose[where]))

    return dealt.groupBy("group").applyInArrow(run, _PLACED)


def pack(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Each piece with its sequence and its place there, and least_sequences, the bound of all pieces together: no packing has fewer."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    with small_batches(docs.sparkSession):
        every = cut(pieces(docs, text=text, doc_id=doc_id, tokenizer=tokenizer, capacity=capacity, end_id=end_id))
    full = every.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(cols)
    rest = every.filter(F.col("length") < capacity)
    sizes = every.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most a row for each length
    certified = lambda out: out.withColumn("least_sequences", F.lit(bin_bound(whole["length"].to_numpy(), whole["n"].to_numpy(), capacity)).cast("long"))
    whole, sizes = sizes, sizes[sizes.length < capacity]
    if sizes.empty:
        return certified(full)
    bound = bin_bound(sizes["length"].to_numpy(), sizes["n"].to_numpy(), capacity)
    n, first_id, done = int(sizes["n"].sum()), 0, []
    for k in range(rounds + 1):
        groups = -(-n // group)
        placed = cut(_pack_groups(rest, groups, capacity, first_id, seed=k))
        first_id += groups << 20
        if k == rounds or groups == 1:
            done.append(placed)
            break
        done.append(placed.filter(~F.col("loose")))
        rest = placed.filter("loose")
        n = rest.count()
        if n == 0 or sum(d.filter(F.col("offset") == 0).count() for d in done) + rest.filter(F.col("offset") == 0).count() <= bound:
            done.append(rest)
            break
        rest = rest.drop("sequence_id", "offset", "loose")
    out = full
    for d in done:
        out = out.unionByName(d.select(cols))
    return certified(out)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
