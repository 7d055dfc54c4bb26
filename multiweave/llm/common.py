"""What the operators of this subpackage share: the shared folder, and bytes of texts as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without the setting gets a temporary folder; on a cluster such a folder would be of
    one machine, and the lack of the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="multiweave-"))
    return sc.getCheckpointDir()


#: Rows to a file of a small table that is cut.
FILE_ROWS = 10_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, computed now and kept in the shared folder, so that lost executors cost no recomputation.

    rows: about how many there are, where the last step to them is light; a small table then gets few files. Spark
    removes the files when no plan refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    checkpoint_dir(df.sparkSession)
    out = (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).checkpoint(eager=True)
    trim(df.sparkSession)
    return out


#: What is broadcast after its size was measured is at most so large; beyond, rows meet it in so many parts of each key.
BROADCAST_BYTES, SALTS = 16 << 20, 64


def join_few(rows: DataFrame, few: DataFrame, on: list[str], width: Column, salt: Column) -> DataFrame:
    """rows joined with few, a small number of rows for each key of rows, which may be hot. width: bytes of a row of few; few is evaluated more than once."""
    if (few.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), on)
    every = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(every, [*on, "__salt"]).drop("__salt")


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints that no plan refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Returns the native memory that the driver's JVM and Python have freed to the system; whether the JVM can.

    Compilers and the threads of Spark's pools, some hundreds, each leave free memory in the C library's arenas, which
    keep it else. The JVM's diagnostic command for it is reached by reflection, as the server's class is not public.
    """
    give_back()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            out[k] = item
        return out

    of = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
    asked = array(jvm.java.lang.Object, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    try:
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JJavaError:  # another JVM, or another C library
        return False
    return True


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_hash(*cols: Column, seed: int = 0) -> Column:
    """A seeded 64-bit hash, the same on every run and partitioning."""
    return F.xxhash64(F.lit(seed), *cols)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of fewer rows for plans that are run inside, so that Python workers hold less at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lasting_small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's Arrow batches to `rows`, for plans that run after the function that made them has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Returns the memory that a Python worker and Arrow's pool have freed to the system; idle workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict = {}


def held(key: object, make):
    """What make() gives, kept in this Python worker until another is asked for: workers serve one stage after another."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what held() keeps, in workers that come to another kind of step."""
    if _held:
        _held.clear()
        give_back()


def with_rows(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows of docs as one column `__row`, so that no name clashes with theirs, beside the named columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(k) for k, c in named.items()])


def over_texts(docs: DataFrame, text: str, keep: list[Column], of_texts: Callable[[pa.Array], tuple[list[pa.Array], pa.Array | None]], schema: str, rows: int = 1000) -> DataFrame:
    """`__row`, a struct of the columns keep, beside what of_texts gives of the texts: arrays by schema, and which rows stay (None: all).

    Texts come from the struct if it has them, so that they are sent once; blocks of `rows` bound what a worker holds.
    All steps of this subpackage run Python this way, as workers of one kind serve them all. As the plan runs later, the
    session's Arrow batches are lowered for good.
    """
    lasting_small_batches(docs.sparkSession)
    row = docs.select(F.struct(*keep).alias("__row"))
    inside = text in row.schema["__row"].dataType.names
    at = row.schema["__row"].dataType.names.index(text) if inside else None
    source = row if inside else docs.select(F.struct(*keep).alias("__row"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                own = batch.slice(i, rows)
                arrays, stay = of_texts(own.column(0).field(at) if inside else own.column(1))
                out = pa.RecordBatch.from_arrays([own.column(0), *arrays], names=["__row", *names])
                yield out if stay is None else out.filter(stay)
            give_back()

    more = T._parse_datatype_string(schema)
    names = more.names
    return source.mapInArrow(run, T.StructType([row.schema["__row"], *more.fields]))


# ------------------------------------------------------------------ texts as bytes

def text_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; row i has bytes[offsets[i]:offsets[i + 1]], a null has none."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    n = len(arr)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off, arr.is_valid().to_numpy(zero_copy_only=False)


def doc_chunks(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about `most` bytes each; a longer row is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_set(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Words are runs of bytes other than ASCII white space.
NOT_SPACE = byte_set(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_set(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words in buf; off starts at 0 and ends at len(buf); words do not cross rows."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    word = inside[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, word[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, word[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_counts(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Words of each row."""
    n = len(off) - 1
    out = np.zeros(n, np.int64)
    for i, j in doc_chunks(off):
        at = off[i : j + 1]
        starts, _, row = word_spans(buf[at[0] : at[-1]], at - at[0], inside)
        out[i:j] = np.bincount(row, minlength=j - i)
    return out


_PRIME, _powers = np.uint64(0x9E3779B97F4A7C55), [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_PRIME ** i and its inverse, modulo 2**64, for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        base, inverse = int(_PRIME), pow(int(_PRIME), -1, 1 << 64)
        for k, b in enumerate((base, inverse)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubling: out[done:2*done] = out[:done] * b**done
                out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and length alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers_to(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """ASCII capitals and capitals of two bytes that begin with C3 (Latin-1) made small."""
    out = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        second = raw[lead]
        out[lead] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + np.uint8(0x20), second)
    return out


# ------------------------------------------------------------------ graphs

#: A node is a hub if it has this share of the edges; there are so few of them that what is looked up for them is broadcast.
HUB = 1 / 256


def at_nodes(edges: DataFrame, key: str, nodes: DataFrame, least_hub: float) -> DataFrame:
    """edges joined with nodes (node, m, degree) where key is the node. Hubs, of degree over least_hub, meet a broadcast: their edges stay where they are."""
    named = nodes.select(F.col("node").alias(key), "m", "degree")
    hubs = F.broadcast(named.filter(F.col("degree") > least_hub).select(key, F.col("m").alias("__m")))
    seen = edges.join(hubs, key, "left")
    others = named.filter(F.col("degree") <= least_hub).select(key, "m")
    return seen.filter(F.col("__m").isNotNull()).withColumnRenamed("__m", "m").unionByName(seen.filter(F.col("__m").isNull()).drop("__m").join(others, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the undirected edges (a, b): component is the smallest node of its part.

    Alternating large-star and small-star rounds, each cut in the shared folder. Nodes of many edges do not gather them in
    one task. Nulls and loops are left out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    state, n = None, now.count()
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, hub = seen, max(64.0, 2 * HUB * seen[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("m"), F.count("*").alias("degree"))
        large = at_nodes(now, "v", least, hub).select("u", F.col("m").alias("v")).distinct()
        below = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = at_nodes(large, "u", below, hub).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(below.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct(), n)
        del both, least, large, below, small
        tidy(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
