"""Scalar functions as column expressions: time buckets, collations, quantised vectors, and the normal form of a statement."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput


def time_bucket(interval_ms: int, ts_ms: Column) -> Column:
    """The multiple of the interval at or below a time in milliseconds, also for times before 1970."""
    if interval_ms <= 0:
        raise InvalidInput("the interval must be positive")
    return ts_ms - F.pmod(ts_ms, F.lit(interval_ms).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key under which runs of digits compare as numbers: file2 before file10."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), width, "0"), digits(x))).otherwise(x)), "")


def collate(text: Column, collation: str) -> Column:
    """A sort key: binary, case_insensitive or numeric."""
    keys = {"binary": lambda c: c, "case_insensitive": F.lower, "numeric": natural_key}
    if collation not in keys:
        raise InvalidInput(f"no collation: {collation}")
    return keys[collation](text)


# ------------------------------------------------------------------ vectors

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "inner": inner_product}


def _round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def scalar_quantize(v: Column) -> Column:
    """Components as whole numbers from -127 to 127, scaled by the largest; zeros for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.when(top > 0, F.greatest(F.lit(-127), F.least(F.lit(127), _round_half_away(x.cast("double") / top * 127)))).otherwise(0).cast("int"))


def product_quantize(v: Column, segments: int) -> Column:
    """The mean of each segment times 16, rounded, from -127 to 127; segments of ceil(dim / segments) components."""
    if segments < 1:
        raise InvalidInput("at least one segment")
    width = F.ceil(F.size(v) / segments).cast("int")
    at = F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(s)
    return F.transform(at, lambda i: F.greatest(F.lit(-127), F.least(F.lit(127), _round_half_away(mean(F.slice(v, i * width + 1, width)) * 16))).cast("int"))


def quantized_length(dim: Column, kind: str, segments: int = 0) -> Column:
    """Bytes of a stored vector: none, scalar or product."""
    lengths = {"none": dim * 4, "scalar": dim, "product": F.lit(segments)}
    if kind not in lengths:
        raise InvalidInput(f"no quantisation: {kind}")
    return lengths[kind].cast("long")


@F.pandas_udf(T.BinaryType())
def vector_to_bytes(v: pd.Series) -> pd.Series:
    """Components as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", x)))


# ------------------------------------------------------------------ statements

_LITERAL = re.compile(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b")


def fingerprint(statement: str) -> str:
    """A statement without its literals, in small letters and single spaces, after its kind and the sorted tables it names."""
    flat = " ".join(_LITERAL.sub("?", statement).split()).rstrip("; ").lower()
    kind = flat.split(" ", 1)[0] if flat else ""
    tables = sorted(set(re.findall(r"\b(?:from|join|into|update)\s+([a-z_][\w.]*)", flat)))
    return f"{kind}|{','.join(tables)}|{flat}"


def register(spark: SparkSession) -> None:
    """The scalar functions under names that statements can use."""
    for text in (
        "CREATE OR REPLACE TEMPORARY FUNCTION time_bucket(i BIGINT, t BIGINT) RETURNS BIGINT RETURN IF(i > 0, t - pmod(t, i), raise_error('the interval must be positive'))",
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371000 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))",
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN 1 - vec_dot(a, b) / sqrt(vec_dot(a, a) * vec_dot(b, b))",
        "CREATE OR REPLACE TEMPORARY FUNCTION l2_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> pow(double(x) - double(y), 2)), 0D, (s, x) -> s + x))",
    ):
        spark.sql(text)
