"""Documents as JSON text: typed projection and predicates that never coerce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput

_SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}


@dataclass(frozen=True)
class DocField:
    """A column of a collection: the document's id (path None) or the value at a dotted path, if it is of the type."""

    name: str
    path: str | None
    type: str = "str"


def _steps(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def variant(doc: Column) -> Column:
    return F.try_parse_json(doc)


def typed(doc: Column, path: str, kind: str) -> Column:
    """The value at a path of objects if it is exactly of the type, else null: 1 is no float, 1.0 no int, "1" neither."""
    if kind not in _SPARK:
        raise InvalidInput(f"no document type: {kind}")
    at = F.try_variant_get(variant(doc), _steps(path), "variant")
    shape = F.schema_of_variant(at)
    real = {"bool": shape == "BOOLEAN", "int": shape == "BIGINT", "float": shape.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "str": shape == "STRING"}[kind]
    if kind in ("int", "float"):  # whole numbers with a point are floats
        raw = F.get_json_object(doc, _steps(path))
        dotted = raw.rlike(r"[.eE]")
        real = (shape.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")) & (dotted if kind == "float" else ~dotted)
    return F.when(real, F.try_variant_get(variant(doc), _steps(path), _SPARK[kind]))


def project(docs: DataFrame, fields: list[DocField], *, id_col: str = "id", doc_col: str = "doc") -> DataFrame:
    return docs.select(*[(F.col(id_col) if f.path is None else typed(F.col(doc_col), f.path, f.type)).alias(f.name) for f in fields])


def _kind(value) -> str:
    kinds = {bool: "bool", int: "int", float: "float", str: "str"}
    if type(value) not in kinds:
        raise InvalidInput(f"no predicate on {type(value).__name__}")
    return kinds[type(value)]


def eq(doc: Column, path: str, value) -> Column:
    return F.coalesce(typed(doc, path, _kind(value)) == F.lit(value), F.lit(False))


def between(doc: Column, path: str, start, end) -> Column:
    """Values of the bounds' type in [start, end)."""
    if _kind(start) != _kind(end):
        raise InvalidInput("both ends must be of one type")
    v = typed(doc, path, _kind(start))
    return F.coalesce((v >= F.lit(start)) & (v < F.lit(end)), F.lit(False))


def find(docs: DataFrame, predicate: Column) -> DataFrame:
    return docs.filter(predicate)


def page(docs: DataFrame, offset: int, limit: int, *, id_col: str = "id") -> DataFrame:
    return docs.orderBy(id_col).offset(offset).limit(limit)
