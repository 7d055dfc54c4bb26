"""Declared schemas of tables, and the strict checks on rows that are written to them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidInput

#: The column types of tables, by name.
TYPES = {"null": T.NullType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bytes": T.BinaryType()}
_PYTHON = {"bool": bool, "int": int, "float": float, "str": str, "bytes": (bytes, bytearray)}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class TableSchema:
    """Columns and the name of the one that is the primary key, which is never null."""

    columns: tuple[Column, ...]
    primary_key: str

    def __post_init__(self) -> None:
        seen = [c.name for c in self.columns]
        if not seen or any(not n.strip() for n in seen) or len(set(seen)) != len(seen):
            raise InvalidInput("column names must be there, not blank, and differ")
        if self.primary_key not in seen:
            raise InvalidInput(f"the key {self.primary_key} is not a column")
        if bad := [c.type for c in self.columns if c.type not in TYPES]:
            raise InvalidInput(f"no column type: {bad[0]}")

    @staticmethod
    def of(primary_key: str, **columns: str) -> TableSchema:
        """TableSchema.of("id", id="int!", name="str"): a type with ! takes no nulls."""
        return TableSchema(tuple(Column(k, v.rstrip("!"), not v.endswith("!")) for k, v in columns.items()), primary_key)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], c.nullable and c.name != self.primary_key) for c in self.columns])

    def json(self) -> str:
        return json.dumps({"columns": [[c.name, c.type, c.nullable] for c in self.columns], "primary_key": self.primary_key})

    @staticmethod
    def from_json(text: str) -> TableSchema:
        x = json.loads(text)
        return TableSchema(tuple(Column(*c) for c in x["columns"]), x["primary_key"])

    def check(self, rows: list[tuple]) -> list[tuple]:
        """The rows, if every value has exactly the column's type (no int for a float), floats are finite and nulls allowed."""
        for row in rows:
            if len(row) != len(self.columns):
                raise InvalidInput(f"{len(row)} values for {len(self.columns)} columns")
            for c, v in zip(self.columns, row, strict=True):
                if v is None:
                    if not c.nullable or c.name == self.primary_key:
                        raise InvalidInput(f"{c.name} takes no nulls")
                elif c.type == "null" or not isinstance(v, _PYTHON[c.type]) or (c.type != "bool" and isinstance(v, bool)):
                    raise InvalidInput(f"{c.name} takes {c.type}, not {type(v).__name__}")
                elif c.type == "float" and not math.isfinite(v):
                    raise InvalidInput(f"{c.name} takes finite numbers")
        return rows

    def conform(self, df: DataFrame) -> DataFrame:
        """df with just these columns in this order, if the types are exactly these; a missing column is null."""
        types = dict(df.dtypes)
        for c in self.columns:
            if c.name in types and types[c.name] not in (TYPES[c.type].simpleString(), "void"):
                raise InvalidInput(f"{c.name} takes {c.type}, not {types[c.name]}")
        return df.select(*[(F.col(c.name) if c.name in types else F.lit(None)).cast(TYPES[c.type]).alias(c.name) for c in self.columns])

    def violations(self, df: DataFrame) -> DataFrame:
        """Rows of df that have a null where none may be, or a float that is not finite."""
        bad = F.lit(False)
        for c in self.columns:
            if not c.nullable or c.name == self.primary_key:
                bad = bad | F.col(c.name).isNull()
            if c.type == "float":
                bad = bad | F.isnan(c.name) | F.col(c.name).isin(math.inf, -math.inf)
        return df.filter(bad)
