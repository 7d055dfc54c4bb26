"""Rules on rows and columns: which rows a principal sees, what is masked, and what may be written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LimitExceeded

MAX_BYTES, MAX_BATCH = 1 << 20, 1024


@dataclass(frozen=True)
class RowPolicy:
    """Rows of a resource whose column equals a value, or the name of whoever reads (equals None)."""

    resource: str
    column: str
    equals: object = None


@dataclass(frozen=True)
class Mask:
    resource: str
    column: str
    replacement: str = "***"


@dataclass
class Policies:
    rows: list[RowPolicy] = field(default_factory=list)
    masks: list[Mask] = field(default_factory=list)

    def secure(self, df: DataFrame, resource: str, principal: str | None) -> DataFrame:
        """df as the principal sees it: rows that any row policy of the resource admits (all, if it has none), masked."""
        own = [p for p in self.rows if p.resource == resource]
        if own:
            seen: Column = F.lit(False)
            for p in own:
                want = principal if p.equals is None else p.equals
                seen = seen | F.coalesce(F.col(p.column) == F.lit(want), F.lit(False))
            df = df.filter(seen)
        for m in self.masks:
            if m.resource == resource and m.column in df.columns:
                df = df.withColumn(m.column, F.lit(m.replacement).cast(dict(df.dtypes)[m.column]) if dict(df.dtypes)[m.column] == "string" else F.lit(None).cast(dict(df.dtypes)[m.column]))
        return df


def rejects(docs: DataFrame, *, required: list[str] = (), doc_col: str = "doc", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs that lack a required path or are too large, with the reason."""
    reason = F.when(F.octet_length(doc_col) > max_bytes, F.lit("too large"))
    for path in required:
        steps = "$" + "".join(f"['{p}']" for p in path.split("."))
        reason = reason.when(F.get_json_object(doc_col, steps).isNull(), F.lit(f"no {path}"))
    return docs.withColumn("reason", reason).filter("reason is not null")


def check_batch(n: int, most: int = MAX_BATCH) -> None:
    if n > most:
        raise LimitExceeded(f"{n} operations in a batch; at most {most}")


@dataclass(frozen=True)
class Hook:
    """A check before a commit: `empty` rejects null or empty values, `object` asks for a JSON object, `max_bytes` and `prefix` take an argument."""

    name: str
    kind: str
    argument: object = None

    def violates(self, key: Column, value: Column) -> Column:
        rules = {
            "empty": lambda: value.isNull() | (value == ""),
            "object": lambda: ~F.coalesce(F.try_parse_json(value).isNotNull() & value.rlike(r"^\s*\{"), F.lit(False)),
            "max_bytes": lambda: F.octet_length(value) > F.lit(self.argument),
            "prefix": lambda: key.cast("string").startswith(str(self.argument)),
        }
        return F.coalesce(rules[self.kind](), F.lit(False))
