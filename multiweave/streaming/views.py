"""Materialised aggregate views that are kept up by changes, with retractions.

State is two tables: the last counted version of each source row, and the groups' sums. A batch of changes is reduced to
the last change of each row; its old version is taken out of its group and the new one added, as signed rows whose sums
are joined to the groups. A group is gone when no row is left in it. The result equals the view recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput


@dataclass(frozen=True)
class View:
    """count(*), and sums and averages of numeric columns, by one column, of rows whose where-column equals a value."""

    name: str
    source: str
    key: str
    group_by: str
    aggregates: tuple[tuple[str, str | None], ...]  # ("count", None), ("sum", column), ("avg", column)
    where: tuple[str, object] | None = None

    def __post_init__(self) -> None:
        if not self.aggregates or any(k not in ("count", "sum", "avg") or (k != "count" and not c) for k, c in self.aggregates):
            raise InvalidInput("aggregates are count, sum and avg")

    def condition(self) -> Column:
        return F.lit(True) if self.where is None else F.coalesce(F.col(self.where[0]) == F.lit(self.where[1]), F.lit(False))

    def values(self) -> list[str]:
        return list(dict.fromkeys(c for _, c in self.aggregates if c))

    def state_columns(self) -> list[str]:
        return [self.group_by, "__rows", *[f"__sum_{c}" for c in self.values()]]


def _check(rows: DataFrame, view: View) -> DataFrame:
    for c in view.values():
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{view.name}: {c} is null")).cast("double")).otherwise(F.col(c).cast("double")))
    return rows


def _signed(rows: DataFrame, view: View, sign: int) -> DataFrame:
    return rows.select(view.group_by, F.lit(sign).alias("__rows"), *[(sign * F.col(c)).alias(f"__sum_{c}") for c in view.values()])


def initial(source: DataFrame, view: View) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of the state for a source as it stands."""
    rows = _check(source.filter(view.condition()).select(view.key, view.group_by, *view.values()), view)
    return rows, rows.groupBy(view.group_by).agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__sum_{c}") for c in view.values()])


def apply(rows: DataFrame, groups: DataFrame, changes: DataFrame, view: View) -> tuple[DataFrame, DataFrame]:
    """The state after changes (lsn, op, key and columns)."""
    cols = list(dict.fromkeys([view.group_by, *view.values(), *([view.where[0]] if view.where else [])]))
    last = changes.groupBy(view.key).agg(F.max_by(F.struct("op", *cols), "lsn").alias("v")).select(view.key, "v.op", *[f"v.{c}" for c in cols])
    new = _check(last.filter((F.col("op") != "delete") & view.condition()).select(view.key, view.group_by, *view.values()), view)
    old = rows.join(last.select(view.key), view.key, "left_semi")
    kept = rows.join(last.select(view.key), view.key, "left_anti")
    moved = groups.select(view.state_columns()).unionByName(_signed(old, view, -1)).unionByName(_signed(new, view, 1))
    summed = moved.groupBy(view.group_by).agg(F.sum("__rows").alias("__rows"), *[F.sum(f"__sum_{c}").alias(f"__sum_{c}") for c in view.values()])
    return kept.unionByName(new), summed.filter("__rows > 0")


def result(groups: DataFrame, view: View) -> DataFrame:
    """The view's rows: the group, then each aggregate."""
    out = [F.col(view.group_by)]
    for kind, c in view.aggregates:
        v = F.col("__rows").cast("long") if kind == "count" else F.col(f"__sum_{c}") if kind == "sum" else F.col(f"__sum_{c}") / F.col("__rows")
        out.append(v.alias("count" if kind == "count" else f"{kind}_{c}"))
    return groups.select(*out)


def recompute(source: DataFrame, view: View) -> DataFrame:
    return result(initial(source, view)[1], view)
