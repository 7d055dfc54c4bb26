"""Every registered query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import views
from . import domain, facade  # noqa: F401  the facade's queries are registered with the domain's
from .relational import SQL


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


#: A query of relational.SQL that domain.py has too is built there, by operators; its SQL stays what checks it.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql(s if isinstance(s, str) else s[0]) for name, s in SQL.items()} | domain.QUERIES
ORACLE: dict[str, str] = {name: s if isinstance(s, str) else s[1] for name, s in SQL.items()} | domain.ORACLE
