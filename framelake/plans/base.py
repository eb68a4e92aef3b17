"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
WHOLE = ("tinyint", "smallint", "int", "bigint")


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under a name; results are cast to bigint, or rounded to 6 places."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Whole numbers as bigint, other numbers as double rounded to ``places`` (no negative zero)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in WHOLE:
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)
