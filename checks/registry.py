"""The table of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Register a query; without `sql` it is checked by rows only."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, **ctes)
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Plain column types, doubles to six digits as the other engine rounds (adding zero turns -0.0 into 0.0)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            scale = 10.0 ** DIGITS
            c = F.round(c.cast("double") * scale, 0) / scale + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)
