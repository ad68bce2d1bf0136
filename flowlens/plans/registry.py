"""Registry of the checked queries: one Spark builder and (when the result is
SQL-expressible) one DuckDB oracle text per operator of SURVEY §2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_quickly(c: Column, digits: int) -> Column:
    """``F.round`` of a double, which goes through decimal text, only where the scaled value lies near a half or is not of
    ordinary size; elsewhere the nearest integer, divided once, is the same double."""
    scale = F.lit(float(10 ** digits))
    x = c * scale
    plain = (x >= 1) & (x < 1e12) & (F.abs(x - F.floor(x) - 0.5) > 1e-3)
    return F.when(plain, F.floor(x + 0.5) / scale).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6, many: bool = False) -> DataFrame:
    """Round every double column so value hashes agree across engines; ``many``: the same values, quicker for very many rows."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            r = F.round(c, digits)
            cols.append((round_quickly(c, digits) if many and isinstance(f.dataType, T.DoubleType) else r).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
