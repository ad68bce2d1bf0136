"""Filters and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .encode import _attach_one_row
from .numbering import dense_index


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# FLT-1 -----------------------------------------------------------------------
def drop_incomplete(df: DataFrame) -> DataFrame:
    """±inf -> null in floating columns, then drop rows null anywhere in the
    numeric or text columns."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, fn.finite_or_null(f.name))
    return out.na.drop(subset=_numeric_cols(df) + _text_cols(df))


# FLT-3 -----------------------------------------------------------------------
def drop_placeholder(df: DataFrame, cols: tuple[str, ...] = ("src_ip", "dst_ip"),
                     placeholder: str = "0.0.0.0") -> DataFrame:
    cond = None
    for c in cols:
        e = F.col(c) != placeholder
        cond = e if cond is None else cond & e
    return df.filter(cond)


# FLT-4 -----------------------------------------------------------------------
def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column, nulls) in one pass: one ``count_if`` per column, unpivoted."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"))
                                          for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return long.filter(F.col("nulls") > 0) if only_positive else long


# FLT-5 -----------------------------------------------------------------------
def fit_median(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians (linear interpolation, nulls ignored), each
    from two order statistics found by distributed dense ranking, so no
    aggregation buffer holds all distinct values."""
    from .numbering import exact_quantile
    out = None
    for c in cols:
        q = exact_quantile(train, c, 0.5).select(F.col("quantile").alias(f"{c}__median"))
        out = q if out is None else _attach_one_row(out, q)
    return out


def impute_median(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    stats = fit_median(train, cols)

    def apply(d):
        j = _attach_one_row(d, stats)
        for c in cols:
            j = j.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"`{c}__median`")))
        return j.drop(*stats.columns)
    return apply(train), apply(test)


# FLT-6 -----------------------------------------------------------------------
def fit_mode(train: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value (ties: smallest value)."""
    g = train.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(f"{col}__mode"))


def impute_mode(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    modes = [fit_mode(train, c) for c in cols]

    def apply(d):
        j = d
        for c, m in zip(cols, modes):
            j = _attach_one_row(j, m).withColumn(c, F.coalesce(F.col(c), F.col(f"{c}__mode"))).drop(f"{c}__mode")
        return j
    return apply(train), apply(test)


# FLT-7 -----------------------------------------------------------------------
def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


# FLT-8 -----------------------------------------------------------------------
def prefix_mask(df: DataFrame, frac: float, order: list[str], out: str = "in_prefix") -> DataFrame:
    """True for the first int(frac * n) rows by ``order`` (a unique key)."""
    idx = dense_index(df, order, "_idx")
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(frac)).alias("_lim"))
    return _attach_one_row(idx, n).withColumn(out, F.col("_idx") < F.col("_lim")).drop("_idx", "_lim")


# FLT-9 -----------------------------------------------------------------------
def count_preserved(before: DataFrame, transform) -> tuple[DataFrame, Observation, Observation]:
    """Wrap a row-preserving step with two ``Observation`` counters that are
    filled by the same job that writes the result (no extra pass)."""
    ob, oa = Observation("before"), Observation("after")
    b = before.observe(ob, F.count(F.lit(1)).alias("rows"))
    a = transform(b).observe(oa, F.count(F.lit(1)).alias("rows"))
    return a, ob, oa


def assert_same_count(ob: Observation, oa: Observation) -> None:
    if ob.get["rows"] != oa.get["rows"]:
        raise AssertionError(f"row count changed: {ob.get['rows']} -> {oa.get['rows']}")
