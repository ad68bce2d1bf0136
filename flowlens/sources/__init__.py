"""Scans.  All reads are lazy Spark scans with an
explicit schema where one is known; files are split across tasks by Spark,
so the reference's chunk loops need no counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# SRC-1 / SRC-2 / SRC-6 / SRC-9 -------------------------------------------------
def read_flows(spark: SparkSession, path, schema: T.StructType | str | None = None, fmt: str = "csv",
               trim: bool = True, limit: int | None = None, order: list[str] | None = None,
               encoding: str | None = None, sep: str = ",") -> DataFrame:
    """CSV (header) or parquet flows.  ``trim`` strips blanks after the
    delimiter and in header names; ``limit`` keeps the first n rows in
    ``order`` (deterministic bounded scan)."""
    if fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        r = spark.read.option("header", True).option("sep", sep)
        if trim:
            r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        if encoding:
            r = r.option("encoding", encoding)
        if schema is not None:
            r = r.schema(schema)
        else:
            r = r.option("inferSchema", True)
        df = r.csv(path)
        if trim:
            df = df.toDF(*[c.strip() for c in df.columns])
    if limit is not None:
        if not order:
            raise ValueError("a bounded scan needs an order, else its rows are arbitrary")
        df = df.orderBy(*order).limit(limit)
    return df


# SRC-3 ---------------------------------------------------------------------------
def read_named(spark: SparkSession, path, names: list[str], types: dict[str, str] | None = None,
               encoding: str | None = None) -> DataFrame:
    """Headerless text (plain or .gz) with supplied column names."""
    types = types or {}
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(types.get(n, "string")), True) for n in names])
    r = spark.read.option("header", False).schema(schema)
    if encoding:
        r = r.option("encoding", encoding)
    return r.csv(path)


# SRC-4 ---------------------------------------------------------------------------
def read_with_dictionary(spark: SparkSession, paths: list[str], dict_path: str, name_col: int = 0,
                         encoding: str | None = None) -> DataFrame:
    """Several headerless files whose column names come from a side
    dictionary file (one name per row, first field), lower-cased and with
    blanks removed."""
    d = spark.read.option("header", True).csv(dict_path)
    names = [str(r[name_col]).strip().lower().replace(" ", "") for r in d.collect()]   # a few dozen names
    r = spark.read.option("header", False)
    if encoding:
        r = r.option("encoding", encoding)
    df = r.csv(paths)
    if len(names) != len(df.columns):
        raise ValueError(f"the dictionary names {len(names)} columns, the files have {len(df.columns)}")
    return df.toDF(*names)


# SRC-5 ---------------------------------------------------------------------------
def sniff_sep(spark: SparkSession, path: str, candidates=(",", ";")) -> str:
    """Choose the delimiter from the header line: fall back to ';' when a
    comma split gives a single column."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    for c in candidates:
        if len(line.split(c)) > 1:
            return c
    return candidates[0]


# SRC-8 ---------------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def resolve_sources(spark: SparkSession, base: str, names: list[str], reduced: bool = True,
                    patterns=("{base}/{name}_reduced_standardized.{ext}", "{base}/{name}_reduced.{ext}",
                              "{base}/{name}_standardized.{ext}"), ext: str = "csv") -> dict[str, str]:
    """First existing file per source along the fallback list."""
    out = {}
    for n in names:
        pats = patterns if reduced else patterns[2:]
        for p in pats:
            cand = p.format(base=base, name=n, ext=ext)
            if path_exists(spark, cand):
                out[n] = cand
                break
    return out


# SRC-10 --------------------------------------------------------------------------
def require_columns(df: DataFrame, cols: list[str], mode: str = "raise") -> list[str]:
    missing = [c for c in cols if c not in df.columns]
    if missing and mode == "raise":
        raise ValueError(f"missing required columns: {missing}")
    return missing


# SRC-11 --------------------------------------------------------------------------
def select_core(df: DataFrame, cols: list[str]) -> DataFrame:
    """Prune to the needed columns (Catalyst pushes this into the scan)."""
    return df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])
