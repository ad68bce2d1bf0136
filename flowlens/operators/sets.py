"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import dense_index


# SET-1 -----------------------------------------------------------------------
def combine(dfs: list[DataFrame], order: list[str] | None = None, renumber: str | None = "flow_id",
            dense_inputs: bool = False) -> DataFrame:
    """Union by name (missing columns -> null) and re-number ``renumber``
    0..n-1 in (input order, ``order``) order, like a concat + reset.

    With ``dense_inputs`` (each part's ``renumber`` already runs 0..n_i-1) the
    new id is the old one plus the row count of the earlier parts: a tiny
    per-part count table instead of a global ranking."""
    parts = [d.withColumn("_part", F.lit(i)) for i, d in enumerate(dfs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if renumber and dense_inputs and not order:
        from pyspark.sql import Window
        cnt = out.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        off = cnt.select("_part", F.coalesce(F.sum("_n").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
        out = out.join(F.broadcast(off), "_part").withColumn(renumber, (F.col(renumber) + F.col("_off")).cast("bigint"))
        return out.drop("_part", "_off")
    if renumber:
        keys = ["_part"] + (order or [])
        if renumber in out.columns:
            out = out.withColumnRenamed(renumber, f"_{renumber}_old")
            if not order:
                keys = ["_part", f"_{renumber}_old"]
        out = dense_index(out, keys, renumber, drop=[f"_{renumber}_old"] if f"_{renumber}_old" in out.columns else None)
    return out.drop("_part")


# SET-3 -----------------------------------------------------------------------
def endpoints(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", name: str = "ip") -> DataFrame:
    return df.select(F.col(src).alias(name)).union(df.select(F.col(dst).alias(name))).distinct()


# SET-4 -----------------------------------------------------------------------
def set_tally(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """|a|, |b|, |a∩b|, |a−b|, |b−a| over distinct keys in one aggregation
    (a full outer join of the two key sets)."""
    x = a.select(F.col(key).alias("_k")).distinct().withColumn("_a", F.lit(1))
    y = b.select(F.col(key).alias("_k")).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, "_k", "full_outer")
    return j.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
                 F.count_if(F.col("_b").isNull()).alias("only_a"),
                 F.count_if(F.col("_a").isNull()).alias("only_b"))
