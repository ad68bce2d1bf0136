"""Sinks: parallel writes, never a single-file loop."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# SNK-1 -----------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# SNK-2 -----------------------------------------------------------------------
def write_spaced(df: DataFrame, path: str) -> None:
    """``", "``-separated text with a header line, written in parallel: one
    part file per partition, each with its header (Spark's CSV writer with a
    multi-character separator; nothing is funnelled through one task)."""
    df.write.mode("overwrite").option("header", True).option("sep", ", ").option("quote", "\u0000").csv(path)


# SNK-3 -----------------------------------------------------------------------
def class_map_json(cmap: DataFrame, name: str = "name", code: str = "code") -> DataFrame:
    """One-row ``{"class": code, ...}`` JSON text of a (small) class map."""
    return cmap.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col(code)))))).alias("json"))


def write_class_map(cmap: DataFrame, path: str) -> None:
    class_map_json(cmap).coalesce(1).write.mode("overwrite").text(path)


# SNK-4 -----------------------------------------------------------------------
def write_graph(nodes: DataFrame, edges: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    write_table(nodes, f"{path}/nodes", partition_by=partition_by if partition_by and all(c in nodes.columns for c in partition_by) else None)
    write_table(edges, f"{path}/edges", partition_by=partition_by if partition_by and all(c in edges.columns for c in partition_by) else None)


# SNK-5 / SNK-7 -----------------------------------------------------------------
def write_results(df: DataFrame, path: str, run_id: str, fmt: str = "json") -> None:
    """Append a result table with its run id (timestamped runs side by side)."""
    write_table(df.withColumn("run_id", F.lit(run_id)), path, fmt=fmt, mode="append")


# SNK-6 -------------------------------------------------------------------------
def save_transform(stats: DataFrame, path: str, meta: dict | None = None) -> None:
    """Fitted statistics (a small DataFrame) as parquet plus a JSON sidecar."""
    write_table(stats, f"{path}/stats")
    if meta is not None:
        stats.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")
