"""Structured Streaming re-aims of the reference's chunk loops (STR-*).

Files arriving in a folder are processed incrementally with
``trigger(availableNow=True)``; state (class counts) lives in the streaming
aggregation's state store and the checkpoint, so a restarted or failed
query resumes exactly once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_unit
from ..session import ensure_checkpoint_dir
from ..sources import path_exists


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")


# STR-1 -----------------------------------------------------------------------
def stream_standardize(spark: SparkSession, in_dir: str, out_dir: str, schema, adapter, fmt: str = "parquet",
                       checkpoint: str | None = None):
    """Stateless standardize of every new file, appended to ``out_dir``."""
    src = spark.readStream.schema(schema).format(fmt).load(in_dir)
    q = (adapter(src).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint or _ckpt(spark, "std"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


# STR-2 -----------------------------------------------------------------------
def stream_class_counts(spark: SparkSession, stream: DataFrame, col: str, out_dir: str | None = None,
                        checkpoint: str | None = None) -> DataFrame:
    """Class counts kept in streaming state over all files seen (update mode); equals the batch class distribution.

    Every micro-batch writes the classes it changed, with their new counts, to
    a folder of its own below ``out_dir`` (``version=<batch id>``), overwriting
    what an earlier attempt at the same batch may have left, so a restart from
    ``checkpoint`` changes nothing.  The result is each class's newest version;
    no count passes through the driver.  Without input it is empty."""
    base = checkpoint or _ckpt(spark, "counts")
    out_dir = out_dir or f"{base}-versions"
    counts = stream.groupBy(col).agg(F.count(F.lit(1)).alias("count"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/version={batch_id}")

    q = counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", base).trigger(availableNow=True).start()
    q.awaitTermination()
    if not path_exists(spark, out_dir):
        return spark.createDataFrame([], counts.schema)
    versions = spark.read.schema(counts.schema.add("version", "long")).parquet(out_dir)
    return versions.groupBy(col).agg(F.max_by("count", "version").alias("count"))


# STR-3 -----------------------------------------------------------------------
def stream_reduce(spark: SparkSession, stream: DataFrame, rates: DataFrame, col: str, key: str, out_dir: str,
                  seed: int = 42, checkpoint: str | None = None) -> DataFrame:
    """Per-file sampling with globally fitted rates: a stream-static join of
    the (small) rate table and an order-free hash threshold u < rate."""
    s = stream.join(F.broadcast(rates.select(col, "rate")), col, "left") \
              .filter(hash_unit(F.col(key), seed) < F.coalesce(F.col("rate"), F.lit(1.0))).drop("rate")
    q = (s.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint or _ckpt(spark, "reduce"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
