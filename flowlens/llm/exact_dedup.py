"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import free_name, map_batches, stored, text_of, texts_utf8

COUNTERS = 1024  # Misra-Gries counters: any digest with more than 1/1024 of the rows is found


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased, nothing else changed."""
    def one(batch):
        found = [hashlib.sha256(t.lower()).digest() for t in texts_utf8(batch)]  # bytes.lower: A-Z only
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "digest"])
    t = text_of(docs, id_col, text_col)
    return map_batches(t, one, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, digest binary")


def merge_counters(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Misra-Gries reduction to at most ``k`` counters: subtract the (k+1)-th largest count from all."""
    if len(counts) <= k:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -(k + 1))[-(k + 1)])
    return {d: n - cut for d, n in counts.items() if n > cut}


def frequent(digest_rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` candidate digests, with every digest that has more than 1/k of all rows among them.

    Each partition keeps k counters.  A digest above 1/k of all rows is above
    1/k of some partition, so that partition's summary holds it; the sums of
    lower bounds of all partitions are cut to the k largest.  The undercount
    of a digest is at most rows/k in total, so the summaries use 4k counters
    to keep the order at the cut right.
    """
    def summary(batches):
        held: dict[bytes, int] = {}
        for b in batches:
            for c in b.column("digest").value_counts().to_pylist():
                held[c["values"]] = held.get(c["values"], 0) + c["counts"]
            held = merge_counters(held, 4 * k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "low"])
    return (digest_rows.select("digest").mapInArrow(summary, "digest binary, low long").where("low > 1")
            .groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(k).select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, uid, digest, keep_id, keep_uid, group_size, kept.

    Texts are equal when identical after lower-casing A-Z (null counts as
    empty).  Of equal texts the row with the largest id stays; a null id is
    the smallest, and of repeated rows with one id exactly one stays.

    Misra-Gries summaries name the digests that may be frequent, one counting
    pass verifies them (more than rows/k, hence fewer than k), and the
    verified winners are broadcast: their rows are settled map-side.  All
    other digests, none above rows/k, go through an ordinary shuffle: groups of
    two or more are found by an aggregate that combines before it and joined
    back to their rows, so that no task holds a group.  Empty input gives an empty result; other columns are not read.
    """
    rows = stored(digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "digests")
    n = rows.count()
    best = F.max(F.struct("doc_id", "uid"))
    winners = (rows.join(F.broadcast(frequent(rows, k)), "digest").groupBy("digest")
               .agg(best.alias("keep"), F.count("*").alias("group_size")).where(F.col("group_size") * k > n))
    winners = stored(winners, "winners")
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(best.alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    rest = rest.join(groups, "digest", "left").withColumns(
        {"keep": F.coalesce("keep", F.struct("doc_id", "uid")), "group_size": F.coalesce("group_size", F.lit(1))})
    return heavy.unionByName(rest).select(
        "doc_id", "uid", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"))


def with_digest(docs: DataFrame, text_col: str = "text", name: str = "__digest") -> DataFrame:
    """All columns and the digest of the normalised text under ``name``."""
    def one(batch):
        found = [hashlib.sha256((t or b"").lower()).digest() for t in texts_utf8(batch, text_col)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, name])
    return map_batches(docs, one, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns and no others.

    The pairs (id, digest) that stay are joined back to the documents; a pair
    belongs to one input row unless rows repeat.  Of repeated rows (same id,
    same text) one is picked by a map-side combined aggregate.
    """
    i, dg, n, own = (free_name(x, docs.columns) for x in ("__id", "__dg", "__rows", "__digest"))
    pairs = (exact_dedup(docs, id_col, text_col, k).groupBy("doc_id", "digest")
             .agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
             .select(F.col("doc_id").alias(i), F.col("digest").alias(dg), F.col("rows").alias(n)))
    d = with_digest(docs, text_col, own)
    hit = d.join(pairs, (F.col(own) == F.col(dg)) & F.col(f"`{id_col}`").eqNullSafe(F.col(i)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = hit.where(F.col(n) == 1).select(*cols)
    again = hit.where(F.col(n) > 1).groupBy(i, dg).agg(F.first(F.struct(*cols)).alias("one")).select("one.*")
    return once.unionByName(again)
