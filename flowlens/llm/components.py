"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest in star form: (node, smallest node of its part) for every node but the smallest."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a):]
    root = np.arange(len(nodes))
    while True:
        m = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], m)
        np.minimum.at(root, root[y], m)
        np.minimum.at(root, x, m)
        np.minimum.at(root, y, m)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contract(links: DataFrame, rows: int = 500_000) -> DataFrame:
    """Replace the links of each slice of a partition by a spanning forest; keeps components, never adds links."""
    def run(batches):
        held, n = [], 0

        def out():
            t = pa.concat_tables(held)
            v, w = local_forest(t.column("a").to_numpy(), t.column("b").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(w, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                n += batch.num_rows
            if n >= rows:
                yield out()
                held, n = [], 0
        if held:
            yield out()
    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long), component = smallest node reachable.

    Large-star and small-star rounds (each node's larger, then smaller,
    neighbours move to the smallest one) until the links stop changing; the
    number of links never grows.  No side of a join is broadcast: links on disk
    are a fraction of their size in memory.  Minima are taken by a map-side combined
    aggregate and joined back, so a hub is never gathered in one task.  An
    empty table gives an empty result; self links are ignored.
    """
    links = stored(contract(links.where("a <> b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low2.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        links = stored(small, "links")
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
