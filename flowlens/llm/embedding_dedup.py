"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import map_batches, sorted_groups, stored
from .components import components, local_forest

MIN_COSINE = 0.93
SAMPLE = 4096  # bounded sample that fits the index, at least (four vectors a pivot above that); every vector is indexed
PIVOTS, MAX_PIVOTS = 256, 4096  # of it, far from each other, so that a dense group does not use them up: the root of the number of rows, within these
APART = 0.8  # no two reference points have a larger cosine: vectors near each other share theirs
PREFIX = 10  # nearest pivots that describe a vector, at 256 pivots; one more for each doubling
SHARED = 4  # pivots of their prefixes that a candidate pair has in common, at least
MAX_LENGTHS = 64  # each length of vectors has reference points of its own; more lengths are an error
BLOCK = 4096  # longer lists are compared as tiles of blocks
KEYS = ["label", "dim", "list", "ti", "tj"]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.array([np.nan if x is None else x for x in v], float) if v is not None else np.empty(0) for v in column.to_pylist()]


def described(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec, digest): digest null unless the vector can link (label, no null, finite, not zero)."""
    def one(batch):
        digests = []
        for v, label in zip(_matrix(batch.column("vec")), batch.column("label").to_pylist(), strict=True):
            ok = label is not None and len(v) and np.isfinite(v).all() and (v != 0).any() and np.isfinite(np.linalg.norm(v)) and np.linalg.norm(v) > 0
            digests.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["vec_id", "label", "vec", "digest"])
    kind = vectors.schema[vec_col].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.col(f"`{vec_col}`").cast(kind).alias("vec"))
    return map_batches(v, one, f"vec_id long, label long, vec {kind}, digest binary")


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Reference points: each next one is the unit vector of the sample farthest from those before, while one is APART."""
    if not len(sample):
        return sample
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        at = int(np.argmin(best))
        if best[at] > APART:
            break
        chosen.append(at)
        best = np.maximum(best, sample @ sample[at])
    return sample[chosen]


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def pivots_for(rows: int, least: int) -> int:
    """The root of the number of rows as a power of two, so that lists grow no faster than it."""
    return max(least, min(MAX_PIVOTS, 1 << max(0, int(np.ceil(np.log2(max(rows, 1)) / 2)))))


def prefix_for(pivots: int, prefix: int) -> int:
    return min(pivots, prefix + max(0, int(np.ceil(np.log2(max(pivots, 1) / PIVOTS)))))


def of_one_length(t: pa.Table):
    """The parts of a table, sorted by label and dim, that hold vectors of one length, in order."""
    dim = t.column("dim").to_numpy()
    cut = [0, *(np.flatnonzero(np.diff(dim)) + 1).tolist(), t.num_rows]
    yield from (t.slice(s, e - s) for s, e in zip(cut, cut[1:], strict=False))


def tiles(batches):
    """(table, prefixes, [(list, rows, other rows, whether they are the same rows)]) of whole tiles of the inverted lists."""
    for t in (part for g in sorted_groups(batches, KEYS, rows=8192) for part in of_one_length(g)):
        cols = {k: t.column(k).to_numpy() for k in (*KEYS, "blk")}
        pre = t.column("prefix").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in KEYS], axis=0)
        start = np.flatnonzero(new)
        end = np.append(start[1:], t.num_rows)
        found = []
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if cols["ti"][s] == cols["tj"][s]:
                found.append((cols["list"][s], np.arange(s, e), np.arange(s, e), True))
            else:
                found.append((cols["list"][s], s + np.flatnonzero(cols["blk"][s:e] == cols["ti"][s]), s + np.flatnonzero(cols["blk"][s:e] == cols["tj"][s]), False))
        yield t, pre, [f for f in found if len(f[1]) and len(f[2]) and (len(f[1]) > 1 or not f[3])]


def candidates(pre: np.ndarray, pivot: int, rows: np.ndarray, others: np.ndarray, same: bool, shared: int, step: int = 256):
    """(rows, mask over the others) by ``step`` rows: pairs that share enough pivots and are settled in this list.

    Shared pivots are counted by a product of indicator rows.  A pair is
    settled in the smallest of the lists that both of its vectors stand in.
    """
    at = rows if same else np.concatenate((rows, others))
    used, code = np.unique(pre[at], return_inverse=True)
    code = code.reshape(len(at), -1)
    has = np.zeros((len(at), len(used)), np.float32)
    np.put_along_axis(has, code, 1, axis=1)
    low = int(np.searchsorted(used, pivot))
    listed = np.zeros((len(at), low), np.float32)
    r, c = np.nonzero(code[:, :pre.shape[1] // 2 + 1] < low)
    listed[r, code[r, c]] = 1
    has_other, listed_other = (has, listed) if same else (has[len(rows):], listed[len(rows):])
    for i in range(0, len(rows), step):
        part = rows[i:i + step]
        ok = has[i:i + len(part)] @ has_other.T >= min(shared, pre.shape[1])
        if low:
            ok &= listed[i:i + len(part)] @ listed_other.T == 0
        if same:
            ok &= np.arange(len(others)) > np.arange(i, i + len(part))[:, None]
        yield part, ok


def with_candidates(batches, shared: int):
    """The entries of each tile that are in a candidate pair there."""
    for t, pre, found in tiles(batches):
        hit = np.zeros(t.num_rows, bool)
        for pivot, rows, others, same in found:
            for part, ok in candidates(pre, pivot, rows, others, same, shared):
                hit[part] |= ok.any(1)
                hit[others] |= ok.any(0)
        yield from t.filter(pa.array(hit)).to_batches()


def list_links(batches, shared: int, min_cosine: float):
    """Candidates with their exact cosine: (uid, id, add, peer) with add = copies linked, peer from a spanning forest."""
    for t, pre, found in tiles(batches):
        x = unit(t.column("vec").combine_chunks().flatten().to_numpy().astype(float).reshape(t.num_rows, -1))
        uid, node, copies = (t.column(k).to_numpy() for k in ("uid", "node", "copies"))
        add = np.zeros(t.num_rows, np.int64)
        stars = []
        for pivot, rows, others, same in found:
            for part, ok in candidates(pre, pivot, rows, others, same, shared):
                a, b = np.nonzero(ok)
                if not len(a):
                    continue
                if len(a) * 8 < ok.size:  # few: one by one
                    cosine = np.concatenate([np.einsum("ij,ij->i", x[part[a[i:i + 65536]]], x[others[b[i:i + 65536]]]) for i in range(0, len(a), 65536)])
                else:
                    cosine = (x[part] @ x[others].T)[a, b]
                    near = np.flatnonzero(np.abs(cosine - min_cosine) < 1e-9)  # rounded alike at every shape of a tile
                    cosine[near] = np.einsum("ij,ij->i", x[part[a[near]]], x[others[b[near]]])
                a, b = part[a[cosine >= min_cosine]], others[b[cosine >= min_cosine]]
                if len(a):
                    add += np.bincount(a, copies[b], t.num_rows).astype(np.int64) + np.bincount(b, copies[a], t.num_rows).astype(np.int64)
                    stars.append(local_forest(node[a], node[b]))
        if not stars:
            continue
        v, w = local_forest(*(np.concatenate(s) for s in zip(*stars, strict=True)))
        at = np.flatnonzero(add)
        peer = np.zeros(len(at), np.int64)
        linked = np.isin(node[at], v)
        peer[linked] = w[np.searchsorted(v, node[at][linked])]
        yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(node[at]), pa.array(add[at]), pa.array(peer, mask=~linked)], names=["uid", "id", "add", "peer"])


def embedding_dedup(vectors: DataFrame, min_cosine: float = MIN_COSINE, pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label with cosine (double precision) of at least
    ``min_cosine`` link; vectors without label, with null or non-finite
    components, zero or null link with nothing, nor do vectors of different
    lengths.  n_links counts the other vectors linked directly, copies each;
    component_id is the smallest id reachable; kept: it is the row's own id.
    Ids must be integers; repeated rows count as vectors; empty input gives an
    empty result.

    Equal vectors are made one first.  Each length of vectors (at most
    MAX_LENGTHS with two or more vectors) is indexed by itself.  Of a bounded
    sample (SAMPLE, smallest digests) ``pivots`` (default: the root of the
    number of rows, within PIVOTS and MAX_PIVOTS) far from each other are the
    reference points.  A vector is described by its ``prefix`` nearest, in
    order, and stands in the inverted lists of the first half of them and one
    more.  The lists hold ids and prefixes only.  Pairs that meet in one and
    share at least ``shared`` pivots are candidates, settled in the smallest
    list that both stand in.  Vectors travel only to the lists where they have
    candidates, and the exact cosine decides.  Lists above ``block`` are
    compared tile by tile.  Only entries, counts and spanning forests leave a
    task, not pairs.
    """
    rows = stored(described(vectors, id_col, vec_col, label_col), "vectors")
    key = ["label", "digest"]
    one = stored(rows.where("digest is not null").groupBy(*key).agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec")).where("node is not null")
        .withColumn("dim", F.size("vec")).withColumn("uid", F.monotonically_increasing_id()), "distinct")
    dims = {r.dim: r.n for r in one.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").limit(MAX_LENGTHS + 1).collect()}
    if len(dims) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    points = {}  # reference points by length
    for d, n in dims.items():
        most = pivots_for(n, PIVOTS) if pivots is None else pivots
        sample = one.where(F.col("dim") == d).orderBy("digest", "label").limit(max(SAMPLE, 4 * most)).select("vec").toArrow().column("vec").combine_chunks()
        points[d] = spread(unit(sample.flatten().to_numpy().astype(float).reshape(-1, d)), most)

    def index(batch):
        size = batch.column("dim").to_numpy()
        prefixes = [None] * len(size)
        flat = batch.column("vec").flatten().to_numpy().astype(float)
        begin = np.cumsum(size) - size
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            x = unit(flat[begin[own][:, None] + np.arange(d)])
            for i, p in zip(own.tolist(), nearest(x, points[d], prefix_for(len(points[d]), prefix)), strict=True):
                prefixes[i] = p
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("label"), batch.column("dim"), pa.array(prefixes, pa.list_(pa.int16()))],
                                          names=["uid", "label", "dim", "prefix"])

    described_by = stored(map_batches(one.where(F.col("dim").isin(list(dims))).select("uid", "label", "dim", "vec"), index,
                                      "uid long, label long, dim int, prefix array<smallint>", rows=1000), "prefixes")
    entries = described_by.withColumn("list", F.expr("explode(slice(prefix, 1, cast(size(prefix) div 2 + 1 as int)))"))
    sizes = entries.groupBy("label", "dim", "list").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    tiled = (entries.join(sizes.select("label", "dim", "list", "blocks"), ["label", "dim", "list"])
             .withColumn("blk", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", "list", F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"), "blk", "uid", "prefix"))
    open_entries = stored(tiled.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(lambda b: with_candidates(b, shared), tiled.schema), "candidates")
    found = stored(open_entries.join(one.select("uid", "node", "copies", "vec"), "uid").repartition(*KEYS).sortWithinPartitions(*KEYS)
                   .mapInArrow(lambda b: list_links(b, shared, min_cosine), "uid long, id long, add long, peer long"), "links")
    counts = found.groupBy("uid").agg(F.sum("add").alias("links"))
    comp = components(found.where("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b")))
    named = (one.select("uid", "node", "copies", *key).join(counts, "uid", "left").join(comp.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
             .where("copies > 1 or links is not null")
             .select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")))
    out = rows.select("vec_id", *key).join(named, key, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
