"""Hard negatives by inner product, found through summaries of vector segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .vectors import integer_vectors, matrix

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 3
BAND = (50, 95)  # percent of the positive's score
ANCHORS = 4096  # anchors of one block
ROWS = 65_536  # rows that meet a block of anchors in one slice, about; they stream past it
LEAF = 2  # components of the shortest segments
DENSE = 0.2  # share of open pairs above which a level is computed for all of a tile
NONE = np.iinfo(np.int64).min


def segment_lengths(dims: int) -> list[int]:
    """Lengths of the segments of each level, longest first; a vector is padded with zeros to the longest."""
    top = max(LEAF, 1 << max(0, dims - 1).bit_length())
    return [n for n in (top // 4, top // 16, LEAF) if n >= LEAF][:3] if top > 4 * LEAF else [LEAF]


class Summary:
    """Each vector's mean and deviation on the segments of every level, both times the root of the segment's length.

    With them the inner product on a segment is the product of the means plus
    or minus the product of the deviations, so the sums over the segments
    bound the whole score from both sides (Cauchy-Schwarz on what is left
    after the mean).
    """

    def __init__(self, q: np.ndarray):
        self.q = q
        x = q.astype(np.float64)
        self.means, self.devs = [], []
        for n in segment_lengths(q.shape[1]):
            width = -(-q.shape[1] // n) * n
            seg = np.pad(x, ((0, 0), (0, width - q.shape[1]))).reshape(len(x), width // n, n)
            mean = seg.mean(axis=2)
            self.means.append(mean * np.sqrt(n))
            self.devs.append(np.sqrt(((seg - mean[:, :, None]) ** 2).sum(axis=2)))
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.exact = float(np.abs(x).max(initial=0)) ** 2 * q.shape[1] < 2.0 ** 53  # float products of these are exact

    def scores(self, other: Summary, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact integer inner products of pairs."""
        return np.einsum("ij,ij->i", self.q[i].astype(np.int64), other.q[j].astype(np.int64))

    def all_scores(self, other: Summary) -> np.ndarray:
        if self.exact and other.exact:
            return (self.q.astype(np.float64) @ other.q.astype(np.float64).T).astype(np.int64)
        return self.q.astype(np.int64) @ other.q.astype(np.int64).T


def open_pairs(a: Summary, b: Summary, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all allowed pairs with low[i] <= score <= high[i].

    Level by level the pairs whose bounds lie outside are closed; a level is a
    matrix product while many pairs are open and a gather of the open ones
    after that.  What is open at the end is scored exactly.
    """
    slack = 1e-9 * a.norm.max(initial=0) * b.norm.max(initial=0) + 1e-6  # rounding of the bounds
    lo, hi = low.astype(np.float64) - slack, high.astype(np.float64) + slack
    mask, i, j = allowed, None, None
    size = max(1, allowed.size)
    for level in range(len(a.means)):
        if i is None:
            mid = a.means[level] @ b.means[level].T
            off = a.devs[level] @ b.devs[level].T
            mask = mask & (mid + off >= lo[:, None]) & (mid - off <= hi[:, None])
            if np.count_nonzero(mask) < DENSE * size:
                i, j = np.nonzero(mask)
        else:
            keep = []
            for s in range(0, len(i), 1 << 16):
                x, y = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
                mid = np.einsum("ij,ij->i", a.means[level][x], b.means[level][y])
                off = np.einsum("ij,ij->i", a.devs[level][x], b.devs[level][y])
                keep.append((mid + off >= lo[x]) & (mid - off <= hi[x]))
            keep = np.concatenate(keep) if keep else np.empty(0, bool)
            i, j = i[keep], j[keep]
    if i is None:
        score = a.all_scores(b)
        i, j = np.nonzero(mask & (score >= low[:, None]) & (score <= high[:, None]))
        return i, j, score[i, j]
    score = np.concatenate([a.scores(b, i[s:s + (1 << 16)], j[s:s + (1 << 16)]) for s in range(0, len(i), 1 << 16)] or [np.empty(0, np.int64)])
    keep = (score >= low[i]) & (score <= high[i])
    return i[keep], j[keep], score[keep]


class Best:
    """The k best rows (score, then id) of each anchor and band seen so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # (anchors, bands); a band that is empty has low > high
        self.score = np.full((*low.shape, k), NONE)
        self.id = np.zeros((*low.shape, k), np.int64)

    def needed(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest score that can still enter any band of an anchor."""
        used = self.low <= self.high
        need = np.where(used, np.maximum(self.low, self.score[:, :, -1]), np.iinfo(np.int64).max)
        return need.min(axis=1, initial=np.iinfo(np.int64).max), np.where(used, self.high, NONE).max(axis=1, initial=NONE)

    def add(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for band in range(self.low.shape[1]):
            ok = (score >= np.maximum(self.low[i, band], self.score[i, band, -1])) & (score <= self.high[i, band])
            if not ok.any():
                continue
            who = np.unique(i[ok])
            have = self.score[who, band] > NONE
            a = np.concatenate([i[ok], np.repeat(who, have.sum(axis=1))])
            s = np.concatenate([score[ok], self.score[who, band][have]])
            d = np.concatenate([ids[ok], self.id[who, band][have]])
            order = np.lexsort((d, -s, a))
            a, s, d = a[order], s[order], d[order]
            place = np.arange(len(a)) - np.repeat(np.flatnonzero(np.diff(a, prepend=-1)), np.diff(np.flatnonzero(np.append(np.diff(a, prepend=-1), 1))))
            top = place < self.k
            self.score[a[top], band, place[top]] = s[top]
            self.id[a[top], band, place[top]] = d[top]


def streamed(batches, k: int, same: bool):
    """The k best rows of each anchor and band in every slice.

    Batches are sorted by (dims, lab, block, slice, kind): the anchors of a
    block come first and are held, the rows of the slice stream past them.
    """
    key, held, state = None, [], None

    def out():
        uid, best = state[1], state[4]
        i, band, place = np.nonzero(best.score > NONE)
        return pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(band.astype(np.int32)), pa.array(best.id[i, band, place]), pa.array(best.score[i, band, place])],
                                          names=["anchor", "band", "id", "score"])

    def start(t: pa.Table, dims: int):
        low, high = (t.column(c).combine_chunks() for c in ("low", "high"))
        bands = len(low.flatten()) // max(1, t.num_rows)
        return (Summary(matrix(t.column("q"), dims)), t.column("uid").to_numpy(), t.column("label").to_numpy(), t.num_rows,
                Best(low.flatten().to_numpy().reshape(t.num_rows, bands).copy(), high.flatten().to_numpy().reshape(t.num_rows, bands).copy(), k))

    for batch in small_batches(batches, 4096):
        part = pa.Table.from_batches([batch])
        keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("dims", "lab", "block", "slice", "kind")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now, kind = tuple(keys[s, :4].tolist()), int(keys[s, 4])
            if now != key:
                if state is not None:
                    yield out()
                key, held, state = now, [], None
            piece = part.slice(s, e - s)
            if kind == 0:
                held.append(piece)
                continue
            if state is None:
                if not held:
                    continue  # no anchor fell into this block
                state = start(pa.concat_tables(held), now[0])
                held = []
            a, uid, label, _, best = state
            for at in range(0, piece.num_rows, 1024):
                t = piece.slice(at, 1024)
                b = Summary(matrix(t.column("q"), now[0]))
                equal = label[:, None] == t.column("label").to_numpy()[None, :]
                allowed = equal & (uid[:, None] != t.column("uid").to_numpy()[None, :]) if same else ~equal
                i, j, score = open_pairs(a, b, allowed, *best.needed())
                if len(i):
                    best.add(i, t.column("vec_id").to_numpy()[j], score)
    if state is not None:
        yield out()


def best_of(anchors: DataFrame, rows: DataFrame, k: int, same: bool, anchor_block: int, row_slice: int) -> DataFrame:
    """(anchor, band, id, score, rank): of each anchor's rows of the same label, or of all others, the k best in each band.

    Anchors are dealt to blocks and rows to slices, by hash; every block meets
    every slice.  Blocks and slices follow the counts of a label (of all rows
    for other labels), so a label of any size is spread; a slice adds at most
    k rows for each anchor and band.
    """
    lab = F.col("label") if same else F.lit(0).cast("long")
    a = anchors.withColumn("dims", F.size("q")).withColumn("lab", lab)
    r = rows.withColumn("dims", F.size("q")).withColumn("lab", lab)
    deal = (a.groupBy("dims", "lab").agg(F.count("*").alias("na")).join(r.groupBy("dims", "lab").agg(F.count("*").alias("nr")), ["dims", "lab"])
            .select("dims", "lab", F.ceil(F.col("na") / anchor_block).cast("int").alias("blocks"), F.ceil(F.col("nr") / row_slice).cast("int").alias("slices")))
    key = ["dims", "lab", "block", "slice"]
    a = (a.join(deal, ["dims", "lab"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
         .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
         .select(*key, F.lit(0).alias("kind"), "uid", "vec_id", "label", "q", "low", "high"))
    none = F.lit(None).cast("array<long>")
    r = (r.join(deal, ["dims", "lab"]).withColumn("slice", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("slices")).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select(*key, F.lit(1).alias("kind"), "uid", "vec_id", "label", "q", none.alias("low"), none.alias("high")))
    found = (a.unionByName(r).repartition(*key).sortWithinPartitions(*key, "kind")
             .mapInArrow(lambda b: streamed(b, k, same), "anchor long, band int, id long, score long"))
    w = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
                   scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", anchor_block: int = ANCHORS, row_slice: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``, ``label`` a column of
    ``vectors``.  Components become floor(scale * x); a row's score is its
    integer inner product with the anchor, ties go to the smaller id (a null
    id comes last).  An anchor's positives are its best ``positives`` other
    rows of its label.  For each of them the best ``negatives`` rows of other
    labels are returned whose score is within ``band`` percent of the
    positive's: band[0] * p <= 100 * n <= band[1] * p.

    Rows with a null label, a null vector or a null or non-finite component
    take no part; vectors of another length never meet.  Repeated rows count
    as rows: a repeated anchor is answered once for each row.  Anchors without
    positives or negatives give no row; empty input gives an empty result.

    Every vector is cut into segments, hierarchically; means and deviations of
    the segments bound a score from both sides, and only pairs whose bounds
    reach a band, and the band's k-th best score so far, are refined and at
    last scored.  Nothing but the k best rows of an anchor in a slice leaves a
    task, and neither anchors nor rows are broadcast or held whole.
    """
    rows = stored(integer_vectors(vectors, id_col, vec_col, scale, label=label)
                  .withColumn("vec_id", F.coalesce("vec_id", F.lit(np.iinfo(np.int64).max))), "vectors")
    real = F.nullif(F.col("vec_id"), F.lit(np.iinfo(np.int64).max))
    anchors = rows.where(F.size("q") > 0).withColumn("vec_id", real).where(is_anchor)
    rows = rows.where(F.size("q") > 0)
    whole = [F.array(F.lit(x).cast("long")).alias(n) for n, x in (("low", NONE + 1), ("high", np.iinfo(np.int64).max))]
    pos = stored(best_of(anchors.select("*", *whole), rows, positives, True, anchor_block, row_slice), "positives")
    # floor and ceiling of shares of a score in whole numbers; decimals, since 100 times a score may not fit
    percent = lambda b: F.col("score").cast("decimal(38,0)") * F.lit(b) / F.lit(100)
    bands = pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.ceil(percent(band[0])).cast("long").alias("low"), F.floor(percent(band[1])).cast("long").alias("high")))).alias("b"))  # at most ``positives``
    fill = lambda name, empty: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col(f"b.{name}"), i - 1), F.lit(empty).cast("long")))
    asked = anchors.join(bands, F.col("uid") == F.col("anchor")).select(
        *anchors.columns, fill("low", 1).alias("low"), fill("high", 0).alias("high"))
    neg = best_of(asked, rows, negatives, False, anchor_block, row_slice)
    names = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = (pos.select("anchor", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
           .join(neg.select("anchor", "band", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor", "band"])
           .join(names, "anchor"))
    back = lambda c: F.nullif(F.col(c), F.lit(np.iinfo(np.int64).max)).alias(c)
    return out.select("anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")
