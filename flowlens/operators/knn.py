"""Exact nearest-neighbour and radius self-joins (JN-7, JN-8, JN-9).

Neighbour search by block pairs.  Rows are dealt to parts of BOUND_ROWS; the
k-th distance inside its part bounds a row's k-th distance.  Then rows are
hashed into B blocks and every unordered block pair is one group: each row is
sent once to each of the B pairs its block is in (B copies per row, an
equi-join on the block pair, no cross join), dealt to as many tasks as there
are pairs.  Inside a group a matrix product in single precision gives lower bounds of the distances, SLICE x SPAN
at a time (in double precision where that leaves more than a COARSE-th of a
tile); of the pairs whose bound is within a row's, those that may be among its k
best in the group are computed exactly and the k best emitted.  A final window over the partial lists keeps the k best
(k·B rows per id).

Cost: n²·d flops of matrix product spread over B²/2 tasks; shuffle B·n vectors
+ n·k·B partials.  B is BLOCKS from MIN_BLOCK_ROWS rows a block up to
MAX_BLOCK_ROWS, so that the shuffle grows with n, and with n² only above
BLOCKS * MAX_BLOCK_ROWS rows, where a task's memory is the bound.

The radius search by block pairs has blocks of ROWS_PER_BLOCK rows and computes
whole tiles (32 MB), since all it finds leaves the group.

Above PRUNE_ABOVE rows the same results come from a partitioned search where
the rows have structure (a sample decides, ``_has_structure``).  A bounded set
of rows are pivots; a row's cell is its nearest pivot, a cell is cut into rings
by distance to it, a ring into salted units of about ROWS_PER_BLOCK rows.  By
the triangle inequality no row of a ring is closer to x than max(d(x, pivot) -
outer, inner - d(x, pivot)).  A neighbour search first looks in the row's own
unit, which bounds its k-th distance, and then sends the row to the units that
may hold something closer; a radius search sends it to the units within the
radius, each pair of units in one direction only.  A row is held against the
whole cells first and against the rings of those that remain, so that its
search for units does not grow with their number.  A unit that many rows visit
is split by visitors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR_SCHEMA = "src long, dst long, dist double"


ROWS_PER_BLOCK = 2000
PRUNE_ABOVE = 20_000  # rows; below that the block pairs take seconds
MAX_PIVOTS = 2048
MAX_RINGS = 64
VISITORS = 4  # times ROWS_PER_BLOCK that meet a unit in one group
UNIT = ["_cell", "_ring", "_salt"]
BLOCKS = 10  # of a neighbour search by block pairs, unless blocks were smaller or larger than the next
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 512, 100_000
BOUND_ROWS = 8192  # rows among which a row's k-th distance is bounded
SLICE, SPAN = 512, 1024  # rows and columns of a tile of bounds
COARSE = 64  # of a tile one pair may pass the bounds in single precision
HELD = 2_000_000  # found pairs kept before they are cut to the k best
GROUPS_PER_TASK, MAX_TASKS = 32, 10_000  # of a radius search: a group of 256 members may emit half a million rows
NO_ID = -2 ** 63  # in the pairs of a radius search, for a row without id, which is no row's self
FEW = 8  # components up to which distances are summed one component at a time
PROBE = 2048  # rows that tell whether vectors have structure
MANY_VISITS = 32  # units that a row of a radius search may look into before block pairs are taken


def _auto_blocks(df: DataFrame, n_blocks: int | None) -> int:
    """Blocks of at most ROWS_PER_BLOCK rows, and tiles for all task slots unless blocks fell below 64 rows."""
    if n_blocks:
        return n_blocks
    n = df.count()
    slots = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return max(1, math.ceil(n / ROWS_PER_BLOCK), min(math.ceil(math.sqrt(2 * slots)), n // 64))


def _blocks(df: DataFrame, id_col: str, vec: str, n_blocks: int | None, label: str | None = None) -> DataFrame:
    n_blocks = _auto_blocks(df, n_blocks)
    d = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v"),
                  *([F.col(label).alias("_lab")] if label else []))
    d = d.withColumn("_blk", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return d.withColumn("_lb", F.least("_blk", "_o")).withColumn("_rb", F.greatest("_blk", "_o")).drop("_o")


def _sides(pdf: pd.DataFrame):
    """(left, right) rows of a block pair; the same rows twice on the diagonal."""
    lb, rb = pdf["_lb"].iloc[0], pdf["_rb"].iloc[0]
    return (pdf, pdf) if lb == rb else (pdf[pdf["_blk"] == lb], pdf[pdf["_blk"] == rb])


def _distances(lv: np.ndarray, rv: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        ln = np.linalg.norm(lv, axis=1, keepdims=True)
        rn = np.linalg.norm(rv, axis=1, keepdims=True)
        ln[ln == 0] = 1.0
        rn[rn == 0] = 1.0
        return 1.0 - (lv / ln) @ (rv / rn).T
    # exact euclidean per pair (no expansion trick: keeps ties stable)
    out = np.empty((lv.shape[0], rv.shape[0]))
    for i in range(lv.shape[0]):
        diff = rv - lv[i]
        out[i] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _tile_fn(eps: float, metric: str, strict: bool, exclude_self: bool):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if left.empty or right.empty:
            return _pairs([], [], [])
        lid, rid = left["_id"].to_numpy(), right["_id"].to_numpy()
        dist = _distances(np.stack(left["_v"].to_numpy()), np.stack(right["_v"].to_numpy()), metric)
        if exclude_self:
            dist = np.where(lid[:, None] == rid[None, :], np.inf, dist)
        ii, jj = np.nonzero(((dist < eps) if strict else (dist <= eps)) & np.isfinite(dist))
        a, b, d = lid[ii], rid[jj], dist[ii, jj]
        if left is right:
            return _pairs(a, b, d)
        return _pairs(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]))
    return fn


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["_v"].to_numpy()).astype(float) if len(pdf) else np.empty((0, 0))


def _factors(x: np.ndarray, centre: np.ndarray, metric: str, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, r): l @ r.T of two sets of rows with one centre are their squared distances (cosine: distances), moved by more
    than the product's rounding error up (``sign`` 1) or down (-1)."""
    slack = 1e-15 * (x.shape[1] + 16) * sign
    one = np.ones((len(x), 1))
    if metric == "cosine":
        u = _unit(x)
        return np.hstack([-u, one * (1 + slack)]), np.hstack([u, one])
    z = x - centre
    size = np.einsum("ij,ij->i", z, z)[:, None] * (1 + slack)
    return np.hstack([-2 * z, size, one]), np.hstack([z, one, size])


def _single_factors(x: np.ndarray, centre: np.ndarray, metric: str, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The lower bounds of ``_factors`` in single precision, for vectors (not cosine) divided by ``scale``, which keeps them within its range."""
    slack = 6e-7 * (x.shape[1] + 16)
    one = np.ones((len(x), 1))
    if metric == "cosine":
        u = _unit(x)
        left, right = np.hstack([-u, one * (1 - slack)]), np.hstack([u, one])
    else:
        z = (x - centre) / scale
        size = np.einsum("ij,ij->i", z, z)[:, None] * (1 - slack) - 1e-30  # what is too small for single precision
        left, right = np.hstack([-2 * z, size, one]), np.hstack([z, one, size])
    return left.astype(np.float32), right.astype(np.float32)


def _single_bound(bound: np.ndarray, scale: float) -> np.ndarray:
    """``bound`` of squared distances (cosine: ``scale`` 1) in single precision, not below it."""
    return np.nextafter((bound / scale / scale).astype(np.float32), np.float32(np.inf))


def _single_gap(x: np.ndarray, y: np.ndarray, centre: np.ndarray, metric: str, scale: float) -> np.ndarray:
    """How far the lower bounds of ``_single_factors`` of a row of ``x`` and any of ``y`` are at most below the real values."""
    slack = 2 * 6e-7 * (x.shape[1] + 16)
    if metric == "cosine":
        return np.full(len(x), slack)
    a, b = (x - centre) / scale, (y - centre) / scale
    return slack * (np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b).max(initial=0)) + 4e-30


def _cut(found: list[tuple], k: int, gap: np.ndarray) -> tuple:
    """Of pairs (i, j, v) with lower bounds v, at most ``gap`` of i below the real values, those that may be among the k nearest of i."""
    i, j, v = (np.concatenate(x) for x in zip(*found))
    if not len(i) or k < 1:
        return i[:0], j[:0], v[:0]
    v = np.maximum(v, 0) + np.float32(0)  # no negative zero: the bits are in the order of the values
    key = np.sort((i.astype(np.uint64) << np.uint64(32)) | v.view(np.uint32))
    row = (key >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    first = first[np.diff(np.append(first, len(row))) >= k]
    most = np.full(len(gap), np.inf)
    most[row[first]] = key[first + k - 1].astype(np.uint32).view(np.float32) + gap[row[first]]
    keep = ~(v > most[i])
    return i[keep], j[keep], v[keep]


def _true_at(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true values, few of them, of a contiguous mask: 64 values are passed over at once."""
    flat = mask.ravel()
    whole = len(flat) // 64 * 64
    eight = flat[:whole].view(np.uint64) != 0
    at = (np.flatnonzero(eight.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = (at[eight[at]][:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[whole:]) + whole])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def _pair_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (x[i], y[j]); cosine: of unit vectors."""
    out = np.empty(len(i))
    for s in range(0, len(i), 32768):
        a, b = x[i[s:s + 32768]], y[j[s:s + 32768]]
        if metric == "cosine":
            out[s:s + 32768] = 1.0 - np.einsum("ij,ij->i", a, b)
        else:
            diff = b - a
            out[s:s + 32768] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _trim(found: list[tuple], k: int) -> tuple:
    """Of the pairs (i, j, d) the k nearest of every i, ties by j."""
    i, j, d = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return i, j, d
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
    return i[keep], j[keep], d[keep]


def _kth_bound(ids: np.ndarray, x: np.ndarray, k: int, metric: str, exclude_self: bool) -> np.ndarray:
    """An upper bound of every row's k-th smallest value (as in ``_factors``) among these rows; infinite where there are fewer."""
    out = np.full(len(x), np.inf)
    if not 0 < k <= len(x):
        return out
    with np.errstate(all="ignore"):
        left, right = _factors(x, x.mean(axis=0), metric, 1)
        for s in range(0, len(x), SLICE):
            far = left[s:s + SLICE] @ right.T
            if exclude_self:
                far[ids[s:s + SLICE, None] == ids[None, :]] = np.inf
            out[s:s + SLICE] = np.partition(far, k - 1, axis=1)[:, k - 1]
    return out


def _k_within(lid: np.ndarray, x: np.ndarray, lt: np.ndarray, rid: np.ndarray, y: np.ndarray, rt: np.ndarray | None, k: int, metric: str,
              exclude_self: bool) -> pd.DataFrame:
    """Of every left row the k nearest right rows whose value (as in ``_factors``) is within its bound ``lt``, ties by id, and with
    ``rt`` those of every right row on the left.  Rows with like bounds share a tile, so that one bound sorts out most of it; of what is
    left only pairs that may be among the k nearest are computed exactly.  Memory: a tile, HELD pairs and the result."""
    with np.errstate(all="ignore"):
        lo, ro = np.argsort(lt, kind="stable"), np.arange(len(rid)) if rt is None else np.argsort(rt, kind="stable")
        lid, x, lt, rid, y, rt = lid[lo], x[lo], lt[lo], rid[ro], y[ro], None if rt is None else rt[ro]
        centre = y.mean(axis=0)
        left, right = _factors(x, centre, metric, -1)[0], np.ascontiguousarray(_factors(y, centre, metric, -1)[1].T)
        scale = 1.0 if metric == "cosine" else float(max(np.abs(x - centre).max(initial=0), np.abs(y - centre).max(initial=0))) or 1.0
        left_single = _single_factors(x, centre, metric, scale)[0]
        right_single = np.ascontiguousarray(_single_factors(y, centre, metric, scale)[1].T)
        lt_single, rt_single = _single_bound(lt, scale), None if rt is None else _single_bound(rt, scale)
        gap, back_gap = _single_gap(x, y, centre, metric, scale), None if rt is None else _single_gap(y, x, centre, metric, scale)
        if metric == "cosine":
            x, y = _unit(x), _unit(y)

        def tile(s, t):
            """Pairs of a tile that are within a bound, with their values, by rows and (with ``rt``) by columns."""
            value = left_single[s:s + SLICE] @ right_single[:, t:t + SPAN]
            most = lt_single[s:s + SLICE].max() if rt is None else max(lt_single[s:s + SLICE].max(), rt_single[t:t + SPAN].max())
            near = ~(value > most)
            fine = np.count_nonzero(near) > near.size // COARSE
            if fine:
                value2 = left[s:s + SLICE] @ right[:, t:t + SPAN]
                near = ~(value2 > lt[s:s + SLICE, None])
                if rt is not None:
                    near |= ~(value2 > rt[None, t:t + SPAN])
            at = _true_at(near)
            i, j = np.divmod(at, near.shape[1])
            v, bounds, w = value.ravel()[at], (lt_single, rt_single), value.ravel()[at]
            if fine:
                bounds, w = (lt, rt), value2.ravel()[at]
            i, j = i + s, j + t
            if exclude_self:
                other = lid[i] != rid[j]
                i, j, v, w = i[other], j[other], v[other], w[other]
            mine = ~(w > bounds[0][i])
            if rt is None:
                return (i[mine], j[mine], v[mine]), None
            theirs = ~(w > bounds[1][j])
            return (i[mine], j[mine], v[mine]), (j[theirs], i[theirs], v[theirs])

        def settle(raw, known, p, q, number, gap):
            """Of pairs with values, and pairs (i, number of j by id) with distances, the k nearest of every row of ``p``, with distances."""
            i, j, _ = _cut(raw, k, gap)
            d = _pair_distances(p, q, i, j, metric)
            ok = np.isfinite(d)
            return _trim([known, (i[ok], number[j[ok]], d[ok])], k)
        lsort, rsort = np.argsort(lid, kind="stable"), np.argsort(rid, kind="stable")
        lnumber, rnumber = np.empty(len(lid), np.int64), np.empty(len(rid), np.int64)
        lnumber[lsort], rnumber[rsort] = np.arange(len(lid)), np.arange(len(rid))
        none, empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        found, raw_back, back, held = [empty], [none], empty, 0
        for s in range(0, len(x), SLICE):
            raw, mine, ours = [none], empty, 0
            for t in range(0, len(y), SPAN):
                here, there = tile(s, t)
                raw.append(here)
                ours += len(here[0])
                if ours > HELD:
                    mine, raw, ours = settle(raw, mine, x, y, rnumber, gap), [none], 0
                if there is not None:
                    raw_back.append(there)
                    held += len(there[0])
                    if held > HELD:
                        back, raw_back, held = settle(raw_back, back, y, x, lnumber, back_gap), [none], 0
            found.append(settle(raw, mine, x, y, rnumber, gap))
        i, j, d = (np.concatenate(c) for c in zip(*found))
        q, p, e = back if rt is None else settle(raw_back, back, y, x, lnumber, back_gap)
    return _pairs(np.concatenate([lid[i], rid[q]]), np.concatenate([rid[rsort[j]], lid[lsort[p]]]), np.concatenate([d, e]))


def _usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """_id, _v of the rows whose vector is there and finite."""
    v = F.col(vec).cast("array<double>")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).filter(usable)


class Partitions:
    """Rows in units (cell, ring, salt) of bounded size, with the distance range of every ring.

    ``rows``: _id, _v, _x (what distances are bounded on: the vector, or its
    unit vector for cosine), _dp, _near (k-th distance to other pivots) and the
    unit; stored.  ``rings``: at most MAX_PIVOTS * MAX_RINGS entries.
    """

    def __init__(self, df: DataFrame, id_col: str, vec: str, metric: str, k: int, unit_rows: int):
        from ..session import cut_lineage
        self.metric = metric
        d = _usable(df, id_col, vec)
        if metric == "cosine":
            norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
            d = d.withColumn("_n", norm).withColumn("_x", F.transform("_v", lambda x: x / F.col("_n"))).drop("_n")
        else:
            d = d.withColumn("_x", F.col("_v"))
        d = cut_lineage(d.repartition("_id"))  # the scan of a small file is one task
        n = d.count()
        wanted = max(1, min(MAX_PIVOTS, math.ceil(n / unit_rows)))
        first = d.orderBy(F.xxhash64("_id"), "_id").limit(wanted).select("_id", "_x").collect()
        ids, points = np.array([r[0] for r in first], np.int64), np.array([r[1] for r in first], float)

        centre = points.mean(axis=0) if len(points) else points
        right = _factors(points, centre, "euclidean", 1)[1].T if len(points) else points

        def assign(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["_x"].to_numpy()).astype(float)
                cell, near = np.empty(len(x), np.int32), np.full(len(x), np.inf)
                for s in range(0, len(x), SLICE):
                    far = _factors(x[s:s + SLICE], centre, "euclidean", 1)[0] @ right
                    cell[s:s + SLICE] = far.argmin(axis=1)
                    if 0 < k <= len(points):
                        far[pdf["_id"].to_numpy()[s:s + SLICE, None] == ids[None, :]] = np.inf
                        near[s:s + SLICE] = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1], 0))
                pdf["_cell"], pdf["_dp"], pdf["_near"] = cell, _pair_distances(x, points, np.arange(len(x)), cell, "euclidean"), near
                yield pdf
        d = cut_lineage(d.mapInPandas(assign, "_id long, _v array<double>, _x array<double>, _cell int, _dp double, _near double"))
        rings = max(1, min(MAX_RINGS, math.ceil(n / (max(1, len(first)) * unit_rows))))
        cuts = d.groupBy("_cell").agg(F.percentile_approx("_dp", [i / rings for i in range(1, rings)] or [0.5]).alias("_cuts"))  # one row a pivot
        ring = F.size(F.filter("_cuts", lambda c: c < F.col("_dp"))) if rings > 1 else F.lit(0)
        d = d.join(F.broadcast(cuts), "_cell").withColumn("_ring", ring).drop("_cuts")
        table = (d.groupBy("_cell", "_ring").agg(F.min("_dp").alias("lo"), F.max("_dp").alias("hi"), F.count(F.lit(1)).alias("rows"))
                 .withColumn("_salts", F.ceil(F.col("rows") / F.lit(unit_rows)).cast("int")).orderBy("_cell", "_ring"))
        found = table.collect()  # bounded by MAX_PIVOTS * MAX_RINGS
        self.points, self.size = points, n
        self.cell, self.ring, self.salts = (np.array([r[c] for r in found], np.int64) for c in ("_cell", "_ring", "_salts"))
        self.low, self.high = (np.array([r[c] for r in found], float) for c in ("lo", "hi"))
        self.rows = d.join(F.broadcast(table.select("_cell", "_ring", "_salts")), ["_cell", "_ring"]) \
            .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")).drop("_salts")

    def _reached(self, once: bool):
        """A function of rows with ``_x``, ``_tau`` and their own unit: (row, unit) of the units they must look into."""
        cell, ring, salts, low, high, points, cosine = self.cell, self.ring, self.salts, self.low, self.high, self.points, self.metric == "cosine"
        first = np.cumsum(salts) - salts  # the first unit of a ring
        flat = np.repeat(np.arange(len(cell)), salts)  # rings of units, in order
        salt = np.arange(len(flat)) - np.repeat(first, salts)
        held, start, rings = np.unique(cell, return_index=True, return_counts=True)  # cells with rows, their rings
        inner, outer = (np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)) if len(cell) else (low, high)
        points = points[held]
        centre = points.mean(axis=0) if len(points) else points
        near, far = (_factors(points, centre, "euclidean", sign)[1].T if len(points) else points for sign in (-1, 1))

        def reached(pdf):
            x = np.stack(pdf["_x"].to_numpy()).astype(float)
            tau = pdf["_tau"].to_numpy()
            reach = np.sqrt(2 * np.maximum(tau, 0)) if cosine else tau  # of unit vectors
            reach = reach * (1 + 1e-9) + 1e-12 * (1 + np.abs(x).max(axis=1, initial=0))
            lower = np.sqrt(np.maximum(_factors(x, centre, "euclidean", -1)[0] @ near, 0))
            upper = np.sqrt(np.maximum(_factors(x, centre, "euclidean", 1)[0] @ far, 0))
            q, c = np.nonzero((lower - outer <= reach[:, None]) & (inner - upper <= reach[:, None]))
            dist = _pair_distances(x, points, q, c, "euclidean")
            times = rings[c]
            r = np.repeat(start[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, dist = np.repeat(q, times), np.repeat(dist, times)
            gap = np.maximum(dist - high[r], low[r] - dist)
            on = gap <= reach[q] + 1e-9 * dist
            q, r = q[on], r[on]
            times = salts[r]
            u = np.repeat(first[r], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q = np.repeat(q, times)
            own = np.stack([pdf[n].to_numpy()[q] for n in UNIT])
            there = np.stack([cell[flat[u]], ring[flat[u]], salt[u]])
            after = (there[0] > own[0]) | ((there[0] == own[0]) & ((there[1] > own[1]) | ((there[1] == own[1]) & (there[2] > own[2]))))
            keep = after if once else (there != own).any(axis=0)
            return q[keep], there[:, keep].astype("int32")
        return reached

    def visits(self, asking: DataFrame, once: bool, chunk: int | None = None) -> DataFrame:
        """One row for each unit other than its own that a row of ``asking`` (with ``_tau``, its largest useful
        distance) must look into; ``once``: only units after its own.  With ``chunk`` not the rows but the units: the number of
        groups of at most about that many visitors each."""
        reached = self._reached(once)
        rows = max(1, min(SLICE, 8_000_000 // max(1, int(self.salts.sum()))))  # that may visit every unit at once

        def run(batches):
            for whole in batches:
                for s in range(0, len(whole), rows):
                    pdf = whole.iloc[s:s + rows]
                    q, there = reached(pdf)
                    out = pd.DataFrame(dict(zip(UNIT, there)))
                    if chunk is None:
                        out["_id"], out["_v"], out["_tau"] = (pdf[n].to_numpy()[q] for n in ("_id", "_v", "_tau"))
                        yield out
                    else:
                        yield out.groupby(UNIT, as_index=False).size().rename(columns={"size": "_n"})
        unit = "_cell int, _ring int, _salt int, "
        if chunk is None:
            return asking.select(*UNIT, "_id", "_v", "_x", "_tau").mapInPandas(run, unit + "_id long, _v array<double>, _tau double")
        return (asking.select(*UNIT, "_x", "_tau").mapInPandas(run, unit + "_n long").groupBy(*UNIT)
                .agg(F.ceil(F.sum("_n") / F.lit(chunk)).cast("int").alias("_chunks")))

    def groups(self, asking: DataFrame, once: bool, chunk: int, per_task: int | None = None):
        """Every unit with each group of at most about ``chunk`` of its visitors: members have ``_side`` 0, visitors 1.
        ``per_task``: about so many groups a task, for groups that emit far more than they read; else as Spark sizes them."""
        from ..session import cut_lineage
        visits = self.visits(asking, once)
        many = cut_lineage(self.visits(asking, once, chunk))  # one row a unit
        member = (self.rows.join(many, UNIT).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
                  .select(*UNIT, "_chunk", F.lit(0).alias("_side"), "_id", "_v", F.lit(0.0).alias("_tau")))
        visitor = (visits.join(many, UNIT).withColumn("_chunk", F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_chunks")).cast("int"))
                   .select(*UNIT, "_chunk", F.lit(1).alias("_side"), "_id", "_v", "_tau"))
        both = member.unionByName(visitor)
        if per_task:
            n, slots = many.agg(F.sum("_chunks")).first()[0] or 1, max(both.sparkSession.sparkContext.defaultParallelism, 1)
            both = both.repartition(min(n, max(slots, min(n // per_task, MAX_TASKS))), *UNIT, "_chunk")
        return both.groupBy(*UNIT, "_chunk")

    def met(self, asking: DataFrame, once: bool, fn, chunk: int) -> DataFrame:
        """``fn(members, visitors)`` of all ``groups``."""
        def run(pdf):
            return fn(pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1])
        return self.groups(asking, once, chunk).applyInPandas(run, PAIR_SCHEMA)

    def own(self, fn) -> DataFrame:
        return self.rows.select(*UNIT, "_id", "_v").groupBy(*UNIT).applyInPandas(fn, PAIR_SCHEMA)


def _pairs(src, dst, dist) -> pd.DataFrame:
    return pd.DataFrame({"src": np.asarray(src, "int64"), "dst": np.asarray(dst, "int64"), "dist": np.asarray(dist, "float64")})


def _knn_visits(parts: Partitions, k: int, exclude_self: bool):
    """(best of the own unit, rows with ``_tau``): the own unit and the pivots bound each row's k-th distance."""
    from ..session import cut_lineage
    metric = parts.metric

    def own(pdf):
        ids, x = pdf["_id"].to_numpy(), _vectors(pdf)
        return _k_within(ids, x, _kth_bound(ids, x, k, metric, exclude_self), ids, x, None, k, metric, exclude_self)
    best = cut_lineage(parts.own(own))
    tau = best.groupBy("src").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_kth"))
    near = F.col("_near") * F.col("_near") / 2 if metric == "cosine" else F.col("_near")
    asking = parts.rows.join(tau, F.col("_id") == F.col("src"), "left").withColumn("_tau", F.least(F.coalesce("_kth", F.lit(float("inf"))), near)).drop("src", "_kth")
    return best, cut_lineage(asking)


def _best_below(k: int, metric: str, exclude_self: bool):
    def fn(members, visitors):
        if members.empty or visitors.empty:
            return _pairs([], [], [])
        tau = visitors["_tau"].to_numpy() * (1 + 1e-9) + 1e-12
        return _k_within(visitors["_id"].to_numpy(), _vectors(visitors), tau if metric == "cosine" else tau * tau,
                         members["_id"].to_numpy(), _vectors(members), None, k, metric, exclude_self)
    return fn


def _pruned_knn(df: DataFrame, id_col: str, vec: str, k: int, metric: str, exclude_self: bool, unit_rows: int) -> DataFrame:
    parts = Partitions(df, id_col, vec, metric, k, unit_rows)
    best, asking = _knn_visits(parts, k, exclude_self)
    return best.unionByName(parts.met(asking, False, _best_below(k, metric, exclude_self), VISITORS * unit_rows))


def _within(x: np.ndarray, y: np.ndarray, same: np.ndarray, eps: float, metric: str, strict: bool):
    """(row of x, row of y, distance) of the pairs within ``eps`` that are not the same, in order of x."""
    if metric == "euclidean" and x.shape[1] <= FEW:  # by component: no loop over rows
        dist = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            diff = x[:, c, None] - y[None, :, c]
            diff *= diff
            dist += diff
        np.sqrt(dist, out=dist)
    else:
        dist = _distances(x, y, metric)
    at = np.flatnonzero(((dist < eps) if strict else (dist <= eps)) & ~same)
    i = at // len(y)
    return i, at - i * len(y), dist.ravel()[at]


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids (null: NO_ID) and vectors of some rows of a group."""
    ids, v = table.column("_id").combine_chunks().fill_null(NO_ID), table.column("_v").combine_chunks()
    size = np.unique(v.value_lengths().to_numpy())
    if len(size) > 1:
        raise ValueError(f"vectors of {size.tolist()} components")
    return ids.to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size[0] if len(size) else 0)


def _listed(ids: np.ndarray, i: np.ndarray, others: np.ndarray, dist: np.ndarray, both: bool) -> pa.Table:
    """One row for each of ``ids`` with what was found for it; ``i`` ascends."""
    ends = pa.array(np.searchsorted(i, np.arange(len(ids) + 1)), pa.int32())
    return pa.table({"_id": pa.array(ids, pa.int64()), "_to": pa.ListArray.from_arrays(ends, pa.array(others, pa.int64())),
                     "_dist": pa.ListArray.from_arrays(ends, pa.array(dist, pa.float64())), "_both": pa.array([both] * len(ids), pa.bool_())})


LISTED = "_id long, _to array<long>, _dist array<double>, _both boolean"


def _near_tiles(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, eps: float, metric: str, strict: bool, exclude_self: bool, both: bool):
    """``_listed`` tables of the rows of ``x`` and ``y`` within ``eps``, SLICE x SPAN rows at a time; a table has about HELD pairs at most.

    Both sides are in order of their widest component, so that a slice meets only rows within ``eps`` of it there; of
    more than FEW components a matrix product in single precision (rounded down) tells which pairs are computed exactly."""
    if not len(a) or not len(b):
        return
    few = metric == "euclidean" and x.shape[1] <= FEW
    if metric == "cosine":
        x, y, reach = _unit(x), _unit(y), np.inf
    else:
        wide = np.concatenate([x, y])
        reach = eps * (1 + 1e-9) + 1e-12 * (1 + np.abs(wide).max(initial=0))
        c = int(wide.var(axis=0).argmax()) if x.shape[1] else 0
        lo, ro = (np.argsort(z[:, c], kind="stable") for z in (x, y))
        a, x, b, y = a[lo], x[lo], b[ro], y[ro]
    if not few:
        centre = y.mean(axis=0)
        scale = 1.0 if metric == "cosine" else float(max(np.abs(x - centre).max(initial=0), np.abs(y - centre).max(initial=0))) or 1.0
        left, right = _single_factors(x, centre, metric, scale)[0], np.ascontiguousarray(_single_factors(y, centre, metric, scale)[1].T)
        most = _single_bound(np.array([eps if metric == "cosine" else eps * eps]), scale)[0]
    for s in range(0, len(x), SLICE):
        ids, part = a[s:s + SLICE], x[s:s + SLICE]
        first, last = 0, len(y)
        if np.isfinite(reach):
            first, last = np.searchsorted(y[:, c], part[0, c] - reach, "left"), np.searchsorted(y[:, c], part[-1, c] + reach, "right")
        found, held = [], 0

        def out():
            i, j, d = (np.concatenate(z) for z in zip(*found))
            order = np.argsort(i, kind="stable")
            return _listed(ids, i[order], b[j[order]], d[order], both)
        for t in range(first, last, SPAN):
            end = min(t + SPAN, last)
            if few:
                i, j, d = _within(part, y[t:end], np.zeros((1, 1), bool), eps, metric, strict)
            else:
                i, j = np.divmod(_true_at(~(left[s:s + SLICE] @ right[:, t:end] > most)), end - t)
                d = _pair_distances(part, y[t:end], i, j, metric)
                ok = (d < eps) if strict else (d <= eps)
                i, j, d = i[ok], j[ok], d[ok]
            if exclude_self:
                other = (ids[i] != b[t + j]) | (ids[i] == NO_ID)
                i, j, d = i[other], j[other], d[other]
            if len(i):
                found.append((i, t + j, d))
                held += len(i)
            if held > HELD:
                yield out()
                found, held = [], 0
        if found:
            yield out()


def _tiled_radius(parts: Partitions, eps: float, metric: str, exclude_self: bool, strict: bool) -> DataFrame:
    """What rows find in block pairs: as many copies of a row for every number of rows, one task a block pair."""
    slots = max(parts.rows.sparkSession.sparkContext.defaultParallelism, 1)
    blocks = _knn_blocks(parts.size, slots)
    d = parts.rows.select("_id", "_v", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_blk")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("_blk", "_o"), F.greatest("_blk", "_o")
    d = d.select("_id", "_v", (F.col("_blk") == low).alias("_left"), (low == high).alias("_same"), (high * (high + 1) / 2 + low).cast("int").alias("_pair"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        for pair in (pc.unique(table.column("_pair")).to_pylist() if held else []):
            here = table.filter(pc.equal(table.column("_pair"), pair))
            alone = here.column("_same")[0].as_py()
            a, x = _side(here.filter(here.column("_left")))
            b, y = (a, x) if alone else _side(here.filter(pc.invert(here.column("_left"))))
            for found in _near_tiles(a, x, b, y, eps, metric, strict, exclude_self, not alone):
                yield from found.to_batches()
    return d.repartitionById(blocks * (blocks + 1) // 2, "_pair").mapInArrow(run, LISTED)


def _many_visits(parts: Partitions, asking: DataFrame) -> bool:
    """Whether rows look into so many units that block pairs send fewer copies of them (tried on PROBE rows): MANY_VISITS units, or more than
    BLOCKS where the units spare little."""
    probe = asking.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(PROBE)
    visits = (parts.visits(probe, True, 1).agg(F.sum("_chunks")).first()[0] or 0) / max(1, min(PROBE, parts.size))
    return visits > MANY_VISITS or (visits > BLOCKS and 4 * visits > parts.salts.sum())


def _pruned_radius(df: DataFrame, id_col: str, vec: str, eps: float, metric: str, exclude_self: bool, strict: bool, unit_rows: int) -> DataFrame:
    """A group emits what a row has found as one row, which Spark takes apart, into both directions if two units met."""
    parts = Partitions(df, id_col, vec, metric, 0, unit_rows)

    def same(a, b):
        return (a[:, None] == b[None, :]) & (a != NO_ID)[:, None] if exclude_self else np.zeros((1, 1), bool)

    def own(table):
        ids, x = _side(table)
        i, j, dist = _within(x, x, same(ids, ids), eps, metric, strict)
        return _listed(ids, i, ids[j], dist, False)

    def across(table):
        side = table.column("_side")
        (a, x), (b, y) = _side(table.filter(pc.equal(side, 1))), _side(table.filter(pc.equal(side, 0)))
        if not len(a) or not len(b):
            return _listed(a[:0], a[:0], a[:0], np.empty(0), True)
        i, j, dist = _within(x, y, same(a, b), eps, metric, strict)
        return _listed(a, i, b[j], dist, True)
    asking = parts.rows.withColumn("_tau", F.lit(float(eps)))
    if _many_visits(parts, asking):
        listed = _tiled_radius(parts, eps, metric, exclude_self, strict)
    else:
        listed = parts.rows.select(*UNIT, "_id", "_v").groupBy(*UNIT).applyInArrow(own, LISTED).unionByName(
            parts.groups(asking, True, VISITORS * unit_rows, GROUPS_PER_TASK).applyInArrow(across, LISTED))
    one = listed.select("_id", "_both", "_dist", F.posexplode("_to").alias("_at", "_other")).select(
        "_id", "_other", F.get("_dist", "_at").alias("dist"),
        F.explode(F.when(F.col("_both"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_back"))
    return one.select(F.when(F.col("_back"), F.col("_other")).otherwise(F.col("_id")).alias("src"),
                      F.when(F.col("_back"), F.col("_id")).otherwise(F.col("_other")).alias("dst"), "dist")


def compared_pairs(df: DataFrame, id_col: str, vec: str, k: int | None = None, eps: float | None = None, metric: str = "euclidean",
                   unit_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row: n, pairs (all ordered pairs), compared (ordered pairs whose distance the partitioned search computes) and their share."""
    parts = Partitions(df, id_col, vec, metric, k or 0, unit_rows)
    if k is not None:
        visits = parts.visits(_knn_visits(parts, k, True)[1], once=False)
    else:
        visits = parts.visits(parts.rows.withColumn("_tau", F.lit(float(eps))), once=True)
    sizes = parts.rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m"))
    across = visits.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("q"))
    done = sizes.join(across, UNIT, "left").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("a"), F.sum(F.col("m") * F.coalesce("q", F.lit(0)) * (2 if k is None else 1)).alias("b"))
    pairs = F.lit(float(parts.size) * max(parts.size - 1, 1))
    return done.select(F.lit(parts.size).cast("long").alias("n"), pairs.cast("long").alias("pairs"), (F.col("a") + F.col("b")).alias("compared"),
                       ((F.col("a") + F.col("b")) / pairs).alias("share"))


def _has_structure(df: DataFrame, id_col: str, vec: str, metric: str, k: int) -> bool:
    """Whether the triangle inequality spares a neighbour search most cells: tried on PROBE rows, a quarter of them as pivots.
    Only the way of the search depends on it, not its result."""
    rows = _usable(df, id_col, vec).orderBy(F.xxhash64("_id"), "_id").limit(PROBE).select("_v").collect()
    x = np.array([r[0] for r in rows], float)
    if metric == "cosine":
        x = _unit(x)
    with np.errstate(all="ignore"):
        centre = x.mean(axis=0)
        left, right = _factors(x, centre, "euclidean", 1)
        dist = np.sqrt(np.maximum(left @ right.T, 0))
        np.fill_diagonal(dist, np.inf)
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if 0 < k <= len(x) else np.full(len(x), np.inf)
        np.fill_diagonal(dist, 0)
        dist = dist[:, :max(1, len(x) // 4)]
        cell = dist.argmin(axis=1)
        low, high = np.full(dist.shape[1], np.inf), np.full(dist.shape[1], -np.inf)
        own = dist[np.arange(len(x)), cell]
        np.minimum.at(low, cell, own)
        np.maximum.at(high, cell, own)
        return float(((dist - high <= kth[:, None]) & (low - dist <= kth[:, None])).mean()) <= 0.2


def _use_pruned(df: DataFrame, vec: str, metric: str, n_blocks: int | None, pruned: bool | None) -> bool:
    """Partitioned search where asked for, or by itself above PRUNE_ABOVE rows; cosine with zero vectors has no triangle inequality."""
    if pruned is None:
        pruned = n_blocks is None and df.limit(PRUNE_ABOVE + 1).count() > PRUNE_ABOVE
    if pruned and metric == "cosine":
        return df.filter(~F.exists(F.col(vec), lambda x: x != 0)).limit(1).count() == 0
    return pruned


def _knn_blocks(n: int, slots: int) -> int:
    return max(1, min(BLOCKS, n // MIN_BLOCK_ROWS), min(math.ceil(math.sqrt(2 * slots)), n // 64), math.ceil(n / MAX_BLOCK_ROWS))


def _tiled_knn(df: DataFrame, id_col: str, vec: str, k: int, metric: str, n_blocks: int | None, exclude_self: bool) -> DataFrame:
    """Lists of the k best of each row in every block it meets: bounds from parts of the rows, then block pairs."""
    d = _usable(df, id_col, vec)
    n, slots = d.count(), max(df.sparkSession.sparkContext.defaultParallelism, 1)
    parts = max(1, math.ceil(n / BOUND_ROWS), min(slots, n // 512))

    def bound(pdf):
        pdf = pdf[["_id", "_v"]].copy()
        pdf["_tau"] = _kth_bound(pdf["_id"].to_numpy(), _vectors(pdf), k, metric, exclude_self)
        return pdf

    def tile(pdf):
        left, right = _sides(pdf)
        if left.empty or right.empty:
            return _pairs([], [], [])
        (a, x, s), (b, y, t) = ((p["_id"].to_numpy(), _vectors(p), p["_tau"].to_numpy()) for p in (left, right))
        return _k_within(a, x, s, b, y, None if left is right else t, k, metric, exclude_self)
    d = d.groupBy(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(parts)).alias("_part")).applyInPandas(bound, "_id long, _v array<double>, _tau double")
    blocks = n_blocks or _knn_blocks(n, slots)
    d = d.withColumn("_blk", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumn("_lb", F.least("_blk", "_o")).withColumn("_rb", F.greatest("_blk", "_o")).drop("_o")
    d = d.withColumn("_pair", (F.col("_rb") * (F.col("_rb") + 1) / 2 + F.col("_lb")).cast("int"))  # each has a task of its own: by hash some got several
    return d.repartitionById(blocks * (blocks + 1) // 2, "_pair").groupBy("_pair").applyInPandas(tile, PAIR_SCHEMA)


def knn_join(df: DataFrame, id_col: str, vec: str, k: int, metric: str = "euclidean",
             n_blocks: int | None = None, exclude_self: bool = True, pruned: bool | None = None, unit_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Exact k nearest neighbours of every row (self excluded): rows
    (src, dst, dist, rank), exactly min(k, n-1) per src, ties by dst id.

    ``pruned``: the partitioned search (True), the block pairs (False), or by size and structure."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    use = _use_pruned(df, vec, metric, n_blocks, pruned)
    if use and (pruned or _has_structure(df, id_col, vec, metric, k)):
        pairs = _pruned_knn(df, id_col, vec, k, metric, exclude_self, unit_rows)
    else:
        pairs = _tiled_knn(df, id_col, vec, k, metric, n_blocks, exclude_self)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def radius_join(df: DataFrame, id_col: str, vec: str, eps: float, metric: str = "euclidean",
                n_blocks: int | None = None, exclude_self: bool = True, strict: bool = True,
                pruned: bool | None = None, unit_rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """All pairs closer than ``eps`` (output-sensitive; no partner cap)."""
    if _use_pruned(df, vec, metric, n_blocks, pruned):
        return _pruned_radius(df, id_col, vec, eps, metric, exclude_self, strict, unit_rows)
    return _blocks(df, id_col, vec, n_blocks).groupBy("_lb", "_rb").applyInPandas(
        _tile_fn(eps, metric, strict, exclude_self), PAIR_SCHEMA)


def adaptive_join(df: DataFrame, id_col: str, vec: str, k: int = 20, eps: float = 0.5,
                  metric: str = "euclidean", n_blocks: int | None = None, pruned: bool | None = None) -> DataFrame:
    """kNN ∩ (distance < eps): the k nearest, then the threshold."""
    return knn_join(df, id_col, vec, k, metric, n_blocks, pruned=pruned).filter(F.col("dist") < eps)


def knn_graph(df: DataFrame, id_col: str, vec: str, k: int, symmetric: bool = False,
              metric: str = "euclidean", n_blocks: int | None = None) -> DataFrame:
    """Directed kNN edges (src -> its neighbours), or their symmetric closure."""
    e = knn_join(df, id_col, vec, k, metric, n_blocks).select("src", "dst")
    if symmetric:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return e


def _pair_sum_fn(margin: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if left.empty or right.empty:
            return pd.DataFrame({"s": [0.0], "n": [0]})
        lv = np.stack(left["_v"].to_numpy())
        rv = np.stack(right["_v"].to_numpy())
        ln = np.linalg.norm(lv, axis=1, keepdims=True)
        rn = np.linalg.norm(rv, axis=1, keepdims=True)
        cos = (lv / np.where(ln == 0, 1.0, ln)) @ (rv / np.where(rn == 0, 1.0, rn)).T
        other = left["_lab"].to_numpy()[:, None] != right["_lab"].to_numpy()[None, :]
        times = 1 if left is right else 2  # ordered pairs
        return pd.DataFrame({"s": [times * float(np.maximum(cos - margin, 0.0)[other].sum())], "n": [times * int(other.sum())]})
    return fn


def negative_pair_term(df: DataFrame, id_col: str, vec: str, label: str, margin: float,
                       n_blocks: int | None = None, over_all: bool = False) -> DataFrame:
    """mean over ordered pairs with different labels (``over_all``: sum over
    them by the number of all ordered pairs) of relu(cos - margin): block
    tiles each emit one (sum, count) row, never the pairs."""
    parts = _blocks(df, id_col, vec, n_blocks, label).groupBy("_lb", "_rb").applyInPandas(_pair_sum_fn(margin), "s double, n long")
    if over_all:
        n = df.count()
        return parts.agg((F.sum("s") / F.lit(float(n) * n)).alias("neg_loss"))
    return parts.agg((F.sum("s") / F.sum("n")).alias("neg_loss"))


def _ship_by_value() -> None:
    """Functions of this module run inside Python workers; pickle them by
    value so executors need no installed copy of the package."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
