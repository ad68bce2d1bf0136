"""Row numbering and exact per-group selection (IDX-1, IDX-2, IDX-3 helpers).

No operator here moves all rows, or all rows of one group, into one task:

* ``dense_index`` and ``running_sum`` let the engine range-partition and sort
  the rows by the key, store that once (as Parquet, so partition
  numbers and positions cannot change on recomputation), and add the counts
  or sums of the partitions before: a table of one row per partition and group.
* ``exact_quantile`` counts rows per value first, so a frequent value is one
  row, and finds two order statistics by prefix sums over the counts; of many
  rows it sorts only the values near the quantile.
* ``mark_first_n`` keeps/marks the first ``n`` rows of every group in the
  shared hash order.  It histograms the order into 65,536 buckets per group
  (partially aggregated), finds the one boundary bucket per group on that
  small histogram and in it the last hash that is in; the rows are then
  marked by comparison with that hash, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_order


def _ranged(df: DataFrame, keys: list[str], partitions: int | None = None, drop: list[str] | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` and stored, with ``__pid``
    (partitions in key order) and ``__pos`` (0-based place within one); columns of
    ``drop`` only order the rows and are not stored."""
    from ..session import stored
    d = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    place = F.monotonically_increasing_id()
    return stored(d.sortWithinPartitions(*keys)
                  .withColumn("__pid", F.shiftright(place, 33))
                  .withColumn("__pos", place.bitwiseAND(F.lit((1 << 33) - 1))).drop(*(drop or [])))


def dense_index(df: DataFrame, order_cols: list[str], name: str = "flow_id",
                offset: int = 0, partitions: int | None = None,
                by: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank of each row by ``order_cols`` (+ offset),
    within each group of ``by`` when given; columns of ``drop`` are left out.

    ``order_cols`` must be unique per row (carry a content key such as
    ``flow_key``); the result then equals
    ``row_number() OVER ([PARTITION BY by] ORDER BY ...) - 1``.

    A row's rank is its place in its partition, less the place where its
    group begins there, plus the group's rows in earlier partitions.
    """
    by = list(by or [])
    d = _ranged(df, by + list(order_cols), partitions, drop)
    counts = d.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("_cnt"), F.min("__pos").alias("_first"))
    w = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__pid").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                            (F.coalesce(F.sum("_cnt").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    on = F.col("__pid") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    # one row per partition (and group that occurs in it): broadcast only without free groups
    out = d.join(offsets if by else F.broadcast(offsets), on)
    return out.withColumn(name, (F.col("_off") + F.col("__pos") + F.lit(offset)).cast("bigint")) \
              .drop("__pid", "__pos", "_p", "_off", *[f"_by{i}" for i in range(len(by))])


def _boundaries(hist: DataFrame, by: list[str], quota: DataFrame, n_col: str) -> DataFrame:
    """Per group: boundary bucket ``_bstar`` and rows still needed there
    (computed on the bucket histogram: at most 65,536 rows per group)."""
    from .encode import _attach_one_row
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    q = quota.select(*by, F.col(n_col).alias("_n"))
    h = hist.join(F.broadcast(q), by) if by else _attach_one_row(hist, q)
    h = h.withColumn("_before", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    cross = h.filter((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_bc") >= F.col("_n")))
    b = cross.select(*by, F.col("_b").alias("_bstar"), (F.col("_n") - F.col("_before")).alias("_need"))
    # groups whose quota is 0 keep nothing: boundary below every bucket
    zero = quota.filter(F.col(n_col) <= 0).select(*by, F.lit("").alias("_bstar"), F.lit(0).cast("bigint").alias("_need"))
    return b.unionByName(zero)


def mark_first_n(df: DataFrame, by: list[str], quota, key, seed: int = 42,
                 flag: str = "_in", n_col: str = "n") -> DataFrame:
    """Add boolean ``flag``: row is among the first ``n`` of its group when
    the group is ordered by ``md5(seed:key)`` (ties by key).

    ``quota`` is a DataFrame with one row per group (``by`` columns +
    ``n_col``), or a function from the group counts (``by`` + ``cnt``) to such
    a DataFrame; the counts then come from the bucket histogram, so the input
    is not scanned an extra time.  Groups missing from the quota keep all rows.

    Two passes over group and key alone find, for each group, the last hash
    that is in (one row per group, stored); the third marks rows map-side.
    """
    from ..session import cut_lineage
    key_col = F.col(key) if isinstance(key, str) else key
    slim = df.select(*by, key_col.cast("string").alias("_k"), hash_order(key_col, seed).alias("_u")) \
             .withColumn("_b", F.substring("_u", 1, 4))
    hist = slim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    if callable(quota):
        quota = quota(hist.groupBy(*by).agg(F.sum("_bc").alias("cnt")))
    from .encode import _attach_one_row
    bnd = cut_lineage(_boundaries(hist, by, quota, n_col))
    if by:
        edge = slim.join(F.broadcast(bnd), by)  # one row per group
    else:
        edge = _attach_one_row(slim, bnd.agg(F.first("_bstar").alias("_bstar"), F.first("_need").alias("_need")))
    edge = edge.filter(F.col("_b") == F.col("_bstar"))
    w = Window.partitionBy(*by).orderBy("_u", "_k")
    last = edge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.col("_need")).select(*by, F.struct("_u", "_k").alias("_cut"))
    none = bnd.filter(F.col("_need") <= 0).select(*by, F.struct(F.lit("").alias("_u"), F.lit("").alias("_k")).alias("_cut"))
    cut = cut_lineage(last.unionByName(none))
    own = F.struct(hash_order(key_col, seed).alias("_u"), key_col.cast("string").alias("_k"))
    if by:
        j = df.withColumn("_own", own).join(F.broadcast(cut), by, "left")
    else:
        j = _attach_one_row(df.withColumn("_own", own), cut.agg(F.first("_cut").alias("_cut")))
    return j.withColumn(flag, F.col("_cut").isNull() | (F.col("_own") <= F.col("_cut"))).drop("_own", "_cut")


def take_per_group(df: DataFrame, by: list[str], quota, key, seed: int = 42,
                   n_col: str = "n") -> DataFrame:
    """Exactly ``n`` rows per group (whole group when n >= its size)."""
    return mark_first_n(df, by, quota, key, seed, "_in", n_col).filter("_in").drop("_in")


#: Rows that one task holds for a top-n pass.
TOP_ROWS = 100_000


def hash_rank_flag(df: DataFrame, n: int | Column, key, seed: int = 42, flag: str = "_in") -> DataFrame:
    """Global variant: first ``n`` rows of the whole table in hash order.  A small number of them is found by one top-n pass
    over the keys instead of a histogram and the ranking of a bucket."""
    if isinstance(n, int) and 0 < n <= TOP_ROWS:
        key_col = F.col(key) if isinstance(key, str) else key
        own = F.struct(hash_order(key_col, seed).alias("_u"), key_col.cast("string").alias("_k"))
        first = df.select(own.alias("_own")).orderBy("_own").limit(n)
        last = first.agg(F.count(F.lit(1)).alias("n"), F.max("_own").alias("cut")).first()
        if last["n"] < n:
            return df.withColumn(flag, F.lit(True))
        cut = F.struct(F.lit(last["cut"]["_u"]).cast("string").alias("_u"), F.lit(last["cut"]["_k"]).cast("string").alias("_k"))
        return df.withColumn(flag, own <= cut)
    def quota(c):
        return c.select(F.lit(n).cast("bigint").alias("n"))
    return mark_first_n(df, [], quota, key, seed, flag)


def running_sum(df: DataFrame, order_cols: list[str], cols: list[str], suffix: str = "_cum",
                inclusive: bool = True, partitions: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Prefix sums of ``cols`` in ``order_cols`` order (unique within each
    group of ``by``): summed inside each range partition by one window and
    offset by the totals of the earlier partitions (at most partitions x
    groups rows)."""
    by = list(by or [])
    d = _ranged(df, by + list(order_cols), partitions)
    tot = d.groupBy("__pid", *by).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cols)])
    wb = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("__pid", *by, *[F.coalesce(F.sum(f"_t{i}").over(wb), F.lit(0)).alias(f"_o{i}") for i in range(len(cols))])
    frame = Window.partitionBy("__pid", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = d.join(off if by else F.broadcast(off), ["__pid"] + by)
    for i, c in enumerate(cols):
        out = out.withColumn(c + suffix, F.col(f"_o{i}") + F.coalesce(F.sum(c).over(frame), F.lit(0)))
    return out.drop("__pid", "__pos", *[f"_o{i}" for i in range(len(cols))])


def carry_known(df: DataFrame, by: list[str], order_cols: list[str], value: str, before: str, after: str,
                partitions: int | None = None) -> DataFrame:
    """Add the last known (non-null) ``value`` at or before each row and the
    first at or after it, in ``order_cols`` order within each group of ``by``.

    Inside a range partition by windows; over its borders by one row for each
    partition and group with the first and last value known there."""
    d = _ranged(df, by + list(order_cols), partitions)
    known = F.col(value).isNotNull()
    ends = d.groupBy("__pid", *by).agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col("__pos"))).alias("_last"),
                                       F.min_by(F.when(known, F.col(value)), F.when(known, F.col("__pos"))).alias("_first"))
    up = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("__pid")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__pid", *by, F.last("_last", ignorenulls=True).over(up).alias("_carried"), F.last("_first", ignorenulls=True).over(down).alias("_coming"))
    left = Window.partitionBy("__pid", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("__pid", *by).orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(ends, ["__pid"] + by)
    out = out.withColumn(before, F.coalesce(F.last(value, ignorenulls=True).over(left), F.col("_carried")))
    out = out.withColumn(after, F.coalesce(F.last(value, ignorenulls=True).over(right), F.col("_coming")))
    return out.drop("__pid", "__pos", "_carried", "_coming")


#: Rows from which ``exact_quantiles`` looks near the quantiles only; 1 / the rank error of its sketch.
BRACKET_ABOVE, BRACKET_ACCURACY = 200_000, 10_000


def _brackets(v: DataFrame, n: int, qs: list[float]) -> list[tuple[float, float, int, int]] | None:
    """For each quantile (low, high, rows below low, rows below low in any bracket): a range of ``_v`` that holds its two ranks.
    None if the sketch missed one."""
    off = 2 / BRACKET_ACCURACY
    at = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-off, off)]
    ends = v.agg(F.percentile_approx("_v", at, BRACKET_ACCURACY).alias("p")).first()["p"]
    pairs = list(zip(ends[::2], ends[1::2]))
    inside = F.lit(False)
    for a, b in pairs:
        inside = inside | F.col("_v").between(F.lit(a), F.lit(b))
    found = v.agg(*[F.count_if(c).alias(f"{k}{i}") for i, (a, b) in enumerate(pairs)
                    for k, c in (("below", F.col("_v") < F.lit(a)), ("before", inside & (F.col("_v") < F.lit(a))), ("upto", F.col("_v") <= F.lit(b)))]).first()
    for i, q in enumerate(qs):
        h = (n - 1) * float(q)
        if not (found[f"below{i}"] <= math.floor(h) and math.ceil(h) < found[f"upto{i}"]):
            return None
    return [(a, b, found[f"below{i}"], found[f"before{i}"]) for i, (a, b) in enumerate(pairs)]


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    """One row: ``quantiles``, the linear-interpolation quantiles of ``col`` at ``qs`` (NumPy/Spark ``percentile``
    semantics; nulls ignored).  All of them come from one pass of prefix sums over the counts per distinct value.

    Above BRACKET_ABOVE rows only the values near the quantiles are counted and sorted: a sketch gives a bracket around
    each, the rows below it are counted, and a bracket that does not hold the wanted ranks is replaced by all values."""
    from ..session import forget, stored
    v = stored(df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    n = v.count()
    brackets = _brackets(v, n, qs) if n > BRACKET_ABOVE else None
    near = v
    if brackets:
        inside = F.lit(False)
        for a, b, _, _ in brackets:
            inside = inside | F.col("_v").between(F.lit(a), F.lit(b))
        near = v.filter(inside)
    c = running_sum(near.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")), ["_v"], ["_c"], suffix="_up").withColumn("_n", F.lit(n))
    forget(v)
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * F.lit(float(q))
        up, here = F.col("_c_up"), F.lit(True)
        if brackets:
            a, b, below, before = brackets[i]
            up, here = up + F.lit(below - before), F.col("_v").between(F.lit(a), F.lit(b))
        holds = lambda r: here & (up - F.col("_c") <= r) & (r < up)  # noqa: B023, E731
        aggs += [F.max(F.when(holds(F.floor(h)), F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(h)), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(h - F.floor(h)).alias(f"_f{i}")]
    return c.agg(*aggs).select(F.array(*[F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(qs))]).alias("quantiles"))


def exact_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """One row: the linear-interpolation quantile of ``col`` from two exact order statistics (``exact_quantiles``)."""
    return exact_quantiles(df, col, [q]).select(F.col("quantiles")[0].alias("quantile"))
