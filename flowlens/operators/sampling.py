"""Class-aware exact sampling, reduction and splits.

Every sampler has the same shape:
  1. ``groupBy(class).count()``   — partial aggregation, a few rows out;
  2. a quota per class/stratum    — column expressions on that small table;
  3. ``take_per_group``           — exactly n rows per group in the shared
     ``md5(seed:key)`` order, skew-safe (see numbering.py).
Nothing is sampled per chunk or per partition, so the result does not
depend on how the input is split, and it is exactly reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import dense_index, hash_rank_flag, mark_first_n, take_per_group
from .. import functions as fn


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))


def _with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.sum("cnt").over(Window.partitionBy()))


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0)


# SMP-1 -----------------------------------------------------------------------
def sample_by_rate(df: DataFrame, col: str, rates: dict[str, float], key: str,
                   keep_below: int = 1000, seed: int = 42) -> DataFrame:
    """Fixed per-class rates; classes below ``keep_below`` rows kept whole;
    classes without a rate dropped.  n = round-half-even(rate * count)."""
    rate_map = fn.literal_map({k: float(v) for k, v in rates.items()})
    kept = df.filter(F.col(col).isin(list(rates)))

    def quota(c):
        return c.select(col, F.when(F.col("cnt") < keep_below, F.col("cnt"))
                        .otherwise(round_half_even(F.col("cnt") * rate_map[F.col(col)])).cast("bigint").alias("n"))
    return take_per_group(kept, [col], quota, key, seed)


# SMP-2 / SMP-3 -----------------------------------------------------------------
TIERS = {
    # tier set: (rare share, uncommon share, rare rate, uncommon rate, common factor)
    "1/10": (0.01, 0.10, lambda r: F.greatest(F.lit(0.5), F.lit(5 * r)), lambda r: F.least(F.lit(1.0), F.lit(2 * r)), 0.9),
    "0.1/5": (0.001, 0.05, lambda r: F.greatest(F.lit(0.5), F.lit(10 * r)), lambda r: F.least(F.lit(1.0), F.lit(4 * r)), 0.9),
}


def rarity_rates(df: DataFrame, col: str, r: float, tiers: str = "1/10") -> DataFrame:
    """(class, cnt, total, rate) by the 3-tier rarity rule; rate capped at 1."""
    return _rarity_from_counts(_counts(df, [col]), r, tiers)


def _rarity_from_counts(counts: DataFrame, r: float, tiers: str) -> DataFrame:
    rare, unc, rr, ur, cf = TIERS[tiers]
    c = _with_total(counts)
    rate = (F.when(F.col("cnt") < F.col("total") * rare, rr(r))
             .when(F.col("cnt") < F.col("total") * unc, ur(r))
             .otherwise(F.lit(cf * r)))
    return c.withColumn("rate", F.least(rate, F.lit(1.0)))


def reduce_by_rarity(df: DataFrame, col: str, r: float, key: str, tiers: str = "1/10",
                     keep_below: int = 1000, seed: int = 42) -> DataFrame:
    def quota(c):
        return _rarity_from_counts(c, r, tiers).select(
            col, F.when(F.col("cnt") < keep_below, F.col("cnt"))
                  .otherwise(round_half_even(F.col("cnt") * F.col("rate"))).cast("bigint").alias("n"))
    return take_per_group(df, [col], quota, key, seed)


# SMP-4 ---------------------------------------------------------------------------
def combine_rates(df: DataFrame, col: str, r: float) -> DataFrame:
    """4-tier rates of the combined reduction (thresholds on the combined N)."""
    return _combine_rates_from_counts(_counts(df, [col]), r)


def _combine_rates_from_counts(counts: DataFrame, r: float) -> DataFrame:
    b = max(0.01, r)
    c = _with_total(counts)
    common = max(0.01, 0.9 * b if r <= 0.1 else b)
    rate = (F.when(F.col("cnt") < F.col("total") * 0.001, F.lit(min(1.0, max(0.9, b * 10))))
             .when(F.col("cnt") < F.col("total") * 0.01, F.lit(min(0.8, max(0.1, b * 5))))
             .when(F.col("cnt") < F.col("total") * 0.05, F.lit(min(0.6, max(0.05, b * 2.5))))
             .otherwise(F.lit(common)))
    return c.withColumn("rate", rate)


def combine_reduce(df: DataFrame, col: str, r: float, key: str, source_col: str = "dataset_source",
                   seed: int = 42, renumber: str | None = None) -> DataFrame:
    """Rates by class tier, exact n = max(1, ceil(rate * stratum)) per
    (class, source) stratum; whole stratum when n >= its size.  The kept rows
    are numbered anew in ``renumber`` (0..n-1 in key order) when given."""
    def quota(strata):
        classes = strata.groupBy(col).agg(F.sum("cnt").alias("cnt"))
        rates = _combine_rates_from_counts(classes, r).select(col, "rate")
        return strata.join(F.broadcast(rates), col).select(
            col, source_col, F.greatest(F.lit(1), F.ceil(F.col("cnt") * F.col("rate"))).cast("bigint").alias("n"))
    kept = take_per_group(df, [col, source_col], quota, key, seed)
    return dense_index(kept.withColumnRenamed(renumber, "__old") if renumber in df.columns else kept,
                       ["__old" if renumber == key else key], renumber).drop("__old") if renumber else kept


# SMP-5 / SMP-6 --------------------------------------------------------------------
def cap_proportional(df: DataFrame, col: str, key: str, total: int = 50000, large_min: int = 1000,
                     strict: bool = False, at_least: int = 1, seed: int = 42) -> DataFrame:
    """Large classes (>= large_min, or > large_min when ``strict``) scaled by
    min(1, total / their sum), n = max(at_least, trunc(count*factor)); small
    classes kept whole."""
    def quota(c):
        is_large = (F.col("cnt") > large_min) if strict else (F.col("cnt") >= large_min)
        c = c.withColumn("_large", is_large)
        big = F.sum(F.when(F.col("_large"), F.col("cnt"))).over(Window.partitionBy())
        c = c.withColumn("_factor", F.least(F.lit(1.0), F.lit(float(total)) / big))
        n = F.greatest(F.lit(at_least), F.least(F.floor(F.col("cnt") * F.col("_factor")), F.col("cnt")))
        return c.select(col, F.when(F.col("_large"), n).otherwise(F.col("cnt")).cast("bigint").alias("n"))
    return take_per_group(df, [col], quota, key, seed)


# SMP-7 / SMP-10 allocation ----------------------------------------------------------
def allocate(counts: DataFrame, col: str, n_total: Column) -> DataFrame:
    """Split ``n_total`` over classes by share: floor, then the leftover one by
    one to the largest remainders (ties by class name asc)."""
    c = _with_total(counts).withColumn("_n", n_total)
    c = c.withColumn("_exact", F.col("_n") * F.col("cnt") / F.col("total")) \
         .withColumn("_fl", F.floor("_exact")) \
         .withColumn("_rem", F.col("_exact") - F.col("_fl"))
    w = Window.partitionBy()
    c = c.withColumn("_left", F.col("_n") - F.sum("_fl").over(w)) \
         .withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(col))))
    return c.select(col, "cnt", (F.col("_fl") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("n"))


def fixed_subset(df: DataFrame, n: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """n rows stratified by ``label``; when the smallest class has fewer than
    n/k rows the subset is a plain hash-order sample of n rows."""
    few = _counts(df, [label]).agg((F.min("cnt") * F.count(F.lit(1)) < F.lit(n)).alias("few")).first()["few"]
    if few:
        return hash_rank_flag(df, n, key, seed).filter("_in").drop("_in")
    return take_per_group(df, [label], lambda cc: allocate(cc, label, F.lit(n)).select(label, "n"), key, seed)


# SMP-8 ------------------------------------------------------------------------------
def sample_by_group(df: DataFrame, col: str, frac: float, key: str, seed: int = 42) -> DataFrame:
    def quota(c):
        return c.select(col, round_half_even(F.col("cnt") * frac).cast("bigint").alias("n"))
    return take_per_group(df, [col], quota, key, seed)


# SMP-9 ------------------------------------------------------------------------------
def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Uniform n-row sample: the first n rows of the hash order."""
    return hash_rank_flag(df, n, key, seed).filter("_in").drop("_in")


# SMP-10 / SMP-11 --------------------------------------------------------------------
def split(df: DataFrame, key: str, strata: list[str] | None = None, test_frac: float = 0.3,
          seed: int = 42, out: str = "split", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Train/test split.  n_test = ceil(test_frac * N); stratified splits
    allocate it over strata by largest remainder and take each stratum's
    first rows in hash order as test."""
    if strata:
        skey = fn.stratum_key(*strata)

        def quota(c):
            return allocate(c, "_s", F.ceil(F.sum("cnt").over(Window.partitionBy()) * test_frac)).select("_s", "n")
        marked = mark_first_n(df.withColumn("_s", skey), ["_s"], quota, key, seed, "_t").drop("_s")
    else:
        def quota(c):
            return c.select(F.ceil(F.col("cnt") * test_frac).cast("bigint").alias("n"))
        marked = mark_first_n(df, [], quota, key, seed, "_t")
    return marked.withColumn(out, F.when(F.col("_t"), F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_t")


def split3(df: DataFrame, key: str, strata: list[str] | None = None, val_frac: float = 0.15,
           test_frac: float = 0.15, seed: int = 42, out: str = "split") -> DataFrame:
    """70/15/15: split off val+test, then halve that part (nested, like the
    reference), each step stratified when ``strata`` is given."""
    first = split(df, key, strata, val_frac + test_frac, seed, "_p", ("train", "rest"))
    train = first.filter(F.col("_p") == "train").drop("_p").withColumn(out, F.lit("train"))
    rest = first.filter(F.col("_p") == "rest").drop("_p")
    second = split(rest, key, strata, test_frac / (val_frac + test_frac), seed + 1, out, ("val", "test"))
    return train.unionByName(second)


# SMP-13 ------------------------------------------------------------------------------
def kfold(df: DataFrame, key: str, k: int, strata: list[str] | None = None, seed: int = 42,
          out: str = "fold") -> DataFrame:
    """Fold = rank within stratum (hash order) mod k."""
    by = strata or []
    d = df.withColumn("_u", fn.hash_order(F.col(key), seed))
    ranked = dense_index(d, ["_u", key], "_r", by=by)
    return ranked.withColumn(out, (F.col("_r") % k).cast("int")).drop("_u", "_r")


# SMP-12 ------------------------------------------------------------------------------
def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A full shuffle only matters when an ordered output is requested."""
    return df.orderBy(fn.hash_order(F.col(key), seed), F.col(key))
