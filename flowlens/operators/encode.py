"""Feature encoding.

Fitted state is a DataFrame (one row per category, or one row of statistics)
joined into the transform; Spark broadcasts it where its size allows.  Nothing
fitted passes through the driver except, for dense one-hot columns, the sorted
category list that fixes the output schema (``one_hot_sparse`` has no list).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn


# AGG-4 ---------------------------------------------------------------------
def fit_class_map(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """Sorted distinct values -> 0..k-1 (label encoding).  For classes; a column
    with many values (addresses) is numbered by ``label_encode_all``."""
    d = df.select(F.col(col).alias("name")).distinct()
    return d.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias(code))


# JN-1 ----------------------------------------------------------------------
def apply_class_map(df: DataFrame, cmap: DataFrame, col: str, out: str,
                    code: str = "code", default=None) -> DataFrame:
    """Dictionary lookup as a left join with a default for unmatched keys."""
    m = cmap.select(F.col("name").alias("_name"), F.col(code).alias("_code"))
    j = df.join(m, df[col].eqNullSafe(m["_name"]), "left")
    val = F.col("_code") if default is None else F.coalesce(F.col("_code"), F.lit(default))
    return j.withColumn(out, val).drop("_name", "_code")


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str, default=None) -> DataFrame:
    m = dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v"))
    j = df.join(m, df[key] == m["_k"], "left")
    val = F.col("_v") if default is None else F.coalesce(F.col("_v"), F.lit(default))
    return j.withColumn(out, val).drop("_k", "_v")


# AGG-17 / ENC-3 --------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std per column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(F.col(f"`{c}`").cast("double")).alias(f"{c}__mean"))
        sd = F.stddev_pop(F.col(f"`{c}`").cast("double"))
        aggs.append(F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd).alias(f"{c}__std"))
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / std with the one-row fitted statistics broadcast."""
    out = _attach_one_row(df, stats)
    for c in cols:
        out = out.withColumn(c + suffix, (F.col(f"`{c}`").cast("double") - F.col(f"`{c}__mean`")) / F.col(f"`{c}__std`"))
    return out.drop(*[x for x in stats.columns])


def _attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (fitted statistics, counts) to
    every row as a scalar subquery: Spark runs the one-row plan once and
    substitutes the value, so no join (and no nested-loop join) is planned."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")).scalar()
    return df.withColumn("_row", packed).select("*", *[F.col("_row").getField(c).alias(c) for c in cols]).drop("_row")


# ENC-1 / ENC-2 ---------------------------------------------------------------
def fit_categories(df: DataFrame, cols: list[str], max_categories: int = 10000) -> dict[str, list]:
    """Sorted distinct values per column.  This decides the output schema
    of dense one-hot columns, so it is the one place a (small, checked) list
    comes to the driver; columns with more values take ``one_hot_sparse``."""
    out = {}
    for c in cols:
        d = df.select(F.col(f"`{c}`").alias("v")).distinct()
        vals = [r["v"] for r in d.orderBy("v").limit(max_categories + 1).collect()]
        if len(vals) > max_categories:
            raise ValueError(f"column {c} has more than {max_categories} categories: use one_hot_sparse")
        out[c] = vals
    return out


def one_hot(df: DataFrame, categories: dict[str, list], drop_source: bool = True,
            prefix_sep: str = "_", null_token: str | None = None) -> DataFrame:
    """0/1 int columns ``col_value`` in sorted order; values not in the
    fitted list (unseen at transform time) give all zeros."""
    out = df
    new_cols = []
    for c, vals in categories.items():
        for v in vals:
            if v is None:
                continue
            new_cols.append((F.col(f"`{c}`").cast("string") == F.lit(str(v))).cast("int").alias(f"{c}{prefix_sep}{v}"))
    keep = [F.col(f"`{x}`") for x in df.columns if not (drop_source and x in categories)]
    return out.select(*keep, *new_cols)


def one_hot_sparse(train: DataFrame, df: DataFrame, cols: list[str], suffix: str = "_vec") -> DataFrame:
    """One sparse 0/1 vector per column (``StringIndexer`` and ``OneHotEncoder``): any number of categories, places in
    sorted order; nulls and values not in ``train`` give the empty vector."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    text = [F.col(f"`{c}`").cast("string").alias(f"_t_{c}") for c in cols]
    ix = StringIndexer(inputCols=[f"_t_{c}" for c in cols], outputCols=[f"_i_{c}" for c in cols], stringOrderType="alphabetAsc",
                       handleInvalid="keep").fit(train.select(*text))
    with_ix = ix.transform(df.select("*", *text))
    # unseen values and nulls have the index past the last label; as the dropped last place they give the empty vector
    fitted = OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[c + suffix for c in cols], dropLast=True).fit(with_ix)
    return fitted.transform(with_ix).drop(*[f"_t_{c}" for c in cols], *[f"_i_{c}" for c in cols])


# ENC-4 -------------------------------------------------------------------------
def fit_target_encoder(df: DataFrame, cols: list[str], y: str, min_samples_leaf: int = 20,
                       smoothing: float = 10.0) -> DataFrame:
    """Long table (column, value, enc) of smoothed class means:
    enc = prior*(1-l) + mean*l, l = 1/(1+exp(-(n-k)/f)).  One row per
    (column, category) plus a prior row (value null) for unseen values."""
    prior = df.agg(F.avg(F.col(y).cast("double")).alias("_prior"))
    parts = []
    for c in cols:
        g = df.groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("_n"), F.avg(F.col(y).cast("double")).alias("_m"))
        parts.append(g.withColumn("column", F.lit(c)))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    enc = _attach_one_row(stats, prior)
    # single-member categories fall back to the prior (category_encoders rule)
    enc = enc.select("column", "value", F.when(F.col("_n") == 1, F.col("_prior"))
                     .otherwise(F.col("_prior") * (F.lit(1.0) - lam) + F.col("_m") * lam).alias("enc"),
                     "_prior")
    return enc


def apply_target_encoder(df: DataFrame, enc: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    out = df
    prior = enc.select(F.max("_prior").alias("_prior_all"))
    out = _attach_one_row(out, prior)
    for c in cols:
        m = enc.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("enc").alias(f"_e_{c}"))
        out = out.join(m, F.col(f"`{c}`").cast("string") == F.col(f"_v_{c}"), "left") \
                 .withColumn(c + suffix, F.coalesce(F.col(f"_e_{c}"), F.col("_prior_all"))) \
                 .drop(f"_v_{c}", f"_e_{c}")
    return out.drop("_prior_all")


# ENC-5 ---------------------------------------------------------------------------
def label_encode_all(df: DataFrame, cols: list[str] | None = None, suffix: str = "") -> DataFrame:
    """Every text column replaced by the rank of its value among the sorted
    distinct values of that column."""
    from .adapters import split_by_type
    from .numbering import dense_index
    if cols is None:
        _, cols = split_by_type(df)
    out = df
    for c in cols:
        values = df.select(F.col(c).alias("name")).distinct()
        cmap = dense_index(values, ["name"], "code").withColumn("code", F.col("code").cast("int"))
        out = apply_class_map(out, cmap, c, c + suffix if suffix else "_enc").drop(*([] if suffix else [c]))
        if not suffix:
            out = out.withColumnRenamed("_enc", c)
    return out


# ENC-7 ---------------------------------------------------------------------------
def hash_matrix(rows: int, cols: int, seed: int, lo: float = 0.0, hi: float = 1.0) -> list[list[float]]:
    """Deterministic pseudo-random matrix (md5 of 'seed:i:j'), entries in [lo,hi)."""
    import hashlib
    out = []
    for i in range(rows):
        r = []
        for j in range(cols):
            h = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:13], 16) / float(16 ** 13)
            r.append(lo + (hi - lo) * h)
        out.append(r)
    return out


def matvec(vec: Column, matrix: list[list[float]]) -> Column:
    """``vec · M`` for a literal matrix M (d_in x d_out)."""
    d_out = len(matrix[0])
    cols = []
    for j in range(d_out):
        colj = F.array(*[F.lit(float(matrix[i][j])) for i in range(len(matrix))])
        cols.append(fn.dot(vec, colj))
    return F.array(*cols)


def mix_features(df: DataFrame, vec: str, d: int, level: float = 0.5, seed: int = 42, out: str | None = None) -> DataFrame:
    """Random linear mixing ``X·C`` with ``C ~ U(level, 1)`` (d x d)."""
    c = hash_matrix(d, d, seed, level, 1.0)
    return df.withColumn(out or vec, matvec(F.col(vec), c))


# ENC-8 ---------------------------------------------------------------------------
def mask_features(df: DataFrame, vec: str, d: int, rate: float, seed: int = 42, out: str | None = None) -> DataFrame:
    """Set ``trunc(rate*d)`` feature positions (hash-chosen) to 0 in every row."""
    import hashlib
    k = int(math.floor(rate * d))
    order = sorted(range(d), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    masked = sorted(order[:k])
    mask_arr = F.array(*[F.lit(i) for i in masked]) if masked else F.array().cast("array<int>")
    return df.withColumn(out or vec, F.transform(F.col(vec), lambda v, i: F.when(F.array_contains(mask_arr, i), F.lit(0.0)).otherwise(v)))


# ENC-6 ---------------------------------------------------------------------------
class FeatureChain:
    """Impute -> (log1p) -> scale -> one-hot -> assemble, fitted on train and
    applied to any table.  Numeric gaps (and ±inf) take the train median,
    text gaps the train mode; the scaler is fitted on the transformed train
    columns; one-hot categories are the sorted train values (unseen -> 0)."""

    def __init__(self, numeric: list[str], categorical: list[str], log1p: bool = True, out: str = "features"):
        self.numeric, self.categorical, self.log1p, self.out = list(numeric), list(categorical), log1p, out

    def _num(self, df: DataFrame) -> DataFrame:
        from .. import functions as fnc
        out = df
        for c in self.numeric:
            out = out.withColumn(c, fnc.finite_or_null(c))
        return out

    def fit(self, train: DataFrame) -> "FeatureChain":
        from .cleaning import fit_median, fit_mode
        t = self._num(train)
        self.medians = fit_median(t, self.numeric) if self.numeric else None
        self.modes = [fit_mode(t, c) for c in self.categorical]
        prepared = self._prepare(t)
        self.stats = fit_scaler(prepared, self.numeric) if self.numeric else None
        self.categories = fit_categories(prepared, self.categorical) if self.categorical else {}
        return self

    def _prepare(self, df: DataFrame) -> DataFrame:
        out = df
        if self.medians is not None:
            out = _attach_one_row(out, self.medians)
            for c in self.numeric:
                v = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median"))
                out = out.withColumn(c, F.log1p(v) if self.log1p else v)
            out = out.drop(*self.medians.columns)
        for c, m in zip(self.categorical, self.modes):
            out = _attach_one_row(out, m).withColumn(c, F.coalesce(F.col(c), F.col(f"{c}__mode"))).drop(f"{c}__mode")
        return out

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        p = self._prepare(self._num(df))
        if self.stats is not None:
            p = apply_scaler(p, self.stats, self.numeric)
        parts = [F.col(c).cast("double") for c in self.numeric]
        for c, vals in self.categories.items():
            parts += [(F.col(c).cast("string") == F.lit(str(v))).cast("double") for v in vals if v is not None]
        return p.select(*keep, F.array(*parts).alias(self.out))
