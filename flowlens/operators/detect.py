"""Outlier detectors and supervised classifiers.

Fitting reduces the training table to a small model (histograms, cluster
centres, components) with distributed aggregations or ``pyspark.ml``; the
model is then applied as column expressions, so scoring is a map-only pass.
Thresholds are exact order statistics (``exact_quantile``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .encode import _attach_one_row
from .numbering import exact_quantile, exact_quantiles


# DET-1 -------------------------------------------------------------------------
def fit_hbos(train: DataFrame, cols: list[str], bins: int = 10) -> dict:
    """Equal-width histograms on [min, max] of the training data; density =
    count / (n * width).  The model is F x bins numbers."""
    mm = train.agg(F.count(F.lit(1)).alias("n"),
                   *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    n = mm["n"]
    lo = [mm[f"lo{i}"] for i in range(len(cols))]
    hi = [mm[f"hi{i}"] for i in range(len(cols))]
    width = [(h - l) / bins if h > l else 1.0 / bins for l, h in zip(lo, hi)]
    exprs = []
    for i, c in enumerate(cols):
        b = _bin(F.col(c).cast("double"), lo[i], hi[i], width[i], bins)
        exprs.append(F.struct(F.lit(i).alias("f"), b.alias("b")))
    counts = train.select(F.explode(F.array(*exprs)).alias("s")).groupBy("s.f", "s.b").agg(F.count(F.lit(1)).alias("c")).collect()
    dens = [[0.0] * bins for _ in cols]
    for r in counts:
        dens[r["f"]][r["b"]] = r["c"] / (n * width[r["f"]])
    return {"cols": list(cols), "bins": bins, "lo": lo, "hi": hi, "width": width, "density": dens}


def _bin(x: Column, lo: float, hi: float, width: float, bins: int) -> Column:
    raw = F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
    return F.when(x >= F.lit(hi), F.lit(bins - 1)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))


def hbos_score(df: DataFrame, model: dict, alpha: float = 0.1, tol: float = 0.5, out: str = "score") -> DataFrame:
    """score = -Σ log2(density + α); values beyond the fitted range by more
    than ``tol`` bins take the feature's lowest density."""
    terms = []
    for i, c in enumerate(model["cols"]):
        lo, hi, w, bins = model["lo"][i], model["hi"][i], model["width"][i], model["bins"]
        d = model["density"][i]
        x = F.col(c).cast("double")
        arr = F.array(*[F.lit(float(v)) for v in d])
        inside = F.element_at(arr, _bin(x, lo, hi, w, bins) + 1)
        dens = (F.when((x < F.lit(lo)) & (F.lit(lo) - x > F.lit(tol * w)), F.lit(float(min(d))))
                 .when((x > F.lit(hi)) & (x - F.lit(hi) > F.lit(tol * w)), F.lit(float(min(d))))
                 .otherwise(inside))
        terms.append(F.log2(dens + F.lit(alpha)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, -total)


# DET-5 ---------------------------------------------------------------------------
def threshold(train_scores: DataFrame, contamination: float, score: str = "score", tie: str = "flow_key") -> DataFrame:
    """One row: the (1 - contamination) quantile of the training scores."""
    return exact_quantile(train_scores, score, 1.0 - contamination).withColumnRenamed("quantile", "threshold")


def apply_threshold(df: DataFrame, thr: DataFrame, score: str = "score", out: str = "pred") -> DataFrame:
    return _attach_one_row(df, thr).withColumn(out, (F.col(score) > F.col("threshold")).cast("int")).drop("threshold")


def hbos(train: DataFrame, test: DataFrame, cols: list[str], bins: int = 10, contamination: float = 0.1,
         tie: str = "flow_key") -> DataFrame:
    m = fit_hbos(train, cols, bins)
    thr = threshold(hbos_score(train, m), contamination, tie=tie)
    return apply_threshold(hbos_score(test, m), thr)


# DET-2 -----------------------------------------------------------------------------
def _assemble(df: DataFrame, cols: list[str] | str, out: str = "features"):
    """The columns, or the elements of one array column, as a vector."""
    if isinstance(cols, str):
        from pyspark.ml.functions import array_to_vector
        return df.withColumn(out, array_to_vector(cols))
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def large_clusters(sizes: dict[int, int], alpha: float, beta: float) -> set[int]:
    """Clusters by size (largest first, ties by id); the boundary is the first
    place where the large ones hold the share ``alpha`` of the rows *and* the
    next one is ``beta`` times smaller; else the first where the share is
    reached; else where the ratio is."""
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    n, cum, share, ratio = sum(sizes.values()), 0, [], []
    for i, c in enumerate(order[:-1]):
        cum += sizes[c]
        share.append(cum >= alpha * n)
        ratio.append(sizes[c] >= beta * max(sizes[order[i + 1]], 1))
    for test in ([a and b for a, b in zip(share, ratio)], share, ratio):
        if True in test:
            return set(order[: test.index(True) + 1])
    return set(order)


def _distance(x: list[Column], point: list[float]) -> Column:
    """``fn.euclidean`` of columns and a constant point, term by term: compiled, where functions of arrays are not."""
    total = F.lit(0.0)
    for c, v in zip(x, point):
        total = total + (c - F.lit(float(v))) * (c - F.lit(float(v)))
    return F.sqrt(total)


def cblof_score(df: DataFrame, cols: list[str], centres: list[list[float]], large: set[int], out: str = "score") -> DataFrame:
    """Given the centres: distance to the own (nearest) centre if its cluster is large, else to the nearest large one."""
    x = [F.col(c).cast("double") for c in cols]
    d = F.array(*[_distance(x, cen) for cen in centres])
    own = F.array_position(d, F.array_min(d)) - 1
    nearest_large = F.array_min(F.array(*[d[c] for c in sorted(large)]))
    return df.withColumn(out, F.when(own.isin([int(c) for c in large]), F.array_min(d)).otherwise(nearest_large))


def fit_cblof(train: DataFrame, cols: list[str], k: int = 8, alpha: float = 0.9, beta: float = 5.0, seed: int = 42) -> dict:
    """k-means centres and the numbers of the large clusters."""
    from pyspark.ml.clustering import KMeans
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(_assemble(train, cols))
    sizes = {r["cluster"]: r["count"] for r in km.summary.predictions.groupBy("cluster").count().collect()}
    return {"cols": list(cols), "centres": [list(map(float, c)) for c in km.clusterCenters()], "large": large_clusters(sizes, alpha, beta), "sizes": sizes}


def cblof(train: DataFrame, test: DataFrame, cols: list[str], k: int = 8, contamination: float = 0.1,
          alpha: float = 0.9, beta: float = 5.0, seed: int = 42, tie: str = "flow_key") -> DataFrame:
    """Cluster-based local outlier factor: k-means, large and small clusters by ``large_clusters``, ``cblof_score``."""
    m = fit_cblof(train, cols, k, alpha, beta, seed)
    thr = threshold(cblof_score(train, cols, m["centres"], m["large"]), contamination, tie=tie)
    return apply_threshold(cblof_score(test, cols, m["centres"], m["large"]), thr)


# DET-3 ------------------------------------------------------------------------------
def pca_score(df: DataFrame, zcols: list[str], components: list[list[float]], weights: list[float], out: str = "score") -> DataFrame:
    """Given the components: the sum over them of the distance of the (standardized) row to the component's unit
    vector, divided by the component's share of the variance."""
    x = [F.col(c) for c in zcols]
    terms = [_distance(x, comp) / F.lit(float(max(w, 1e-12))) for comp, w in zip(components, weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def fit_pca(train: DataFrame, cols: list[str], n_components: int | None = None) -> dict:
    """Scaler statistics, components (unit vectors) of the standardized features and their shares of the variance."""
    from pyspark.ml.feature import PCA
    from .encode import apply_scaler, fit_scaler
    from ..session import cut_lineage
    st = cut_lineage(fit_scaler(train, cols))  # one row, read by every scoring job
    model = PCA(k=n_components or len(cols), inputCol="features", outputCol="_pc").fit(
        _assemble(apply_scaler(train, st, cols, "_z"), [c + "_z" for c in cols]))
    return {"cols": list(cols), "stats": st, "components": model.pc.toArray().T.tolist(), "shares": [float(v) for v in model.explainedVariance.toArray()]}


def pca_apply(df: DataFrame, model: dict) -> DataFrame:
    from .encode import apply_scaler
    zc = [c + "_z" for c in model["cols"]]
    return pca_score(apply_scaler(df, model["stats"], model["cols"], "_z"), zc, model["components"], model["shares"]).drop(*zc)


def pca_outlier(train: DataFrame, test: DataFrame, cols: list[str], n_components: int | None = None,
                contamination: float = 0.1, tie: str = "flow_key") -> DataFrame:
    """PCA outlier score on standardized features: weighted distances to the eigenvectors (``pca_score``)."""
    m = fit_pca(train, cols, n_components)
    thr = threshold(pca_apply(train, m), contamination, tie=tie)
    return apply_threshold(pca_apply(test, m), thr)


# DET-4 ------------------------------------------------------------------------------
def fit_forest(train: DataFrame, cols: list[str], trees: int = 50, sample: int = 256, seed: int = 42, tie: str = "flow_key") -> dict:
    """Isolation trees.  ``trees * sample`` rows are drawn once by hash rank
    and dealt to the trees in hash order (fewer rows: all of them, several
    times over with another hash); trees are grown in parallel with
    ``groupBy(tree).applyInPandas`` (a tree of 256 points is tiny)."""
    import numpy as np
    import pandas as pd
    from .numbering import dense_index
    from .sampling import sample_n

    drawn = sample_n(train.select(tie, *cols), trees * sample, tie, seed)
    ranked = dense_index(drawn.withColumn("_u", fn.hash_order(F.col(tie), seed)), ["_u", tie], "_r").drop("_u")
    n_drawn = ranked.count()
    if n_drawn >= trees * sample:
        picked = ranked.withColumn("tree", (F.col("_r") % trees).cast("int"))
    else:  # too few rows for disjoint draws: a window of consecutive ranks for each tree, wrapped around; at most trees * sample rows
        size = min(sample, n_drawn)
        slots = train.sparkSession.range(trees * size).select((F.col("id") % trees).cast("int").alias("tree"),
                                                              (F.floor(F.col("id") / trees) + (F.col("id") % trees) * F.lit(max(n_drawn // trees, 1))).alias("_p"))
        picked = slots.withColumn("_r", F.pmod(F.col("_p"), F.lit(max(n_drawn, 1)))).join(ranked, "_r")
    height = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        X = pdf[cols].to_numpy(dtype=float)
        nodes = []

        def build(idx, depth):
            me = len(nodes)
            nodes.append(None)
            if depth >= height or len(idx) <= 1 or np.all(X[idx].max(0) == X[idx].min(0)):
                nodes[me] = (t, me, -1, 0.0, -1, -1, len(idx))
                return me
            feats = np.where(X[idx].max(0) > X[idx].min(0))[0]
            f = int(rng.choice(feats))
            lo, hi = X[idx, f].min(), X[idx, f].max()
            s = float(rng.uniform(lo, hi))
            left = idx[X[idx, f] < s]
            right = idx[X[idx, f] >= s]
            li = build(left, depth + 1)
            ri = build(right, depth + 1)
            nodes[me] = (t, me, f, s, li, ri, len(idx))
            return me

        build(np.arange(len(X)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "size"])

    forest = picked.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, split double, left int, right int, size long")
    rows = forest.collect()   # trees x <= 2*sample nodes: bounded model
    model = {}
    for r in rows:
        model.setdefault(r["tree"], []).append(r)
    arrays = []
    for t in sorted(model):
        nodes = sorted(model[t], key=lambda r: r["node"])
        arrays.append(tuple(np.array([r[c] for r in nodes]) for c in ("feature", "split", "left", "right", "size")))
    return {"cols": list(cols), "trees": arrays, "sample": sample}


def forest_score(df: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """2 ** -(mean path length / expected length); the forest (trees x 2 * sample nodes) is broadcast, rows are scored in Arrow batches."""
    import numpy as np
    import pandas as pd
    bc = df.sparkSession.sparkContext.broadcast(model["trees"])
    sample = model["sample"]
    height = int(math.ceil(math.log2(max(sample, 2))))

    def c_factor(n):
        n = np.asarray(n, dtype=float)
        safe = np.maximum(n - 1, 1)
        return np.where(n <= 1, 0.0, 2.0 * (np.log(safe) + 0.5772156649) - 2.0 * (n - 1) / np.maximum(n, 1))

    cn = float(c_factor(sample))

    @F.pandas_udf("double")
    def iso_score(*series):
        X = np.column_stack([s.to_numpy(dtype=float) for s in series])
        n = len(X)
        rows_idx = np.arange(n)
        depth = np.zeros(n)
        for feat, split, left, right, size in bc.value:
            node = np.zeros(n, dtype=int)
            d = np.zeros(n)
            for _ in range(height + 1):
                f = feat[node]
                leaf = f < 0
                if leaf.all():
                    break
                go_left = X[rows_idx, np.where(leaf, 0, f)] < split[node]
                node = np.where(leaf, node, np.where(go_left, left[node], right[node]))
                d += ~leaf
            depth += d + c_factor(size[node])
        return pd.Series(2.0 ** (-(depth / len(bc.value)) / cn))

    return df.withColumn(out, iso_score(*[F.col(c).cast("double") for c in model["cols"]]))


def isolation_forest(train: DataFrame, test: DataFrame, cols: list[str], trees: int = 50, sample: int = 256,
                     contamination: float = 0.1, seed: int = 42, tie: str = "flow_key") -> DataFrame:
    m = fit_forest(train, cols, trees, sample, seed, tie)
    thr = threshold(forest_score(train, m), contamination, tie=tie)
    return apply_threshold(forest_score(test, m), thr)


# DET-6, any detector ------------------------------------------------------------------
# name -> fit(train, cols, parameter): a function that adds ``score``
DETECTORS = {
    "hbos": lambda train, cols, p: (lambda m: lambda df: hbos_score(df, m))(fit_hbos(train, cols, p)),
    "cblof": lambda train, cols, p: (lambda m: lambda df: cblof_score(df, cols, m["centres"], m["large"]))(fit_cblof(train, cols, p)),
    "pca": lambda train, cols, p: (lambda m: lambda df: pca_apply(df, m))(fit_pca(train, cols, p)),
    "forest": lambda train, cols, p: (lambda m: lambda df: forest_score(df, m))(fit_forest(train, cols, p)),
}
SWEEP_SCHEMA = "detector string, param int, grid_order int, contamination double, threshold double, macro_f1 double, error string"


def _macro_f1(tp: Column, fp: Column, positives: Column, negatives: Column) -> Column:
    """Mean F1 of the classes that occur as a label or a prediction, from the counts of class 1."""
    def f1(hit, predicted, real):
        return F.when(predicted + real > 0, 2.0 * hit / (predicted + real))
    one = f1(tp, tp + fp, positives)
    zero = f1(negatives - fp, negatives - fp + positives - tp, negatives)
    return (F.coalesce(one, F.lit(0.0)) + F.coalesce(zero, F.lit(0.0))) / (one.isNotNull().cast("int") + zero.isNotNull().cast("int"))


def sweep(train: DataFrame, test: DataFrame, cols: list[str], label: str, detector: str, params: list[int], contaminations: list[float],
          benign_only: bool = False) -> DataFrame:
    """One row for each parameter and contamination: threshold and macro-F1 (SWEEP_SCHEMA).

    A parameter costs one fit, one scoring pass over the training rows, whose
    scores give the thresholds of all contaminations at once
    (``exact_quantiles``), and one over the test rows, whose confusion counts
    under all thresholds are one aggregate.  ``benign_only`` fits and sets
    thresholds on training rows with label 0.  A parameter that the detector
    refuses gives one row with ``error``, and the sweep goes on."""
    from ..session import cut_lineage
    spark = train.sparkSession
    train = train.filter(F.col(label) == 0) if benign_only else train
    out = []
    for at, p in enumerate(params):
        point = [F.lit(detector).alias("detector"), F.lit(int(p)).alias("param")]
        try:
            score = DETECTORS[detector](train, cols, p)
            thr = cut_lineage(exact_quantiles(score(train), "score", [1.0 - c for c in contaminations]))
        except Exception as e:  # noqa: BLE001  any refusal of the fit is a row of the result
            text = str(e).strip().splitlines() or [type(e).__name__]
            out.append(spark.range(1).select(*point, F.lit(at * len(contaminations)).alias("grid_order"), F.lit(None).cast("double").alias("contamination"),
                                             F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("macro_f1"), F.lit(text[0][:200]).alias("error")))
            continue
        scored = _attach_one_row(score(test).select((F.col(label) == 1).alias("_y"), "score"), thr)
        counts = [F.count_if(F.col("_y")).alias("_p"), F.count_if(~F.col("_y")).alias("_n"), F.first("quantiles").alias("quantiles")]
        for i in range(len(contaminations)):
            hit = F.col("score") > F.col("quantiles")[i]
            counts += [F.count_if(F.col("_y") & hit).alias(f"_tp{i}"), F.count_if(~F.col("_y") & hit).alias(f"_fp{i}")]
        row = scored.agg(*counts)
        levels = [F.struct(F.lit(at * len(contaminations) + i).alias("grid_order"), F.lit(float(c)).alias("contamination"), F.col("quantiles")[i].alias("threshold"),
                           _macro_f1(F.col(f"_tp{i}"), F.col(f"_fp{i}"), F.col("_p"), F.col("_n")).alias("macro_f1")) for i, c in enumerate(contaminations)]
        out.append(row.select(F.explode(F.array(*levels)).alias("r")).select(*point, "r.*", F.lit(None).cast("string").alias("error")))
    found = out[0]
    for r in out[1:]:
        found = found.unionByName(r)
    return found


# CLS-1..6 ----------------------------------------------------------------------------
def train_classifier(df: DataFrame, cols: list[str] | str, label: str, kind: str = "lr", weight: str | None = None,
                     num_classes: int | None = None, seed: int = 42):
    """pyspark.ml classifier on assembled features: lr, dt, rf, gbt, mlp, svm."""
    from pyspark.ml import classification as C
    data = _assemble(df, cols)
    if kind == "lr":
        est = C.LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, **({"weightCol": weight} if weight else {}))
    elif kind == "dt":
        est = C.DecisionTreeClassifier(labelCol=label, featuresCol="features", seed=seed)
    elif kind == "rf":
        est = C.RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=20, seed=seed)
    elif kind == "gbt":
        base = C.GBTClassifier(featuresCol="features", maxIter=20, seed=seed)
        est = base.setLabelCol(label) if (num_classes or 2) == 2 else C.OneVsRest(classifier=base, labelCol=label, featuresCol="features")
    elif kind == "mlp":
        k = num_classes or 2
        if isinstance(cols, str):
            raise ValueError("a multilayer perceptron needs named columns")
        est = C.MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[len(cols), 16, k], seed=seed, maxIter=100)
    elif kind == "svm":
        base = C.LinearSVC(featuresCol="features", maxIter=50)
        est = base.setLabelCol(label) if (num_classes or 2) == 2 else C.OneVsRest(classifier=base, labelCol=label, featuresCol="features")
    else:
        raise ValueError(kind)
    return est.fit(data)


def predict(model, df: DataFrame, cols: list[str] | str) -> DataFrame:
    out = model.transform(_assemble(df, cols)).drop("features", "rawPrediction")
    return out.withColumn("pred", F.col("prediction").cast("int"))


def _ship_by_value() -> None:
    """Functions of this module run inside Python workers; pickle them by
    value so executors need no installed copy of the package."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
