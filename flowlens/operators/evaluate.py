"""Classification metrics and robustness tables.

Every metric is one or two grouped aggregations over (label, prediction,
score) rows; ROC/AUC use prefix sums over the distinct scores (skew-safe,
see ``running_sum``).  An optional ``group`` column evaluates many models or
perturbations in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import _attach_one_row
from .numbering import carry_known, running_sum


def _g(group):
    return [group] if isinstance(group, str) else list(group or [])


# EVL-2 / EVL-7 -------------------------------------------------------------
def binary_metrics(df: DataFrame, y: str = "y", p: str = "pred", group=None) -> DataFrame:
    """accuracy, precision, recall, F1 (zero_division = 0)."""
    tp = F.count_if((F.col(y) == 1) & (F.col(p) == 1))
    fp = F.count_if((F.col(y) == 0) & (F.col(p) == 1))
    fn_ = F.count_if((F.col(y) == 1) & (F.col(p) == 0))
    agg = df.groupBy(*_g(group)).agg(tp.alias("tp"), fp.alias("fp"), fn_.alias("fn"),
                                     F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    out = agg.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).select(*_g(group), "accuracy", "precision", "recall", "f1")


# EVL-1 -----------------------------------------------------------------------
def confusion_matrix(df: DataFrame, y: str = "y", p: str = "pred", normalize: bool = False) -> DataFrame:
    """Dense (true, pred, count[, share of the true row]) over all classes seen."""
    cnt = df.groupBy(F.col(y).alias("true"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("count"))
    classes = cnt.select(F.col("true").alias("c")).union(cnt.select(F.col("pred").alias("c"))).distinct()
    # the class list is small: one row holding it, exploded twice into the k x k grid
    arr = classes.agg(F.collect_list("c").alias("_cs"))
    grid = arr.select(F.explode("_cs").alias("true"), "_cs").select("true", F.explode("_cs").alias("pred"))
    dense = grid.join(cnt, ["true", "pred"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if normalize:
        row = F.sum("count").over(Window.partitionBy("true"))
        dense = dense.withColumn("share", F.when(row > 0, F.col("count") / row).otherwise(F.lit(0.0)))
    return dense


def per_class(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Per class: support, precision, recall, F1 (zero_division = 0)."""
    t = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("support"),
                                               F.count_if(F.col(y) == F.col(p)).alias("tp"))
    pr = df.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    j = t.join(pr, "cls", "full_outer").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).select("cls", "support", "precision", "recall", "f1")


# EVL-3 -----------------------------------------------------------------------
def macro_metrics(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    pc = per_class(df, y, p)
    return pc.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                  F.avg("f1").alias("macro_f1"))


# EVL-4 -----------------------------------------------------------------------
def classification_report(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    pc = per_class(df, y, p)
    rows = pc.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                   F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    wsum = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / wsum).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / wsum).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / wsum).alias("f1"), wsum.alias("support"))
    acc = df.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("f1"),
                 F.count(F.lit(1)).alias("support"))
    return rows.unionByName(macro).unionByName(weighted).unionByName(acc)


# EVL-5 / IDX-3 ------------------------------------------------------------------
def _score_table(df: DataFrame, y: str, score: str, group=None) -> DataFrame:
    return df.groupBy(*_g(group), F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def _rank_runs(group: list[str]):
    """A function of batches of (group, pos, neg), one row a distinct score, in order of group and score: one row for each group in
    a batch, with its place in the order (``_at``), its rows and the sum of its positives' mean ranks among them."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            pos, neg = (b.column(c).to_numpy() for c in ("pos", "neg"))
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in group:
                code = b.column(c).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            n = pos + neg
            up = np.cumsum(n)
            inside = up - n - np.repeat((up - n)[first], np.diff(np.append(first, len(n))))
            sums = [np.add.reduceat(x, first) for x in (pos, n, pos * (inside + (n + 1) / 2.0))]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(first)) for c in group], pa.array(at + np.arange(len(first))), *map(pa.array, sums)],
                                             names=[*group, "_at", "pos", "n", "_ranks"])
            at += len(first)
    return run


def auc(df: DataFrame, y: str = "y", score: str = "score", group=None) -> DataFrame:
    """Binary ROC AUC by the rank-sum formula with averaged tie ranks; null
    when one class is absent.  With ``group`` one AUC per group, all from
    one pass: distinct scores are range-partitioned and sorted once, and a
    batch of them leaves its task as one row for each group in it."""
    g = _g(group)
    names = [f"_g{i}" for i in range(len(g))]
    t = _score_table(df, y, score, g)
    for c in g:
        t = t.filter(F.col(c).isNotNull())
    t = t.select(*[F.col(c).alias(n) for c, n in zip(g, names)], "s", "pos", "neg").repartitionByRange(*names, "s")
    runs = t.sortWithinPartitions(*names, "s").drop("s").mapInArrow(_rank_runs(names), T.StructType(
        [f for f in t.schema.fields if f.name in names] + [T.StructField(c, T.LongType()) for c in ("_at", "pos", "n")] + [T.StructField("_ranks", T.DoubleType())]))
    w = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    rank_sum = F.sum(F.col("_ranks") + F.col("pos") * F.col("_before"))
    P, N = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return r.groupBy(*[F.col(n).alias(c) for n, c in zip(names, g)]).agg(F.when((P > 0) & (N > 0), (rank_sum - P * (P + 1) / 2.0) / (P * N)).alias("auc"))


# EVL-6 -------------------------------------------------------------------------
def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, high to low."""
    t = _score_table(df, y, score).withColumn("_neg_s", -F.col("s"))
    r = running_sum(t, ["_neg_s"], ["pos", "neg"])
    r = _attach_one_row(r, t.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    return r.select(F.col("s").alias("threshold"), (F.col("neg_cum") / F.col("_n")).alias("fpr"), (F.col("pos_cum") / F.col("_p")).alias("tpr"))


def _one_vs_rest(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """(curve, hit, s): every (row, class) decision under its class and once more under ``micro``."""
    long = df.select(F.col(y).alias("_y"), F.posexplode(probs).alias("cls", "s")).filter(F.col("cls") < k)
    long = long.select(F.col("cls").cast("string").alias("curve"), (F.col("_y") == F.col("cls")).cast("int").alias("hit"), "s")
    return long.unionByName(long.withColumn("curve", F.lit("micro")))


def roc_curves(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """(curve, threshold, fpr, tpr): a one-vs-rest curve for each of ``k`` classes and the micro curve, from a
    probability array; a class without rows on one side has no curve."""
    t = _one_vs_rest(df, y, probs, k).groupBy("curve", "s").agg(F.count_if(F.col("hit") == 1).alias("pos"), F.count_if(F.col("hit") == 0).alias("neg"))
    r = running_sum(t.withColumn("_neg_s", -F.col("s")), ["_neg_s"], ["pos", "neg"], by=["curve"])
    tot = t.groupBy("curve").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).filter("_p > 0 and _n > 0")
    return r.join(F.broadcast(tot), "curve").select("curve", F.col("s").alias("threshold"), (F.col("neg_cum") / F.col("_n")).alias("fpr"),
                                                    (F.col("pos_cum") / F.col("_p")).alias("tpr"))


def macro_curve(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """(fpr, tpr): the mean of the one-vs-rest curves over the union of their fpr grids.

    A curve is read at each grid point between its last point before and its
    first point after (where it has points there, the highest of them); both
    are carried over range partitions, so no curve is gathered in one task.
    Classes without rows on one side have no curve and do not count."""
    curves = roc_curves(df, y, probs, k).filter("curve <> 'micro'").select("curve", "fpr", "tpr")
    names = curves.select("curve").distinct()  # at most k
    knots = curves.unionByName(names.select("curve", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))) \
                  .groupBy("curve", "fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    from ..session import cut_lineage
    knots = cut_lineage(knots)
    grid = _attach_one_row(knots.select("fpr").distinct(), names.agg(F.sort_array(F.collect_list("curve")).alias("_cs"))) \
        .select("fpr", F.explode("_cs").alias("curve"))
    t = grid.join(knots.withColumn("knot", F.struct("fpr", "low", "high")), ["curve", "fpr"], "left").select("curve", "fpr", "knot")
    t = carry_known(t, ["curve"], ["fpr"], "knot", "_a", "_b")
    between = F.col("_a.high") + (F.col("fpr") - F.col("_a.fpr")) / (F.col("_b.fpr") - F.col("_a.fpr")) * (F.col("_b.low") - F.col("_a.high"))
    return t.groupBy("fpr").agg(F.avg(F.when(F.col("knot").isNotNull(), F.col("knot.high")).otherwise(between)).alias("tpr"))


def roc_areas(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """(curve, auc) of those curves, and ``macro``: the mean over classes."""
    per = auc(_one_vs_rest(df, y, probs, k), "hit", "s", group="curve").filter(F.col("auc").isNotNull())
    macro = per.filter("curve <> 'micro'").agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("curve"), "auc")
    return per.select("curve", "auc").unionByName(macro)


def auc_ovr(df: DataFrame, y: str, probs: str, k: int) -> DataFrame:
    """Macro one-vs-rest AUC over ``k`` classes from a probability array."""
    long = df.select(F.col(y).alias("_y"), F.posexplode(probs).alias("cls", "_p"))
    long = long.select("cls", (F.col("_y") == F.col("cls")).cast("int").alias("_b"), "_p")
    # one grouped pass: an AUC per class, then their mean
    return auc(long, "_b", "_p", group="cls").agg(F.avg("auc").alias("macro_auc_ovr"))


# EVL-8 --------------------------------------------------------------------------
def per_class_recall(df: DataFrame, attack: str = "attack_type", p: str = "pred", normal: str = "Normal") -> DataFrame:
    """Detection rate per attack class (share predicted as attack); for the
    normal class this is the false-alarm rate."""
    return df.groupBy(attack).agg(F.count(F.lit(1)).alias("n"),
                                  F.avg((F.col(p) == 1).cast("double")).alias("detection_rate"))


# EVL-9 ---------------------------------------------------------------------------
def compare(results: DataFrame, model: str = "model", metrics=("accuracy", "precision", "recall", "f1", "auc")) -> DataFrame:
    """Metric rows x model columns (unpivot then pivot; the model list is the
    small set of distinct names)."""
    long = results.select(model, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                                     for m in metrics if m in results.columns])).alias("s")).select(model, "s.*")
    models = sorted(r[0] for r in results.select(model).distinct().collect())
    return long.groupBy("metric").pivot(model, models).agg(F.first("v"))


# ROB-3 ----------------------------------------------------------------------------
def degradation(results: DataFrame, key: str = "perturbation", clean: str = "clean",
                metrics=("accuracy", "precision", "recall", "f1", "auc"), group=None) -> DataFrame:
    """Δ metric of every row against the clean row of the same group."""
    g = _g(group)
    base = results.filter(F.col(key) == clean).select(*g, *[F.col(m).alias(f"_c_{m}") for m in metrics])
    j = results.join(F.broadcast(base), g, "left") if g else __import__(
        "flowlens.operators.encode", fromlist=["_attach_one_row"])._attach_one_row(results, base)
    for m in metrics:
        j = j.withColumn(f"delta_{m}", F.col(m) - F.col(f"_c_{m}"))
    return j.drop(*[f"_c_{m}" for m in metrics])


# ORD-1 / ORD-3 ---------------------------------------------------------------------
def leaderboard(results: DataFrame, metric: str, tie: str = "model") -> DataFrame:
    return results.orderBy(F.desc(metric), F.col(tie))


def best_params(results: DataFrame, metric: str, order: str) -> DataFrame:
    """Best row of a grid: highest metric, the earliest grid position on ties
    (strictly-greater update rule)."""
    return results.agg(F.max_by(F.struct(*[F.col(c) for c in results.columns]),
                                F.struct(F.col(metric), -F.col(order))).alias("b")).select("b.*")


def _ship_by_value() -> None:
    """Functions of this module run inside Python workers; pickle them by
    value so executors need no installed copy of the package."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
