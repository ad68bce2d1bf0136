"""Invariants of SURVEY §5 (c)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF_SMALL
from flowlens import fixtures as fx
from flowlens.operators import adapters as ad
from flowlens.operators import aggregate as agg
from flowlens.operators import evaluate as ev
from flowlens.operators import graph as gr
from flowlens.operators import knn
from flowlens.operators import propagate as pg
from flowlens.operators import sampling as sm


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_partitioning(spark):
    q = E.queries()
    names = ["prj5_netflow_standardize", "smp2_reduce_by_rarity", "smp10_stratified_split", "agg5_host_profile",
             "smp13_kfold", "evl5_auc"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append({name: _rows(q[name](spark, SF_SMALL)) for name in names})
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_class_counts_sum_and_reduction_keeps_less(spark):
    std = ad.adapt_netflow(fx.li(spark, SF_SMALL), number=False)
    n = std.count()
    dist = agg.class_distribution(std, "attack_type").collect()
    assert sum(r["count"] for r in dist) == n
    assert abs(sum(r["share"] for r in dist) - 1.0) < 1e-9
    red = sm.reduce_by_rarity(std, "attack_type", 0.1, "flow_key")
    before = {r["attack_type"]: r["count"] for r in dist}
    after = {r["attack_type"]: r["count"] for r in red.groupBy("attack_type").count().collect()}
    assert all(after[c] <= before[c] for c in after)


def test_edge_removal_count(spark):
    std = ad.adapt_netflow(fx.li(spark, SF_SMALL), number=False)
    e = agg.edge_features(std).withColumn("ek", F.concat_ws(">", "src", "dst"))
    m = e.count()
    for rate in (0.0, 0.05, 0.3, 1.0):
        assert gr.remove_edges(e, rate, "ek").count() == m - int(rate * m)


def test_auc_symmetry(spark):
    s = fx.scored(spark, SF_SMALL)
    a = ev.auc(s).first()["auc"]
    b = ev.auc(s.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert abs(a + b - 1.0) < 1e-9


def test_attention_weights_sum_to_one(spark):
    e = fx.embeddings(spark, SF_SMALL)
    nodes = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 4).alias("x"))
    edges = knn.knn_graph(e, "vec_id", "embedding", 5)
    w = [[0.1, 0.2, 0.3], [0.3, -0.2, 0.1], [0.0, 0.5, -0.1], [0.2, 0.2, 0.2]]
    a = [0.1, -0.2, 0.3, 0.05, 0.4, -0.3]
    sums = pg.attention_weights(nodes, edges, w, a).groupBy("dst").agg(F.sum("alpha").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_exact_split_sizes(spark):
    std = ad.adapt_netflow(fx.li(spark, SF_SMALL), number=False)
    n = std.count()
    s = sm.split(std, "flow_key", ["attack_type"], 0.3)
    import math
    assert s.filter("split = 'test'").count() == math.ceil(0.3 * n)
