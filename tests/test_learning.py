"""Graph classifiers, edge heads, endpoint gathering and counts in streaming state."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import learn as ln
from flowlens.operators import propagate as pg
from flowlens.sources.sinks import save_transform


@pytest.fixture(scope="module")
def communities(spark):
    """Two communities; a node's own features hardly tell which, the means of its neighbours do."""
    rng = np.random.default_rng(2)
    n, d = 300, 4
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + 0.35 * (2 * y[:, None] - 1)
    edges = set()
    for v in range(n):
        same, other = np.flatnonzero(y == y[v]), np.flatnonzero(y != y[v])
        for u in [*rng.choice(same, 14), *rng.choice(other, 1)]:
            if u != v:
                edges.add((int(u), v))
    nodes = spark.createDataFrame([(i, [float(a) for a in x[i]], int(y[i]), "train" if i % 10 < 7 else "test") for i in range(n)], "id long, x array<double>, y int, split string")
    return nodes.cache(), spark.createDataFrame(sorted(edges), "src long, dst long").cache(), d


def accuracy(m, nodes, edges):
    p = m.predict(nodes, edges).join(nodes.filter("split = 'test'").select("id", "y"), "id")
    return p.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]


def test_graph_kinds_beat_a_head_without_edges(spark, communities):
    nodes, edges, d = communities
    train = F.col("split") == "train"
    plain = accuracy(ln.train_graph_classifier(nodes, edges, d, "none", 0, mask=train), nodes, edges)
    assert plain < 0.85
    for kind in ln.KINDS:
        m = ln.train_graph_classifier(nodes, edges, d, kind, 2 if kind == "gcn" else 1, mask=train)
        assert accuracy(m, nodes, edges) > max(0.9, plain + 0.05), kind
    path = f"{tempfile.mkdtemp()}/model"
    m.save(path)
    again = ln.GraphClassifier.load(spark, path)
    assert (again.kind, again.hops, again.d) == (m.kind, m.hops, m.d)
    assert sorted(map(tuple, again.predict(nodes, edges).collect())) == sorted(map(tuple, m.predict(nodes, edges).collect()))
    with pytest.raises(ValueError):
        ln.hop_features(nodes, edges, d, "unheard", 1)


def test_edge_head_is_the_weighted_logistic_fit(spark):
    rng = np.random.default_rng(9)
    n = 400
    src, dst = rng.integers(0, 25, n), rng.integers(0, 25, n)
    h = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * h[:, 0] - h[:, 1] - 1)))).astype(int)
    edges = spark.createDataFrame([(str(i), f"n{src[i]}", f"n{dst[i]}", h[i].tolist(), int(y[i])) for i in range(n)], "eid string, src string, dst string, h array<double>, binary_label int")
    path = f"{tempfile.mkdtemp()}/head"
    save_transform(ln.fit_edge_head(edges, 2), path)
    we, wu, wv, b = ln.load_edge_head(spark, path)
    ends = [[] for _ in range(25)]
    for i in range(n):
        ends[src[i]].append(h[i])
        ends[dst[i]].append(h[i])
    mean = np.array([np.mean(e, axis=0) for e in ends])
    z = np.concatenate([h, mean[src], mean[dst], np.ones((n, 1))], axis=1)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    beta = np.zeros(7)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z, z.T @ (weight * (y - p)))
    assert np.allclose([*we, *wu, *wv, b], beta, atol=2e-3)


def test_endpoints_with_a_hub(spark):
    rng = np.random.default_rng(3)
    edges = [(0 if rng.random() < 0.5 else int(rng.integers(40)), int(rng.integers(40)), i) for i in range(500)] + [(99, 1, 500)]
    e = spark.createDataFrame(edges, "src long, dst long, n long").repartition(4)
    nodes = spark.createDataFrame([(i, float(i) / 2) for i in range(40)], "id long, v double")
    want = sorted((s, d, n, s / 2, d / 2) for s, d, n in edges if s < 40)
    for hub in (None, 20, 10_000):
        found = pg.gather_endpoints(e, nodes, {"v": "vs"}, {"v": "vd"}, hub_edges=hub)
        assert found.columns == ["src", "dst", "n", "vs", "vd"]
        assert sorted(map(tuple, found.collect())) == want
    # with the split the hub's edges are joined under several salts
    plan = pg.gather_endpoints(e, nodes, {"v": "vs"}, hub_edges=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_copy" in plan


def test_zip_checks_its_keys(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, x array<double>")
    b = spark.createDataFrame([(2, [4.0]), (1, [3.0])], "id long, x array<double>")
    assert sorted(map(tuple, pg.zip_on_key(a, b, check=True).collect())) == [(1, [1.0, 3.0]), (2, [2.0, 4.0])]
    for bad in (b.limit(1), b.union(b)):
        with pytest.raises(ValueError, match="keys"):
            pg.zip_on_key(a, bad, check=True)


def test_cross_dataset_takes_the_shared_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    rows = [(float(a), float(b), int(c), int(a + b > 0), "t") for a, b, c in x * 10]
    one = spark.createDataFrame(rows, "p double, q double, r int, y int, s string")
    two = spark.createDataFrame([(q, p, y, 1.0) for p, q, _, y, _ in rows], "q double, p double, y int, only double")
    assert ln.common_features({"one": one, "two": two}, ("y",)) == ["p", "q"]
    found = {(r["train"], r["test"]): r["accuracy"] for r in ln.cross_dataset({"one": one, "two": two}, "y").collect()}
    assert set(found) == {(a, b) for a in ("one", "two") for b in ("one", "two")} and min(found.values()) > 0.95
    with pytest.raises(ValueError, match="share no"):
        ln.cross_dataset({"one": one.select("y", "s"), "two": two}, "y")


def test_class_counts_survive_a_restart(spark):
    from flowlens.streaming import stream_class_counts
    base = tempfile.mkdtemp()
    folder, out, ckpt = (os.path.join(base, n) for n in ("in", "out", "ckpt"))
    schema = "attack string, n long"

    def run():
        return sorted((r["attack"] or "", r["count"]) for r in stream_class_counts(spark, spark.readStream.schema(schema).parquet(folder), "attack", out, ckpt).collect())
    os.makedirs(folder)
    assert run() == []
    spark.createDataFrame([("dos", 1), ("dos", 2), ("scan", 3), (None, 4)], schema).coalesce(1).write.mode("append").parquet(folder)
    first = run()
    assert first == [("", 1), ("dos", 2), ("scan", 1)]
    assert run() == first  # restarted without new files
    spark.createDataFrame([("dos", 5), ("worm", 6)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [("", 1), ("dos", 3), ("scan", 1), ("worm", 1)]
    # an attempt at a batch that is repeated overwrites its version
    last = max(int(d.split("=")[1]) for d in os.listdir(out))
    spark.createDataFrame([("dos", 3), ("worm", 1)], "attack string, count long").write.mode("overwrite").parquet(f"{out}/version={last}")
    assert run() == [("", 1), ("dos", 3), ("scan", 1), ("worm", 1)]
