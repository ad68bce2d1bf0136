"""Fitted detectors against independent NumPy versions, and the sweep against a plain loop."""

import math

import numpy as np
import pytest

from flowlens.operators import detect as dt
from flowlens.operators.numbering import carry_known, exact_quantiles

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Three blobs of different size, correlated features and five planted outliers."""
    rng = np.random.default_rng(12)
    blobs = [rng.normal(size=(n, 3)) * s + m for n, s, m in ((300, 1.0, [0, 0, 0]), (150, 0.5, [10, 10, 0]), (12, 0.2, [30, -20, 5]))]
    x = np.concatenate(blobs)
    x[:, 2] += 0.8 * x[:, 0]
    x = np.concatenate([x, [[60, 60, -40], [-50, 70, 30], [80, -60, 10], [-70, -70, -70], [0, 90, 90]]]).round(3)
    y = (np.arange(len(x)) >= len(x) - 17).astype(int)
    df = spark.createDataFrame([(f"k{i:04d}", *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "flow_key string, a double, b double, c double, y int")
    return x, y, df.repartition(3).cache()


def scores_of(df):
    return np.array([r["score"] for r in sorted(df.select("flow_key", "score").collect())])


def test_pca_fit_and_scores(table):
    x, _, df = table
    m = dt.fit_pca(df, COLS, 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    value, vector = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-value)[:2]
    assert np.allclose(m["shares"], value[order] / value.sum(), atol=1e-8)
    for got, at in zip(m["components"], order):
        assert abs(abs(np.dot(got, vector[:, at])) - 1) < 1e-8
    want = sum(np.linalg.norm(z - np.array(c), axis=1) / s for c, s in zip(m["components"], m["shares"]))
    assert np.allclose(scores_of(dt.pca_apply(df, m)), want, rtol=1e-8)


def lloyd(x, k, seed):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
    return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()


def test_cblof_fit_and_scores(table):
    x, _, df = table
    m = dt.fit_cblof(df, COLS, 4, 0.8, 5.0)
    c = np.array(m["centres"])
    d = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
    at = d.argmin(axis=1)
    sizes = np.bincount(at, minlength=len(c))
    assert {j: n for j, n in m["sizes"].items()} == {j: int(n) for j, n in enumerate(sizes) if n}
    for j in np.flatnonzero(sizes):  # a centre is the mean of its rows: the fit is a fixed point
        assert np.allclose(c[j], x[at == j].mean(axis=0), atol=1e-2)
    assert (d.min(axis=1) ** 2).sum() <= 1.3 * min(lloyd(x, 4, s) for s in range(20))
    order = np.argsort(-sizes, kind="stable")
    b = next((i for i in range(1, len(order)) if sizes[order[:i]].sum() >= 0.8 * len(x) and sizes[order[i - 1]] >= 5.0 * max(sizes[order[i]], 1)), None)
    if b is None:
        b = next(i for i in range(1, len(order) + 1) if sizes[order[:i]].sum() >= 0.8 * len(x))
    large = set(order[:b].tolist())
    assert m["large"] == large
    want = np.where(np.isin(at, list(large)), d.min(axis=1), d[:, sorted(large)].min(axis=1))
    got = scores_of(dt.cblof_score(df, COLS, m["centres"], m["large"]))
    assert np.allclose(got, want, rtol=1e-9) and set(np.argsort(-got)[:5]) == set(range(len(x) - 5, len(x)))


def walk(tree, v):
    """Path length of one row, one comparison at a time, with the expected rest of a leaf."""
    feature, split, left, right, size = (list(a) for a in tree)
    node, depth = 0, 0
    while feature[node] >= 0:
        node = left[node] if v[feature[node]] < split[node] else right[node]
        depth += 1
    n = size[node]
    return depth + (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0)


def test_forest_fit_and_scores(table):
    x, _, df = table
    m = dt.fit_forest(df, COLS, trees=12, sample=32)
    assert len(m["trees"]) == 12
    for feature, split, left, right, size in m["trees"]:
        assert size[0] == 32
        for n in np.flatnonzero(feature >= 0):  # rows of a node are those of its children
            assert size[n] == size[left[n]] + size[right[n]] and size[left[n]] > 0 and size[right[n]] > 0
            assert x[:, feature[n]].min() <= split[n] <= x[:, feature[n]].max()
    expect = 2 * (math.log(31) + 0.5772156649) - 2 * 31 / 32
    want = np.array([2 ** (-np.mean([walk(t, v) for t in m["trees"]]) / expect) for v in x])
    got = scores_of(dt.forest_score(df, m))
    assert np.allclose(got, want, rtol=1e-9)
    assert len(set(np.argsort(-got)[:12]) & set(range(len(x) - 17, len(x)))) >= 5


@pytest.mark.parametrize(("detector", "params", "benign"), [("hbos", [4, 9], False), ("pca", [2, 7], True)])
def test_sweep_equals_a_plain_loop(table, detector, params, benign):
    x, y, df = table
    levels = [0.01, 0.05, 0.3]
    rows = {(r["param"], r["contamination"]): r for r in dt.sweep(df, df, COLS, "y", detector, params, levels, benign).collect()}
    for p in params:
        if (detector, p) == ("pca", 7):
            assert rows[(7, None)]["error"] and rows[(7, None)]["macro_f1"] is None
            continue
        fit = df.filter("y = 0") if benign else df
        s = scores_of(dt.DETECTORS[detector](fit, COLS, p)(df))
        for c in levels:
            t = np.quantile(s[y == 0] if benign else s, 1 - c)
            pred = s > t
            f1 = [2 * (h & r).sum() / (h.sum() + r.sum()) for h, r in ((pred, y == 1), (~pred, y == 0))]
            assert math.isclose(rows[(p, c)]["threshold"], t, rel_tol=1e-9) and math.isclose(rows[(p, c)]["macro_f1"], np.mean(f1), rel_tol=1e-9)


def test_quantiles_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 20, 500).astype(float), rng.normal(size=77)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    assert np.allclose(exact_quantiles(df, "v", qs).first()[0], np.quantile(x, qs))


def test_known_values_are_carried_over_partition_borders(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, int(rng.integers(100)) if rng.random() < 0.05 else None) for g in ("a", "b", "c") for i in range(200)]
    rows += [("none", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    got = {(r["g"], r["i"]): (r["up"], r["down"]) for r in carry_known(df, ["g"], ["i"], "v", "up", "down", partitions=9).collect()}
    for g in ("a", "b", "c", "none"):
        own = [(i, v) for h, i, v in rows if h == g and v is not None]
        for i in range(200 if g != "none" else 5):
            assert got[(g, i)] == (next((v for j, v in reversed(own) if j <= i), None), next((v for j, v in own if j >= i), None))
