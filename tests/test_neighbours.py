"""The partitioned neighbour and radius searches against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import knn
from flowlens.plans import registry


def clustered(n=1500, dims=6, seed=3):
    """Tight clusters, one of which holds a third of all rows, copies and a few far rows."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, dims)) * 30
    who = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 20, n))
    x = (centre[who] + rng.normal(size=(n, dims))).round(1)
    x[:60] = x[0]  # copies: ties by the dozen
    x[-3:] = rng.normal(size=(3, dims)) * 1000
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) * 3, x)]


def all_pairs(rows, metric):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        dist = 1 - u @ u.T
    else:
        dist = np.stack([np.sqrt(np.einsum("ij,ij->i", x - v, x - v)) for v in x])
    dist[np.arange(len(x)), np.arange(len(x))] = np.inf
    return ids, dist


@pytest.mark.parametrize(("metric", "unit_rows", "k"), [("euclidean", 60, 7), ("euclidean", 400, 1), ("cosine", 100, 5)])
def test_pruned_knn_equals_all_pairs(spark, metric, unit_rows, k):
    rows = clustered()
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    found = {}
    for r in knn.knn_join(df, "id", "v", k, metric, pruned=True, unit_rows=unit_rows).collect():
        found.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    ids, dist = all_pairs(rows, metric)
    assert set(found) == set(ids.tolist())
    for i, src in enumerate(ids.tolist()):
        got = sorted(found[src])
        assert len(got) == k
        want = np.sort(dist[i])[:k]
        assert np.allclose([d for _, _, d in got], want, atol=1e-9)
        if metric == "euclidean":  # ties by id; cosine ties differ in the last bits
            order = np.lexsort((ids, dist[i]))[:k]
            assert [d for _, d, _ in got] == ids[order].tolist()


@pytest.mark.parametrize(("metric", "eps"), [("euclidean", 2.5), ("cosine", 0.002)])
def test_pruned_radius_equals_all_pairs(spark, metric, eps):
    rows = clustered(900)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = sorted((r["src"], r["dst"]) for r in knn.radius_join(df, "id", "v", eps, metric, pruned=True, unit_rows=50).collect())
    ids, dist = all_pairs(rows, metric)
    i, j = np.nonzero(dist < eps)
    want = sorted(zip(ids[i].tolist(), ids[j].tolist()))
    edge = {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.abs(dist - eps) < 1e-12))}
    assert len(got) == len(set(got)) and set(got) ^ set(want) <= edge and len(want) > 5000


def test_clustered_rows_are_compared_with_few_others(spark):
    rows = clustered(3000)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    knn_share = knn.compared_pairs(df, "id", "v", k=5, unit_rows=60).first()
    near_share = knn.compared_pairs(df, "id", "v", eps=1.0, unit_rows=60).first()
    assert knn_share["n"] == 3000 and knn_share["share"] < 0.4 and near_share["share"] < 0.4
    print("share of ordered pairs compared:", knn_share["share"], near_share["share"])


def test_pruned_search_of_odd_rows(spark):
    schema = "id long, v array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [3.0])]):
        df = spark.createDataFrame(rows, schema)
        assert len(knn.knn_join(df, "id", "v", 3, pruned=True).collect()) == max(0, len(rows) * (len(rows) - 1))
        assert knn.radius_join(df, "id", "v", 0.5, pruned=True).collect() == []
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    found = knn.knn_join(spark.createDataFrame(rows, schema), "id", "v", 9, pruned=True, unit_rows=1).collect()
    assert sorted((r["src"], r["dst"]) for r in found) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], schema)  # cosine with a zero vector: block pairs
    found = {(r["src"], r["dst"]): r["dist"] for r in knn.knn_join(zero, "id", "v", 2, "cosine", pruned=True).collect()}
    assert found[(1, 2)] == 1.0 and abs(found[(2, 3)] - (1 - 0.5 ** 0.5)) < 1e-12


def test_vectors_without_structure_take_block_pairs_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]  # a large group of copies
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1300) * 2, x)]
    df = spark.createDataFrame([*rows, (9001, None), (9003, [float("nan")] + [0.0] * 63)], "id long, v array<double>").repartition(3)
    monkeypatch.setattr(knn, "PRUNE_ABOVE", 1000)
    monkeypatch.setattr(knn, "SLICE", 100)
    monkeypatch.setattr(knn, "SPAN", 150)
    monkeypatch.setattr(knn, "HELD", 2000)
    assert not knn._has_structure(df, "id", "v", "euclidean", 20)
    assert knn._has_structure(spark.createDataFrame(clustered(1300), "id long, v array<double>"), "id", "v", "euclidean", 7)

    def refused(*a, **k):
        raise AssertionError("all units would be visited")
    monkeypatch.setattr(knn, "Partitions", refused)
    found = {}
    for r in knn.knn_join(df, "id", "v", 20).collect():
        found.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    ids, dist = all_pairs(rows, "euclidean")
    assert set(found) == set(ids.tolist())
    for i, src in enumerate(ids.tolist()):
        order = np.lexsort((ids, dist[i]))[:20]
        got = sorted(found[src])
        assert [d for _, d, _ in got] == ids[order].tolist() and [d for _, _, d in got] == dist[i][order].tolist()


def test_copies_of_each_row_do_not_grow_with_the_table():
    assert knn._knn_blocks(100_000, 12) == knn._knn_blocks(600_000, 12) == knn._knn_blocks(1_000_000, 12) == knn.BLOCKS
    assert knn._knn_blocks(0, 12) == knn._knn_blocks(60, 12) == 1 and 2_000_000 / knn._knn_blocks(2_000_000, 12) <= knn.MAX_BLOCK_ROWS


def test_copies_of_each_row_are_as_many_for_ten_thousand_rows_as_for_a_million():
    assert len({knn._knn_blocks(n, 12) for n in (10_256, 51_282, 102_564, 615_384, 1_000_000)}) == 1
    assert knn._knn_blocks(615_384, 12) < 16


def test_only_pairs_that_may_be_nearest_are_computed_exactly(monkeypatch):
    """Ties, repeated ids and wide bounds included, the k nearest of both sides are those of all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).round(1)
    x[5:60], x[1600:1650] = x[5], x[5]  # copies on both sides
    ids = rng.permutation(3000)
    ids[10], ids[1700] = ids[11], ids[1701]
    a, b = np.arange(1500), np.arange(1500, 3000)
    wide = np.where(rng.random(3000) < 0.01, np.inf, 40.0)
    done, exact = [], knn._pair_distances
    monkeypatch.setattr(knn, "_pair_distances", lambda x, y, i, j, m: done.append(len(i)) or exact(x, y, i, j, m))
    monkeypatch.setattr(knn, "HELD", 50_000)
    found = knn._k_within(ids[a], x[a], wide[a], ids[b], x[b], wide[b], 4, "euclidean", True)
    dist = np.stack([exact(x[b], x[a], b - 1500, np.full(1500, i), "euclidean") for i in a])
    assert sum(done) < dist[dist * dist < 40].size / 4
    want = []
    for mine, theirs, d in ((a, b, dist), (b, a, dist.T)):
        for i, row in zip(mine, d):
            order = np.lexsort((ids[theirs], row))[:4]
            want += [(ids[i], ids[theirs][j], row[j]) for j in order if row[j] * row[j] <= wide[i]]
    assert sorted(zip(found["src"], found["dst"], found["dist"])) == sorted(want)


def test_rows_of_a_scan_in_one_task_are_spread(spark):
    from pyspark.sql import functions as F
    one = spark.range(0, 100_000, 1, 1).select("id", F.array(F.pmod(F.hash("id"), F.lit(50)).cast("double"), (F.col("id") % 997) / 10.0).alias("v"))
    parts = knn.Partitions(one, "id", "v", "euclidean", 5, 2000)
    assert parts.rows.rdd.getNumPartitions() > 1 and parts.size == 100_000


@pytest.mark.parametrize("name", ["gr23_concat_layers", "tri6_triage_report"])
def test_queries_build_one_graph_once(spark, monkeypatch, name):
    from paths import SF_SMALL

    import __spark_entry__ as entry
    calls, build = [], knn.knn_graph
    monkeypatch.setattr(knn, "knn_graph", lambda *a, **k: calls.append(a) or build(*a, **k))
    assert entry.queries()[name](spark, SF_SMALL).count() > 0
    assert len(calls) == 1


def test_single_precision_bounds_lose_no_neighbour():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 9))
    x[:40] = x[0] + rng.normal(size=(40, 9)) * 1e-9  # closer than single precision tells
    ids = rng.permutation(700)
    for metric, scale, shift in (("euclidean", 1.0, 0.0), ("euclidean", 1e-30, 0.0), ("euclidean", 1e25, 0.0), ("euclidean", 1.0, 1e6), ("cosine", 1e-30, 0.0)):
        v = x * scale + shift
        bound = knn._kth_bound(ids, v, 6, metric, True)
        a, b = np.arange(350), np.arange(350, 700)
        found = knn._k_within(ids[a], v[a], bound[a], ids[b], v[b], bound[b], 6, metric, True)
        own = [knn._k_within(ids[p], v[p], bound[p], ids[p], v[p], None, 6, metric, True) for p in (a, b)]
        lists = {}
        for pairs in (found, *own):
            for s, d in zip(pairs["src"], pairs["dist"]):
                lists.setdefault(s, []).append(d)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        dist = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(v[:, None] - v[None], axis=2)
        np.fill_diagonal(dist, np.inf)
        got, want = np.array([sorted(lists[i])[:6] for i in ids]), np.sort(dist, axis=1)[:, :6]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-14), (metric, scale, shift)


def test_true_positions_of_odd_sizes():
    rng = np.random.default_rng(6)
    for shape in ((1, 1), (3, 5), (8, 16), (13, 41)):
        mask = rng.random(shape) < 0.1
        assert sorted(knn._true_at(mask)) == np.flatnonzero(mask).tolist()


def test_block_pairs_are_not_put_into_few_tasks(spark):
    """Their work is not in their bytes, by which Spark would join small partitions."""
    df = spark.createDataFrame(clustered(600), "id long, v array<double>")
    found = knn._tiled_knn(df, "id", "v", 3, "euclidean", 6, True)
    found.collect()
    assert found.rdd.getNumPartitions() >= 21


def test_radius_search_emits_lists_and_deals_its_groups_to_many_tasks(spark):
    rows = [(i, [float(i % 40), float(i // 40)]) for i in range(1000)]
    near = knn.radius_join(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 5.5, pruned=True, unit_rows=16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "Generate posexplode" in plan  # a row's partners leave Python as one row
    assert "REPARTITION_BY_NUM" in plan
    got = sorted((r["src"], r["dst"], r["dist"]) for r in near.collect())
    x = np.array([v for _, v in rows])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    i, j = np.nonzero(dist < 5.5)
    assert len(got) > 60_000 and got == sorted(zip(i.tolist(), j.tolist(), dist[i, j].tolist()))


def test_radius_search_of_repeated_and_missing_ids(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 0.5]), (3, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ids = [knn.NO_ID if i is None else i for i, _ in rows]
    x = np.array([v for _, v in rows])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = sorted((ids[a], ids[b]) for a, b in zip(*np.nonzero(dist < 2)) if ids[a] != ids[b] or ids[a] == knn.NO_ID)
    for unit_rows in (4, 100):
        got = knn.radius_join(df, "id", "v", 2.0, pruned=True, unit_rows=unit_rows).collect()
        assert sorted((r["src"], r["dst"]) for r in got) == want


def test_quick_rounding_equals_round(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.uniform(0, 5, 20_000), rng.integers(0, 5_000_000, 20_000) / 1e6 + 5e-7, -rng.uniform(0, 5, 1000), 10.0 ** rng.uniform(-9, 18, 5000),
                             [0.0, -0.0, 1.0000005, 2.6750005, 1e-7, 5e-7, 1e300, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for digits in (0, 2, 6):
        both = df.select("x", F.round("x", digits).alias("want"), registry.round_quickly(F.col("x"), digits).alias("got"))
        assert both.where(~F.col("want").eqNullSafe(F.col("got"))).collect() == []


def test_radius_of_many_units_takes_block_pairs(spark, monkeypatch):
    from flowlens.operators import knn
    rng = np.random.default_rng(9)
    taken, tiled = [], knn._tiled_radius
    monkeypatch.setattr(knn, "_tiled_radius", lambda *a: taken.append(1) or tiled(*a))
    for x, eps, metric in ((np.round(rng.random((900, 2)) * 30, 1), 12.0, "euclidean"), (rng.normal(size=(900, 24)), 5.5, "euclidean"), (rng.normal(size=(900, 24)), 0.8, "cosine")):
        ids = [None, None, 7, 7, *range(100, 996)]
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)] + [(5, None)], "id long, v array<double>")
        want = []
        d = knn._distances(x, x, metric)
        for i, j in zip(*np.nonzero(d < eps)):
            if ids[i] is None or ids[i] != ids[j]:
                want.append((ids[i] if ids[i] is not None else knn.NO_ID, ids[j] if ids[j] is not None else knn.NO_ID, round(d[i, j], 9)))
        got = knn.radius_join(df, "id", "v", eps, metric, pruned=True, unit_rows=8)
        assert sorted((r.src, r.dst, round(r.dist, 9)) for r in got.collect()) == sorted(want) and len(want) > 5000
    assert len(taken) == 3
