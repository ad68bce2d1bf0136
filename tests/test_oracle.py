"""Every registered query against its DuckDB oracle on sf0.001, plus the
invariants of SURVEY §5 (c)."""

import math

import pytest

import __spark_entry__ as E
from paths import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if isinstance(v, int) else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _assert_plan_ok(df):
    """Scale guard: no cross product or nested-loop join in the physical plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan], plan[:2000]


def _is_own(name):
    """The library's own queries; the training-data operators have tests of their own."""
    return not (name == "pipeline" or name.startswith("op"))


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if _is_own(n)))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    _assert_plan_ok(df)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


NO_ORACLE = sorted(n for n in set(QUERIES) - set(ORACLES) if _is_own(n))
METRICS = ("accuracy", "precision", "recall", "f1")


def _consistent(r):
    """Metrics of one row are shares, and F1 is the harmonic mean of precision and recall."""
    assert all(0.0 <= r[m] <= 1.0 for m in METRICS)
    both = r["precision"] + r["recall"]
    assert abs(r["f1"] - (2 * r["precision"] * r["recall"] / both if both else 0.0)) < 1e-4


@pytest.mark.parametrize("name", NO_ORACLE)
def test_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    _assert_plan_ok(df)
    rows = [r.asDict() for r in df.collect()]
    if name == "det6_detector_sweeps":
        refused = {(r["detector"], r["param"]) for r in rows if r["error"]}
        assert refused == {("cblof", 0), ("pca", 9)} and len(rows) == 8 * 6 + len(refused)
        assert all(r["error"] or 0 < r["macro_f1"] <= 1 for r in rows)
        for r in rows:  # higher contamination, lower threshold
            assert all(s["threshold"] >= r["threshold"] for s in rows if not r["error"] and not s["error"] and (s["detector"], s["param"]) == (r["detector"], r["param"])
                       and s["contamination"] < r["contamination"])
        return
    assert rows
    for r in rows:
        _consistent(r)
    if name == "cls7_benchmark_leaderboard":
        assert sorted(r["model"] for r in rows) == ["dt", "gbt", "lr", "mlp", "rf", "svm"]
    if name in ("cls5_kinds_leaderboard", "pip3_similarity_benchmark"):
        assert sorted(r["model"] for r in rows) == ["arma", "attention", "cluster", "gcn", "gin", "none", "sage"]
    if name == "pip4_fitted_detector":
        assert {r["perturbation"] for r in rows} == {"clean", "pgd", "remove", "inject"}
    if name in ("cls7_benchmark_leaderboard", "pip3_similarity_benchmark", "cls5_kinds_leaderboard"):
        assert [r["f1"] for r in rows] == sorted((r["f1"] for r in rows), reverse=True)
    if name == "cls8_cross_dataset":
        assert {(r["train"], r["test"]) for r in rows} == {(a, b) for a in ("li", "ev", "od") for b in ("li", "ev", "od")}
    if name in ("cls1_logistic_regression", "cls2_decision_tree", "cls2_random_forest", "cls2_gradient_boosting"):
        assert rows[0]["accuracy"] >= 0.5


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ip" in df.columns
