"""Property test: exact-n per group equals a brute-force ranking by md5."""

import hashlib

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from flowlens.operators import numbering as nb


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=0, max_value=300), min_size=1, max_size=4),
       quotas=st.lists(st.integers(min_value=-1, max_value=400), min_size=4, max_size=4),
       seed=st.integers(min_value=0, max_value=1000))
def test_take_per_group_matches_brute_force(spark, sizes, quotas, seed):
    rows = [(f"g{g}", f"k{g}-{i}") for g, n in enumerate(sizes) for i in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "g string, k string")
    quota = spark.createDataFrame([(f"g{g}", quotas[g]) for g in range(len(sizes))], "g string, n long")
    got = sorted(r.k for r in nb.take_per_group(df, ["g"], quota, "k", seed).collect())
    exp = []
    for g, n in enumerate(sizes):
        keys = sorted((hashlib.md5(f"{seed}:k{g}-{i}".encode()).hexdigest(), f"k{g}-{i}") for i in range(n))
        exp += [k for _, k in keys[: max(quotas[g], 0)]]
    assert got == sorted(exp)
