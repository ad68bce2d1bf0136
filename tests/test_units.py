"""Unit tests for the I/O-side (T) operators and published small cases."""

import os
import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from flowlens import fixtures as fx
from flowlens.operators import adapters as ad
from flowlens.operators import cleaning as cl
from flowlens.operators import graph as gr
from flowlens.operators import knn
from flowlens.operators import numbering as nb
from flowlens.operators import triage as tr
from flowlens.sources import read_flows, read_named, require_columns, resolve_sources, sniff_sep
from flowlens.sources.sinks import class_map_json, write_class_map, write_graph, write_spaced, write_table


def _tmp():
    return tempfile.mkdtemp(prefix="flowlens-test-")


def test_csv_round_trip_with_blanks(spark):
    d = _tmp()
    p = os.path.join(d, "flows.csv")
    with open(p, "w") as f:
        f.write(" src_ip, dst_ip, Label\n10.0.0.1, 10.0.0.2, BENIGN\n10.0.0.3, 10.0.0.4, DoS\n")
    df = read_flows(spark, p)
    assert df.columns == ["src_ip", "dst_ip", "Label"]
    assert sorted(r.Label for r in df.collect()) == ["BENIGN", "DoS"]
    assert require_columns(df, ["src_ip", "missing"], mode="warn") == ["missing"]


def test_sniff_sep_and_named(spark):
    d = _tmp()
    p = os.path.join(d, "semi.csv")
    with open(p, "w") as f:
        f.write("a;b;c\n1;2;3\n")
    assert sniff_sep(spark, p) == ";"
    q = os.path.join(d, "noheader.csv")
    with open(q, "w") as f:
        f.write("1,x\n2,y\n")
    df = read_named(spark, q, ["n", "s"], {"n": "int"})
    assert [r.n for r in df.orderBy("n").collect()] == [1, 2]


def test_resolve_sources_fallback(spark):
    d = _tmp()
    open(os.path.join(d, "unsw_reduced.csv"), "w").write("x\n1\n")
    open(os.path.join(d, "cic_standardized.csv"), "w").write("x\n1\n")
    got = resolve_sources(spark, d, ["unsw", "cic", "none"])
    assert got["unsw"].endswith("unsw_reduced.csv") and got["cic"].endswith("cic_standardized.csv") and "none" not in got


def test_sinks(spark):
    d = _tmp()
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, code int")
    write_table(df, os.path.join(d, "t"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(d, "t")).count() == 2
    write_spaced(df, os.path.join(d, "s"))
    lines = [r.value for r in spark.read.text(os.path.join(d, "s")).collect()]
    assert "name, code" in lines and "a, 1" in lines and "b, 2" in lines
    assert class_map_json(df).first().json == '{"a":1,"b":2}'
    write_class_map(df, os.path.join(d, "m"))
    write_graph(df, df, os.path.join(d, "g"))
    assert spark.read.parquet(os.path.join(d, "g", "edges")).count() == 2


def test_observation_count_preserved(spark):
    li = fx.li(spark, SF_SMALL)
    out, ob, oa = cl.count_preserved(li, lambda d: ad.adapt_netflow(d, number=False))
    out.write.format("noop").mode("overwrite").save()
    cl.assert_same_count(ob, oa)


def test_dense_index_matches_row_number_and_is_stable(spark):
    li = fx.li(spark, SF_SMALL).select("flow_key")
    a = nb.dense_index(li, ["flow_key"], "i", partitions=4)
    b = nb.dense_index(li, ["flow_key"], "i", partitions=16)
    assert a.join(b.withColumnRenamed("i", "j"), "flow_key").filter("i != j").count() == 0
    assert sorted(r.i for r in a.collect()) == list(range(li.count()))


def test_exact_n_invariants(spark):
    li = ad.adapt_netflow(fx.li(spark, SF_SMALL), number=False)
    q = li.groupBy("attack_type").count().select("attack_type", F.least(F.col("count"), F.lit(50)).alias("n"))
    got = nb.take_per_group(li, ["attack_type"], q, "flow_key").groupBy("attack_type").count()
    exp = {r.attack_type: r.n for r in q.collect()}
    assert {r.attack_type: r["count"] for r in got.collect()} == exp


def test_knn_exactly_k_per_node_and_injection_counts(spark):
    e = fx.embeddings(spark, SF_SMALL)
    small = e.filter(F.col("vec_id") < 100)
    edges = knn.knn_graph(small, "vec_id", "embedding", 20)
    assert edges.count() == 2000            # 100 nodes x k=20
    nodes = small.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 4).alias("x"))
    n2, e2, new = gr.inject_sim_nodes(nodes, edges, 20, 4, c=5)
    assert e2.count() == 2200 and n2.count() == 120


def test_parse_verdict_branches(spark):
    rows = [(1, '{"node_id": 1, "confidence_score": 0.9, "justification": "x"}'),
            (2, '[{"node_id": 2, "confidence_score": 1.7, "justification": "y"}]'),
            (3, '```json\n{\n  "node_id": 3, "confidence_score": 0.2, "justification": "z"\n}\n```'),
            (4, "no json here"),
            (5, '{"node_id": 6, "confidence_score": 0.9, "justification": "w"}'),
            (6, '{"node_id": 6, "confidence_score": "high", "justification": "w"}')]
    df = spark.createDataFrame(rows, "node_id long, raw string")
    got = {r.node_id: (round(r.confidence_score, 3), r.error) for r in tr.parse_verdicts(df).collect()}
    assert got == {1: (0.9, None), 2: (1.0, None), 3: (0.2, None), 4: (0.0, "no_json"),
                   5: (0.0, "mismatch"), 6: (0.0, "bad_value")}


def test_mitigation_tally_published_case(spark):
    # 120 nodes, 20 injected (100..119); 34 flagged = all 20 injected + 14 originals
    flagged = spark.range(100, 120).union(spark.range(0, 14)).withColumnRenamed("id", "node_id")
    injected = spark.range(100, 120).withColumnRenamed("id", "node_id")
    r = tr.mitigation_tally(flagged, injected).first()
    assert (r.flagged, r.injected_found, r.wrongly_flagged, r.missed) == (34, 20, 14, 0)


def test_stream_standardize_and_reduce(spark):
    from flowlens.streaming import stream_reduce, stream_standardize
    d = _tmp()
    li = fx.li(spark, SF_SMALL)
    li.repartition(3).write.parquet(os.path.join(d, "in"))
    out = stream_standardize(spark, os.path.join(d, "in"), os.path.join(d, "out"), li.schema,
                             lambda s: ad.adapt_netflow(s, number=False))
    assert out.count() == li.count()
    rates = spark.createDataFrame([("Normal", 0.1)], "attack_type string, rate double")
    std_schema = out.schema
    red = stream_reduce(spark, spark.readStream.schema(std_schema).parquet(os.path.join(d, "out")), rates,
                        "attack_type", "flow_key", os.path.join(d, "red"))
    n_norm = red.filter("attack_type = 'Normal'").count()
    assert 0 < n_norm < out.filter("attack_type = 'Normal'").count()
    assert red.filter("attack_type <> 'Normal'").count() == out.filter("attack_type <> 'Normal'").count()


def test_dictionary_header_and_bounded_scan(spark):
    from flowlens.sources import read_with_dictionary
    d = _tmp()
    dic = os.path.join(d, "names.csv")
    with open(dic, "w") as f:
        f.write("Name,Type\nSrc Addr,str\n Dst Addr ,str\nBytes,int\n")
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    open(a, "w").write("1.1.1.1,2.2.2.2,10\n")
    open(b, "w").write("3.3.3.3,4.4.4.4,20\n5.5.5.5,6.6.6.6,30\n")
    df = read_with_dictionary(spark, [a, b], dic)
    assert df.columns == ["srcaddr", "dstaddr", "bytes"] and df.count() == 3
    c = os.path.join(d, "c.csv")
    open(c, "w").write("x,y,z\nb,2,20\na,1,10\n")
    head = read_flows(spark, c, schema="x string, y string, z int", limit=1, order=["x"])
    assert [r.z for r in head.collect()] == [10]


def test_results_and_transform_sinks(spark):
    from flowlens.operators.encode import fit_scaler
    from flowlens.sources.sinks import save_transform, write_results
    d = _tmp()
    res = spark.createDataFrame([("clean", 0.9), ("pgd", 0.7)], "perturbation string, f1 double")
    write_results(res, os.path.join(d, "r"), "run1")
    write_results(res, os.path.join(d, "r"), "run2")
    back = spark.read.json(os.path.join(d, "r"))
    assert back.count() == 4 and {r.run_id for r in back.collect()} == {"run1", "run2"}
    stats = fit_scaler(spark.createDataFrame([(1.0,), (3.0,)], "v double"), ["v"])
    save_transform(stats, os.path.join(d, "t"), {"features": ["v"]})
    assert spark.read.parquet(os.path.join(d, "t", "stats")).first()["v__mean"] == 2.0


def test_dispatch_and_stat_pass_through(spark):
    import pytest
    with pytest.raises(ValueError):
        ad.standardize(spark.range(1), "no_such_source")
    df = spark.createDataFrame(
        [(80, 6, 1.5, 2, 1, 100, 50, 1, 0, 0, 1, 1, 0, "BENIGN", 3.5, 7)],
        "`Destination Port` int, Protocol int, `Flow Duration` double, `Total Fwd Packets` long, "
        "`Total Backward Packets` long, `Total Length of Fwd Packets` long, `Total Length of Bwd Packets` long, "
        "`FIN Flag Count` int, `SYN Flag Count` int, `RST Flag Count` int, `PSH Flag Count` int, `ACK Flag Count` int, "
        "`URG Flag Count` int, Label string, `Flow IAT Mean` double, rid long")
    r = ad.adapt_cic(df, key="rid").first()
    assert (r.tcp_flags, r.binary_label, r.attack_type, r.stat_flow_iat_mean, r.flow_id) == (1 + 8 + 16, 0, "Normal", 3.5, 0)


def test_auc_ovr_and_label_helpers(spark):
    from flowlens import functions as fn
    from flowlens.operators import evaluate as ev
    rows = [(0, [0.8, 0.1, 0.1]), (1, [0.2, 0.7, 0.1]), (2, [0.1, 0.2, 0.7]), (0, [0.5, 0.3, 0.2]),
            (1, [0.3, 0.4, 0.3]), (2, [0.3, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    assert abs(ev.auc_ovr(df, "y", "p", 3).first()[0] - 1.0) < 1e-9
    lab = spark.createDataFrame([("Benign", 1), ("Theft", 1), ("DoS attacks-Hulk", 1), ("Odd", 1), ("Theft", 0)],
                                "label string, attack int")
    got = [r[0] for r in lab.select(fn.attack_family("label", "attack")).collect()]
    assert got == ["Normal", "Information_Theft", "DoS", "Other", "Normal"]
    pr = spark.createDataFrame([([0.7, 0.2, 0.1],)], "p array<double>")
    assert abs(pr.select(fn.attack_probability("p", 0)).first()[0] - 0.3) < 1e-9


# detectors, numbering and curves ------------------------------------------------------------------


def test_large_clusters_rule():
    from flowlens.operators.detect import large_clusters
    # share and ratio together win over an earlier ratio alone
    assert large_clusters({0: 50, 1: 45, 2: 3, 3: 2}, 0.9, 5) == {0, 1}
    # share only
    assert large_clusters({0: 50, 1: 40, 2: 30}, 0.7, 5) == {0, 1}
    # ratio only: the share of all but the last is never reached
    assert large_clusters({0: 60, 1: 10, 2: 9}, 0.99, 5) == {0}
    # ties by id; one cluster is large
    assert large_clusters({3: 5, 1: 5, 2: 5}, 0.6, 9) == {1, 2} and large_clusters({4: 9}, 0.9, 5) == {4}


def test_outlier_scores_rank_planted_rows(spark):
    import numpy as np
    from flowlens.operators import detect as dt
    rng = np.random.default_rng(1)
    rows = [(f"k{i:04d}", float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    rows += [(f"x{i}", 9.0 + i, -9.0 - i, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "flow_key string, a double, b double, y int")
    for run in (lambda: dt.cblof(df, df, ["a", "b"], k=3, contamination=0.02, alpha=0.7, beta=5),
                lambda: dt.isolation_forest(df, df, ["a", "b"], trees=8, sample=64, contamination=0.02),
                lambda: dt.pca_outlier(df, df, ["a", "b"], 2, 0.02), lambda: dt.hbos(df, df, ["a", "b"], contamination=0.02)):
        out = [(r["y"], r["score"]) for r in run().select("y", "score").collect()]
        bad, good = [s for y, s in out if y], [s for y, s in out if not y]
        assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good) > 0.95


def test_numbering_with_a_hot_value_and_constant_plan(spark):
    from pyspark.sql import functions as F
    from flowlens.operators import numbering as nb
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("v"))
    got = nb.exact_quantile(df, "v", 0.5).first()[0]
    assert got == 7.0
    rank = nb.dense_index(df, ["v", "id"], "r", by=[]).collect()
    want = {r["id"]: i for i, r in enumerate(sorted(rank, key=lambda r: (r["v"], r["id"])))}
    assert all(r["r"] == want[r["id"]] for r in rank)
    sizes = []
    for n in (4, 400):
        sizes.append(len(nb.dense_index(df, ["id"], "r", partitions=n)._jdf.queryExecution().toString()))
    assert abs(sizes[0] - sizes[1]) < 200


def test_block_counts_agree(spark):
    import numpy as np
    from flowlens.operators import knn
    x = np.random.default_rng(2).normal(size=(150, 5))
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "id long, v array<double>, y int")
    found = [sorted((r["src"], r["dst"], round(r["dist"], 9), r["rank"]) for r in knn.knn_join(df, "id", "v", 4, n_blocks=b).collect()) for b in (1, 4, 9)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 600
    near = [sorted((r["src"], r["dst"]) for r in knn.radius_join(df, "id", "v", 1.5, n_blocks=b).collect()) for b in (1, 4, 9)]
    assert near[0] == near[1] == near[2] and near[0]
    neg = [round(knn.negative_pair_term(df, "id", "v", "y", 0.1, n_blocks=b).first()[0], 9) for b in (1, 4, 9)]
    assert neg[0] == neg[1] == neg[2]


def test_injection_into_a_tiny_graph_has_distinct_targets(spark):
    from flowlens.operators import graph as gr
    nodes = spark.createDataFrame([(i, [1.0, 2.0 * i], 0) for i in range(3)], "id long, x array<double>, y int")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    _, e, new = gr.inject_sim_nodes(nodes, edges, 4, 2, c=5)
    pairs = [tuple(r) for r in e.where("src >= 3").collect()]
    assert len(pairs) == len(set(pairs)) == 12 and new.count() == 4
    _, _, zero = gr.inject_sim_nodes(nodes, edges, 1, 2, c=5, strategy="zero")
    assert zero.first()["x"] == [0.0, 0.0]


def test_pgd_closed_form_equals_the_steps(spark):
    import math
    from flowlens.operators import robust as rb
    w, b, eps, iters = [0.5, -0.3, 0.8], -0.2, 0.3, 7
    rows = [(i, [0.1 * i, 1 - 0.2 * i, 0.05 * i], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    got = {r["id"]: r["x"] for r in rb.pgd_perturb(df, "x", "y", w, b, eps, iters, step=0.02, mask=[0, 2]).collect()}
    for i, x, y in rows:
        cur = list(x)
        for _ in range(iters):
            p = 1 / (1 + math.exp(-(sum(a * c for a, c in zip(cur, w)) + b)))
            for k in (0, 2):
                g = (p - y) * w[k]
                cur[k] = min(max(cur[k] + 0.02 * ((g > 0) - (g < 0)), x[k] - eps), x[k] + eps)
        assert all(abs(a - c) < 1e-9 for a, c in zip(got[i], cur))


def test_sparse_one_hot(spark):
    from flowlens.operators.encode import one_hot_sparse
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    test = spark.createDataFrame([("a",), ("c",), ("new",), (None,)], "k string")
    got = {r["k"]: r["k_vec"].toArray().tolist() for r in one_hot_sparse(train, test, ["k"]).collect()}
    assert got["a"][:3] == [1.0, 0.0, 0.0] and got["c"][:3] == [0.0, 0.0, 1.0] and sum(got["new"]) == 0.0 and sum(got[None]) == 0.0


def test_bounded_scan_needs_an_order_and_dictionary_must_fit(spark, tmp_path):
    import pytest
    from flowlens import sources as src
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    with pytest.raises(ValueError):
        src.read_flows(spark, str(tmp_path / "a.csv"), limit=1)
    assert src.read_flows(spark, str(tmp_path / "a.csv"), limit=1, order=["x"]).first()["x"] == 1
    (tmp_path / "names.csv").write_text("name\none\ntwo\nthree\n")
    (tmp_path / "b.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        src.read_with_dictionary(spark, [str(tmp_path / "b.csv")], str(tmp_path / "names.csv"))


def test_fixed_tables_have_their_values():
    from flowlens.functions import columns as c
    from flowlens.operators import sampling as sm
    assert c.PROTOCOL_NAMES == {1: "ICMP", 6: "TCP", 17: "UDP"} and c.PROTOCOL_NUMBERS == {"tcp": 6, "udp": 17, "icmp": 1}
    assert (c.PROTOCOL_NAMES_EXTENDED[47], c.PROTOCOL_NAMES_EXTENDED[132], c.PROTOCOL_NAMES_EXTENDED[58]) == ("GRE", "SCTP", "IPv6-ICMP")
    assert (c.ATTACK_FAMILIES["Theft"], c.ATTACK_FAMILIES["Benign"], c.ATTACK_FAMILIES["Brute Force"]) == ("Information_Theft", "Normal", "Brute_Force")
    assert (c.MASK_IP_LOW, c.MASK_IP_HIGH) == (0xAC100001, 0xAC1F0001) and c.NSL_CLASSES == {"normal": 0, "neptune": 1}
    assert {k: v[:2] for k, v in sm.TIERS.items()} == {"1/10": (0.01, 0.10), "0.1/5": (0.001, 0.05)}


def test_stored_keeps_rows_and_names_and_no_shuffle_files(spark, tmp_path):
    import glob
    import time

    from flowlens.session import forget, stored
    df = spark.createDataFrame([(i % 3, f"k{i}", None if i % 2 else 1.5, [1.0, float(i)]) for i in range(40)], "`a b;{}` int, B string, b double, v array<double>")
    df = df.repartition(5, "v")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    def gone(before):
        for _ in range(50):
            if not files() - before:
                return True
            time.sleep(0.1)
        return False
    before = files()
    out = stored(df)
    assert gone(before)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    before = files()
    grouped = stored(df.groupBy("v").count())
    assert gone(before) and grouped.count() == 40
    path = out._stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    forget(out)
    assert not os.path.exists(path)


def test_adapters_number_only_the_columns_that_are_read(spark, monkeypatch):
    from flowlens import session
    from flowlens.operators import adapters as ad
    from flowlens.operators import graph as gr
    rows = [("10.0.0.1", 1, "10.0.0.2", 80, 6, 1.0, 10.0 + i, 2.0, i, i, 0, 5.0, i % 2, "DoS" if i % 2 else "Normal", f"k{i * 7 % 30:02}") for i in range(30)]
    raw = spark.createDataFrame(rows, "IPV4_SRC_ADDR string, L4_SRC_PORT int, IPV4_DST_ADDR string, L4_DST_PORT int, PROTOCOL int, L7_PROTO double, IN_BYTES double, "
                                "OUT_BYTES double, IN_PKTS int, OUT_PKTS int, TCP_FLAGS int, FLOW_DURATION_MILLISECONDS double, Label int, Attack string, flow_key string")
    wide = ad.adapt_netflow(raw).select("attack_type", "flow_id")
    kept, whole = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df: kept.append(df.columns) or whole(df))
    slim = ad.adapt_netflow(raw, only=["attack_type"])
    assert slim.columns == ["attack_type", "flow_id"] and sorted(slim.collect()) == sorted(wide.collect())
    assert kept == [["attack_type", "__pid", "__pos"]]
    edges = spark.createDataFrame([(f"e{i:02}", f"s{i}", f"d{i}", [float(i)]) for i in range(12)], "eid string, src string, dst string, h array<double>")
    kept.clear()
    out = gr.permute_features(edges, "eid").collect()
    assert [set(k) - {"__pid", "__pos"} for k in kept] == [{"eid", "src", "dst"}, {"h"}]
    import hashlib
    order = sorted(range(12), key=lambda i: hashlib.md5(f"42:e{i:02}".encode()).hexdigest())
    assert {r.eid: r.h for r in out} == {f"e{i:02}": [float(j)] for i, j in enumerate(order)}


def test_auc_over_many_runs_ties_and_groups(spark):
    import numpy as np

    from flowlens.operators.evaluate import auc
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.random() < 0.3), float(rng.integers(0, 50)) / 7 if g == "a" else float(rng.normal())) for g in ("a", "b", "c") for _ in range(700)]
    rows += [("c", 1, None), ("c", 0, None), ("c", 1, float("nan"))]
    rows = [(g, 1 if g == "b" else y, s) for g, y, s in rows]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {r.g: r.auc for r in auc(df, "y", "s", "g").collect()}
        one = auc(df.filter("g = 'a'"), "y", "s").first().auc
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def want(g):
        key = [(-np.inf if s is None else np.inf if s != s else s, y) for h, y, s in rows if h == g]
        p, n = [s for s, y in key if y], [s for s, y in key if not y]
        return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert got["b"] is None
    assert abs(got["a"] - want("a")) < 1e-12 and abs(got["c"] - want("c")) < 1e-12 and one == got["a"]


def test_graph_sweep_stores_one_scored_graph_at_a_time(spark, monkeypatch):
    from flowlens.operators import robust as rb
    e = spark.createDataFrame([(f"e{i}", f"s{i % 4}", f"d{i % 3}", [float(i % 5), 1.0], i % 2) for i in range(40)],
                              "eid string, src string, dst string, h array<double>, binary_label int")
    there, most, keep, drop = set(), [], rb.stored, rb.forget

    def put(df):
        out = keep(df)
        if "pred" in df.columns:
            there.add(out._stored_at)
            most.append(len(there))
        return out
    monkeypatch.setattr(rb, "stored", put)
    monkeypatch.setattr(rb, "forget", lambda df: there.discard(df._stored_at) or drop(df))
    res = rb.graph_sweep(e, [0.5, -0.3], [0.4, 0.2], [-0.2, 0.3], -0.5, [("pgd", 0.3), ("remove", 0.2), ("inject", 0.3)]).collect()
    assert sorted(r.perturbation for r in res) == ["clean", "inject", "pgd", "remove"] and most == [1, 1, 1, 1] and not there
    assert all(0 <= r.accuracy <= 1 and 0 <= r.auc <= 1 for r in res)


def test_quantiles_of_many_rows_sort_only_the_values_near_them(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    sets = [rng.normal(size=30000) ** 5, np.concatenate([np.full(20000, 2.5), rng.random(10000)]), np.repeat([1.0, 7.0], 15000),
            np.concatenate([rng.random(29000), np.full(1000, np.inf)])]
    qs, sorted_rows, whole = [0.0, 0.5, 0.8, 0.95, 0.999, 1.0], [], nb._ranged
    monkeypatch.setattr(nb, "BRACKET_ABOVE", 1000)
    monkeypatch.setattr(nb, "BRACKET_ACCURACY", 2000)
    monkeypatch.setattr(nb, "_ranged", lambda df, *a: sorted_rows.append(df.count()) or whole(df, *a))
    for x in sets:
        df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)] + [(None,)], "s double")
        got = nb.exact_quantiles(df, "s", qs).first().quantiles
        want = np.sort(x)
        for g, q in zip(got, qs):
            h = (len(x) - 1) * q
            lo, hi = want[int(np.floor(h))], want[int(np.ceil(h))]
            assert g == lo + (h - np.floor(h)) * (hi - lo) or (np.isnan(g) and np.isinf(lo))
    assert max(sorted_rows) < 1000
    monkeypatch.setattr(nb, "_brackets", lambda *a: None)  # a sketch that missed
    assert nb.exact_quantiles(df, "s", [0.5]).first().quantiles[0] == np.sort(x)[14999:15001].mean()


def test_a_small_hash_sample_takes_one_pass(spark, monkeypatch):
    import hashlib
    keys = [f"k{i % 90}" for i in range(100)]  # ten keys twice
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    sizes = {}
    for n in (1, 30, 100, 130):
        old = nb.mark_first_n(df, [], lambda c: c.select(F.lit(n).cast("bigint").alias("n")), "k").filter("_in").select("k").collect()
        sizes[n] = sorted(r.k for r in old)
    monkeypatch.setattr(nb, "mark_first_n", None)
    for n, want in sizes.items():
        got = sorted(r.k for r in nb.hash_rank_flag(df, n, "k").filter("_in").select("k").collect())
        assert got == want and set(got) == set(order[:n])
