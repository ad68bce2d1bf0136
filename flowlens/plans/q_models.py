"""Checked queries: detectors, classifiers, robustness, triage, encoders,
remaining scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import functions as fn
from ..operators import aggregate as agg
from ..operators import detect as dt
from ..operators import encode as enc
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import knn
from ..operators import learn as ln
from ..operators import propagate as pg
from ..operators import robust as rb
from ..operators import sampling as sm
from ..operators import triage as tr
from .q_flows import std_li
from .q_graph import DIM, EMB, emb, emb_nodes, explode_vec, knn_sql, sql_elems, sql_explode
from .q_sampling import D
from .registry import query, rounded
from .sqltext import with_fx, with_li

FEATS = ["duration_ms", "bytes_in", "packets_in"]


def _split_std(spark, sf, cols=FEATS):
    """Train/test split of the wanted columns, materialized once: it feeds
    the fit, the threshold and the scoring jobs."""
    from ..session import cut_lineage
    s = cut_lineage(_split_std_lazy(spark, sf).select("flow_key", "binary_label", "split", *cols))
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split")


def _split_std_lazy(spark, sf):
    return sm.split(std_li(spark, sf, number=False).select("flow_key", "binary_label", "attack_type", "protocol_name",
                                                         "dst_port", *FEATS)
                 .withColumn("bytes_in", F.col("bytes_in").cast("double"))
                 .withColumn("packets_in", F.col("packets_in").cast("double")), "flow_key", None, 0.3)


SPLIT_STD = f"""gs AS (SELECT flow_key, binary_label, attack_type, protocol_name, dst_port, duration_ms,
       CAST(bytes_in AS DOUBLE) AS bytes_in, CAST(packets_in AS DOUBLE) AS packets_in,
       CASE WHEN row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) <= ceil(count(*) OVER () * {D(0.3)})
            THEN 'test' ELSE 'train' END AS split FROM std),
  trn AS (SELECT * FROM gs WHERE split = 'train'), tst AS (SELECT * FROM gs WHERE split = 'test')"""


def _hbos_sql(bins: int = 10, alpha: float = 0.1) -> str:
    f = FEATS
    mm = ", ".join([f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(f)])
    wid = ", ".join([f"CASE WHEN hi{i} > lo{i} THEN (hi{i} - lo{i}) / {bins}.0 ELSE 1.0 / {bins} END AS w{i}" for i in range(len(f))])

    def binx(i, c):
        return (f"CASE WHEN {c} >= hi{i} THEN {bins - 1} ELSE least(greatest(CAST(floor(({c} - lo{i}) / w{i}) AS INTEGER), 0), {bins - 1}) END")

    tb = " UNION ALL ".join([f"SELECT {i} AS f, {binx(i, c)} AS b FROM trn, mm" for i, c in enumerate(f)])
    dens = []
    for i, c in enumerate(f):
        dens.append(f"""(SELECT CASE WHEN {c} < lo{i} AND lo{i} - {c} > 0.5 * w{i} THEN mn.d
                      WHEN {c} > hi{i} AND {c} - hi{i} > 0.5 * w{i} THEN mn.d
                      ELSE g.d END
             FROM grid g, (SELECT min(d) AS d FROM grid WHERE f = {i}) mn WHERE g.f = {i} AND g.b = {binx(i, c)})""")
    score = " + ".join([f"log2({d} + {alpha})" for d in dens])
    return f"""
, mm AS (SELECT count(*) AS n, {mm} FROM trn),
  mm2 AS (SELECT *, {wid} FROM mm),
  bt AS (SELECT f, b, count(*) AS c FROM ({tb.replace('FROM trn, mm', 'FROM trn, mm2')}) GROUP BY f, b),
  grid AS (SELECT ff.f, bb.b, coalesce(bt.c, 0) / (mm2.n * CASE ff.f {' '.join(f'WHEN {i} THEN w{i}' for i in range(len(f)))} END) AS d
           FROM range(0, {len(f)}) ff(f) CROSS JOIN range(0, {bins}) bb(b) CROSS JOIN mm2 LEFT JOIN bt ON bt.f = ff.f AND bt.b = bb.b),
  strn AS (SELECT flow_key, -({score}) AS score FROM trn, mm2),
  stst AS (SELECT flow_key, -({score}) AS score FROM tst, mm2),
  thr AS (SELECT quantile_cont(score, 0.9) AS t FROM strn)"""


def _hbos_spark(spark, sf):
    trn, tst = _split_std(spark, sf)
    m = dt.fit_hbos(trn, FEATS, 10)
    thr = dt.threshold(dt.hbos_score(trn, m), 0.1)
    return dt.apply_threshold(dt.hbos_score(tst, m), thr)


query("det1_hbos_scores", with_li(_hbos_sql().replace("\n, mm AS", "mm AS", 1).join([", ", ""]).join(["", """
SELECT flow_key, round(score, 6) AS score, CAST(score > t AS INTEGER) AS pred FROM stst, thr"""]), extra=[SPLIT_STD]))(
    lambda spark, sf: rounded(_hbos_spark(spark, sf).select("flow_key", "score", "pred")))

query("det5_contamination_threshold", with_li(_hbos_sql().replace("\n, mm AS", "mm AS", 1).join([", ", ""]).join(["", """
SELECT round(t, 6) AS threshold FROM thr"""]), extra=[SPLIT_STD]))(
    lambda spark, sf: (lambda trn: rounded(dt.threshold(dt.hbos_score(trn, dt.fit_hbos(trn, FEATS, 10)), 0.1)))(_split_std(spark, sf)[0]))

# DET-6: grids of a parameter and the contamination, on all or only on benign training rows ---------------------------
BINS, LEVELS = [5, 10, 15, 20, 25, 30], [0.001, 0.01, 0.04, 0.05, 0.1, 0.2]
SWEEP_POINTS = [("cblof", [2, 3, 5, 0]), ("pca", [1, 2, 3, 9]), ("forest", [5, 10])]  # no cluster and nine components of three features are refused


def _sweep_sql(benign: bool) -> str:
    """Every grid point of the histogram detector, as one query."""
    import re
    ctes, rows = [], []
    for n, b in enumerate(BINS):
        text = re.sub(r"\b(mm|mm2|bt|grid|strn|stst|thr)\b", rf"\1_{b}", _hbos_sql(b).replace("\n, mm AS", "mm AS", 1).replace("SELECT flow_key, -(", "SELECT flow_key, binary_label, -("))
        text = text.replace("quantile_cont(score, 0.9)", f"quantile_cont(score, {[1.0 - c for c in LEVELS]!r})")
        ctes.append(re.sub(r"\btrn\b", "fit", text))
        for i, c in enumerate(LEVELS):
            rows.append(f"SELECT {b} AS param, {n * len(LEVELS) + i} AS grid_order, {c!r}::DOUBLE AS contamination, t[{i + 1}] AS threshold, "
                        f"count(*) FILTER (WHERE binary_label = 1 AND score > t[{i + 1}]) AS tp, count(*) FILTER (WHERE binary_label <> 1 AND score > t[{i + 1}]) AS fp, "
                        f"count(*) FILTER (WHERE binary_label = 1) AS p, count(*) FILTER (WHERE binary_label <> 1) AS n FROM stst_{b}, thr_{b} GROUP BY t")
    points = "points AS (" + " UNION ALL ".join(rows) + ")"
    body = """SELECT 'hbos' AS detector, param, grid_order, contamination, round(threshold, 6) AS threshold,
       round((CASE WHEN tp + fp + p > 0 THEN 2.0 * tp / (tp + fp + p) ELSE 0 END + CASE WHEN n - fp + p - tp + n > 0 THEN 2.0 * (n - fp) / (n - fp + p - tp + n) ELSE 0 END)
             / ((tp + fp + p > 0)::INTEGER + (n - fp + p - tp + n > 0)::INTEGER), 6) AS macro_f1, CAST(NULL AS VARCHAR) AS error FROM points"""
    fit = "fit AS (SELECT * FROM trn" + (" WHERE binary_label = 0)" if benign else ")")
    return with_li(body, extra=[SPLIT_STD, fit, *ctes, points])


for _benign, _name in ((False, "det6_hbos_grid"), (True, "det6_hbos_grid_benign")):
    query(_name, _sweep_sql(_benign))(lambda spark, sf, benign=_benign: rounded(dt.sweep(*_split_std(spark, sf), FEATS, "binary_label", "hbos", BINS, LEVELS, benign)))


def _sweeps(spark, sf):
    trn, tst = _split_std(spark, sf)
    out = None
    for name, params in SWEEP_POINTS:
        r = dt.sweep(trn, tst, FEATS, "binary_label", name, params, LEVELS, benign_only=name == "cblof")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


query("det6_detector_sweeps")(_sweeps)
query("det6_hbos_sweep", _sweep_sql(False) + " WHERE param IN (5, 10) ORDER BY round(macro_f1, 12) DESC, grid_order LIMIT 1")(lambda spark, sf: rounded(
    ev.best_params(dt.sweep(*_split_std(spark, sf), FEATS, "binary_label", "hbos", BINS[:2], LEVELS), "macro_f1", "grid_order")))


def _metrics_of(pred_df, y="binary_label"):
    return rounded(ev.binary_metrics(pred_df.withColumn("y", F.col(y)), "y", "pred"))


# DET-2 / DET-3 scoring given the fitted state: fixed centres with large clusters 0 and 2, fixed components ----------------
CENTRES = [[1000.0, 5000.0, 10.0], [200000.0, 40000.0, 30.0], [50000.0, 100000.0, 50.0]]
LARGE = {0, 2}
COMPONENTS, SHARES = [[0.6, 0.8, 0.0], [0.0, 0.6, 0.8]], [0.7, 0.2]


def _dist(cols, point):
    return "sqrt(" + " + ".join(f"({c} - {v!r}::DOUBLE) ** 2" for c, v in zip(cols, point)) + ")"


query("det2_cblof_scoring", with_li(f"""
, d AS (SELECT flow_key, [{", ".join(_dist(FEATS, c) for c in CENTRES)}] AS d FROM tst)
SELECT flow_key, round(CASE WHEN list_position(d, list_min(d)) - 1 IN (0, 2) THEN list_min(d) ELSE least(d[1], d[3]) END, 4) AS score FROM d"""
    .replace("\n, d AS", ", d AS", 1), extra=[SPLIT_STD]))(
    lambda spark, sf: rounded(dt.cblof_score(_split_std(spark, sf)[1], FEATS, CENTRES, LARGE).select("flow_key", "score"), 4))

_Z = [f"z{i}" for i in range(3)]
query("det3_pca_scoring", with_li(f"""
, st AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(FEATS))} FROM trn),
  z AS (SELECT flow_key, {", ".join(f"({c} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS z{i}" for i, c in enumerate(FEATS))} FROM tst, st)
SELECT flow_key, round({" + ".join(f"{_dist(_Z, c)} / {w!r}::DOUBLE" for c, w in zip(COMPONENTS, SHARES))}, 5) AS score FROM z"""
    .replace("\n, st AS", ", st AS", 1), extra=[SPLIT_STD]))(lambda spark, sf: _pca_fixed(spark, sf))


def _pca_fixed(spark, sf):
    trn, tst = _split_std(spark, sf)
    z = enc.apply_scaler(tst, enc.fit_scaler(trn, FEATS), FEATS, "_z")
    return rounded(dt.pca_score(z, [c + "_z" for c in FEATS], COMPONENTS, SHARES).select("flow_key", "score"), 5)


query("det2_cblof")(lambda spark, sf: _metrics_of(dt.cblof(*_split_std(spark, sf), FEATS, k=8, contamination=0.1, alpha=0.7, beta=3)))
query("det3_pca_outlier")(lambda spark, sf: _metrics_of(dt.pca_outlier(*_split_std(spark, sf), FEATS, 2, 0.1)))
query("det4_isolation_forest")(lambda spark, sf: _metrics_of(dt.isolation_forest(*_split_std(spark, sf), FEATS, trees=10, sample=256)))


def _cls(kind):
    def run(spark, sf):
        trn, tst = _split_std(spark, sf)
        m = dt.train_classifier(trn, FEATS, "binary_label", kind)
        return _metrics_of(dt.predict(m, tst, FEATS)).withColumn("model", F.lit(kind))
    return run


for _k, _n in (("lr", "cls1_logistic_regression"), ("dt", "cls2_decision_tree"), ("rf", "cls2_random_forest"),
               ("gbt", "cls2_gradient_boosting"), ("mlp", "cls3_multilayer_perceptron"), ("svm", "cls4_linear_svm")):
    query(_n)(_cls(_k))


def _benchmark(spark, sf):
    """CLS-7 + ORD-1: several models on one split -> leaderboard by F1."""
    import time
    trn, tst = _split_std(spark, sf)
    res = None
    for kind in ("lr", "dt", "rf", "gbt", "mlp", "svm"):
        t0 = time.time()
        m = dt.train_classifier(trn, FEATS, "binary_label", kind)
        r = _metrics_of(dt.predict(m, tst, FEATS)).withColumn("model", F.lit(kind)) \
            .withColumn("fit_seconds", F.lit(round(time.time() - t0, 3)))
        res = r if res is None else res.unionByName(r)
    return ev.leaderboard(res, "f1")


query("cls7_benchmark_leaderboard")(_benchmark)


def _cross(spark, sf):
    """CLS-8: scaler and head fitted on all rows of each source, tested on every source, on the columns they share."""
    from .. import fixtures as fx
    from ..operators import adapters as ad
    from .q_flows import cic_std
    sources = {"li": std_li(spark, sf), "ev": ad.adapt_bot_iot_reduced(fx.ev(spark, sf), key="pkSeqID"), "od": cic_std(spark, sf)}
    return rounded(ln.cross_dataset(sources, "binary_label", ("flow_id", "src_port", "dst_port", "protocol", "attack_code")))


query("cls8_cross_dataset")(_cross)


def _labelled_graph(spark, sf):
    """Nodes (id, x, y, split) and edges of the kNN graph of the vectors."""
    from ..session import cut_lineage
    nodes = emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") % 2).alias("y"))
    s = sm.split(nodes.withColumn("k", F.col("id").cast("string")), "k", ["y"], 0.3).drop("k")
    return cut_lineage(s), cut_lineage(knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 10))


def _graph_classifier(spark, sf):
    """CLS-5: two SAGE hops on the kNN graph, then a weighted LR head."""
    nodes, edges = _labelled_graph(spark, sf)
    m = ln.train_graph_classifier(nodes, edges, DIM, "sage", 2, mask=F.col("split") == "train")
    return _metrics_of(m.predict(nodes, edges).join(nodes.filter("split = 'test'").select("id", "y"), "id"), "y")


query("cls5_kinds_leaderboard")(lambda spark, sf: rounded(ln.kinds_leaderboard(
    *_labelled_graph(spark, sf), DIM, F.col("split") == "train", F.col("split") == "test")))
query("cls5_graph_classifier")(_graph_classifier)

# ROB-1: PGD against a logistic head (oracle: closed form) ---------------------------------------
W_LR = [0.5, -0.3, 0.8]
B_LR = -4.0
EPS_PGD = 0.3


def _lvec(df):
    return df.withColumn("x", F.array(F.log1p("duration_ms"), F.log1p(F.col("bytes_in").cast("double")),
                                      F.log1p(F.col("packets_in").cast("double"))))


query("rob1_pgd_perturb", with_li(f"""
, v AS (SELECT flow_key, binary_label AS y, [ln(1 + duration_ms), ln(1 + bytes_in), ln(1 + packets_in)] AS x FROM std),
  p AS (SELECT *, 1 / (1 + exp(-(x[1] * {D(W_LR[0])} + x[2] * {D(W_LR[1])} + x[3] * {D(W_LR[2])} + {D(B_LR)}))) AS p0 FROM v),
  o AS (SELECT flow_key, [x[1] + {D(EPS_PGD)} * sign(p0 - y) * sign({D(W_LR[0])}), x[2] + {D(EPS_PGD)} * sign(p0 - y) * sign({D(W_LR[1])}),
                          x[3] + {D(EPS_PGD)} * sign(p0 - y) * sign({D(W_LR[2])})] AS x FROM p)
{sql_explode('o', 'flow_key', 'x', 3)}""").replace("\n, v AS", ", v AS", 1))(
    lambda spark, sf: explode_vec(rb.pgd_perturb(_lvec(std_li(spark, sf, number=False)), "x", "binary_label",
                                                 W_LR, B_LR, EPS_PGD, 10), ["flow_key"]))

PLAN = [("pgd", 0.1), ("pgd", 0.3), ("drop", 0.1), ("drop", 0.3)]


def _sweep(spark, sf):
    return rb.robustness_sweep(_lvec(std_li(spark, sf, number=False)), "x", "binary_label", W_LR, B_LR, PLAN, iters=5)


def _sweep_sql(degrade: bool, plan=None) -> str:
    plan = PLAN if plan is None else plan
    w0, w1, w2 = (D(v) for v in W_LR)
    lin = lambda a, b_, c: f"{a} * {w0} + {b_} * {w1} + {c} * {w2} + {D(B_LR)}"
    parts = ["SELECT 'clean' AS pert, CAST(0.0 AS DOUBLE) AS param, flow_key, y, x1, x2, x3 FROM p"]
    for kind, prm in plan:
        if kind == "pgd":
            e = D(prm)
            parts.append(f"SELECT 'pgd', {D(float(prm))}, flow_key, y, x1 + {e} * sign(p0 - y) * sign({w0}), "
                         f"x2 + {e} * sign(p0 - y) * sign({w1}), x3 + {e} * sign(p0 - y) * sign({w2}) FROM p")
        else:
            parts.append(f"SELECT 'drop', {D(float(prm))}, flow_key, y, x1, x2, x3 FROM "
                         f"(SELECT *, row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) AS rn FROM p) "
                         f"WHERE rn > (SELECT floor(count(*) * {D(float(prm))}) FROM p)")
    union = "\n  UNION ALL ".join(parts)
    body = f"""
, v AS (SELECT flow_key, binary_label AS y, ln(1 + duration_ms) AS x1, ln(1 + CAST(bytes_in AS DOUBLE)) AS x2,
               ln(1 + CAST(packets_in AS DOUBLE)) AS x3 FROM std),
  p AS (SELECT *, 1 / (1 + exp(-({lin('x1', 'x2', 'x3')}))) AS p0 FROM v),
  allp AS ({union}),
  sp AS (SELECT *, 1 / (1 + exp(-({lin('x1', 'x2', 'x3')}))) AS score FROM allp),
  sp2 AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM sp),
  m AS (SELECT pert, param, avg(CAST(y = pred AS DOUBLE)) AS accuracy,
               count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn FROM sp2 GROUP BY pert, param),
  m2 AS (SELECT pert, param, accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
                CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m),
  rk AS (SELECT pert, param, y, rank() OVER (PARTITION BY pert, param ORDER BY score)
                + (count(*) OVER (PARTITION BY pert, param, score) - 1) / 2.0 AS r FROM sp2),
  au AS (SELECT pert, param, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
                / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) AS auc FROM rk GROUP BY pert, param),
  res AS (SELECT m2.pert AS perturbation, m2.param, accuracy, precision, recall, f1, auc FROM m2 JOIN au USING (pert, param))"""
    if not degrade:
        sel = """
SELECT perturbation, round(param, 6) AS param, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM res"""
    else:
        sel = """
SELECT r.perturbation, round(r.param, 6) AS param, round(r.accuracy, 6) AS accuracy, round(r.precision, 6) AS precision,
       round(r.recall, 6) AS recall, round(r.f1, 6) AS f1, round(r.auc, 6) AS auc,
       round(r.accuracy - c.accuracy, 6) AS delta_accuracy, round(r.precision - c.precision, 6) AS delta_precision,
       round(r.recall - c.recall, 6) AS delta_recall, round(r.f1 - c.f1, 6) AS delta_f1, round(r.auc - c.auc, 6) AS delta_auc
FROM res r, (SELECT * FROM res WHERE perturbation = 'clean') c"""
    return with_li((body + sel).replace("\n, v AS", ", v AS", 1))


query("rob2_robustness_sweep", _sweep_sql(False))(lambda spark, sf: rounded(_sweep(spark, sf)))
query("rob3_degradation", _sweep_sql(True))(lambda spark, sf: rounded(ev.degradation(_sweep(spark, sf))))

# TRI-2: verdict parsing (fixture strings from documents.doc_id) ---------------------------------------
VERDICT_SQL = """SELECT doc_id AS node_id, CASE
 WHEN doc_id % 4 = 0 THEN concat('{{"node_id": ', CAST(CASE WHEN doc_id % 8 = 4 THEN doc_id + 1 ELSE doc_id END AS STRING),
      ', "confidence_score": ', CAST((doc_id * 37) % 13 AS STRING), '.0e-1, "justification": "pattern ', CAST(doc_id AS STRING), '"}}')
 WHEN doc_id % 4 = 1 THEN concat('[{{"node_id": ', CAST(doc_id AS STRING), ', "confidence_score": ',
      CASE WHEN doc_id % 16 = 5 THEN '"high"' ELSE concat(CAST((doc_id * 37) % 13 AS STRING), '.0e-1') END, ', "justification": "list"}}]')
 WHEN doc_id % 4 = 2 THEN concat('```json', chr(10), '{{', chr(10), '  "node_id": ', CAST(doc_id AS STRING), ',', chr(10),
      '  "confidence_score": ', CAST((doc_id * 37) % 13 AS STRING), '.0e-1', CASE WHEN doc_id % 16 = 6 THEN '' ELSE ', "justification": "fenced"' END,
      chr(10), '}}', chr(10), '```')
 ELSE concat('I cannot tell for node ', CAST(doc_id AS STRING)) END AS raw FROM {documents}"""


def verdicts(spark, sf):
    from ..session import read_table
    return spark.sql(VERDICT_SQL, documents=read_table(spark, sf, "documents"))


VERDICTS = "vr AS (" + VERDICT_SQL.format(documents="documents") + ")"
PARSE_SQL = """pv AS (
 SELECT node_id, s, is_list,
        CASE WHEN s LIKE '{%' AND s LIKE '%}' THEN s
             WHEN is_list THEN CASE WHEN trim(CAST(json_extract(s, '$[0]') AS VARCHAR)) LIKE '{%' THEN CAST(json_extract(s, '$[0]') AS VARCHAR) END
             WHEN regexp_extract(s, '(?s)```json\n(\\{.*?\n\\})\n```', 1) <> '' THEN trim(regexp_extract(s, '(?s)```json\n(\\{.*?\n\\})\n```', 1))
        END AS txt
 FROM (SELECT node_id, trim(raw) AS s, trim(raw) LIKE '[%' AND trim(raw) LIKE '%]' AS is_list FROM vr)),
 pj AS (SELECT node_id, is_list, txt,
        CASE WHEN json_valid(txt) THEN json_extract_string(txt, '$.node_id') END AS nid_s,
        CASE WHEN json_valid(txt) THEN json_extract_string(txt, '$.confidence_score') END AS conf_s,
        CASE WHEN json_valid(txt) THEN json_extract_string(txt, '$.justification') END AS just
        FROM pv),
 pe AS (SELECT *, TRY_CAST(nid_s AS DOUBLE) AS nid, TRY_CAST(conf_s AS DOUBLE) AS conf,
        CASE WHEN is_list AND txt IS NULL THEN 'bad_list' WHEN txt IS NULL THEN 'no_json' WHEN NOT json_valid(txt) THEN 'decode'
             WHEN nid_s IS NULL OR conf_s IS NULL OR just IS NULL THEN 'missing_keys'
             WHEN TRY_CAST(nid_s AS DOUBLE) IS NULL OR TRY_CAST(conf_s AS DOUBLE) IS NULL THEN 'bad_value'
             WHEN CAST(floor(TRY_CAST(nid_s AS DOUBLE)) AS BIGINT) <> node_id THEN 'mismatch' END AS error FROM pj),
 parsed AS (SELECT CAST(node_id AS BIGINT) AS node_id,
        CASE WHEN error IS NULL THEN least(greatest(conf, 0.0), 1.0) ELSE 0.0 END AS confidence_score,
        CASE WHEN error IS NULL THEN just ELSE 'N/A - ' || error END AS justification, error FROM pe)"""

query("tri2_parse_verdicts", with_fx("SELECT node_id, round(confidence_score, 6) AS confidence_score, justification, error FROM parsed",
                                     [], [VERDICTS, PARSE_SQL]))(
    lambda spark, sf: rounded(tr.parse_verdicts(verdicts(spark, sf))))

query("tri3_flag_nodes", with_fx("SELECT node_id FROM parsed WHERE confidence_score >= 0.8 AND error IS NULL",
                                 [], [VERDICTS, PARSE_SQL]))(
    lambda spark, sf: tr.flag_nodes(tr.parse_verdicts(verdicts(spark, sf)), 0.8))


# GR-12 + TRI-4 + TRI-5: injection into the k=20 similarity graph, triage, removal --------------------
def _sim_injected(spark, sf, cut: bool = False, edges=None):
    nodes = emb_nodes(spark, sf)
    edges = edges if edges is not None else knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 20)
    if cut:
        from ..session import cut_lineage
        edges = cut_lineage(edges)
    n2, e2, new = gr.inject_sim_nodes(nodes, edges, 20, DIM, c=5, strategy="mean", label=0)
    if cut:
        n2, e2, new = cut_lineage(n2), cut_lineage(e2), cut_lineage(new)
    return n2, e2, new


INJ_SQL = f"""nodes AS (SELECT vec_id AS id, e AS x FROM emb),
 st AS (SELECT count(*) AS n, max(id) AS mx, {sql_elems('avg', 'x')} AS m FROM nodes),
 new AS (SELECT j, n, mx + 1 + j AS id, m AS x FROM st, range(0, 20) t(j)),
 nidx AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), CAST(id AS VARCHAR)) - 1 AS nidx FROM nodes),
 pick AS (SELECT id, t * n // least(5, n) + (('0x' || substr(md5('42:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 12))::BIGINT)
                 % ((t + 1) * n // least(5, n) - t * n // least(5, n)) AS place FROM new, range(0, 5) tt(t) WHERE t < n),
 links AS (SELECT pick.id, nidx.id AS target FROM pick JOIN nidx ON nidx.nidx = pick.place),
 edges AS (SELECT src, dst FROM kn UNION ALL SELECT id, target FROM links UNION ALL SELECT target, id FROM links)"""

query("gr12_inject_sim_nodes", with_fx(sql_explode("new", "id", "x", DIM),
                                       [], [EMB, knn_sql(20), INJ_SQL]))(
    lambda spark, sf: explode_vec(_sim_injected(spark, sf)[2], ["id"]))

query("gr12_injected_edge_count", with_fx("SELECT count(*) AS edges, count(DISTINCT src) AS sources FROM edges",
                                          [], [EMB, knn_sql(20), INJ_SQL]))(
    lambda spark, sf: _sim_injected(spark, sf)[1].agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources")))


def _triage_fixed(spark, sf, cut: bool = True, edges=None):
    nodes, edges, new = _sim_injected(spark, sf, cut, edges)
    flagged = tr.flag_nodes(tr.parse_verdicts(verdicts(spark, sf)), 0.8).withColumnRenamed("node_id", "id")
    flagged = flagged.join(nodes.select("id"), "id", "left_semi")
    n2, e2, _ = gr.remove_nodes(nodes, edges, flagged)
    return nodes, edges, new, flagged, n2, e2


FLAGGED = "fl AS (SELECT node_id AS id FROM parsed WHERE confidence_score >= 0.8 AND error IS NULL AND node_id IN (SELECT id FROM nodes UNION ALL SELECT id FROM new))"
query("tri4_remove_flagged", with_fx("""
SELECT (SELECT count(*) FROM (SELECT id FROM nodes UNION ALL SELECT id FROM new) WHERE id NOT IN (SELECT id FROM fl)) AS nodes,
       (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM fl) AND dst NOT IN (SELECT id FROM fl)) AS edges""",
    [], [EMB, knn_sql(20), INJ_SQL, VERDICTS, PARSE_SQL, FLAGGED]))(
    lambda spark, sf: (lambda t: enc._attach_one_row(t[4].agg(F.count(F.lit(1)).alias("nodes")),
                                                     t[5].agg(F.count(F.lit(1)).alias("edges"))))(_triage_fixed(spark, sf)))

query("tri5_mitigation_tally", with_fx("""
SELECT (SELECT count(*) FROM fl) AS flagged, (SELECT count(*) FROM fl WHERE id IN (SELECT id FROM new)) AS injected_found,
       (SELECT count(*) FROM fl WHERE id NOT IN (SELECT id FROM new)) AS wrongly_flagged,
       (SELECT count(*) FROM new WHERE id NOT IN (SELECT id FROM fl)) AS missed""",
    [], [EMB, knn_sql(20), INJ_SQL, VERDICTS, PARSE_SQL, FLAGGED]))(
    lambda spark, sf: (lambda t: tr.mitigation_tally(t[3].withColumnRenamed("id", "node_id"),
                                                     t[2].withColumnRenamed("id", "node_id")))(_triage_fixed(spark, sf)))


def _triage_report(spark, sf):
    """TRI-6: the same node scorer evaluated on clean, injected and fixed graphs."""
    from ..session import cut_lineage
    clean_nodes = emb_nodes(spark, sf)
    clean_edges = cut_lineage(knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 20))
    nodes, edges, new, flagged, n2, e2 = _triage_fixed(spark, sf, cut=True, edges=clean_edges)
    n2, e2 = cut_lineage(n2), cut_lineage(e2)

    def evaluate(name, n, e):
        h = pg.propagate(n, e, DIM, "sage")
        s = h.join(n.select("id", F.coalesce(F.col("y"), F.lit(0)).alias("y0")), "id") \
             .select((F.col("y0") % 2).alias("y"), fn.sigmoid(F.aggregate("x", F.lit(0.0), lambda a, b: a + b) * 10).alias("score"))
        s = s.withColumn("pred", (F.col("score") > 0.5).cast("int"))
        return enc._attach_one_row(ev.binary_metrics(s), ev.auc(s)).withColumn("graph", F.lit(name))
    return rounded(evaluate("clean", clean_nodes, clean_edges).unionByName(evaluate("injected", nodes, edges))
                   .unionByName(evaluate("fixed", n2, e2)))


def _tri6_sql() -> str:
    graphs = {"clean": ("gcn_n", "gcn_e"), "injected": ("gin_n", "gin_e"), "fixed": ("gfx_n", "gfx_e")}
    ctes = ["""gcn_n AS (SELECT vec_id AS id, e AS x, label AS y FROM emb)""",
            "gcn_e AS (SELECT src, dst FROM kn)",
            "gin_n AS (SELECT id, x, y FROM gcn_n UNION ALL SELECT id, x, 0 FROM new)",
            "gin_e AS (SELECT src, dst FROM edges)",
            "gfx_n AS (SELECT * FROM gin_n WHERE id NOT IN (SELECT id FROM fl))",
            "gfx_e AS (SELECT * FROM gin_e WHERE src NOT IN (SELECT id FROM fl) AND dst NOT IN (SELECT id FROM fl))"]
    sc = []
    for name, (gn, ge) in graphs.items():
        ctes.append(f"""a_{name} AS (SELECT e.dst, {sql_elems('avg', 'n.x')} AS s
                        FROM {ge} e JOIN {gn} n ON n.id = e.src GROUP BY e.dst)""")
        ctes.append(f"""h_{name} AS (SELECT n.y % 2 AS y,
                        list_sum(list_transform(range(1, {DIM + 1}), lambda i: coalesce(a.s[i], 0.0))) AS t
                        FROM {gn} n LEFT JOIN a_{name} a ON a.dst = n.id)""")
        sc.append(f"SELECT '{name}' AS graph, y, 1 / (1 + exp(-(t * 10))) AS score FROM h_{name}")
    ctes.append("sc AS (" + " UNION ALL ".join(sc) + ")")
    ctes.append("sp AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM sc)")
    ctes.append("""m AS (SELECT graph, avg(CAST(y = pred AS DOUBLE)) AS accuracy,
          count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
          count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn FROM sp GROUP BY graph)""")
    ctes.append("""rk AS (SELECT graph, y, rank() OVER (PARTITION BY graph ORDER BY score)
          + (count(*) OVER (PARTITION BY graph, score) - 1) / 2.0 AS r FROM sp)""")
    ctes.append("""au AS (SELECT graph, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
          / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) AS auc FROM rk GROUP BY graph)""")
    body = """
SELECT m.graph, round(accuracy, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(auc, 6) AS auc
FROM m JOIN au ON au.graph = m.graph"""
    return with_fx(body, [], [EMB, knn_sql(20), INJ_SQL, VERDICTS, PARSE_SQL, FLAGGED] + ctes)


query("tri6_triage_report", _tri6_sql())(_triage_report)

# TRI-1: prompts; every seventh node has no raw record, as injected nodes
RAW_SQL = "SELECT vec_id AS id, label, CASE label % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol FROM {t} WHERE vec_id % 7 <> 3"


def _prompts(spark, sf):
    from ..session import cut_lineage
    nodes = emb(spark, sf)
    raw = spark.sql(RAW_SQL.format(t="{e}"), e=nodes)
    return tr.render_prompts(nodes.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")),
                             cut_lineage(knn.knn_graph(nodes, "vec_id", "embedding", 20)), raw)


query("tri1_render_prompts", with_fx("""
, raw AS (""" + RAW_SQL.format(t="emb") + """),
  own AS (SELECT e.vec_id AS id, coalesce('label=' || raw.label || ', protocol=' || raw.protocol || ', protocol_name=' ||
                 CASE raw.protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END, 'none (no raw record)') AS r,
                 array_to_string(list_transform(e.e[1:10], lambda v: format('{:.4f}', v)), ', ') AS f
          FROM emb e LEFT JOIN raw ON raw.id = e.vec_id),
  nb AS (SELECT src, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN '  - neighbour ' || dst || ': [' || o.r || ']' END, chr(10) ORDER BY dst) AS t
         FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM kn) k JOIN own o ON o.id = k.dst GROUP BY src)
SELECT own.id AS node_id, 'Node ' || own.id || chr(10) || 'Raw attributes: ' || own.r || chr(10) || 'Processed features: ' || own.f || chr(10)
       || 'Neighbours: ' || coalesce(nb.n, 0) || chr(10) || coalesce(nb.t, '') AS prompt
FROM own LEFT JOIN nb ON nb.src = own.id""".replace("\n, raw AS", ", raw AS", 1), [], [EMB, knn_sql(20)]))(_prompts)

query("idx4_top_neighbours", with_fx("""
SELECT src, count(*) AS n_neighbours, string_agg(CASE WHEN rn <= 5 THEN CAST(dst AS VARCHAR) END, ',' ORDER BY dst) AS first_neighbours,
       count(*) > 5 AS more
FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM kn) GROUP BY src""",
    [], [EMB, knn_sql(20)]))(
    lambda spark, sf: tr.top_neighbours(knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 20)))
