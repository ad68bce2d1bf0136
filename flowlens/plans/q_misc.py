"""Checked queries: remaining scalar functions, encoders, feature scores,
streaming and composite runs."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import functions as fn
from ..operators import aggregate as agg
from ..operators import encode as enc
from ..operators import sampling as sm
from ..session import read_table
from .composite import process_dataset, reduce_combine, standardize_sources
from .q_flows import COMB_EXTRA, HOST_PROFILE_SQL, std_li
from .q_graph import DIM, EMB, emb, explode_vec, sql_explode, sql_matvec
from .q_models import SPLIT_STD, _split_std
from .q_sampling import D
from .registry import query, rounded
from .sqltext import case_map, with_fx, with_li


# FN-4/9/13/14/15/19/20/23/24 on the flow fixtures -------------------------------------------
def _fn_flows(spark, sf):
    g = fx.fixture(spark, sf, "gaps")
    li = fx.li(spark, sf).select("flow_key", "PROTOCOL", "IPV4_SRC_ADDR", "Attack", "Label")
    j = li.join(g.select("flow_key", "price", "flag_txt", "qty"), "flow_key")
    return rounded(j.select(
        "flow_key",
        fn.protocol_name("PROTOCOL", extended=True).alias("proto_ext"),
        fn.protocol_name("PROTOCOL", default="OTHER").alias("proto_other"),
        fn.binary_label("Attack").alias("bin_from_text"),
        fn.mask_ip("IPV4_SRC_ADDR").alias("masked_src"),
        fn.log1p_col("qty").alias("log_qty"),
        fn.finite0("price").alias("price0"),
        fn.to_binary_pred(F.col("Label"), 0).alias("bin_pred"),
        fn.outlier_to_label(F.when(F.col("Label") == 1, -1).otherwise(1)).alias("outlier"),
        fn.stratum_key("Attack", "PROTOCOL").alias("stratum"),
        fn.as_category("flag_txt").alias("flag_cat")))


_span = fn.columns.MASK_IP_HIGH - fn.columns.MASK_IP_LOW + 1
_maskn = f"({fn.columns.MASK_IP_LOW} + (('0x' || substr(md5('42:' || IPV4_SRC_ADDR), 1, 12))::BIGINT) % {_span})"
query("fn_scalar_flow_functions", with_li(f"""
SELECT li.flow_key, {case_map('PROTOCOL', fn.PROTOCOL_NAMES_EXTENDED, "'Unknown'")} AS proto_ext,
       CASE PROTOCOL WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'OTHER' END AS proto_other,
       CAST(CASE WHEN trim(Attack) IN ('Normal', 'BENIGN', 'Benign') THEN 0 ELSE 1 END AS INTEGER) AS bin_from_text,
       CAST(({_maskn} >> 24) % 256 AS VARCHAR) || '.' || CAST(({_maskn} >> 16) % 256 AS VARCHAR) || '.' ||
       CAST(({_maskn} >> 8) % 256 AS VARCHAR) || '.' || CAST({_maskn} % 256 AS VARCHAR) AS masked_src,
       round(ln(1 + qty), 6) AS log_qty, round(CASE WHEN price IS NULL OR isnan(price) OR isinf(price) THEN 0 ELSE price END, 6) AS price0,
       CAST(li.Label <> 0 AS INTEGER) AS bin_pred, CAST(CASE WHEN li.Label = 1 THEN 1 ELSE 0 END AS INTEGER) AS outlier,
       Attack || '_' || CAST(PROTOCOL AS VARCHAR) AS stratum, coalesce(flag_txt, 'missing') AS flag_cat
FROM li JOIN gaps ON li.flow_key = gaps.flow_key""", std=False, extra=[f"gaps AS ({fx.duck('gaps')})"]))(_fn_flows)

# FN-10/21/22/27 on names built from the nation table ---------------------------------------------
NAMES_SQL = """SELECT n_nationkey,
 CASE WHEN n_nationkey % 3 = 0 THEN concat('/data/nf_', lower(replace(n_name, ' ', '_')), '_reduced_standardized.csv')
      WHEN n_nationkey % 3 = 1 THEN concat('/data/nf_', lower(replace(n_name, ' ', '_')), '_standardized.csv')
      ELSE concat('/data/', lower(replace(n_name, ' ', '_')), '_standardized.csv') END AS path,
 concat(upper(replace(n_name, ' ', '_')), CASE WHEN n_nationkey % 2 = 0 THEN concat('_', CAST(n_nationkey AS STRING)) ELSE '' END, '_scaled') AS feature,
 CASE n_nationkey % 5 WHEN 0 THEN 'normal.' WHEN 1 THEN 'neptune.' WHEN 2 THEN 'smurf.' WHEN 3 THEN 'satan.' ELSE 'unknown.' END AS target
FROM {nation}"""


def _names(spark, sf):
    n = spark.sql(NAMES_SQL, nation=read_table(spark, sf, "nation"))
    return n.select("n_nationkey", fn.dataset_short_name("path").alias("short_name"), fn.is_reduced("path").alias("reduced"),
                    fn.base_feature("feature").alias("base"), fn.kdd_category("target").alias("category"),
                    fn.nsl_class(F.regexp_replace("target", r"\.$", "")).alias("nsl"))


_kdd_case = case_map("regexp_replace(target, '\\.$', '')", fn.columns.KDD_CATEGORIES, "NULL")
query("fn_name_functions", with_fx(f"""
SELECT n_nationkey,
  CASE WHEN regexp_matches(regexp_extract(path, '([^/]+)$', 1), 'nf_([a-zA-Z0-9_]+?)_(reduced_)?standardized\\.csv')
       THEN coalesce({case_map("regexp_extract(regexp_extract(path, '([^/]+)$', 1), 'nf_([a-zA-Z0-9_]+?)_(reduced_)?standardized\\.csv', 1)", fn.columns.DATASET_ALIASES, 'NULL')},
                     regexp_extract(regexp_extract(path, '([^/]+)$', 1), 'nf_([a-zA-Z0-9_]+?)_(reduced_)?standardized\\.csv', 1))
            || CASE WHEN regexp_extract(regexp_extract(path, '([^/]+)$', 1), 'nf_([a-zA-Z0-9_]+?)_(reduced_)?standardized\\.csv', 2) <> '' THEN '_red' ELSE '' END
       ELSE replace(replace(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', ''), '_standardized', ''), 'nf_', '') END AS short_name,
  contains(regexp_extract(path, '([^/]+)$', 1), 'reduced') AS reduced,
  CASE WHEN regexp_extract(feature, '^([a-zA-Z0-9_]+?)(_[0-9.\\-]+)?(_scaled)?$', 1) <> ''
       THEN regexp_extract(feature, '^([a-zA-Z0-9_]+?)(_[0-9.\\-]+)?(_scaled)?$', 1) ELSE feature END AS base,
  {_kdd_case} AS category,
  CAST(CASE regexp_replace(target, '\\.$', '') WHEN 'normal' THEN 0 WHEN 'neptune' THEN 1 ELSE 2 END AS INTEGER) AS nsl
FROM ({NAMES_SQL.format(nation='nation')})""", [], []))(_names)

# FN-7 alone: flag packing on the CIC layout ------------------------------------------------------
query("fn7_pack_tcp_flags", with_fx("""
SELECT "Record ID", CAST((CASE WHEN "FIN Flag Cnt" > 0 THEN 1 ELSE 0 END) + (CASE WHEN "SYN Flag Cnt" > 0 THEN 2 ELSE 0 END)
   + (CASE WHEN "RST Flag Cnt" > 0 THEN 4 ELSE 0 END) + (CASE WHEN "PSH Flag Cnt" > 0 THEN 8 ELSE 0 END)
   + (CASE WHEN "ACK Flag Cnt" > 0 THEN 16 ELSE 0 END) + (CASE WHEN "URG Flag Cnt" > 0 THEN 32 ELSE 0 END) AS INTEGER) AS tcp_flags FROM od""",
    ["od"]))(
    lambda spark, sf: fx.od(spark, sf).select("Record ID", fn.pack_tcp_flags(
        *[F.col(f"`{c} Flag Cnt`") for c in ("FIN", "SYN", "RST", "PSH", "ACK", "URG")]).alias("tcp_flags")))

# ENC-1: one-hot with categories from the data ---------------------------------------------------------
def _one_hot(spark, sf):
    d = std_li(spark, sf, number=False).select("flow_key", "protocol_name")
    cats = enc.fit_categories(d, ["protocol_name"])
    return enc.one_hot(d, cats)


query("enc1_one_hot", with_li("""
SELECT flow_key, CAST(protocol_name = 'ICMP' AS INTEGER) AS protocol_name_ICMP, CAST(protocol_name = 'TCP' AS INTEGER) AS protocol_name_TCP,
       CAST(protocol_name = 'UDP' AS INTEGER) AS protocol_name_UDP, CAST(protocol_name = 'Unknown' AS INTEGER) AS protocol_name_Unknown FROM std"""))(_one_hot)


# ENC-2: fit on train (rare class held out), apply to test: unseen -> zeros ------------------------------
def _one_hot_fit_apply(spark, sf):
    trn, tst = _split_std(spark, sf, ["attack_type"])
    cats = enc.fit_categories(trn.filter(F.col("attack_type") != "Worms"), ["attack_type"])
    return enc.one_hot(tst.select("flow_key", "attack_type"), cats)


_classes = ["DDoS", "DoS", "Infiltration", "Normal", "Reconnaissance", "Shellcode"]
query("enc2_one_hot_fit_apply", with_li("SELECT flow_key, " + ", ".join(
    f"CAST(attack_type = '{c}' AS INTEGER) AS attack_type_{c}" for c in _classes) + " FROM tst", extra=[SPLIT_STD]))(_one_hot_fit_apply)


# ENC-3: scaler fitted on train, applied to test ----------------------------------------------------------
def _scale(spark, sf):
    trn, tst = _split_std(spark, sf)
    st = enc.fit_scaler(trn, ["bytes_in", "duration_ms"])
    return rounded(enc.apply_scaler(tst, st, ["bytes_in", "duration_ms"], "_z").select("flow_key", "bytes_in_z", "duration_ms_z"), 5)


query("enc3_apply_scaler", with_li("""
, s AS (SELECT avg(bytes_in) AS mb, CASE WHEN stddev_pop(bytes_in) = 0 THEN 1 ELSE stddev_pop(bytes_in) END AS sb,
               avg(duration_ms) AS md, CASE WHEN stddev_pop(duration_ms) = 0 THEN 1 ELSE stddev_pop(duration_ms) END AS sd FROM trn)
SELECT flow_key, round((bytes_in - mb) / sb, 5) AS bytes_in_z, round((duration_ms - md) / sd, 5) AS duration_ms_z FROM tst, s"""
    .replace("\n, s AS", ", s AS", 1), extra=[SPLIT_STD]))(_scale)


# ENC-4: smoothed target encoding fitted on train ----------------------------------------------------------
def _target(spark, sf):
    trn, tst = _split_std(spark, sf, ["protocol_name", "dst_port"])
    e = enc.fit_target_encoder(trn, ["protocol_name", "dst_port"], "binary_label")
    return rounded(enc.apply_target_encoder(tst, e, ["protocol_name", "dst_port"], "_te")
                   .select("flow_key", "protocol_name_te", "dst_port_te"))


def _te_sql(col: str) -> str:
    return f"""te_{col} AS (SELECT CAST({col} AS VARCHAR) AS v, CASE WHEN count(*) = 1 THEN p.prior ELSE
       p.prior * (1 - 1 / (1 + exp(-(count(*) - 20) / 10.0))) + avg(CAST(binary_label AS DOUBLE)) / (1 + exp(-(count(*) - 20) / 10.0)) END AS enc
       FROM trn, pr p GROUP BY CAST({col} AS VARCHAR), p.prior)"""


query("enc4_target_encoder", with_li("""
SELECT flow_key, round(coalesce(a.enc, (SELECT prior FROM pr)), 6) AS protocol_name_te, round(coalesce(b.enc, (SELECT prior FROM pr)), 6) AS dst_port_te
FROM tst LEFT JOIN te_protocol_name a ON a.v = tst.protocol_name LEFT JOIN te_dst_port b ON b.v = CAST(tst.dst_port AS VARCHAR)""",
    extra=[SPLIT_STD, "pr AS (SELECT avg(CAST(binary_label AS DOUBLE)) AS prior FROM trn)", _te_sql("protocol_name"), _te_sql("dst_port")]))(_target)

# ENC-5: every text column label-encoded ------------------------------------------------------------------------
query("enc5_label_encode_all", with_fx("""
SELECT pkSeqID, CAST(dense_rank() OVER (ORDER BY saddr) - 1 AS INTEGER) AS saddr, CAST(dense_rank() OVER (ORDER BY daddr) - 1 AS INTEGER) AS daddr,
       CAST(dense_rank() OVER (ORDER BY proto) - 1 AS INTEGER) AS proto, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label FROM ev""",
    ["ev"]))(
    lambda spark, sf: enc.label_encode_all(fx.ev(spark, sf).select("pkSeqID", "saddr", "daddr", "proto", "label")))

# ENC-7 / ENC-8: random mixing and masking of vectors ------------------------------------------------------------
C_MIX = enc.hash_matrix(DIM, DIM, 42, 0.5, 1.0)
query("enc7_mix_features", with_fx(sql_explode(f"(SELECT vec_id, {sql_matvec('e', C_MIX)} AS m FROM emb)", "vec_id", "m", DIM), [], [EMB]))(
    lambda spark, sf: explode_vec(enc.mix_features(emb(spark, sf).select("vec_id", F.col("embedding").alias("x")), "x", DIM), ["vec_id"]))

_order = sorted(range(DIM), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
MASKED = sorted(_order[: int(math.floor(0.25 * DIM))])
query("enc8_mask_features", with_fx(sql_explode(
    "(SELECT vec_id, [" + ", ".join(("0.0::DOUBLE" if i in MASKED else f"e[{i + 1}]") for i in range(DIM)) + "] AS m FROM emb)", "vec_id", "m", DIM),
    [], [EMB]))(
    lambda spark, sf: explode_vec(enc.mask_features(emb(spark, sf).select("vec_id", F.col("embedding").alias("x")), "x", DIM, 0.25), ["vec_id"]))

# AGG-19: audit of the masking perturbation --------------------------------------------------------------------
query("agg19_perturbation_diff", with_fx(f"""
SELECT round(max(abs(d)), 6) AS max_abs_diff, round(avg(abs(d)), 6) AS mean_abs_diff, max(abs(d)) < 1e-5 AS identical
FROM (SELECT unnest(list_transform(range(1, {DIM + 1}), lambda i: CASE WHEN i - 1 IN (""" + ", ".join(map(str, MASKED)) + """) THEN e[i] ELSE 0 END)) AS d FROM emb)""",
    [], [EMB]))(
    lambda spark, sf: rounded(agg.perturbation_diff(
        emb(spark, sf).select("vec_id", F.col("embedding").alias("x")),
        enc.mask_features(emb(spark, sf).select("vec_id", F.col("embedding").alias("x")), "x", DIM, 0.25), "vec_id", "x", DIM)))


# AGG-18 + ORD-4: binned mutual information and the top half of the features -------------------------------------
MI_COLS = ["duration_ms", "bytes_in", "packets_in", "tcp_flags"]


def _mi_sql(keep_top: bool) -> str:
    parts = []
    for c in MI_COLS:
        parts.append(f"""SELECT '{c}' AS feature, attack_type AS y,
            CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE
            least(CAST(floor((CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 10) AS INTEGER), 9) END AS b FROM std""")
    body = f"""
, long AS ({' UNION ALL '.join(parts)}),
  j AS (SELECT feature, b, y, count(*) AS n_by FROM long GROUP BY feature, b, y),
  jj AS (SELECT *, sum(n_by) OVER (PARTITION BY feature) AS n, sum(n_by) OVER (PARTITION BY feature, b) AS n_b,
                sum(n_by) OVER (PARTITION BY feature, y) AS n_y FROM j),
  mi AS (SELECT feature, sum(n_by / n * ln(n_by * n / (n_b * n_y))) AS mi FROM jj GROUP BY feature)"""
    if keep_top:
        return body + "\nSELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi DESC, feature LIMIT 2"
    return body + "\nSELECT feature, round(mi, 6) AS mi FROM mi"


def _mi(spark, sf):
    d = std_li(spark, sf, number=False)
    return agg.mutual_information(d, MI_COLS, "attack_type", 10)


query("agg18_mutual_information", with_li(_mi_sql(False).replace("\n, long", ", long", 1)))(lambda spark, sf: rounded(_mi(spark, sf)))
query("ord4_top_ratio_features", with_li(_mi_sql(True).replace("\n, long", ", long", 1)))(
    lambda spark, sf: rounded(agg.top_ratio(_mi(spark, sf), "mi", 0.5)))

# AGG-20: row counts of the three flow layouts -----------------------------------------------------------------------
query("agg20_row_counts", with_fx("""
SELECT 'li' AS source, count(*) AS n FROM li UNION ALL SELECT 'ev', count(*) FROM ev UNION ALL SELECT 'od', count(*) FROM od""",
    ["li", "ev", "od"]))(
    lambda spark, sf: fx.li(spark, sf).select(F.lit("li").alias("source")).unionByName(
        fx.ev(spark, sf).select(F.lit("ev").alias("source"))).unionByName(
        fx.od(spark, sf).select(F.lit("od").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n")))


# STR-2: class counts accumulated over a file stream equal the batch distribution ---------------------------------------
def _stream_counts(spark, sf):
    from ..operators import adapters as ad
    from ..streaming import stream_class_counts
    schema = read_table(spark, sf, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    li_stream = spark.sql(fx.LI_SQL, lineitem=stream, orders=read_table(spark, sf, "orders"))
    std = ad.adapt_netflow(li_stream, key="flow_key", number=False)
    return stream_class_counts(spark, std, "attack_type")


query("str2_stream_class_counts", with_li("SELECT attack_type, count(*) AS count FROM std GROUP BY attack_type"))(_stream_counts)


# PIP-1: reduce -> standardize -> combine, one plan over three sources, full and reduced ---------------------------------
PIP1_RATES = {"li": 0.1, "ev": 0.2, "od": 0.3}


def _pip1(spark, sf):
    from ..operators import adapters as ad
    only = {"only": ["attack_type"]}  # the column that the counts read
    standard = standardize_sources({
        "li": (fx.li(spark, sf), "nf_bot_iot", "flow_key", only), "ev": (fx.ev(spark, sf), "bot_iot_reduced", "pkSeqID", only),
        "od": (ad.rename_cic(fx.od(spark, sf), drop_ids=False), "cic_ids2018", "Record ID", {"label_map": fn.columns.CIC_LABELS_11} | only)})
    both = None
    for kind in ("full", "reduced"):
        out = reduce_combine(standard, PIP1_RATES, reduced=kind == "reduced")
        r = out.groupBy("dataset_source", "attack_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("flow_id").alias("ids")) \
            .withColumn("kind", F.lit(kind))
        both = r if both is None else both.unionByName(r)
    return both


def _pip1_rate() -> str:
    def tiers(r):
        return (f"least(CASE WHEN cnt < total * {D(0.01)} THEN {D(max(0.5, 5 * r))} WHEN cnt < total * {D(0.1)} THEN {D(min(1.0, 2 * r))} "
                f"ELSE {D(0.9 * r)} END, 1.0)")
    return "CASE dataset_source " + " ".join(f"WHEN '{s}' THEN {tiers(r)}" for s, r in PIP1_RATES.items()) + " END"


query("pip1_reduce_standardize_combine", with_li(f"""
, c AS (SELECT dataset_source, attack_type, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY dataset_source) AS total FROM comb GROUP BY dataset_source, attack_type),
  q AS (SELECT *, CAST(CASE WHEN cnt < 1000 THEN cnt ELSE round_even(cnt * {_pip1_rate()}, 0) END AS BIGINT) AS n FROM c)
SELECT 'full' AS kind, dataset_source, attack_type, cnt AS n, cnt AS ids FROM c
UNION ALL SELECT 'reduced', dataset_source, attack_type, n, n FROM q WHERE n > 0""", extra=COMB_EXTRA)
    .replace("\n, c AS", ", c AS", 1))(_pip1)


# PIP-2: standardize -> encode -> host graph -> metrics --------------------------------------------------------------------
def _pip2(spark, sf):
    enc_df, cmap, nodes, edges, metrics = process_dataset(fx.li(spark, sf), "nf_bot_iot")
    return rounded(metrics)


query("pip2_process_dataset", with_li("""
, n AS (SELECT count(*) AS n FROM (SELECT src_ip FROM std UNION SELECT dst_ip FROM std)),
  m AS (SELECT count(*) AS m FROM (SELECT DISTINCT src_ip, dst_ip FROM std))
SELECT CAST(n AS BIGINT) AS nodes, CAST(m AS BIGINT) AS edges,
       round(CASE WHEN n > 1 THEN m / (n * (n - 1.0)) ELSE 0 END, 6) AS density,
       round(CASE WHEN n > 0 THEN 2.0 * m / n ELSE 0 END, 6) AS avg_degree FROM n, m""").replace("\n, n AS", ", n AS", 1))(_pip2)


# GR-3: host graph of a uniform 10,000-flow sample with first-seen edges -------------------------------------
query("gr3_sampled_host_graph", with_li("""
, s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) AS rn FROM std) WHERE rn <= 10000)
SELECT src_ip AS src, dst_ip AS dst, 1 AS weight, CAST(arg_min(binary_label, flow_key) AS INTEGER) AS attack_flows FROM s GROUP BY src_ip, dst_ip"""
    .replace("\n, s AS", ", s AS", 1)))(
    lambda spark, sf: __import__("flowlens.operators.graph", fromlist=["sampled_host_graph"]).sampled_host_graph(
        std_li(spark, sf, number=False), 10000, "flow_key")[1])


# GR-14: node removal with re-index -----------------------------------------------------------------------------
def _reindex(spark, sf):
    from ..operators import graph as gr
    from ..operators.aggregate import edge_features, node_features
    d = std_li(spark, sf, number=False)
    nodes = node_features(d).withColumnRenamed("ip", "id")
    edges = edge_features(d)
    flagged = nodes.filter(F.col("label") == 1).select("id")
    n2, e2, idmap = gr.remove_nodes(nodes, edges, flagged, reindex=True)
    return e2.select("src", "dst", "new_src", "new_dst")


query("gr14_remove_nodes_reindex", with_li("""
, lab AS (SELECT ip, avg(binary_label) AS m FROM (SELECT src_ip AS ip, binary_label FROM std UNION ALL SELECT dst_ip, binary_label FROM std) GROUP BY ip),
  keep AS (SELECT ip, CAST(row_number() OVER (ORDER BY ip) - 1 AS BIGINT) AS new_id FROM lab WHERE m < 0.5),
  e AS (SELECT DISTINCT src_ip AS src, dst_ip AS dst FROM std)
SELECT e.src, e.dst, a.new_id AS new_src, b.new_id AS new_dst FROM e JOIN keep a ON a.ip = e.src JOIN keep b ON b.ip = e.dst"""
    .replace("\n, lab AS", ", lab AS", 1)))(_reindex)


# GR-17 / GR-18 / GR-19 on the ip-level flow graph ------------------------------------------------------------------
WM = enc.hash_matrix(4, 2, 11, -1.0, 1.0)   # [h_src(2) || e(2)] -> 2
WA = enc.hash_matrix(4, 2, 12, -1.0, 1.0)   # [h(2) || m(2)] -> 2
WE = enc.hash_matrix(4, 3, 13, -1.0, 1.0)   # [h_u(2) || h_v(2)] -> 3


def _ipgraph(spark, sf):
    from ..operators import graph as gr
    d = std_li(spark, sf, number=False).withColumn("lb", F.log1p(F.col("bytes_in").cast("double"))) \
        .withColumn("ld", F.log1p("duration_ms")).withColumn("flow_id", F.col("flow_key"))
    e = gr.flow_graph(d, ["lb", "ld"], key="ip")
    nodes = gr.init_nodes(e, 2)
    return nodes, e


IPG = ["fe AS (SELECT src_ip AS src, dst_ip AS dst, [ln(1 + CAST(bytes_in AS DOUBLE)), ln(1 + duration_ms)] AS h FROM std)",
       "nd AS (SELECT ip AS id, [1.0::DOUBLE, 1.0::DOUBLE] AS x FROM (SELECT src FROM fe UNION SELECT dst FROM fe) t(ip))"]


def _relu_list(expr_list: str) -> str:
    return f"list_transform({expr_list}, lambda v: greatest(v, 0.0))"


query("gr17_sage_edge_layer", with_li(f"""
, msg AS (SELECT fe.dst, {sql_matvec('list_concat(nd.x, fe.h)', WM).replace('list_concat(nd.x, fe.h)[', 'list_concat(nd.x, fe.h)[')} AS m
          FROM fe JOIN nd ON nd.id = fe.src),
  agg AS (SELECT dst, [avg(m[1]), avg(m[2])] AS m FROM msg GROUP BY dst),
  out AS (SELECT nd.id, {_relu_list(sql_matvec('list_concat(nd.x, coalesce(agg.m, [0.0::DOUBLE, 0.0::DOUBLE]))', WA))} AS x
          FROM nd LEFT JOIN agg ON agg.dst = nd.id)
{sql_explode('out', 'id', 'x', 2)}""".replace("\n, msg AS", ", msg AS", 1), extra=IPG))(
    lambda spark, sf: explode_vec(__import__("flowlens.operators.propagate", fromlist=["x"]).sage_edge_layer(
        *_ipgraph(spark, sf), WM, WA, 2), ["id"]))

query("gr18_anomal_layer", with_li(f"""
, agg AS (SELECT dst, [avg(h[1]), avg(h[2])] AS m FROM fe GROUP BY dst),
  out AS (SELECT nd.id, {_relu_list(sql_matvec('list_concat(nd.x, coalesce(agg.m, [0.0::DOUBLE, 0.0::DOUBLE]))', WA))} AS x
          FROM nd LEFT JOIN agg ON agg.dst = nd.id)
{sql_explode('out', 'id', 'x', 2)}""".replace("\n, agg AS", ", agg AS", 1), extra=IPG))(
    lambda spark, sf: explode_vec(__import__("flowlens.operators.propagate", fromlist=["x"]).anomal_layer(
        *_ipgraph(spark, sf), WA, 2), ["id"]))


def _score_edges(spark, sf):
    from ..operators import propagate as pg
    nodes, e = _ipgraph(spark, sf)
    h = pg.anomal_layer(nodes, e, WA, 2)
    he = e.select("src", "dst").distinct()
    return explode_vec(pg.score_edges(he, h, WE), ["src", "dst"], "score")


query("gr19_score_edges", with_li(f"""
, agg AS (SELECT dst, [avg(h[1]), avg(h[2])] AS m FROM fe GROUP BY dst),
  hn AS (SELECT nd.id, {_relu_list(sql_matvec('list_concat(nd.x, coalesce(agg.m, [0.0::DOUBLE, 0.0::DOUBLE]))', WA))} AS x
         FROM nd LEFT JOIN agg ON agg.dst = nd.id),
  ee AS (SELECT DISTINCT src, dst FROM fe),
  sc AS (SELECT ee.src, ee.dst, {sql_matvec('list_concat(u.x, v.x)', WE)} AS score FROM ee JOIN hn u ON u.id = ee.src JOIN hn v ON v.id = ee.dst)
{sql_explode('sc', 'src, dst', 'score', 3)}""".replace("\n, agg AS", ", agg AS", 1), extra=IPG))(_score_edges)


# GR-11: node injection into the flow graph (rows: new edges with donor features) ------------------------------------------
def _inject_flow(spark, sf):
    from ..operators import graph as gr
    nodes, e = _ipgraph(spark, sf)
    new_edges, new_nodes = gr.inject_flow_nodes(e.withColumn("eid", F.col("eid").cast("string")), 0.05, 2, c=5)
    return rounded(new_edges.select("eid", "src", "dst", "binary_label", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")))


query("gr11_inject_flow_nodes", with_li("""
, fe2 AS (SELECT flow_key AS eid, src_ip AS src, dst_ip AS dst, binary_label,
                 ln(1 + CAST(bytes_in AS DOUBLE)) AS h0, ln(1 + duration_ms) AS h1 FROM std),
  nodes AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS nidx FROM (SELECT src AS id FROM fe2 UNION SELECT dst FROM fe2)),
  don AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || eid), eid) - 1 AS didx FROM fe2 WHERE binary_label = 1),
  cnt AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM don) AS n_donors,
                 (SELECT avg(h0) FROM don) AS m0, (SELECT avg(h1) FROM don) AS m1),
  new AS (SELECT j, n_nodes, n_donors, m0, m1
          FROM cnt, range(0, CAST(floor((SELECT n_nodes FROM cnt) * 0.05::DOUBLE) AS BIGINT)) t(j)),
  links AS (SELECT new.*, t, t * n_nodes // 5 + (('0x' || substr(md5('42:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 12))::BIGINT)
                                              % ((t + 1) * n_nodes // 5 - t * n_nodes // 5) AS nidx,
                   CASE WHEN n_donors > 0 THEN (('0x' || substr(md5('43:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 12))::BIGINT) % n_donors END AS didx
            FROM new, range(0, 5) tt(t))
SELECT 'inj:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR) AS eid, 'injected_' || CAST(j AS VARCHAR) AS src, nodes.id AS dst,
       1 AS binary_label, round(coalesce(don.h0, m0), 6) AS h0, round(coalesce(don.h1, m1), 6) AS h1
FROM links JOIN nodes ON nodes.nidx = links.nidx LEFT JOIN don ON don.didx = links.didx""".replace("\n, fe2 AS", ", fe2 AS", 1)))(_inject_flow)


# GR-24: infomax loss of clean vs corrupted node embeddings ------------------------------------------------------------
def _infomax(spark, sf):
    from ..operators import graph as gr
    from ..operators import propagate as pg
    from ..session import stored
    e = stored(_ipgraph(spark, sf)[1].select("eid", "src", "dst", "h"))
    nodes = gr.init_nodes(e, 2)
    pos = pg.anomal_layer(nodes, e, WA, 2)
    neg = pg.anomal_layer(nodes, gr.permute_features(e, "eid"), WA, 2)
    return rounded(pg.infomax_loss(pos, neg, W_INFO, 2))


W_INFO = enc.hash_matrix(2, 2, 14, -1.0, 1.0)


def _infomax_sql() -> str:
    layer = _relu_list(sql_matvec('list_concat(nd.x, coalesce(agg.m, [0.0::DOUBLE, 0.0::DOUBLE]))', WA))
    w = W_INFO
    ws = [f"(s1 * CAST({w[j][0]!r} AS DOUBLE) + s2 * CAST({w[j][1]!r} AS DOUBLE))" for j in range(2)]
    bce = "greatest(sc, 0) - sc * y + ln(1 + exp(-abs(sc)))"
    return with_li(f"""
, fk AS (SELECT flow_key AS eid, src_ip AS src, dst_ip AS dst, [ln(1 + CAST(bytes_in AS DOUBLE)), ln(1 + duration_ms)] AS h FROM std),
  pa AS (SELECT eid, src, dst, row_number() OVER (ORDER BY eid) AS i FROM fk),
  pb AS (SELECT h, row_number() OVER (ORDER BY md5('42:' || eid), eid) AS i FROM fk),
  fp AS (SELECT pa.src, pa.dst, pb.h FROM pa JOIN pb ON pa.i = pb.i),
  agg AS (SELECT dst, [avg(h[1]), avg(h[2])] AS m FROM fe GROUP BY dst),
  pos AS (SELECT nd.id, {layer} AS x FROM nd LEFT JOIN agg ON agg.dst = nd.id),
  aggn AS (SELECT dst, [avg(h[1]), avg(h[2])] AS m FROM fp GROUP BY dst),
  neg AS (SELECT nd.id, {layer.replace('agg.m', 'aggn.m')} AS x FROM nd LEFT JOIN aggn ON aggn.dst = nd.id),
  su AS (SELECT 1 / (1 + exp(-avg(x[1]))) AS s1, 1 / (1 + exp(-avg(x[2]))) AS s2 FROM pos),
  sc AS (SELECT 1 AS y, x[1] * {ws[0]} + x[2] * {ws[1]} AS sc FROM pos, su
         UNION ALL SELECT 0, x[1] * {ws[0]} + x[2] * {ws[1]} FROM neg, su),
  l AS (SELECT y, avg({bce}) AS l FROM sc GROUP BY y)
SELECT round(sum(l), 6) AS loss FROM l""".replace("\n, fk AS", ", fk AS", 1), extra=IPG)


query("gr24_infomax_loss", _infomax_sql())(_infomax)


# PIP-3: flow table -> cap -> 70/15/15 -> fitted features -> adaptive graph -> one head for each graph kind -> leaderboard -----
def _pip3(spark, sf):
    from ..operators import learn as ln
    from .q_flows import cic_std
    flows = cic_std(spark, sf).withColumn("key", F.col("flow_id").cast("string"))
    return rounded(ln.benchmark_dataset(flows, ["duration_ms", "bytes_in", "bytes_out", "packets_in", "packets_out"], ["protocol_name"], "binary_label", "attack_type", "key"))


query("pip3_similarity_benchmark")(_pip3)


# PIP-4: flow graph -> node means -> edge head -> feature, edge and node perturbations of the graph -> evaluation -----------
GRAPH_W = ([0.5, -0.3], [0.4, 0.2], [-0.2, 0.3], -4.0)  # weights of an edge's own features, its source's and target's means, bias
GRAPH_PLAN = [("pgd", 0.3), ("remove", 0.2), ("inject", 0.05)]


def _pip4_fitted(spark, sf):
    """A head fitted on the clean graph of the training flows and stored; loaded, it scores the test flows' graph, clean and perturbed."""
    import uuid
    from ..operators import evaluate as ev
    from ..operators import learn as ln
    from ..operators import robust as rb
    from ..operators import sampling as sm
    from ..session import ensure_checkpoint_dir, stored
    from ..sources.sinks import save_transform
    e = _ipgraph(spark, sf)[1].withColumn("eid", F.col("eid").cast("string"))
    e = stored(sm.split(e.select("eid", "src", "dst", "h", "binary_label"), "eid", ["binary_label"], 0.3))
    path = f"{ensure_checkpoint_dir(spark)}/edge-head-{uuid.uuid4().hex}"
    save_transform(ln.fit_edge_head(e.filter("split = 'train'").drop("split"), 2), path)
    return rounded(ev.degradation(rb.graph_sweep(e.filter("split = 'test'").drop("split"), *ln.load_edge_head(spark, path), GRAPH_PLAN)))


query("pip4_fitted_detector")(_pip4_fitted)


def _pip4(spark, sf):
    from ..operators import evaluate as ev
    from ..operators import robust as rb
    nodes, e = _ipgraph(spark, sf)
    res = rb.graph_sweep(e.withColumn("eid", F.col("eid").cast("string")), *GRAPH_W, GRAPH_PLAN)
    return rounded(ev.degradation(res))


def _pip4_sql() -> str:
    wh, wu, wv, b = GRAPH_W
    lin = " + ".join(f"{v} * {D(w)}" for v, w in zip(("e.h0", "e.h1", "u.m0", "u.m1", "v.m0", "v.m1"), wh + wu + wv)) + f" + {D(b)}"

    def scored(name, src):
        return (f"{name}_n AS (SELECT id, avg(h0) AS m0, avg(h1) AS m1 FROM (SELECT src AS id, h0, h1 FROM {src} UNION ALL SELECT dst, h0, h1 FROM {src}) GROUP BY id),\n"
                f"{name}_s AS (SELECT e.*, 1 / (1 + exp(-({lin}))) AS score FROM {src} e JOIN {name}_n u ON u.id = e.src JOIN {name}_n v ON v.id = e.dst)")
    ctes = ["""g0 AS (SELECT flow_key AS eid, src_ip AS src, dst_ip AS dst, binary_label AS y, ln(1 + CAST(bytes_in AS DOUBLE)) AS h0, ln(1 + duration_ms) AS h1 FROM std)""",
            scored("g0", "g0"),
            f"g1 AS (SELECT eid, src, dst, y, h0 + {D(0.3)} * sign(score - y) * sign({D(wh[0])}) AS h0, h1 + {D(0.3)} * sign(score - y) * sign({D(wh[1])}) AS h1 FROM g0_s)",
            scored("g1", "g1"),
            f"""g2 AS (SELECT eid, src, dst, y, h0, h1 FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || eid), eid) AS rn FROM g0)
                WHERE rn > (SELECT floor(count(*) * {D(0.2)}) FROM g0))""",
            scored("g2", "g2"),
            """inodes AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS nidx FROM (SELECT src AS id FROM g0 UNION SELECT dst FROM g0))""",
            """idon AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || eid), eid) - 1 AS didx FROM g0 WHERE y = 1)""",
            """icnt AS (SELECT (SELECT count(*) FROM inodes) AS n_nodes, (SELECT count(*) FROM idon) AS n_donors)""",
            """ilinks AS (SELECT j, t, t * n_nodes // 5 + (('0x' || substr(md5('42:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 12))::BIGINT)
                          % ((t + 1) * n_nodes // 5 - t * n_nodes // 5) AS nidx,
                          (('0x' || substr(md5('43:' || CAST(j AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 12))::BIGINT) % n_donors AS didx
               FROM icnt, range(0, CAST(floor((SELECT n_nodes FROM icnt) * 0.05::DOUBLE) AS BIGINT)) a(j), range(0, 5) b(t))""",
            """g3 AS (SELECT * FROM g0 UNION ALL SELECT 'inj:' || j || ':' || t, 'injected_' || j, inodes.id, 1, idon.h0, idon.h1
               FROM ilinks JOIN inodes USING (nidx) JOIN idon USING (didx))""",
            scored("g3", "g3"),
            "sp AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pert, {D(v)} AS param, y, score, CAST(score > 0.5 AS INTEGER) AS pred FROM {t}_s"
                                            for p, v, t in (("clean", 0.0, "g0"), ("pgd", 0.3, "g1"), ("remove", 0.2, "g2"), ("inject", 0.05, "g3"))) + ")",
            """m AS (SELECT pert, param, avg(CAST(y = pred AS DOUBLE)) AS accuracy, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
                      count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn FROM sp GROUP BY pert, param)""",
            """m2 AS (SELECT pert, param, accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m)""",
            """rk AS (SELECT pert, y, rank() OVER (PARTITION BY pert ORDER BY score) + (count(*) OVER (PARTITION BY pert, score) - 1) / 2.0 AS r FROM sp)""",
            """au AS (SELECT pert, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM rk GROUP BY pert)""",
            "res AS (SELECT m2.pert AS perturbation, m2.param, accuracy, precision, recall, f1, auc FROM m2 JOIN au USING (pert))"]
    tail = __import__("flowlens.plans.q_models", fromlist=["_sweep_sql"])._sweep_sql(True)
    return with_li(tail[tail.rindex("\nSELECT r.perturbation"):], extra=ctes)


query("pip4_evaluate_robustness", _pip4_sql())(_pip4)


# PRJ-4: UNSW-NB15 layout -> common-v1 ------------------------------------------------------------------------------
query("prj4_unsw_adapter", with_fx("""
SELECT '0.0.0.0' AS src_ip, CAST(0 AS BIGINT) AS src_port, '0.0.0.0' AS dst_ip, CAST(0 AS BIGINT) AS dst_port,
       CAST(CASE lower(proto) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS INTEGER) AS protocol,
       proto AS protocol_name, round(dur * 1000.0, 6) AS duration_ms, sbytes AS bytes_in, dbytes AS bytes_out,
       spkts AS packets_in, dpkts AS packets_out, 0 AS tcp_flags, label AS binary_label,
       CASE WHEN label = 0 THEN 'Normal' ELSE """ + case_map("attack_cat", fn.ATTACK_FAMILIES, "'Other'") + """ END AS attack_type,
       id AS flow_id, round(smean, 6) AS stat_src_mean, round(dmean, 6) AS stat_dst_mean FROM un""", ["un"]))(
    lambda spark, sf: rounded(__import__("flowlens.operators.adapters", fromlist=["adapt_unsw"]).adapt_unsw(fx.fixture(spark, sf, "un"))))

# GR-1: host graph nodes (same semantics as the host profile) --------------------------------------------------------
query("gr1_host_graph_nodes", HOST_PROFILE_SQL)(
    lambda spark, sf: rounded(__import__("flowlens.operators.graph", fromlist=["host_graph"]).host_graph(
        std_li(spark, sf, number=False))[0]))


# JN-6: induced subgraph of a node subset ------------------------------------------------------------------------------
def _induced(spark, sf):
    from ..operators import graph as gr
    from ..operators import knn
    nodes = emb(spark, sf).select(F.col("vec_id").alias("id"), "label")
    edges = knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 10)
    n, e = gr.induced_subgraph(nodes, edges, nodes.filter(F.col("label") < 5))
    return e


query("jn6_induced_subgraph", with_fx("""
SELECT src, dst FROM kn WHERE src IN (SELECT vec_id FROM emb WHERE label < 5) AND dst IN (SELECT vec_id FROM emb WHERE label < 5)""",
    [], [EMB, __import__("flowlens.plans.q_graph", fromlist=["knn_sql"]).knn_sql(10)]))(_induced)


# ENC-6: impute -> log1p -> scale -> one-hot -> assemble, fitted on train -------------------------------------------------
def _feature_chain(spark, sf):
    from .q_sampling import _gsplit
    trn, tst = _gsplit(spark, sf)
    p = enc.FeatureChain(["qty", "price"], ["flag_txt"]).fit(trn)
    return explode_vec(p.transform(tst, keep=["flow_key"]), ["flow_key"], "features", 5)


_GS = __import__("flowlens.plans.q_sampling", fromlist=["GSPLIT"])
query("enc6_fitted_feature_chain", with_fx(f"""
, med AS (SELECT quantile_cont(qty, 0.5) AS mq, quantile_cont(CASE WHEN isinf(price) THEN NULL ELSE price END, 0.5) AS mp FROM gs WHERE split = 'train'),
  md AS (SELECT flag_txt AS mode FROM (SELECT flag_txt, count(*) AS n FROM gs WHERE split = 'train' AND flag_txt IS NOT NULL GROUP BY flag_txt)
         ORDER BY n DESC, flag_txt LIMIT 1),
  tt AS (SELECT split, flow_key, ln(1 + coalesce(qty, mq)) AS a,
                ln(1 + coalesce(CASE WHEN isinf(price) THEN NULL ELSE price END, mp)) AS b, coalesce(flag_txt, mode) AS f FROM gs, med, md),
  st AS (SELECT avg(a) AS ma, CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END AS sa,
                avg(b) AS mb, CASE WHEN stddev_pop(b) = 0 THEN 1 ELSE stddev_pop(b) END AS sb FROM tt WHERE split = 'train'),
  o AS (SELECT flow_key, [(a - ma) / sa, (b - mb) / sb, CAST(f = 'A' AS DOUBLE), CAST(f = 'N' AS DOUBLE), CAST(f = 'R' AS DOUBLE)] AS v
        FROM tt, st WHERE split = 'test')
{sql_explode('o', 'flow_key', 'v', 5, 5)}""".replace("\n, med AS", ", med AS", 1), [], [f"gaps AS ({fx.duck('gaps')})", _GS.GSPLIT]))(_feature_chain)


# EVL-9: side-by-side comparison of two decision rules ----------------------------------------------------------------------
def _compare(spark, sf):
    from ..operators import evaluate as ev
    s = fx.scored(spark, sf)
    res = None
    for name, t in (("t03", 0.3), ("t05", 0.5)):
        m = ev.binary_metrics(s.withColumn("pred", (F.col("score") > t).cast("int"))).withColumn("model", F.lit(name))
        res = m if res is None else res.unionByName(m)
    return rounded(ev.compare(res, metrics=("accuracy", "precision", "recall", "f1")))


def _cmp_sql():
    rows = []
    for t in ("0.3", "0.5"):
        rows.append(f"""m{t[-1]} AS (SELECT avg(CAST(y = p AS DOUBLE)) AS accuracy,
          CASE WHEN count(*) FILTER (WHERE p = 1) > 0 THEN count(*) FILTER (WHERE p = 1 AND y = 1) / count(*) FILTER (WHERE p = 1) ELSE 0 END AS precision,
          CASE WHEN count(*) FILTER (WHERE y = 1) > 0 THEN count(*) FILTER (WHERE p = 1 AND y = 1) / count(*) FILTER (WHERE y = 1) ELSE 0 END AS recall
          FROM (SELECT y, CAST(score > {t} AS INTEGER) AS p FROM scored))""")
    body = """, f3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m3),
  f5 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m5)
SELECT 'accuracy' AS metric, round(f3.accuracy, 6) AS t03, round(f5.accuracy, 6) AS t05 FROM f3, f5
UNION ALL SELECT 'precision', round(f3.precision, 6), round(f5.precision, 6) FROM f3, f5
UNION ALL SELECT 'recall', round(f3.recall, 6), round(f5.recall, 6) FROM f3, f5
UNION ALL SELECT 'f1', round(f3.f1, 6), round(f5.f1, 6) FROM f3, f5"""
    return with_fx(body.replace(", f3 AS", "f3 AS", 1), ["scored"], rows + [""]).replace(",\n\nf3 AS", ",\nf3 AS")


query("evl9_compare_models", _cmp_sql())(_compare)
