"""Checked queries: standardization, scalar functions, host profile, edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import functions as fn
from ..operators import adapters as ad
from ..operators import aggregate as agg
from .registry import query, rounded
from .sqltext import with_li

R6 = "round({}, 6)"


def std_li(spark, sf, number: bool = True, only=None):
    """common-v1 flows of the li fixture; ``number=False`` keeps the content
    key and skips the dense flow_id (queries that never read it); ``only``: the
    columns that are numbered."""
    return ad.adapt_netflow(fx.li(spark, sf), key="flow_key", variant="v1", number=number, only=only)


# --- flagship: per-host profile (AGG-5 + AGG-6 on PRJ-5) ---------------------
HOST_PROFILE_SQL = with_li("""
, r AS (SELECT src_ip AS ip, TRUE AS is_src, binary_label, attack_type, bytes_in, bytes_out, packets_in, packets_out FROM std
        UNION ALL
        SELECT dst_ip AS ip, FALSE AS is_src, binary_label, attack_type, bytes_in, bytes_out, packets_in, packets_out FROM std)
, a AS (SELECT ip, attack_type, count(*) AS n FROM r GROUP BY ip, attack_type)
, m AS (SELECT ip, attack_type FROM (SELECT ip, attack_type, row_number() OVER (PARTITION BY ip ORDER BY n DESC, attack_type) AS rk FROM a) WHERE rk = 1)
, g AS (SELECT ip, count(*) AS total_flows, sum(binary_label) AS attack_flows,
        bool_or(is_src) AS is_source, bool_or(NOT is_src) AS is_destination,
        coalesce(avg(CASE WHEN is_src THEN bytes_in END), 0) AS avg_bytes_sent,
        coalesce(avg(CASE WHEN NOT is_src THEN bytes_out END), 0) AS avg_bytes_received,
        coalesce(avg(CASE WHEN is_src THEN packets_in END), 0) AS avg_packets_sent,
        coalesce(avg(CASE WHEN NOT is_src THEN packets_out END), 0) AS avg_packets_received,
        avg(binary_label) AS mean_label
        FROM r GROUP BY ip)
SELECT g.ip, CAST(total_flows AS BIGINT) AS total_flows, CAST(attack_flows AS BIGINT) AS attack_flows,
       CAST(total_flows - attack_flows AS BIGINT) AS normal_flows, is_source, is_destination,
       round(avg_bytes_sent, 6) AS avg_bytes_sent, round(avg_bytes_received, 6) AS avg_bytes_received,
       round(avg_packets_sent, 6) AS avg_packets_sent, round(avg_packets_received, 6) AS avg_packets_received,
       CAST(CASE WHEN mean_label >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS label, m.attack_type
FROM g JOIN m ON g.ip = m.ip""".replace("\n, r AS", ", r AS", 1))


def host_profile(spark, sf):
    return rounded(agg.node_features(std_li(spark, sf, number=False)))


query("agg5_host_profile", HOST_PROFILE_SQL)(host_profile)


def gaps(spark, sf):
    return fx.fixture(spark, sf, "gaps")


STD_COLS = ("src_ip, src_port, dst_ip, dst_port, protocol, protocol_name, round(duration_ms, 6) AS duration_ms, "
            "bytes_in, bytes_out, packets_in, packets_out, tcp_flags, binary_label, attack_type")

# --- PRJ-5 + IDX-1: NetFlow -> common-v1 with dense flow ids -----------------
query("prj5_netflow_standardize", with_li(f"""
SELECT {STD_COLS}, round(l7_proto, 6) AS l7_proto, flow_key, flow_id FROM std"""))(
    lambda spark, sf: rounded(std_li(spark, sf)))


# --- PRJ-1: BoT-IoT addr:port layout ----------------------------------------
def _ev_joined(spark, sf):
    e = fx.ev(spark, sf)
    return e.withColumn("daddr", F.concat_ws(":", "daddr", "dport"))


EV_ATTACK = "CASE WHEN attack = 0 THEN 'Normal' ELSE " + \
    __import__("flowlens.plans.sqltext", fromlist=["case_map"]).case_map("label", fn.ATTACK_FAMILIES, "'Other'") + " END"

query("prj1_bot_iot_adapter", with_li(f"""
, e AS (SELECT *, daddr || ':' || dport AS daddr2 FROM ev)
SELECT saddr AS src_ip, CAST(NULL AS BIGINT) AS src_port, split_part(daddr2, ':', 1) AS dst_ip,
       CAST(trunc(TRY_CAST(split_part(daddr2, ':', 2) AS DOUBLE)) AS BIGINT) AS dst_port,
       CAST(CASE lower(proto) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS INTEGER) AS protocol,
       proto AS protocol_name, round(dur * 1000.0, 6) AS duration_ms, sbytes AS bytes_in, dbytes AS bytes_out,
       CAST(0 AS BIGINT) AS packets_in, CAST(0 AS BIGINT) AS packets_out, 0 AS tcp_flags, attack AS binary_label,
       {EV_ATTACK} AS attack_type, pkSeqID,
       CAST(row_number() OVER (ORDER BY pkSeqID) - 1 AS BIGINT) AS flow_id
FROM e""", std=False, extra=[f"ev AS ({fx.duck('ev')})"]).replace("\n, e AS", ", e AS", 1))(
    lambda spark, sf: rounded(ad.adapt_bot_iot(_ev_joined(spark, sf), key="pkSeqID")))

# --- PRJ-2: reduced BoT-IoT (hex ports, '-' labels, pass-through, encoded) --
query("prj2_bot_iot_reduced", with_li("""
, b AS (SELECT saddr AS src_ip, CAST(CASE WHEN sport LIKE '0x%' THEN TRY_CAST(sport AS BIGINT) ELSE TRY_CAST(trim(sport) AS BIGINT) END AS BIGINT) AS src_port,
        daddr AS dst_ip, coalesce(TRY_CAST(trim(dport) AS BIGINT), 0) AS dst_port,
        CAST(CASE lower(proto) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS INTEGER) AS protocol,
        proto AS protocol_name, round(coalesce(dur, 0) * 1000.0, 6) AS duration_ms,
        sbytes AS bytes_in, dbytes AS bytes_out, CAST(0 AS BIGINT) AS packets_in, CAST(0 AS BIGINT) AS packets_out,
        0 AS tcp_flags, attack AS binary_label,
        CASE WHEN coalesce(label, 'Normal') = '-' OR attack = 0 THEN 'Normal' ELSE coalesce(label, 'Normal') END AS attack_type,
        pkSeqID, CAST(row_number() OVER (ORDER BY pkSeqID) - 1 AS BIGINT) AS flow_id
 FROM ev)
SELECT *, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS INTEGER) AS attack_type_encoded FROM b""",
    std=False, extra=[f"ev AS ({fx.duck('ev')})"]).replace("\n, b AS", ", b AS", 1))(
    lambda spark, sf: rounded(ad.adapt_bot_iot_reduced(fx.ev(spark, sf), key="pkSeqID")))


# --- PRJ-8 + PRJ-3 + FN-7 + FN-11: CIC raw -> long names -> common-v1 -------
def cic_std(spark, sf, only=None):
    renamed = ad.rename_cic(fx.od(spark, sf), drop_ids=False)
    return ad.adapt_cic(renamed, key="Record ID", label_map=fn.columns.CIC_LABELS_11, only=only)


CIC_LABEL_CASE = __import__("flowlens.plans.sqltext", fromlist=["case_map"]).case_map(
    '"Label"', fn.columns.CIC_LABELS_11, "NULL")
CIC_STD_SQL = f"""cic AS (
 SELECT '0.0.0.0' AS src_ip, CAST(0 AS BIGINT) AS src_port, '0.0.0.0' AS dst_ip, CAST("Dst Port" AS BIGINT) AS dst_port,
        CAST("Protocol" AS INTEGER) AS protocol,
        CASE "Protocol" WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Unknown' END AS protocol_name,
        CAST("Flow Duration" AS DOUBLE) AS duration_ms, CAST("TotLen Fwd Pkts" AS BIGINT) AS bytes_in,
        CAST("TotLen Bwd Pkts" AS BIGINT) AS bytes_out, CAST("Tot Fwd Pkts" AS BIGINT) AS packets_in,
        CAST("Tot Bwd Pkts" AS BIGINT) AS packets_out,
        CAST((CASE WHEN "FIN Flag Cnt" > 0 THEN 1 ELSE 0 END) + (CASE WHEN "SYN Flag Cnt" > 0 THEN 2 ELSE 0 END)
           + (CASE WHEN "RST Flag Cnt" > 0 THEN 4 ELSE 0 END) + (CASE WHEN "PSH Flag Cnt" > 0 THEN 8 ELSE 0 END)
           + (CASE WHEN "ACK Flag Cnt" > 0 THEN 16 ELSE 0 END) + (CASE WHEN "URG Flag Cnt" > 0 THEN 32 ELSE 0 END) AS INTEGER) AS tcp_flags,
        {CIC_LABEL_CASE} AS lab, "Record ID"
 FROM od),
cicstd AS (
 SELECT src_ip, src_port, dst_ip, dst_port, protocol, protocol_name, duration_ms, bytes_in, bytes_out,
        packets_in, packets_out, tcp_flags,
        CAST(CASE WHEN lab = 'BENIGN' THEN 0 ELSE 1 END AS INTEGER) AS binary_label,
        CASE WHEN lab = 'BENIGN' THEN 'Normal' ELSE {__import__("flowlens.plans.sqltext", fromlist=["case_map"]).case_map("lab", fn.ATTACK_FAMILIES, "'Other'")} END AS attack_type,
        "Record ID", CAST(row_number() OVER (ORDER BY "Record ID") - 1 AS BIGINT) AS flow_id
 FROM cic)"""

query("prj3_cic_adapter", with_li("""
SELECT src_ip, src_port, dst_ip, dst_port, protocol, protocol_name, round(duration_ms, 6) AS duration_ms,
       bytes_in, bytes_out, packets_in, packets_out, tcp_flags, binary_label, attack_type, "Record ID", flow_id
FROM cicstd""", std=False, extra=[f"od AS ({fx.duck('od')})", CIC_STD_SQL]))(
    lambda spark, sf: rounded(cic_std(spark, sf)))

query("prj8_rename_cic", with_li("""
SELECT "Dst Port" AS "Destination Port", "Protocol", round("Flow Duration", 6) AS "Flow Duration",
       "Tot Fwd Pkts" AS "Total Fwd Packets", "Tot Bwd Pkts" AS "Total Backward Packets",
       "TotLen Fwd Pkts" AS "Total Length of Fwd Packets", "TotLen Bwd Pkts" AS "Total Length of Bwd Packets",
       "FIN Flag Cnt" AS "FIN Flag Count", "SYN Flag Cnt" AS "SYN Flag Count", "RST Flag Cnt" AS "RST Flag Count",
       "PSH Flag Cnt" AS "PSH Flag Count", "ACK Flag Cnt" AS "ACK Flag Count", "URG Flag Cnt" AS "URG Flag Count",
       "Label" FROM od""", std=False, extra=[f"od AS ({fx.duck('od')})"]))(
    lambda spark, sf: rounded(ad.rename_cic(fx.od(spark, sf))))


# --- PRJ-7: NetFlow v2 in-place standardize -----------------------------------
def nf_std(spark, sf, source="nf_test"):
    return ad.standardize_netflow(fx.li(spark, sf), source, key="flow_key")


NF_STD_SQL = """nf AS (
 SELECT IPV4_SRC_ADDR, CAST(L4_SRC_PORT AS BIGINT) AS L4_SRC_PORT, IPV4_DST_ADDR, CAST(L4_DST_PORT AS BIGINT) AS L4_DST_PORT,
        CAST(PROTOCOL AS BIGINT) AS PROTOCOL, L7_PROTO, IN_BYTES, OUT_BYTES, IN_PKTS, OUT_PKTS,
        CAST(TCP_FLAGS AS BIGINT) AS TCP_FLAGS, FLOW_DURATION_MILLISECONDS, CAST(Label AS BIGINT) AS Label, Attack, flow_key,
        'nf_test' AS dataset_source, CAST(row_number() OVER (ORDER BY flow_key) - 1 AS BIGINT) AS flow_id
 FROM li)"""

query("prj7_standardize_netflow", with_li("""
SELECT IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL, round(L7_PROTO, 6) AS L7_PROTO,
       round(IN_BYTES, 6) AS IN_BYTES, round(OUT_BYTES, 6) AS OUT_BYTES, IN_PKTS, OUT_PKTS, TCP_FLAGS,
       round(FLOW_DURATION_MILLISECONDS, 6) AS FLOW_DURATION_MILLISECONDS, Label, Attack, flow_key, dataset_source, flow_id
FROM nf""", std=False, extra=[NF_STD_SQL]))(lambda spark, sf: rounded(nf_std(spark, sf)))

# --- PRJ-11 + FN-12: model view ---------------------------------------------------
query("prj11_model_view", with_li("""
SELECT IPV4_SRC_ADDR || ':' || CAST(L4_SRC_PORT AS VARCHAR) AS src, IPV4_DST_ADDR || ':' || CAST(L4_DST_PORT AS VARCHAR) AS dst,
       CASE PROTOCOL WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE 'OTHER' END AS protocol,
       round(IN_BYTES, 6) AS bytes_in, round(OUT_BYTES, 6) AS bytes_out, IN_PKTS AS packets_in, OUT_PKTS AS packets_out,
       round(FLOW_DURATION_MILLISECONDS, 6) AS duration_ms, TCP_FLAGS AS tcp_flags, round(L7_PROTO, 6) AS service,
       Label AS binary_label, Attack AS attack_type, flow_id, dataset_source
FROM nf""", std=False, extra=[NF_STD_SQL]))(lambda spark, sf: rounded(ad.model_view(nf_std(spark, sf))))

# --- PRJ-10: align to common columns by name rule ----------------------------------
ALIGN_COLS = ["src_ip", "dst_ip", "dst_port", "attack_type", "attack_type_encoded", "relay_ip", "relay_port", "note"]
query("prj10_align_common", with_li("""
SELECT src_ip, dst_ip, dst_port, attack_type, CAST(0 AS BIGINT) AS attack_type_encoded, '0.0.0.0' AS relay_ip,
       CAST(0 AS BIGINT) AS relay_port, 'Unknown' AS note FROM cicstd""",
    std=False, extra=[f"od AS ({fx.duck('od')})", CIC_STD_SQL]))(
    lambda spark, sf: ad.align_common(cic_std(spark, sf), ALIGN_COLS))

# --- PRJ-13: align to an expected feature list ----------------------------------------
EXPECTED = ["IN_BYTES", "OUT_BYTES", "MISSING_FEATURE", "TCP_FLAGS"]
query("prj13_align_features", with_li("""
SELECT flow_key, round(IN_BYTES, 6) AS IN_BYTES, round(OUT_BYTES, 6) AS OUT_BYTES, 0.0::DOUBLE AS MISSING_FEATURE,
       CAST(TCP_FLAGS AS DOUBLE) AS TCP_FLAGS FROM li""", std=False))(
    lambda spark, sf: rounded(ad.align_features(fx.li(spark, sf).withColumn("TCP_FLAGS", F.col("TCP_FLAGS").cast("double")),
                                                EXPECTED, keep=["flow_key"])))

# --- PRJ-12: derived / dropped feature columns ------------------------------------------
query("prj12_derive_features", with_li("""
SELECT saddr, sport, daddr, dport, proto, round(dur, 6) AS dur, sbytes, dbytes, attack, label, sbytes + dbytes AS network_bytes
FROM ev""", std=False, extra=[f"ev AS ({fx.duck('ev')})"]))(
    lambda spark, sf: rounded(ad.derive_features(fx.ev(spark, sf), drop=["pkSeqID", "stime"])))

# --- PRJ-14 + PRJ-16: type split and feature vector (exploded for the check) -------------
def _assembled(spark, sf):
    d = std_li(spark, sf, number=False)
    num, _ = ad.split_by_type(d, exclude=["binary_label", "src_port", "dst_port", "protocol", "tcp_flags", "l7_proto"])
    a = ad.assemble(d, num, "h", keep=["flow_key"])
    return rounded(a.select("flow_key", F.posexplode("h").alias("pos", "val")))


query("prj16_assemble", with_li("""
, v AS (SELECT flow_key, [CAST(duration_ms AS DOUBLE), CAST(bytes_in AS DOUBLE), CAST(bytes_out AS DOUBLE),
                          CAST(packets_in AS DOUBLE), CAST(packets_out AS DOUBLE)] AS h FROM std)
SELECT flow_key, CAST(p - 1 AS INTEGER) AS pos, round(h[p], 6) AS val FROM v, range(1, 6) t(p)""").replace("\n, v AS", ", v AS", 1))(_assembled)

# --- SRC-6: the first rows in a stated order; SRC-11: only the core columns reach the scan; SNK-3: class map as JSON ------------
FIRST = int(0.001 * 1e6)  # rows of a bounded scan: a share of a million, as a feature
CORE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]


def _bounded(spark, sf):
    from ..session import table_path
    from ..sources import read_flows
    return read_flows(spark, table_path(sf, "lineitem"), fmt="parquet", limit=FIRST, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def _core(spark, sf):
    from ..session import read_table
    from ..sources import select_core
    return select_core(read_table(spark, sf, "lineitem"), [*CORE, "not_there"])


def _class_map_json(spark, sf):
    from ..operators.encode import fit_class_map
    from ..sources.sinks import class_map_json
    return class_map_json(fit_class_map(std_li(spark, sf, number=False), "attack_type"))


query("src6_bounded_scan", f"SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT {FIRST}")(_bounded)
query("src11_core_columns", "SELECT " + ", ".join(CORE) + " FROM lineitem")(_core)
query("snk3_class_map_json", with_li("""
SELECT '{' || string_agg('"' || attack_type || '":' || code, ',' ORDER BY attack_type) || '}' AS json
FROM (SELECT attack_type, row_number() OVER (ORDER BY attack_type) - 1 AS code FROM (SELECT DISTINCT attack_type FROM std))"""))(_class_map_json)

# --- PRJ-15 + SET-1: union with provenance and re-numbered flow ids ------------------------
def combined(spark, sf, only=None):
    """The union of the three sources; ``only``: the columns of them that the caller reads (next to flow_id and dataset_source)."""
    from ..operators.sets import combine
    a = ad.with_source(std_li(spark, sf, only=only), "li")
    b = ad.with_source(ad.adapt_bot_iot_reduced(fx.ev(spark, sf), key="pkSeqID", only=only), "ev")
    c = ad.with_source(cic_std(spark, sf, only=only), "od")
    # every source carries dense flow ids, so the union re-numbers by offsets;
    # the combined table feeds several jobs, so it is materialized once (the
    # reference writes it out as a file at this point)
    from ..session import stored
    return stored(combine([a, b, c], dense_inputs=True))


EVB_SQL = """evb AS (
 SELECT saddr AS src_ip, daddr AS dst_ip, sbytes AS bytes_in, dbytes AS bytes_out, CAST(0 AS BIGINT) AS packets_in,
        CAST(0 AS BIGINT) AS packets_out, attack AS binary_label,
        CASE WHEN coalesce(label, 'Normal') = '-' OR attack = 0 THEN 'Normal' ELSE coalesce(label, 'Normal') END AS attack_type,
        CAST(row_number() OVER (ORDER BY pkSeqID) - 1 AS BIGINT) AS flow_id
 FROM ev)"""
COMBINED_SQL = """comb0 AS (
 SELECT 0 AS part, 'li' AS dataset_source, src_ip, dst_ip, bytes_in, bytes_out, packets_in, packets_out, binary_label, attack_type, flow_id FROM std
 UNION ALL SELECT 1, 'ev', src_ip, dst_ip, bytes_in, bytes_out, packets_in, packets_out, binary_label, attack_type, flow_id FROM evb
 UNION ALL SELECT 2, 'od', src_ip, dst_ip, bytes_in, bytes_out, packets_in, packets_out, binary_label, attack_type, flow_id FROM cicstd),
comb AS (SELECT dataset_source, src_ip, dst_ip, bytes_in, bytes_out, packets_in, packets_out, binary_label, attack_type,
                CAST(row_number() OVER (ORDER BY part, flow_id) - 1 AS BIGINT) AS flow_id FROM comb0)"""
COMB_EXTRA = [f"ev AS ({fx.duck('ev')})", f"od AS ({fx.duck('od')})", CIC_STD_SQL, EVB_SQL, COMBINED_SQL]

query("set1_combine", with_li("""
SELECT dataset_source, src_ip, dst_ip, bytes_in, bytes_out, binary_label, attack_type, flow_id FROM comb""",
    extra=COMB_EXTRA))(
    lambda spark, sf: combined(spark, sf).select("dataset_source", "src_ip", "dst_ip", "bytes_in", "bytes_out",
                                                 "binary_label", "attack_type", "flow_id"))

# --- AGG-2: counts per provenance ------------------------------------------------------------
query("agg2_source_distribution", with_li("""
SELECT dataset_source, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM comb GROUP BY dataset_source""", extra=COMB_EXTRA))(
    lambda spark, sf: rounded(agg.source_distribution(combined(spark, sf))))

# --- AGG-1: class distribution -----------------------------------------------------------------
query("agg1_class_distribution", with_li("""
SELECT attack_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM std GROUP BY attack_type"""))(
    lambda spark, sf: rounded(agg.class_distribution(std_li(spark, sf, number=False), "attack_type")))

# --- AGG-4 + JN-1: label encoding and lookup --------------------------------------------------
def _encoded(spark, sf):
    from ..operators.encode import apply_class_map, fit_class_map
    d = std_li(spark, sf, number=False)
    cm = fit_class_map(d, "attack_type")
    return apply_class_map(d, cm, "attack_type", "attack_type_encoded").select("flow_key", "attack_type", "attack_type_encoded")


query("agg4_label_encoding", with_li("""
SELECT flow_key, attack_type, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS INTEGER) AS attack_type_encoded FROM std"""))(_encoded)

# --- AGG-7: per-host flow counts per source -----------------------------------------------------
SOURCES = ["li", "ev", "od"]
query("agg7_node_source_counts", with_li("""
, r AS (SELECT src_ip AS ip, dataset_source FROM comb UNION ALL SELECT dst_ip, dataset_source FROM comb)
SELECT ip, count(*) FILTER (WHERE dataset_source = 'li') AS li_flows, count(*) FILTER (WHERE dataset_source = 'ev') AS ev_flows,
       count(*) FILTER (WHERE dataset_source = 'od') AS od_flows
FROM r WHERE ip <> '0.0.0.0' GROUP BY ip""", extra=COMB_EXTRA).replace("\n, r AS", ", r AS", 1))(
    lambda spark, sf: agg.node_source_counts(combined(spark, sf), SOURCES))

# --- AGG-8 / AGG-9 / GR-1 edges ------------------------------------------------------------------
query("agg8_edge_features", with_li("""
SELECT src_ip AS src, dst_ip AS dst, count(*) AS weight, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes,
       CAST(sum(packets_in + packets_out) AS BIGINT) AS total_packets, CAST(sum(binary_label) AS BIGINT) AS attack_flows
FROM std GROUP BY src_ip, dst_ip"""))(lambda spark, sf: agg.edge_features(std_li(spark, sf, number=False)))

query("agg9_edge_features_by_source", with_li("""
SELECT src_ip AS src, dst_ip AS dst, count(*) AS weight, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes,
       CAST(sum(packets_in + packets_out) AS BIGINT) AS total_packets, CAST(sum(binary_label) AS BIGINT) AS attack_flows,
       count(*) FILTER (WHERE dataset_source = 'li') AS li_flows, count(*) FILTER (WHERE dataset_source = 'ev') AS ev_flows,
       count(*) FILTER (WHERE dataset_source = 'od') AS od_flows
FROM comb WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0' GROUP BY src_ip, dst_ip""", extra=COMB_EXTRA))(
    lambda spark, sf: agg.edge_features(
        __import__("flowlens.operators.cleaning", fromlist=["drop_placeholder"]).drop_placeholder(combined(spark, sf)),
        sources=SOURCES))

# --- GR-2: host graph with provenance, nodes and edges; AGG-8 membership of flows in edges -----------------
def _provenance(spark, sf):
    from ..operators import graph as gr
    nodes, edges = gr.host_graph(combined(spark, sf), by_source=SOURCES, skip_placeholder=True)
    n = nodes.select(F.lit("node").alias("kind"), F.col("ip").alias("a"), F.lit("").alias("b"), *[f"{s}_flows" for s in SOURCES])
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), *[f"{s}_flows" for s in SOURCES]))


_BY_SOURCE = ", ".join(f"count(*) FILTER (WHERE dataset_source = '{s}') AS {s}_flows" for s in SOURCES)
query("gr2_host_graph_by_source", with_li(f"""
, cp AS (SELECT * FROM comb WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0'),
  r AS (SELECT src_ip AS ip, dataset_source FROM cp UNION ALL SELECT dst_ip, dataset_source FROM cp)
SELECT 'node' AS kind, ip AS a, '' AS b, {_BY_SOURCE} FROM r GROUP BY ip
UNION ALL SELECT 'edge', src_ip, dst_ip, {_BY_SOURCE} FROM cp GROUP BY src_ip, dst_ip""", extra=COMB_EXTRA).replace("\n, cp AS", ", cp AS", 1))(_provenance)

query("agg8_edge_flows", with_li("SELECT src_ip AS src, dst_ip AS dst, flow_key FROM std"))(
    lambda spark, sf: agg.edge_flows(std_li(spark, sf, number=False), flow_id="flow_key"))

query("agg10_edge_first", with_li("""
SELECT src_ip AS src, dst_ip AS dst, 1 AS weight, CAST(arg_min(binary_label, flow_key) AS INTEGER) AS attack_flows
FROM std GROUP BY src_ip, dst_ip"""))(lambda spark, sf: agg.edge_first(std_li(spark, sf, number=False), "flow_key"))

# --- AGG-11: graph metrics -------------------------------------------------------------------------
def _metrics(spark, sf):
    from ..operators.sets import endpoints
    d = std_li(spark, sf, number=False)
    return rounded(agg.graph_metrics(endpoints(d), agg.edge_features(d)))


query("agg11_graph_metrics", with_li("""
, n AS (SELECT count(*) AS n FROM (SELECT src_ip FROM std UNION SELECT dst_ip FROM std)),
  m AS (SELECT count(*) AS m FROM (SELECT DISTINCT src_ip, dst_ip FROM std))
SELECT CAST(n AS BIGINT) AS nodes, CAST(m AS BIGINT) AS edges,
       round(CASE WHEN n > 1 THEN m / (n * (n - 1.0)) ELSE 0 END, 6) AS density,
       round(CASE WHEN n > 0 THEN 2.0 * m / n ELSE 0 END, 6) AS avg_degree FROM n, m""").replace("\n, n AS", ", n AS", 1))(_metrics)

# --- AGG-12: cardinality ----------------------------------------------------------------------------
CARD_COLS = ["src_ip", "dst_ip", "protocol_name", "attack_type", "dst_port"]
query("agg12_cardinality", with_li("""
SELECT 'src_ip' AS "column", CAST(count(DISTINCT src_ip) AS BIGINT) AS "distinct" FROM std
UNION ALL SELECT 'dst_ip', count(DISTINCT dst_ip) FROM std
UNION ALL SELECT 'protocol_name', count(DISTINCT protocol_name) FROM std
UNION ALL SELECT 'attack_type', count(DISTINCT attack_type) FROM std
UNION ALL SELECT 'dst_port', count(DISTINCT dst_port) FROM std""").replace(
    'FROM std\nUNION', 'FROM std\nUNION', 1).replace('"distinct" FROM std', '"distinct" FROM std', 1)
    .replace("SELECT 'src_ip' AS \"column\", CAST(count(DISTINCT src_ip) AS BIGINT) AS \"distinct\" FROM std",
             "SELECT *, \"distinct\" > 1000 AS high FROM (SELECT 'src_ip' AS \"column\", CAST(count(DISTINCT src_ip) AS BIGINT) AS \"distinct\" FROM std") + ")")(
    lambda spark, sf: agg.cardinality(std_li(spark, sf, number=False), CARD_COLS))

# --- AGG-14 / AGG-15 ------------------------------------------------------------------------------------
query("agg14_class_weights", with_li("""
SELECT attack_type, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM std GROUP BY attack_type"""))(lambda spark, sf: rounded(agg.class_weights(std_li(spark, sf, number=False), "attack_type")))

query("agg15_pos_weight", with_li("""
SELECT count(*) FILTER (WHERE binary_label = 0) AS neg, count(*) FILTER (WHERE binary_label = 1) AS pos,
       round(count(*) FILTER (WHERE binary_label = 0) / count(*) FILTER (WHERE binary_label = 1), 6) AS pos_weight FROM std"""))(
    lambda spark, sf: rounded(agg.pos_weight(std_li(spark, sf, number=False), "binary_label")))

# --- AGG-17 / ENC-3: scaling statistics ------------------------------------------------------------------
SCALE_COLS = ["duration_ms", "bytes_in", "bytes_out", "packets_in"]
query("agg17_fit_scaler", with_li("""
SELECT round(avg(duration_ms), 4) AS duration_ms__mean, round(stddev_pop(duration_ms), 4) AS duration_ms__std,
       round(avg(bytes_in), 4) AS bytes_in__mean, round(stddev_pop(bytes_in), 4) AS bytes_in__std,
       round(avg(bytes_out), 4) AS bytes_out__mean, round(stddev_pop(bytes_out), 4) AS bytes_out__std,
       round(avg(packets_in), 4) AS packets_in__mean, round(stddev_pop(packets_in), 4) AS packets_in__std FROM std"""))(
    lambda spark, sf: rounded(__import__("flowlens.operators.encode", fromlist=["fit_scaler"]).fit_scaler(
        std_li(spark, sf, number=False), SCALE_COLS), 4))

# --- AGG-13: before/after reduction report ------------------------------------------------------------------
