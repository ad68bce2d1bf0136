"""Source adapters and projections.

Each adapter is one ``select`` of Column expressions, so Catalyst prunes the
scan to the columns it reads and folds the constants.  ``flow_id`` is a
dense rank on a content key (``dense_index``), never a row position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .numbering import dense_index

# Common-v1 output schema (name, type) in the reference's order.
COMMON_V1 = [
    ("src_ip", "string"), ("src_port", "bigint"), ("dst_ip", "string"), ("dst_port", "bigint"),
    ("protocol", "int"), ("protocol_name", "string"), ("duration_ms", "double"),
    ("bytes_in", "bigint"), ("bytes_out", "bigint"), ("packets_in", "bigint"), ("packets_out", "bigint"),
    ("tcp_flags", "int"), ("binary_label", "int"), ("attack_type", "string"),
]

# NetFlow core features (v1 column set every v2 table carries).
NETFLOW_CORE = [
    "IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT", "PROTOCOL", "L7_PROTO",
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "TCP_FLAGS", "FLOW_DURATION_MILLISECONDS",
    "Label", "Attack",
]
NETFLOW_STR = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR", "Attack"]
NETFLOW_INT = ["L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL", "IN_PKTS", "OUT_PKTS", "TCP_FLAGS", "Label", "flow_id"]
NETFLOW_FLOAT = ["L7_PROTO", "IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS"]
# Extra NetFlow v2 columns passed through (lower-cased) by the v2 adapters.
NETFLOW_V2_EXTRA = ["L7_PROTO", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "MIN_TTL", "MAX_TTL",
                    "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN"]

# CIC short column names -> long names (79 keys).
CIC_RENAME = {
    "": "Record ID",
    "Dst Port": "Destination Port",
    "Protocol": "Protocol",
    "Flow Duration": "Flow Duration",
    "Tot Fwd Pkts": "Total Fwd Packets",
    "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets",
    "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Flow IAT Mean": "Flow IAT Mean",
    "Flow IAT Std": "Flow IAT Std",
    "Flow IAT Max": "Flow IAT Max",
    "Flow IAT Min": "Flow IAT Min",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Fwd IAT Mean": "Fwd IAT Mean",
    "Fwd IAT Std": "Fwd IAT Std",
    "Fwd IAT Max": "Fwd IAT Max",
    "Fwd IAT Min": "Fwd IAT Min",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Bwd IAT Mean": "Bwd IAT Mean",
    "Bwd IAT Std": "Bwd IAT Std",
    "Bwd IAT Max": "Bwd IAT Max",
    "Bwd IAT Min": "Bwd IAT Min",
    "Fwd PSH Flags": "Fwd PSH Flags",
    "Bwd PSH Flags": "Bwd PSH Flags",
    "Fwd URG Flags": "Fwd URG Flags",
    "Bwd URG Flags": "Bwd URG Flags",
    "Fwd Header Len": "Fwd Header Length",
    "Bwd Header Len": "Bwd Header Length",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Pkt Len Min": "Min Packet Length",
    "Pkt Len Max": "Max Packet Length",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "FIN Flag Cnt": "FIN Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "RST Flag Cnt": "RST Flag Count",
    "PSH Flag Cnt": "PSH Flag Count",
    "ACK Flag Cnt": "ACK Flag Count",
    "URG Flag Cnt": "URG Flag Count",
    "CWE Flag Count": "CWE Flag Count",
    "ECE Flag Cnt": "ECE Flag Count",
    "Pkt Size Avg": "Average Packet Size",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size",
    "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "Fwd Byts/b Avg": "Fwd Avg Bytes/Bulk",
    "Fwd Pkts/b Avg": "Fwd Avg Packets/Bulk",
    "Fwd Blk Rate Avg": "Fwd Avg Bulk Rate",
    "Bwd Byts/b Avg": "Bwd Avg Bytes/Bulk",
    "Bwd Pkts/b Avg": "Bwd Avg Packets/Bulk",
    "Bwd Blk Rate Avg": "Bwd Avg Bulk Rate",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Subflow Fwd Byts": "Subflow Fwd Bytes",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Subflow Bwd Byts": "Subflow Bwd Bytes",
    "Init Fwd Win Byts": "Init_Win_bytes_forward",
    "Init Bwd Win Byts": "Init_Win_bytes_backward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
    "Active Mean": "Active Mean",
    "Active Std": "Active Std",
    "Active Max": "Active Max",
    "Active Min": "Active Min",
    "Idle Mean": "Idle Mean",
    "Idle Std": "Idle Std",
    "Idle Max": "Idle Max",
    "Idle Min": "Idle Min",
    "Label": "Label",
}

# CIC long names of the six flag counts and the stat pass-throughs.
CIC_FLAG_COLUMNS = ["FIN Flag Count", "SYN Flag Count", "RST Flag Count",
                    "PSH Flag Count", "ACK Flag Count", "URG Flag Count"]
CIC_STATS = [("Fwd Packet Length Mean", "stat_fwd_len_mean"), ("Fwd Packet Length Std", "stat_fwd_len_std"),
             ("Bwd Packet Length Mean", "stat_bwd_len_mean"), ("Bwd Packet Length Std", "stat_bwd_len_std"),
             ("Flow IAT Mean", "stat_flow_iat_mean"), ("Flow IAT Std", "stat_flow_iat_std")]
UNSW_STATS = [("smean", "stat_src_mean"), ("dmean", "stat_dst_mean"),
              ("sload", "stat_src_load"), ("dload", "stat_dst_load")]
BOT_STATS = ["mean", "stddev", "sum", "min", "max"]
# Fixed values.  Columns the reduced BoT-IoT adapter consumes (others numeric pass through).
BOT_REDUCED_USED = ["sport", "dport", "proto_number", "dur", "sbytes", "dbytes",
                    "spkts", "dpkts", "flgs_number", "attack"]
# Fixed values.  Correlated feature columns dropped from raw BoT-IoT before modelling.
BOT_DROPPED = ["pkSeqID", "stime", "flgs", "proto", "sport", "dport", "state", "ltime",
               "seq", "smac", "dmac", "soui", "doui", "sco", "dco", "category", "subcategory"]


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _get(df: DataFrame, name: str, default) -> Column:
    return F.col(f"`{name}`") if _has(df, name) else F.lit(default)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _finish(cols: list[Column], stats: list[Column], df: DataFrame, key: str | None,
            id_col: Column | None, number: bool = True, only: list[str] | None = None) -> DataFrame:
    """``only``: the output columns that are read later; no other goes through the numbering."""
    out_cols = list(cols)
    if id_col is not None:
        out_cols.append(id_col.cast("bigint").alias("flow_id"))
    if key and id_col is None:
        out_cols.append(F.col(key))
    out = df.select(*out_cols, *stats)
    if only is not None:
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c in only or c == key])
    if id_col is None and key and number:
        # md5 content keys are uniform: fixed hex bounds, no sampling pass
        out = dense_index(out, [key], "flow_id", drop=[key] if only is not None and key not in only else None)
    return out


# PRJ-1 -----------------------------------------------------------------------
def adapt_bot_iot(df: DataFrame, key: str | None = None) -> DataFrame:
    """BoT-IoT (``addr:port`` endpoints, seconds) -> common-v1."""
    sip, sport = fn.split_endpoint("saddr")
    dip, dport = fn.split_endpoint("daddr")
    proto = _get(df, "proto_number", None)
    proto = proto.cast("int") if _has(df, "proto_number") else fn.protocol_number("proto")
    cols = [sip.alias("src_ip"), sport.alias("src_port"), dip.alias("dst_ip"), dport.alias("dst_port"),
            proto.alias("protocol"), F.col("proto").cast("string").alias("protocol_name"),
            fn.seconds_to_ms("dur").alias("duration_ms"),
            F.col("sbytes").cast("bigint").alias("bytes_in"), F.col("dbytes").cast("bigint").alias("bytes_out"),
            _get(df, "spkts", 0).cast("bigint").alias("packets_in"),
            _get(df, "dpkts", 0).cast("bigint").alias("packets_out"),
            F.lit(0).alias("tcp_flags"),
            F.col("attack").cast("int").alias("binary_label"),
            F.when(F.col("attack") == 0, F.lit("Normal"))
             .otherwise(F.coalesce(fn.literal_map(fn.ATTACK_FAMILIES)[F.col("label")], F.lit("Other")))
             .alias("attack_type")]
    stats = [F.col(c).alias(f"stat_{c}") for c in BOT_STATS if _has(df, c)]
    return _finish(cols, stats, df, key, None)


# PRJ-2 -----------------------------------------------------------------------
def adapt_bot_iot_reduced(df: DataFrame, key: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Reduced BoT-IoT (separate, possibly hex ports) -> common-v1 plus every
    other numeric column lower-cased (nulls as 0) and ``attack_type_encoded``."""
    label = F.coalesce(F.col("label").cast("string"), F.lit("Normal"))
    attack_type = F.when((label == "-") | (F.col("attack").cast("int") == 0), F.lit("Normal")).otherwise(label)
    proto = (F.col("proto_number").cast("int") if _has(df, "proto_number")
             else fn.protocol_number("proto"))
    cols = [F.col("saddr").cast("string").alias("src_ip"), fn.parse_port("sport").alias("src_port"),
            F.col("daddr").cast("string").alias("dst_ip"), fn.parse_port("dport").alias("dst_port"),
            proto.alias("protocol"), F.col("proto").cast("string").alias("protocol_name"),
            fn.seconds_to_ms("dur", null_as_zero=True).alias("duration_ms"),
            F.coalesce(_get(df, "sbytes", 0), F.lit(0)).cast("bigint").alias("bytes_in"),
            F.coalesce(_get(df, "dbytes", 0), F.lit(0)).cast("bigint").alias("bytes_out"),
            F.coalesce(_get(df, "spkts", 0), F.lit(0)).cast("bigint").alias("packets_in"),
            F.coalesce(_get(df, "dpkts", 0), F.lit(0)).cast("bigint").alias("packets_out"),
            F.coalesce(_get(df, "flgs_number", 0), F.lit(0)).cast("int").alias("tcp_flags"),
            F.col("attack").cast("int").alias("binary_label"),
            attack_type.alias("attack_type")]
    extra = [F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in _numeric(df)
             if c not in BOT_REDUCED_USED and c != key]
    out = _finish(cols, extra, df, key, None, only=only)
    from .encode import fit_class_map, apply_class_map
    cmap = fit_class_map(out, "attack_type")
    return apply_class_map(out, cmap, "attack_type", "attack_type_encoded")


# PRJ-8 -----------------------------------------------------------------------
def rename_cic(df: DataFrame, mapping: dict = CIC_RENAME, drop_ids: bool = True) -> DataFrame:
    """Short CIC feature names -> long names; unmapped kept; id and
    ``Unnamed*`` columns dropped."""
    names = [mapping.get(c.strip(), c.strip()) for c in df.columns]
    out = df.toDF(*names)
    if drop_ids:
        drop = [c for c in out.columns if c == "Record ID" or c.startswith("Unnamed")]
        out = out.drop(*drop)
    return out


# PRJ-3 -----------------------------------------------------------------------
def adapt_cic(df: DataFrame, key: str | None = None, label_map: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """CIC-IDS2018 converted layout -> common-v1 (no addresses: placeholders).

    A numeric ``Label`` is decoded with ``label_map`` first (unmapped -> null)."""
    label = F.col("Label")
    if label_map is not None:
        label = fn.decode_label(label, label_map)
    label = F.trim(label.cast("string"))
    flags = [c for c in CIC_FLAG_COLUMNS if _has(df, c)]
    cols = [F.lit("0.0.0.0").alias("src_ip"), F.lit(0).cast("bigint").alias("src_port"),
            F.lit("0.0.0.0").alias("dst_ip"), F.col("`Destination Port`").cast("bigint").alias("dst_port"),
            F.col("Protocol").cast("int").alias("protocol"), fn.protocol_name("Protocol").alias("protocol_name"),
            F.col("`Flow Duration`").cast("double").alias("duration_ms"),
            F.col("`Total Length of Fwd Packets`").cast("bigint").alias("bytes_in"),
            F.col("`Total Length of Bwd Packets`").cast("bigint").alias("bytes_out"),
            F.col("`Total Fwd Packets`").cast("bigint").alias("packets_in"),
            F.col("`Total Backward Packets`").cast("bigint").alias("packets_out"),
            (fn.pack_tcp_flags(*[F.col(f"`{c}`") for c in flags]) if flags else F.lit(0)).alias("tcp_flags"),
            F.when(label == "BENIGN", 0).otherwise(1).cast("int").alias("binary_label"),
            F.when(label == "BENIGN", F.lit("Normal"))
             .otherwise(F.coalesce(fn.literal_map(fn.ATTACK_FAMILIES)[label], F.lit("Other"))).alias("attack_type")]
    stats = [F.col(f"`{s}`").alias(t) for s, t in CIC_STATS if _has(df, s)]
    return _finish(cols, stats, df, key, None, only=only)


# PRJ-4 -----------------------------------------------------------------------
def adapt_unsw(df: DataFrame) -> DataFrame:
    """UNSW-NB15 -> common-v1 (protocol name -> number, ``id`` as flow_id)."""
    cols = [F.lit("0.0.0.0").alias("src_ip"), F.lit(0).cast("bigint").alias("src_port"),
            F.lit("0.0.0.0").alias("dst_ip"), F.lit(0).cast("bigint").alias("dst_port"),
            fn.protocol_number("proto").alias("protocol"), F.col("proto").cast("string").alias("protocol_name"),
            fn.seconds_to_ms("dur").alias("duration_ms"),
            F.col("sbytes").cast("bigint").alias("bytes_in"), F.col("dbytes").cast("bigint").alias("bytes_out"),
            F.col("spkts").cast("bigint").alias("packets_in"), F.col("dpkts").cast("bigint").alias("packets_out"),
            F.lit(0).alias("tcp_flags"), F.col("label").cast("int").alias("binary_label"),
            F.when(F.col("label") == 0, F.lit("Normal"))
             .otherwise(F.coalesce(fn.literal_map(fn.ATTACK_FAMILIES)[F.col("attack_cat")], F.lit("Other")))
             .alias("attack_type")]
    stats = [F.col(s).alias(t) for s, t in UNSW_STATS if _has(df, s)]
    return _finish(cols, stats, df, None, F.col("id"))


# PRJ-5 -----------------------------------------------------------------------
def adapt_netflow(df: DataFrame, key: str | None = "flow_key", variant: str = "v1",
                  number: bool = True, only: list[str] | None = None) -> DataFrame:
    """NetFlow v1/v2 -> common-v1.

    ``variant='v1'`` passes ``l7_proto``; ``'v2'`` passes the seven extra v2
    columns present, lower-cased."""
    attack = F.col("Attack").cast("string")
    cols = [F.col("IPV4_SRC_ADDR").alias("src_ip"), F.col("L4_SRC_PORT").cast("bigint").alias("src_port"),
            F.col("IPV4_DST_ADDR").alias("dst_ip"), F.col("L4_DST_PORT").cast("bigint").alias("dst_port"),
            F.col("PROTOCOL").cast("int").alias("protocol"), fn.protocol_name("PROTOCOL").alias("protocol_name"),
            F.col("FLOW_DURATION_MILLISECONDS").cast("double").alias("duration_ms"),
            F.col("IN_BYTES").cast("bigint").alias("bytes_in"), F.col("OUT_BYTES").cast("bigint").alias("bytes_out"),
            F.col("IN_PKTS").cast("bigint").alias("packets_in"), F.col("OUT_PKTS").cast("bigint").alias("packets_out"),
            F.coalesce(F.col("TCP_FLAGS"), F.lit(0)).cast("int").alias("tcp_flags"),
            F.col("Label").cast("int").alias("binary_label"),
            F.when(attack == "Normal", F.lit("Normal"))
             .otherwise(F.coalesce(fn.literal_map(fn.ATTACK_FAMILIES)[attack], F.lit("Other"))).alias("attack_type")]
    extra_names = ["L7_PROTO"] if variant == "v1" else NETFLOW_V2_EXTRA
    extra = [F.col(c).alias(c.lower()) for c in extra_names if _has(df, c)]
    return _finish(cols, extra, df, key, None, number, only)


# PRJ-6 -----------------------------------------------------------------------
ADAPTERS = {
    "bot_iot": adapt_bot_iot,
    "bot_iot_reduced": adapt_bot_iot_reduced,
    "cic_ids2018": adapt_cic,
    "unsw_nb15": adapt_unsw,
    "nf_bot_iot": lambda df, **kw: adapt_netflow(df, variant="v1", **kw),
    "nf_cic_ids2018": lambda df, **kw: adapt_netflow(df, variant="v2", **kw),
    "nf_unsw_nb15": lambda df, **kw: adapt_netflow(df, variant="v2", **kw),
}


def standardize(df: DataFrame, source: str, **kw) -> DataFrame:
    """Dispatch by dataset name; unknown names raise."""
    if source not in ADAPTERS:
        raise ValueError(f"Unknown dataset type: {source}")
    return ADAPTERS[source](df, **kw)


# PRJ-9 -----------------------------------------------------------------------
def clean_columns(df: DataFrame, lower: bool = False, squeeze: bool = False) -> DataFrame:
    names = []
    for c in df.columns:
        n = c.strip()
        if lower:
            n = n.lower()
        if squeeze:
            n = n.replace(" ", "")
        names.append(n)
    return df.toDF(*names)


# PRJ-7 -----------------------------------------------------------------------
def standardize_netflow(df: DataFrame, source: str, key: str | None = "flow_key", offset: int = 0) -> DataFrame:
    """NetFlow v2 in-place standardize: trimmed headers, ``flow_id`` (dense,
    with offset) when absent, ``dataset_source``, str/int/float casts with
    bad values -> 0 (ints truncated)."""
    df = clean_columns(df)
    exprs = []
    for c in df.columns:
        if c in NETFLOW_STR:
            exprs.append(F.col(c).cast("string").alias(c))
        elif c in NETFLOW_INT:
            exprs.append(fn.to_int0(c).alias(c))
        elif c in NETFLOW_FLOAT:
            exprs.append(fn.to_dbl0(c).alias(c))
        else:
            exprs.append(F.col(f"`{c}`"))
    out = df.select(*exprs).withColumn("dataset_source", F.lit(source))
    if "flow_id" not in out.columns and key:
        out = dense_index(out, [key], "flow_id", offset=offset)
    return out


# PRJ-10 ----------------------------------------------------------------------
def align_common(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Select ``columns`` in order; absent ones filled by name rule:
    ``*_encoded`` -> 0, ``*_ip`` -> '0.0.0.0', ``*_port`` -> 0, text -> 'Unknown',
    other numerics -> 0 (typed, see README)."""
    types = types or {}
    out = []
    for c in columns:
        if c in df.columns:
            out.append(F.col(c))
        elif c.endswith("_encoded") or c.endswith("_port"):
            out.append(F.lit(0).cast(types.get(c, "bigint")).alias(c))
        elif c.endswith("_ip"):
            out.append(F.lit("0.0.0.0").alias(c))
        elif types.get(c, "string") == "string":
            out.append(F.lit("Unknown").alias(c))
        else:
            out.append(F.lit(0).cast(types[c]).alias(c))
    return df.select(*out)


# PRJ-11 ----------------------------------------------------------------------
def model_view(df: DataFrame) -> DataFrame:
    """Renamed NetFlow projection with ``ip:port`` endpoints and protocol
    names (unmapped -> OTHER)."""
    pairs = [("IN_BYTES", "bytes_in"), ("OUT_BYTES", "bytes_out"), ("IN_PKTS", "packets_in"),
             ("OUT_PKTS", "packets_out"), ("FLOW_DURATION_MILLISECONDS", "duration_ms"),
             ("TCP_FLAGS", "tcp_flags"), ("L7_PROTO", "service"), ("Label", "binary_label"),
             ("Attack", "attack_type"), ("attack_type_encoded", "attack_type_encoded"),
             ("flow_id", "flow_id"), ("dataset_source", "dataset_source")]
    cols = [fn.endpoint("IPV4_SRC_ADDR", "L4_SRC_PORT").alias("src"),
            fn.endpoint("IPV4_DST_ADDR", "L4_DST_PORT").alias("dst"),
            fn.protocol_name("PROTOCOL", default="OTHER").alias("protocol")]
    cols += [F.col(a).alias(b) for a, b in pairs if _has(df, a)]
    return df.select(*cols)


# PRJ-12 ----------------------------------------------------------------------
def derive_features(df: DataFrame, drop: list[str] = (), sum_bytes: tuple[str, str] | None = ("sbytes", "dbytes")) -> DataFrame:
    out = df
    if sum_bytes and all(_has(df, c) for c in sum_bytes):
        out = out.withColumn("network_bytes", F.col(sum_bytes[0]) + F.col(sum_bytes[1]))
    return out.drop(*[c for c in drop if c in out.columns])


# PRJ-13 ----------------------------------------------------------------------
def align_features(df: DataFrame, expected: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the expected feature columns in order; missing -> 0.0."""
    cols = [F.col(c) for c in keep]
    cols += [(F.col(f"`{c}`") if c in df.columns else F.lit(0.0)).alias(c) for c in expected]
    return df.select(*cols)


# PRJ-14 ----------------------------------------------------------------------
def split_by_type(df: DataFrame, exclude: list[str] = ()) -> tuple[list[str], list[str]]:
    num, txt = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            txt.append(f.name)
    return num, txt


# PRJ-15 ----------------------------------------------------------------------
def with_source(df: DataFrame, name: str, overwrite: bool = True) -> DataFrame:
    if not overwrite and "dataset_source" in df.columns:
        return df
    return df.withColumn("dataset_source", F.lit(name))


# PRJ-16 ----------------------------------------------------------------------
def assemble(df: DataFrame, cols: list[str], out: str = "h", keep: list[str] | None = None) -> DataFrame:
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias(out)
    if keep is None:
        return df.withColumn(out, vec)
    return df.select(*keep, vec)
