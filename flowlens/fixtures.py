"""Views of the given test tables as the flow layouts the operators expect.

Each fixture is one SQL text that runs unchanged in Spark SQL (tables passed
as DataFrame arguments) and in DuckDB (tables are views of the same parquet
files).  Only identifier quoting differs for ``od``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import read_table

# Fixture texts (FIXTURES.md Part B), kept verbatim.
LI_SQL = """SELECT concat('10.', cast(cast(floor(l_suppkey/256) as bigint)%256 as string), '.', cast(l_suppkey%256 as string), '.1') AS IPV4_SRC_ADDR,
 cast(1024 + l_partkey%64 as int) AS L4_SRC_PORT,
 concat('192.168.', cast(cast(floor(o_custkey/256) as bigint)%256 as string), '.', cast(o_custkey%256 as string)) AS IPV4_DST_ADDR,
 cast(CASE l_linenumber WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53 WHEN 4 THEN 22 WHEN 5 THEN 21 ELSE 8080 END as int) AS L4_DST_PORT,
 cast(CASE l_linenumber%4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 17 ELSE 47 END as int) AS PROTOCOL,
 cast(l_partkey%10 as double) AS L7_PROTO,
 l_extendedprice AS IN_BYTES, cast(l_extendedprice*l_discount as double) AS OUT_BYTES,
 cast(l_quantity as bigint) AS IN_PKTS, cast(l_linenumber as bigint) AS OUT_PKTS,
 cast(l_suppkey%64 as int) AS TCP_FLAGS,
 cast(l_quantity*l_tax*1000 as double) AS FLOW_DURATION_MILLISECONDS,
 cast(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END as int) AS Label,
 CASE WHEN l_returnflag<>'R' THEN 'Benign' WHEN l_quantity>=50 AND l_discount>=0.095 THEN 'Worms'
      WHEN l_quantity>=50 THEN 'Shellcode' WHEN l_quantity>=46 THEN 'Infiltration'
      WHEN l_quantity>=36 THEN 'Reconnaissance' WHEN l_linestatus='O' THEN 'DDoS' ELSE 'DoS' END AS Attack,
 md5(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string),
     cast(l_linenumber as string), cast(cast(l_quantity as bigint) as string), cast(l_shipdate as string))) AS flow_key
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey"""

EV_SQL = """SELECT concat('172.16.', cast(cast(floor(user_id/256) as bigint)%256 as string), '.', cast(user_id%256 as string)) AS saddr,
 concat('0x', '1f90') AS sport,
 concat('198.51.100.', regexp_extract(props, '([0-9]+)', 1)) AS daddr, regexp_extract(props, '([0-9]+)', 1) AS dport,
 CASE event_type WHEN 'view' THEN 'tcp' WHEN 'click' THEN 'tcp' WHEN 'signup' THEN 'udp' WHEN 'purchase' THEN 'icmp' ELSE 'arp' END AS proto,
 value/1000 AS dur, cast(floor(value*100) as bigint) AS sbytes, cast(floor(value*10) as bigint) AS dbytes,
 cast(CASE WHEN event_type='error' THEN 1 ELSE 0 END as int) AS attack,
 CASE WHEN event_type<>'error' THEN '-' WHEN value>=200 THEN 'Theft' WHEN value>=50 THEN 'DDoS' WHEN value>=20 THEN 'DoS' ELSE 'Reconnaissance' END AS label,
 event_id AS pkSeqID, ts AS stime FROM {events}"""

OD_SQL = """SELECT cast(CASE o_orderstatus WHEN 'F' THEN 80 WHEN 'O' THEN 443 ELSE 22 END as int) AS `Dst Port`,
 cast(CASE WHEN o_orderkey%3=0 THEN 6 WHEN o_orderkey%3=1 THEN 17 ELSE 0 END as int) AS `Protocol`,
 cast(o_totalprice as double) AS `Flow Duration`, cast(o_orderkey%50+1 as bigint) AS `Tot Fwd Pkts`, cast(o_custkey%40 as bigint) AS `Tot Bwd Pkts`,
 cast(floor(o_totalprice) as bigint) AS `TotLen Fwd Pkts`, cast(floor(abs(c_acctbal)) as bigint) AS `TotLen Bwd Pkts`,
 cast(o_orderkey%2 as int) AS `FIN Flag Cnt`, cast(o_orderkey%3 as int) AS `SYN Flag Cnt`, cast(o_orderkey%5 as int) AS `RST Flag Cnt`,
 cast(o_custkey%2 as int) AS `PSH Flag Cnt`, cast(o_custkey%3 as int) AS `ACK Flag Cnt`, cast(o_custkey%7 as int) AS `URG Flag Cnt`,
 cast(CASE WHEN o_orderpriority IN ('1-URGENT') THEN 1+o_orderkey%11 ELSE 1 END as int) AS `Label`, o_orderkey AS `Record ID`
FROM {orders} JOIN {customer} ON o_custkey=c_custkey"""

# B4 helper: deterministic score with the li label.
SCORED_SQL = """SELECT md5(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string),
     cast(l_linenumber as string), cast(cast(l_quantity as bigint) as string), cast(l_shipdate as string))) AS flow_key,
 cast(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END as int) AS y,
 cast(((l_partkey*7919 + l_suppkey*104729 + l_linenumber*31) % 1000)/1000.0*0.7
      + CASE WHEN l_returnflag='R' THEN 0.3 ELSE 0 END as double) AS score
FROM {lineitem}"""

# B4 helper: text and numeric columns with gaps (and infinities).
GAPS_SQL = """SELECT md5(concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string),
     cast(l_linenumber as string), cast(cast(l_quantity as bigint) as string), cast(l_shipdate as string))) AS flow_key,
 CASE WHEN l_partkey%17=0 THEN NULL ELSE l_returnflag END AS flag_txt,
 CASE WHEN l_partkey%13=0 THEN NULL ELSE l_linestatus END AS status_txt,
 CASE WHEN l_partkey%11=0 THEN NULL ELSE l_quantity END AS qty,
 CASE WHEN l_partkey%19=0 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice END AS price,
 l_discount AS disc,
 cast(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END as int) AS Label
FROM {lineitem}"""

# UNSW-NB15 layout over orders (used for the UNSW adapter only).
UN_SQL = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'tcp' WHEN 'O' THEN 'udp' ELSE 'icmp' END AS proto,
 cast(o_totalprice as double)/100000.0 AS dur, cast(floor(o_totalprice) as bigint) AS sbytes, cast(o_custkey % 1000 as bigint) AS dbytes,
 cast(o_orderkey % 7 + 1 as bigint) AS spkts, cast(o_custkey % 5 as bigint) AS dpkts,
 cast(o_totalprice as double)/1000.0 AS smean, cast(o_custkey % 100 as double) AS dmean,
 cast(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END as int) AS label,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'Exploits' WHEN o_orderpriority = '2-HIGH' THEN 'Fuzzers' ELSE '' END AS attack_cat
FROM {orders}"""

EMB_SQL = """SELECT vec_id, label, embedding FROM {embeddings}"""

_TABLES = {
    "li": (LI_SQL, ("lineitem", "orders")),
    "ev": (EV_SQL, ("events",)),
    "od": (OD_SQL, ("orders", "customer")),
    "scored": (SCORED_SQL, ("lineitem",)),
    "gaps": (GAPS_SQL, ("lineitem",)),
    "un": (UN_SQL, ("orders",)),
}


def duck(name: str) -> str:
    """Fixture text for DuckDB (tables referenced by their view names)."""
    sql, tables = _TABLES[name]
    text = sql.format(**{t: t for t in tables})
    return text.replace("`", '"')


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture as a lazy Spark DataFrame over the parquet tables."""
    sql, tables = _TABLES[name]
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "li")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "ev")


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "od")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "scored")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the float vector widened to double."""
    from pyspark.sql import functions as F
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label",
                    F.col("embedding").cast("array<double>").alias("embedding"))
