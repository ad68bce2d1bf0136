"""Shared DuckDB oracle fragments (views over the fixtures).

These are independent SQL formulations of the operators' semantics; only
the fixed lookup tables are rendered from the same constants.
"""

from __future__ import annotations

from ..fixtures import duck
from ..functions.columns import ATTACK_FAMILIES, PROTOCOL_NAMES


def case_map(expr: str, table: dict, default: str = "NULL", quote_keys: bool = True) -> str:
    def q(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


ATTACK_CASE = case_map("Attack", ATTACK_FAMILIES, "'Other'")
PROTO_CASE = case_map("PROTOCOL", PROTOCOL_NAMES, "'Unknown'")

# common-v1 view of li (PRJ-5), flow_id = rank of flow_key.
STD_LI = f"""std AS (
 SELECT IPV4_SRC_ADDR AS src_ip, CAST(L4_SRC_PORT AS BIGINT) AS src_port,
        IPV4_DST_ADDR AS dst_ip, CAST(L4_DST_PORT AS BIGINT) AS dst_port,
        CAST(PROTOCOL AS INTEGER) AS protocol, {PROTO_CASE} AS protocol_name,
        CAST(FLOW_DURATION_MILLISECONDS AS DOUBLE) AS duration_ms,
        CAST(trunc(IN_BYTES) AS BIGINT) AS bytes_in, CAST(trunc(OUT_BYTES) AS BIGINT) AS bytes_out,
        CAST(IN_PKTS AS BIGINT) AS packets_in, CAST(OUT_PKTS AS BIGINT) AS packets_out,
        CAST(TCP_FLAGS AS INTEGER) AS tcp_flags, CAST(Label AS INTEGER) AS binary_label,
        CASE WHEN Attack = 'Normal' THEN 'Normal' WHEN Attack IN ('Normal','BENIGN','Benign') THEN 'Normal' ELSE {ATTACK_CASE} END AS attack_type,
        L7_PROTO AS l7_proto, flow_key,
        CAST(row_number() OVER (ORDER BY flow_key) - 1 AS BIGINT) AS flow_id
 FROM li)"""


def with_li(body: str, std: bool = True, extra: list[str] | None = None) -> str:
    parts = [f"li AS ({duck('li')})"]
    if std:
        parts.append(STD_LI)
    parts += extra or []
    return "WITH " + ",\n".join(parts) + "\n" + body


def with_fx(body: str, names: list[str], extra: list[str] | None = None) -> str:
    parts = [f"{n} AS ({duck(n)})" for n in names]
    parts += extra or []
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
