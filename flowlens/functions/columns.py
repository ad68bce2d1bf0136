"""Scalar Column builders.

Every function returns a ``pyspark.sql.Column`` built from built-in
expressions, so it never leaves the JVM.  Scalar ones are compiled with their
stage; those on arrays (``transform``, ``aggregate``) run as interpreted lambdas.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lookup tables; kept as given).
# ---------------------------------------------------------------------------

# Protocol number -> name, the three-entry table of the standardizers.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}

# Protocol number -> name, the extended table used to render node prompts.
PROTOCOL_NAMES_EXTENDED = {
    1: "ICMP", 6: "TCP", 17: "UDP",
    0: "HOPOPT", 2: "IGMP", 4: "IPv4", 41: "IPv6", 47: "GRE",
    50: "ESP", 51: "AH", 58: "IPv6-ICMP", 88: "EIGRP", 89: "OSPF",
    132: "SCTP", 137: "MPLS",
    -1: "Unknown",
}

# Protocol name -> number for sources that only carry the name.
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}

# Attack label -> attack family (26 distinct source spellings).
ATTACK_FAMILIES = {
    "DDoS": "DDoS",
    "DoS": "DoS",
    "Reconnaissance": "Reconnaissance",
    "Theft": "Information_Theft",
    "Fuzzers": "Fuzzers",
    "Analysis": "Analysis",
    "Backdoor": "Backdoor",
    "Exploits": "Exploits",
    "Generic": "Generic",
    "Shellcode": "Shellcode",
    "Worms": "Worms",
    "Benign": "Normal",
    "Bot": "Bot",
    "Brute Force": "Brute_Force",
    "Brute Force -Web": "Brute_Force",
    "Brute Force -XSS": "Brute_Force",
    "DDOS attack-HOIC": "DDoS",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-Hulk": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "FTP-BruteForce": "Brute_Force",
    "Infiltration": "Infiltration",
    "SQL Injection": "Injection",
    "SSH-Bruteforce": "Brute_Force",
}
# Labels meaning "no attack" in the various sources.
NORMAL_LABELS = ("Normal", "BENIGN", "Benign")

# KDD-99 attack name -> category (names carry a trailing '.' in the raw file).
KDD_CATEGORIES = {
    "normal": "normal", "back": "dos", "buffer_overflow": "u2r", "ftp_write": "r2l",
    "guess_passwd": "r2l", "imap": "r2l", "ipsweep": "probe", "land": "dos",
    "loadmodule": "u2r", "multihop": "r2l", "neptune": "dos", "nmap": "probe",
    "perl": "u2r", "phf": "r2l", "pod": "dos", "portsweep": "probe",
    "rootkit": "u2r", "satan": "probe", "smurf": "dos", "spy": "r2l",
    "teardrop": "dos", "warezclient": "r2l", "warezmaster": "r2l",
}
# NSL-KDD 3-class target: normal 0, neptune 1, everything else 2.
NSL_CLASSES = {"normal": 0, "neptune": 1}
NSL_OTHER = 2

# Numeric CIC label codes -> names (two published variants).
CIC_LABELS_BINARY = {0: "BENIGN", 1: "ATTACK"}
CIC_LABELS_11 = {
    1: "BENIGN", 2: "DoS", 3: "PortScan", 4: "BruteForce", 5: "DDoS",
    6: "WebAttack", 7: "Bot", 8: "Infiltration", 9: "SQL_Injection",
    10: "FTP-Patator", 11: "SSH-Patator",
}

# Address range the source-IP masking draws from (172.16.0.1 .. 172.31.0.1).
MASK_IP_LOW = 0xAC100001
MASK_IP_HIGH = 0xAC1F0001

# Dataset short names from file names.
DATASET_ALIASES = {"bot_iot_v2": "botv2", "cic_ids2018": "cic18", "unsw_nb15": "unsw15"}

# TCP flag order for bit packing: bit i set when count i > 0.
TCP_FLAG_ORDER = ("FIN", "SYN", "RST", "PSH", "ACK", "URG")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: dict) -> Column:
    """A literal ``map`` Column from a small Python dict (constant-folded)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


# FN-1 ----------------------------------------------------------------------
def split_endpoint(c) -> tuple[Column, Column]:
    """``addr:port`` -> (addr, port); port null when absent or not numeric."""
    parts = F.split(_c(c).cast("string"), ":", 2)
    ip = F.element_at(parts, 1)
    port = F.element_at(parts, 2).try_cast("double").cast("bigint")
    return ip, F.when(F.size(parts) > 1, port)


# FN-2 ----------------------------------------------------------------------
def to_int0(c) -> Column:
    """Coerce to number, missing/bad -> 0, truncate toward zero."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0)).cast("bigint")


def to_dbl0(c) -> Column:
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


# FN-3 ----------------------------------------------------------------------
def parse_port(c) -> Column:
    """Port text in decimal or ``0x`` hex; anything unparsable -> 0."""
    s = _c(c).cast("string")
    hex_digits = F.substring(s, 3, 64)
    is_hex = s.startswith("0x")
    hex_ok = hex_digits.rlike("^[0-9a-fA-F]+$")
    hex_val = F.conv(hex_digits, 16, 10).try_cast("bigint")
    dec_val = F.trim(s).try_cast("bigint")
    return F.coalesce(F.when(is_hex, F.when(hex_ok, hex_val)).otherwise(dec_val),
                      F.lit(0)).cast("bigint")


# FN-4 ----------------------------------------------------------------------
def protocol_name(c, default: str = "Unknown", extended: bool = False) -> Column:
    table = PROTOCOL_NAMES_EXTENDED if extended else PROTOCOL_NAMES
    return F.coalesce(literal_map(table)[_c(c).cast("int")], F.lit(default))


# FN-5 ----------------------------------------------------------------------
def protocol_number(c) -> Column:
    return F.coalesce(literal_map(PROTOCOL_NUMBERS)[F.lower(_c(c))], F.lit(0)).cast("int")


# FN-6 ----------------------------------------------------------------------
def seconds_to_ms(c, null_as_zero: bool = False) -> Column:
    v = _c(c).cast("double")
    if null_as_zero:
        v = F.coalesce(v, F.lit(0.0))
    return v * F.lit(1000.0)


# FN-7 ----------------------------------------------------------------------
def pack_tcp_flags(*cols) -> Column:
    """Bit i set when flag count i (FIN,SYN,RST,PSH,ACK,URG order) is > 0."""
    bits = [F.shiftleft((F.coalesce(_c(c).cast("bigint"), F.lit(0)) > 0).cast("int"), i)
            for i, c in enumerate(cols)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


# FN-8 ----------------------------------------------------------------------
def attack_family(label, binary=None) -> Column:
    """Map a source attack label to its family; unmapped -> ``Other``,
    benign spellings (and ``binary == 0`` when given) -> ``Normal``."""
    lab = F.trim(_c(label).cast("string"))
    fam = F.coalesce(literal_map(ATTACK_FAMILIES)[lab], F.lit("Other"))
    out = F.when(lab.isin(*NORMAL_LABELS), F.lit("Normal")).otherwise(fam)
    if binary is not None:
        out = F.when(_c(binary) == 0, F.lit("Normal")).otherwise(out)
    return out


# FN-9 ----------------------------------------------------------------------
def binary_label(c) -> Column:
    lab = F.trim(_c(c).cast("string"))
    return F.when(lab.isin(*NORMAL_LABELS), 0).otherwise(1).cast("int")


# FN-10 ---------------------------------------------------------------------
def kdd_category(c) -> Column:
    """KDD-99 target (``name.``) -> category; unmapped -> null."""
    return literal_map(KDD_CATEGORIES)[F.regexp_replace(_c(c), r"\.$", "")]


def nsl_class(c) -> Column:
    return F.coalesce(literal_map(NSL_CLASSES)[_c(c)], F.lit(NSL_OTHER)).cast("int")


# FN-11 ---------------------------------------------------------------------
def decode_label(c, mapping: dict) -> Column:
    """Numeric code -> label text; unmapped -> null."""
    return literal_map(mapping)[_c(c).cast("int")]


# FN-12 ---------------------------------------------------------------------
def endpoint(ip, port) -> Column:
    return F.concat_ws(":", _c(ip).cast("string"), _c(port).cast("string"))


# FN-13 ---------------------------------------------------------------------
def int_to_ipv4(n) -> Column:
    n = _c(n).cast("bigint")
    return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def mask_ip(key, seed: int = 42) -> Column:
    """Replace an address by one in 172.16.0.1..172.31.0.1, drawn from a hash
    of (seed, key).  Pass the IP as key for a per-host stable mask, or a flow
    key for the per-row variant."""
    span = MASK_IP_HIGH - MASK_IP_LOW + 1
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 12), 16, 10)
    return int_to_ipv4(F.lit(MASK_IP_LOW) + (h.cast("decimal(20,0)") % span).cast("bigint"))


# FN-14 ---------------------------------------------------------------------
def log1p_col(c) -> Column:
    return F.log1p(_c(c).cast("double"))


# FN-15 ---------------------------------------------------------------------
def finite0(c) -> Column:
    v = _c(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def finite_or_null(c) -> Column:
    v = _c(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


# FN-16 ---------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a) -> Column:
    """Row L2 normalization; an all-zero row stays unchanged."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(_c(a))


# FN-17 ---------------------------------------------------------------------
def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def softmax(arr) -> Column:
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# FN-18 ---------------------------------------------------------------------
def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


# FN-19 ---------------------------------------------------------------------
def to_binary_pred(pred_class, benign_code: int) -> Column:
    return (_c(pred_class) != F.lit(benign_code)).cast("int")


def attack_probability(probs, benign_code: int) -> Column:
    return F.lit(1.0) - F.element_at(_c(probs), benign_code + 1)


# FN-20 ---------------------------------------------------------------------
def outlier_to_label(c) -> Column:
    """Outlier convention 1 = inlier, -1 = outlier  ->  0 / 1."""
    return F.when(_c(c) == -1, 1).otherwise(0).cast("int")


# FN-21 ---------------------------------------------------------------------
def dataset_short_name(path) -> Column:
    base = F.regexp_extract(_c(path), r"([^/]+)$", 1)
    # fixed value: must match the published file names
    pat = r"nf_([a-zA-Z0-9_]+?)_(reduced_)?standardized\.csv"
    name = F.regexp_extract(base, pat, 1)
    red = F.regexp_extract(base, pat, 2)
    alias = F.coalesce(literal_map(DATASET_ALIASES)[name], name)
    matched = F.concat(alias, F.when(red != "", F.lit("_red")).otherwise(F.lit("")))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    fallback = F.replace(F.replace(stem, F.lit("_standardized"), F.lit("")), F.lit("nf_"), F.lit(""))
    return F.when(base.rlike(pat), matched).otherwise(fallback)


# FN-22 ---------------------------------------------------------------------
def base_feature(c) -> Column:
    """``F_6`` / ``F_scaled`` / ``F_6_scaled`` -> ``F``."""
    # fixed value: must match the published feature names
    m = F.regexp_extract(_c(c), r"^([a-zA-Z0-9_]+?)(_[0-9.\-]+)?(_scaled)?$", 1)
    return F.when(m != "", m).otherwise(_c(c))


# FN-23 ---------------------------------------------------------------------
def stratum_key(*cols) -> Column:
    return F.concat_ws("_", *[_c(c).cast("string") for c in cols])


# FN-24 ---------------------------------------------------------------------
def as_category(c, missing: str = "missing") -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(missing))


# FN-26 ---------------------------------------------------------------------
def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


# FN-27 ---------------------------------------------------------------------
def is_reduced(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)$", 1).contains("reduced")


# Deterministic randomness ---------------------------------------------------
def hash_order(key, seed: int = 42) -> Column:
    """``md5(seed:key)`` hex: the shared random order of every sampler
    (same text in Spark and DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash_unit(key, seed: int = 42) -> Column:
    """Uniform [0,1) double from the first 13 hex digits of ``hash_order``."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
