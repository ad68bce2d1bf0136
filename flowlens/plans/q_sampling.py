"""Checked queries: sampling, reduction, splits, numbering, sets, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import aggregate as agg
from ..operators import cleaning as cl
from ..operators import numbering as nb
from ..operators import sampling as sm
from ..operators import sets as st
from .q_flows import COMB_EXTRA, combined, gaps, std_li
from .registry import query, rounded
from .sqltext import with_li

U = "md5('42:' || flow_key)"


def ranked(src: str, part: str, key: str = "flow_key", seed: int = 42) -> str:
    u = f"md5('{seed}:' || CAST({key} AS VARCHAR))"
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {u}, CAST({key} AS VARCHAR)) AS rn FROM {src}")


def D(x: float) -> str:
    """A double literal with exactly the value Python computed."""
    return f"CAST({x!r} AS DOUBLE)"


def _sel(df):
    return df.select("flow_key", "attack_type")


# SMP-1 ------------------------------------------------------------------------
# Published sampling rates by class.
RATES = {"DDoS": 0.35, "DoS": 0.35, "Reconnaissance": 0.70, "Normal": 1.0, "Theft": 1.0}
_rate_case = "CASE attack_type " + " ".join(f"WHEN '{k}' THEN {D(v)}" for k, v in RATES.items()) + " END"
query("smp1_sample_by_rate", with_li(f"""
, k AS (SELECT * FROM std WHERE attack_type IN ({", ".join(f"'{k}'" for k in RATES)})),
  c AS (SELECT attack_type, count(*) AS cnt FROM k GROUP BY attack_type),
  q AS (SELECT attack_type, CASE WHEN cnt < 1000 THEN cnt ELSE round_even(cnt * {_rate_case}, 0) END AS n FROM c),
  r AS ({ranked('k', 'attack_type')})
SELECT flow_key, attack_type FROM r JOIN q USING (attack_type) WHERE rn <= n""").replace("\n, k AS", ", k AS", 1))(
    lambda spark, sf: _sel(sm.sample_by_rate(std_li(spark, sf, number=False), "attack_type", RATES, "flow_key")))


# SMP-2 / SMP-3 ------------------------------------------------------------------
def _rarity_sql(rare, unc, rr, ur, cr):
    return with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt, sum(count(*)) OVER () AS total FROM std GROUP BY attack_type),
  q AS (SELECT attack_type, CASE WHEN cnt < 1000 THEN cnt ELSE round_even(cnt * least(CASE WHEN cnt < total * {D(rare)} THEN {D(rr)}
        WHEN cnt < total * {D(unc)} THEN {D(ur)} ELSE {D(cr)} END, 1.0), 0) END AS n FROM c),
  r AS ({ranked('std', 'attack_type')})
SELECT flow_key, attack_type FROM r JOIN q USING (attack_type) WHERE rn <= n""").replace("\n, c AS", ", c AS", 1)


R = 0.1
query("smp2_reduce_by_rarity", _rarity_sql(0.01, 0.10, max(0.5, 5 * R), min(1.0, 2 * R), 0.9 * R))(
    lambda spark, sf: _sel(sm.reduce_by_rarity(std_li(spark, sf, number=False), "attack_type", R, "flow_key", "1/10")))
query("smp3_reduce_by_rarity_fine", _rarity_sql(0.001, 0.05, max(0.5, 10 * R), min(1.0, 4 * R), 0.9 * R))(
    lambda spark, sf: _sel(sm.reduce_by_rarity(std_li(spark, sf, number=False), "attack_type", R, "flow_key", "0.1/5")))

# AGG-13: reduction report on SMP-2 ------------------------------------------------
query("agg13_reduction_report", with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt, sum(count(*)) OVER () AS total FROM std GROUP BY attack_type),
  q AS (SELECT attack_type, CASE WHEN cnt < 1000 THEN cnt ELSE round_even(cnt * least(CASE WHEN cnt < total * {D(0.01)} THEN {D(max(0.5, 5 * R))}
        WHEN cnt < total * {D(0.1)} THEN {D(min(1.0, 2 * R))} ELSE {D(0.9 * R)} END, 1.0), 0) END AS n FROM c),
  r AS ({ranked('std', 'attack_type')}),
  kept AS (SELECT attack_type, count(*) AS kept FROM r JOIN q USING (attack_type) WHERE rn <= n GROUP BY attack_type)
SELECT c.attack_type, c.cnt AS original, coalesce(kept, 0) AS kept,
       round(coalesce(kept, 0) / sum(coalesce(kept, 0)) OVER (), 6) AS kept_share,
       round(coalesce(kept, 0) / c.cnt, 6) AS keep_ratio
FROM c LEFT JOIN kept USING (attack_type)""").replace("\n, c AS", ", c AS", 1))(
    lambda spark, sf: rounded(agg.reduction_report(
        std_li(spark, sf, number=False),
        sm.reduce_by_rarity(std_li(spark, sf, number=False), "attack_type", R, "flow_key", "1/10"), "attack_type")))

# SMP-4: 4-tier x source strata on the combined table ------------------------------
b = max(0.01, R)
_t = [min(1.0, max(0.9, b * 10)), min(0.8, max(0.1, b * 5)), min(0.6, max(0.05, b * 2.5)), max(0.01, 0.9 * b if R <= 0.1 else b)]
query("smp4_combine_reduce", with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt, sum(count(*)) OVER () AS total FROM comb GROUP BY attack_type),
  rt AS (SELECT attack_type, CASE WHEN cnt < total * {D(0.001)} THEN {D(_t[0])} WHEN cnt < total * {D(0.01)} THEN {D(_t[1])}
         WHEN cnt < total * {D(0.05)} THEN {D(_t[2])} ELSE {D(_t[3])} END AS rate FROM c),
  s AS (SELECT attack_type, dataset_source, count(*) AS cnt FROM comb GROUP BY attack_type, dataset_source),
  q AS (SELECT s.attack_type, dataset_source, greatest(1, ceil(cnt * rate)) AS n FROM s JOIN rt USING (attack_type)),
  r AS ({ranked('comb', 'attack_type, dataset_source', 'flow_id')})
SELECT flow_id, attack_type, dataset_source FROM r JOIN q USING (attack_type, dataset_source) WHERE rn <= n""",
    extra=COMB_EXTRA).replace("\n, c AS", ", c AS", 1))(
    lambda spark, sf: sm.combine_reduce(combined(spark, sf), "attack_type", R, "flow_id")
    .select("flow_id", "attack_type", "dataset_source"))


query("smp4_combine_reduce_renumbered", with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt, sum(count(*)) OVER () AS total FROM comb GROUP BY attack_type),
  rt AS (SELECT attack_type, CASE WHEN cnt < total * {D(0.001)} THEN {D(_t[0])} WHEN cnt < total * {D(0.01)} THEN {D(_t[1])}
         WHEN cnt < total * {D(0.05)} THEN {D(_t[2])} ELSE {D(_t[3])} END AS rate FROM c),
  s AS (SELECT attack_type, dataset_source, count(*) AS cnt FROM comb GROUP BY attack_type, dataset_source),
  q AS (SELECT s.attack_type, dataset_source, greatest(1, ceil(cnt * rate)) AS n FROM s JOIN rt USING (attack_type)),
  r AS ({ranked('comb', 'attack_type, dataset_source', 'flow_id')})
SELECT CAST(row_number() OVER (ORDER BY flow_id) - 1 AS BIGINT) AS flow_id, attack_type, dataset_source
FROM r JOIN q USING (attack_type, dataset_source) WHERE rn <= n""", extra=COMB_EXTRA).replace("\n, c AS", ", c AS", 1))(
    lambda spark, sf: sm.combine_reduce(combined(spark, sf, ["attack_type"]), "attack_type", R, "flow_id", renumber="flow_id")
    .select("flow_id", "attack_type", "dataset_source"))


# SMP-5 / SMP-6 ----------------------------------------------------------------------
def _cap_sql(total, large_min, strict, at_least):
    op = ">" if strict else ">="
    return with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt FROM std GROUP BY attack_type),
  f AS (SELECT *, least(1.0, {D(float(total))} / sum(CASE WHEN cnt {op} {large_min} THEN cnt END) OVER ()) AS factor FROM c),
  q AS (SELECT attack_type, CASE WHEN cnt {op} {large_min} THEN greatest({at_least}, least(floor(cnt * factor), cnt)) ELSE cnt END AS n FROM f),
  r AS ({ranked('std', 'attack_type')})
SELECT flow_key, attack_type FROM r JOIN q USING (attack_type) WHERE rn <= n""").replace("\n, c AS", ", c AS", 1)


query("smp5_cap_proportional", _cap_sql(5000, 500, True, 0))(
    lambda spark, sf: _sel(sm.cap_proportional(std_li(spark, sf, number=False), "attack_type", "flow_key",
                                               total=5000, large_min=500, strict=True, at_least=0)))
query("smp6_cap_proportional_floor1", _cap_sql(50000, 1000, False, 1))(
    lambda spark, sf: _sel(sm.cap_proportional(std_li(spark, sf, number=False), "attack_type", "flow_key",
                                               total=50000, large_min=1000, strict=False, at_least=1)))

# SMP-7: fixed-size stratified subset ----------------------------------------------------
query("smp7_fixed_subset", with_li(f"""
, c AS (SELECT attack_type, count(*) AS cnt FROM std GROUP BY attack_type),
  a AS (SELECT *, CAST(100 AS DOUBLE) * cnt / sum(cnt) OVER () AS ex FROM c),
  b AS (SELECT *, floor(ex) AS fl, ex - floor(ex) AS rem FROM a),
  d AS (SELECT *, 100 - sum(fl) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, attack_type) AS rk FROM b),
  q AS (SELECT attack_type, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS n FROM d),
  r AS ({ranked('std', 'attack_type')}),
  flag AS (SELECT min(cnt) * count(*) >= 100 AS strat FROM c)
SELECT flow_key, attack_type FROM r JOIN q USING (attack_type), flag WHERE rn <= n AND strat
UNION ALL
SELECT flow_key, attack_type FROM (SELECT *, row_number() OVER (ORDER BY {U}, flow_key) AS g FROM std), flag
WHERE g <= 100 AND NOT strat""").replace("\n, c AS", ", c AS", 1))(
    lambda spark, sf: _sel(sm.fixed_subset(std_li(spark, sf, number=False), 100, "attack_type", "flow_key")))

# SMP-8: 10 % per class ------------------------------------------------------------------------
query("smp8_sample_by_group", with_li(f"""
, q AS (SELECT attack_type, round_even(count(*) * {D(0.1)}, 0) AS n FROM std GROUP BY attack_type),
  r AS ({ranked('std', 'attack_type')})
SELECT flow_key, attack_type FROM r JOIN q USING (attack_type) WHERE rn <= n""").replace("\n, q AS", ", q AS", 1))(
    lambda spark, sf: _sel(sm.sample_by_group(std_li(spark, sf, number=False), "attack_type", 0.1, "flow_key")))

# SMP-9: uniform n rows -------------------------------------------------------------------------
query("smp9_sample_n", with_li(f"""
SELECT flow_key, attack_type FROM (SELECT *, row_number() OVER (ORDER BY {U}, flow_key) AS rn FROM std) WHERE rn <= 10000"""))(
    lambda spark, sf: _sel(sm.sample_n(std_li(spark, sf, number=False), 10000, "flow_key")))

# IDX-2: exactly n per group ---------------------------------------------------------------------
query("idx2_take_per_group", with_li(f"""
SELECT flow_key, attack_type FROM ({ranked('std', 'attack_type')}) WHERE rn <= 100"""))(
    lambda spark, sf: _sel(nb.take_per_group(std_li(spark, sf, number=False), ["attack_type"],
                                             std_li(spark, sf, number=False).select("attack_type").distinct()
                                             .withColumn("n", F.lit(100)), "flow_key")))


# SMP-10 / SMP-11 -------------------------------------------------------------------------------
def _split_sql(src: str, frac: float, seed: int, names: tuple[str, str], out: str = "split") -> str:
    return f"""
  c_{out} AS (SELECT attack_type, count(*) AS cnt FROM {src} GROUP BY attack_type),
  a_{out} AS (SELECT *, ceil(sum(cnt) OVER () * {D(frac)}) * cnt / sum(cnt) OVER () AS ex FROM c_{out}),
  b_{out} AS (SELECT *, floor(ex) AS fl, ex - floor(ex) AS rem FROM a_{out}),
  d_{out} AS (SELECT *, ceil(sum(cnt) OVER () * {D(frac)}) - sum(fl) OVER () AS lft,
              row_number() OVER (ORDER BY rem DESC, attack_type) AS rk FROM b_{out}),
  q_{out} AS (SELECT attack_type, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS n FROM d_{out}),
  r_{out} AS ({ranked(src, 'attack_type', seed=seed)}),
  {out} AS (SELECT r_{out}.* EXCLUDE (rn), CASE WHEN rn <= n THEN '{names[1]}' ELSE '{names[0]}' END AS {out}
            FROM r_{out} JOIN q_{out} USING (attack_type))"""


query("smp10_stratified_split", with_li(f"""
, {_split_sql('std', 0.3, 42, ('train', 'test'))}
SELECT flow_key, split FROM split""").replace("\n, ", ", ", 1))(
    lambda spark, sf: sm.split(std_li(spark, sf, number=False), "flow_key", ["attack_type"], 0.3).select("flow_key", "split"))

query("smp11_split_70_15_15", with_li(f"""
, {_split_sql('std', 0.3, 42, ('train', 'rest'), 'p1')},
  rest AS (SELECT * EXCLUDE (p1) FROM p1 WHERE p1 = 'rest'),
  {_split_sql('rest', 0.15 / 0.3, 43, ('val', 'test'), 'p2')}
SELECT flow_key, p1 AS split FROM p1 WHERE p1 = 'train'
UNION ALL SELECT flow_key, p2 FROM p2""").replace("\n, ", ", ", 1))(
    lambda spark, sf: sm.split3(std_li(spark, sf, number=False), "flow_key", ["attack_type"]).select("flow_key", "split"))

# SMP-13: k-fold assignment --------------------------------------------------------------------
query("smp13_kfold", with_li(f"""
SELECT flow_key, CAST((row_number() OVER (PARTITION BY attack_type ORDER BY {U}, flow_key) - 1) % 5 AS INTEGER) AS fold FROM std"""))(
    lambda spark, sf: sm.kfold(std_li(spark, sf, number=False), "flow_key", 5, ["attack_type"]).select("flow_key", "fold"))

# SMP-12 + IDX-1: shuffled order as dense positions ----------------------------------------------
query("smp12_shuffle_positions", with_li(f"""
SELECT flow_key, CAST(row_number() OVER (ORDER BY {U}, flow_key) - 1 AS BIGINT) AS pos FROM std"""))(
    lambda spark, sf: nb.dense_index(std_li(spark, sf, number=False).withColumn("_u", F.md5(F.concat(F.lit("42:"), "flow_key"))),
                                     ["_u", "flow_key"], "pos").select("flow_key", "pos"))

query("idx1_rank_within_class", with_li("""
SELECT flow_key, attack_type, CAST(row_number() OVER (PARTITION BY attack_type ORDER BY flow_key) - 1 AS BIGINT) AS rk FROM std"""))(
    lambda spark, sf: nb.dense_index(std_li(spark, sf, number=False), ["flow_key"], "rk", by=["attack_type"])
    .select("flow_key", "attack_type", "rk"))

# ORD-2: head (limit is the feature) -------------------------------------------------------------
query("ord2_head", with_li("""
SELECT flow_key, attack_type, bytes_in FROM std ORDER BY flow_key LIMIT 20"""))(
    lambda spark, sf: std_li(spark, sf, number=False).orderBy("flow_key").limit(20).select("flow_key", "attack_type", "bytes_in"))


# SET-2: union with common columns, global re-encode and global scaling -----------------------------
def _combine_common(spark, sf):
    from ..operators.encode import apply_class_map, apply_scaler, fit_class_map, fit_scaler
    c = combined(spark, sf)
    cm = fit_class_map(c, "attack_type")
    e = apply_class_map(c, cm, "attack_type", "attack_type_encoded")
    stats = fit_scaler(e, ["bytes_in", "bytes_out"])
    s = apply_scaler(e, stats, ["bytes_in", "bytes_out"], "_scaled")
    return rounded(s.select("flow_id", "dataset_source", "attack_type_encoded", "bytes_in_scaled", "bytes_out_scaled"), 5)


query("set2_combine_common", with_li("""
, s AS (SELECT avg(bytes_in) AS mi, CASE WHEN stddev_pop(bytes_in) = 0 THEN 1 ELSE stddev_pop(bytes_in) END AS si,
               avg(bytes_out) AS mo, CASE WHEN stddev_pop(bytes_out) = 0 THEN 1 ELSE stddev_pop(bytes_out) END AS so FROM comb)
SELECT flow_id, dataset_source, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS INTEGER) AS attack_type_encoded,
       round((bytes_in - mi) / si, 5) AS bytes_in_scaled, round((bytes_out - mo) / so, 5) AS bytes_out_scaled
FROM comb, s""", extra=COMB_EXTRA).replace("\n, s AS", ", s AS", 1))(_combine_common)

# SET-3: endpoints ---------------------------------------------------------------------------------------
query("set3_endpoints", with_li("SELECT src_ip AS ip FROM std UNION SELECT dst_ip FROM std"))(
    lambda spark, sf: st.endpoints(std_li(spark, sf, number=False)))

# SET-4: tally of two id sets -------------------------------------------------------------------------------
query("set4_set_tally", with_li("""
, a AS (SELECT DISTINCT src_ip AS k FROM comb), b AS (SELECT DISTINCT dst_ip AS k FROM comb)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
       (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both,
       (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a,
       (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b""", extra=COMB_EXTRA).replace("\n, a AS", ", a AS", 1))(
    lambda spark, sf: (lambda c: st.set_tally(c.select(F.col("src_ip").alias("k")), c.select(F.col("dst_ip").alias("k")), "k"))(combined(spark, sf)))

# JN-4: semi join on a class set ------------------------------------------------------------------------------
query("jn4_semi_join_classes", with_li("""
, big AS (SELECT attack_type FROM std GROUP BY attack_type HAVING count(*) >= 1000)
SELECT flow_key, attack_type FROM std WHERE attack_type IN (SELECT attack_type FROM big)""").replace("\n, big AS", ", big AS", 1))(
    lambda spark, sf: std_li(spark, sf, number=False).join(
        F.broadcast(std_li(spark, sf, number=False).groupBy("attack_type").count().filter("count >= 1000").select("attack_type")),
        "attack_type", "left_semi").select("flow_key", "attack_type"))

# FLT-1 ------------------------------------------------------------------------------------------------------
GAPS = f"gaps AS ({fx.duck('gaps')})"
query("flt1_drop_incomplete", with_li("""
SELECT flow_key, flag_txt, status_txt, round(qty, 6) AS qty, round(price, 6) AS price, round(disc, 6) AS disc, Label FROM gaps
WHERE flag_txt IS NOT NULL AND status_txt IS NOT NULL AND qty IS NOT NULL AND price IS NOT NULL AND NOT isinf(price)
  AND disc IS NOT NULL AND Label IS NOT NULL""", std=False, extra=[GAPS]))(
    lambda spark, sf: rounded(cl.drop_incomplete(gaps(spark, sf))))

# FLT-3: placeholder endpoints removed -------------------------------------------------------------------------
query("flt3_drop_placeholder", with_li("""
SELECT dataset_source, count(*) AS n FROM comb WHERE src_ip <> '0.0.0.0' AND dst_ip <> '0.0.0.0' GROUP BY dataset_source""",
    extra=COMB_EXTRA))(
    lambda spark, sf: cl.drop_placeholder(combined(spark, sf)).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n")))

# FLT-4: null audit ----------------------------------------------------------------------------------------------
query("flt4_null_counts", with_li("""
SELECT * FROM (
 SELECT 'flow_key' AS "column", count(*) FILTER (WHERE flow_key IS NULL) AS nulls FROM gaps
 UNION ALL SELECT 'flag_txt', count(*) FILTER (WHERE flag_txt IS NULL) FROM gaps
 UNION ALL SELECT 'status_txt', count(*) FILTER (WHERE status_txt IS NULL) FROM gaps
 UNION ALL SELECT 'qty', count(*) FILTER (WHERE qty IS NULL) FROM gaps
 UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL) FROM gaps
 UNION ALL SELECT 'disc', count(*) FILTER (WHERE disc IS NULL) FROM gaps
 UNION ALL SELECT 'Label', count(*) FILTER (WHERE Label IS NULL) FROM gaps) WHERE nulls > 0""", std=False, extra=[GAPS]))(
    lambda spark, sf: cl.null_counts(gaps(spark, sf)))


# FLT-5 / FLT-6 / FLT-7: imputation fitted on train, applied to test ---------------------------------------------
def _gsplit(spark, sf):
    g = gaps(spark, sf)
    s = sm.split(g, "flow_key", None, 0.3)
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split")


GSPLIT = f"""gs AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {U}, flow_key) <= (SELECT ceil(count(*) * {D(0.3)}) FROM gaps)
                 THEN 'test' ELSE 'train' END AS split FROM gaps)"""

query("flt5_impute_median", with_li("""
, m AS (SELECT quantile_cont(qty, 0.5) AS med FROM gs WHERE split = 'train')
SELECT flow_key, round(coalesce(qty, med), 6) AS qty FROM gs, m WHERE split = 'test'""",
    std=False, extra=[GAPS, GSPLIT]).replace("\n, m AS", ", m AS", 1))(
    lambda spark, sf: rounded(cl.impute_median(*_gsplit(spark, sf), ["qty"])[1].select("flow_key", "qty")))

query("flt6_impute_mode", with_li("""
, c AS (SELECT flag_txt, count(*) AS n FROM gs WHERE split = 'train' AND flag_txt IS NOT NULL GROUP BY flag_txt),
  m AS (SELECT flag_txt AS mode FROM c ORDER BY n DESC, flag_txt LIMIT 1)
SELECT flow_key, coalesce(flag_txt, mode) AS flag_txt FROM gs, m WHERE split = 'test'""",
    std=False, extra=[GAPS, GSPLIT]).replace("\n, c AS", ", c AS", 1))(
    lambda spark, sf: cl.impute_mode(*_gsplit(spark, sf), ["flag_txt"])[1].select("flow_key", "flag_txt"))

query("flt7_fill_zero", with_li("""
SELECT flow_key, round(coalesce(qty, 0), 6) AS qty, flag_txt FROM gaps""", std=False, extra=[GAPS]))(
    lambda spark, sf: rounded(cl.fill_zero(gaps(spark, sf)).select("flow_key", "qty", "flag_txt")))

# FLT-8: first-fraction mask ----------------------------------------------------------------------------------------
query("flt8_prefix_mask", with_li("""
SELECT (row_number() OVER (ORDER BY flow_key) - 1) < floor(count(*) OVER () * 0.9::DOUBLE) AS in_prefix, flow_key FROM std"""))(
    lambda spark, sf: cl.prefix_mask(std_li(spark, sf, number=False), 0.9, ["flow_key"]).select("in_prefix", "flow_key"))
