"""Checked queries: similarity joins, graphs, perturbations, propagation, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import functions as fn
from ..operators import encode as enc
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import knn
from ..operators import propagate as pg
from .q_flows import std_li
from .registry import query, rounded
from .sqltext import with_fx, with_li

EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
DIM = 64  # elements of a vector; all of them are used


def emb(spark, sf):
    return fx.embeddings(spark, sf)


def emb_nodes(spark, sf):
    """Nodes of the similarity graph: id, features, label."""
    return emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))


def sql_elems(agg: str, vec: str, d: int = DIM) -> str:
    """SQL list of ``agg`` over each element of a vector."""
    return "[" + ", ".join(f"{agg}({vec}[{i}])" for i in range(1, d + 1)) + "]"


def explode_vec(df, id_cols, vec="x", digits=6):
    return rounded(df.select(*id_cols, F.posexplode(vec).alias("pos", "val")), digits)


def sql_explode(src: str, ids: str, vec: str, d: int, digits: int = 6) -> str:
    return (f"SELECT {ids}, CAST(p - 1 AS INTEGER) AS pos, round({vec}[p], {digits}) AS val "
            f"FROM {src}, range(1, {d + 1}) t(p)")


def sql_matvec(vec: str, m: list[list[float]]) -> str:
    """SQL list literal of vec·M (1-based element access)."""
    cols = []
    for j in range(len(m[0])):
        terms = " + ".join(f"{vec}[{i + 1}] * CAST({m[i][j]!r} AS DOUBLE)" for i in range(len(m)))
        cols.append(f"({terms})")
    return "[" + ", ".join(cols) + "]"


def knn_sql(k: int, vec: str = "e", eps: float | None = None) -> str:
    cond = f" WHERE rnk <= {k}" + (f" AND dist < {eps!r}" if eps is not None else "")
    return f"""kn AS (SELECT * FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.{vec}, b.{vec}) AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.{vec}, b.{vec}), b.vec_id) AS rnk
  FROM emb a JOIN emb b ON a.vec_id <> b.vec_id){cond})"""


# JN-7 ------------------------------------------------------------------------
query("jn7_knn_join", with_fx("SELECT src, dst, round(dist, 6) AS dist, CAST(rnk AS INTEGER) AS rank FROM kn", [],
                              [EMB, knn_sql(5)]))(
    lambda spark, sf: rounded(knn.knn_join(emb(spark, sf), "vec_id", "embedding", 5)
                              .withColumn("rank", F.col("rank").cast("int"))))

# JN-7 / JN-8 / JN-9 over pivot cells and rings: products by size and price ---------------------------------------
PARTS = "emb AS (SELECT p_partkey AS vec_id, [CAST(p_size AS DOUBLE), p_retailprice] AS e FROM part)"
PART_EPS = 5.0


def part_vectors(spark, sf):
    from ..session import read_table
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"))


query("jn7_knn_pruned", with_fx("SELECT src, dst, round(dist, 6) AS dist, CAST(rnk AS INTEGER) AS rank FROM kn", [], [PARTS, knn_sql(5)]))(
    lambda spark, sf: rounded(knn.knn_join(part_vectors(spark, sf), "vec_id", "v", 5, pruned=True, unit_rows=256)
                              .withColumn("rank", F.col("rank").cast("int"))))
query("jn8_radius_pruned", with_fx(f"""
SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.e, b.e), 6) AS dist
FROM emb a JOIN emb b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) < {PART_EPS!r}""", [], [PARTS]))(
    lambda spark, sf: rounded(knn.radius_join(part_vectors(spark, sf), "vec_id", "v", PART_EPS, pruned=True, unit_rows=256), many=True))
query("gr8_adaptive_pruned", with_fx("SELECT src, dst, round(dist, 6) AS dist FROM kn", [], [PARTS, knn_sql(20, eps=PART_EPS)]))(
    lambda spark, sf: rounded(knn.adaptive_join(part_vectors(spark, sf), "vec_id", "v", 20, PART_EPS, pruned=True).select("src", "dst", "dist")))

# GR-7: directed kNN graph, k = 20 -------------------------------------------------
query("gr7_knn_graph_k20", with_fx("SELECT src, dst FROM kn", [], [EMB, knn_sql(20)]))(
    lambda spark, sf: knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 20))

# GR-6: symmetric kNN graph, k = 10 --------------------------------------------------
query("gr6_knn_graph_symmetric", with_fx("SELECT src, dst FROM kn UNION SELECT dst, src FROM kn", [],
                                         [EMB, knn_sql(10)]))(
    lambda spark, sf: knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 10, symmetric=True))

# JN-8: radius join ------------------------------------------------------------------
EPS = 1.19
query("jn8_radius_join", with_fx(f"""
SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.e, b.e), 6) AS dist
FROM emb a JOIN emb b ON a.vec_id <> b.vec_id WHERE list_distance(a.e, b.e) < {EPS!r}""", [], [EMB]))(
    lambda spark, sf: rounded(knn.radius_join(emb(spark, sf), "vec_id", "embedding", EPS)))

# JN-9 / GR-8: adaptive graph (kNN ∩ threshold) ----------------------------------------
query("gr8_adaptive_graph", with_fx("SELECT src, dst, round(dist, 6) AS dist FROM kn", [],
                                    [EMB, knn_sql(20, eps=1.2)]))(
    lambda spark, sf: rounded(knn.adaptive_join(emb(spark, sf), "vec_id", "embedding", 20, 1.2).select("src", "dst", "dist")))

# FN-16 / FN-26 / FN-17: vector functions ------------------------------------------------
def _vecfns(spark, sf):
    e = emb(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    j = e.join(nxt, "vec_id")
    return rounded(j.select(
        "vec_id",
        fn.cosine("embedding", "e2").alias("cos"),
        fn.euclidean("embedding", "e2").alias("l2"),
        fn.l2_norm(fn.l2_normalize(F.col("embedding"))).alias("unit_norm"),
        fn.argmax(F.col("embedding")).alias("argmax"),
        fn.sigmoid(F.col("embedding")[0]).alias("sig0"),
        F.element_at(fn.softmax(F.col("embedding")), 1).alias("softmax0"),
        fn.clamp(F.col("embedding")[1] * 10, -0.5, 0.5).alias("clamp1")))


query("fn16_vector_functions", with_fx("""
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cos, round(list_distance(a.e, b.e), 6) AS l2,
       round(sqrt(list_sum(list_transform(a.e, lambda x: (x / sqrt(list_sum(list_transform(a.e, lambda y: y * y)))) ^ 2))), 6) AS unit_norm,
       CAST(list_position(a.e, list_max(a.e)) - 1 AS INTEGER) AS argmax,
       round(1 / (1 + exp(-a.e[1])), 6) AS sig0,
       round(exp(a.e[1] - list_max(a.e)) / list_sum(list_transform(a.e, lambda x: exp(x - list_max(a.e)))), 6) AS softmax0,
       round(least(greatest(a.e[2] * 10, -0.5), 0.5), 6) AS clamp1
FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""", [], [EMB]))(_vecfns)

# AGG-16: mean vector per label ---------------------------------------------------------------
query("agg16_mean_vector", with_fx(sql_explode(
    f"(SELECT label, {sql_elems('avg', 'e')} AS m FROM emb GROUP BY label)", "label", "m", DIM),
    [], [EMB]))(
    lambda spark, sf: explode_vec(__import__("flowlens.operators.aggregate", fromlist=["mean_vector"]).mean_vector(
        emb_nodes(spark, sf).withColumnRenamed("y", "label"), "x", DIM, by=["label"]), ["label"]))

# GR-25: label-contrastive loss (closed form) ------------------------------------------------------
query("gr25_contrastive_loss", with_fx("""
, z AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS z FROM emb)
SELECT round(avg(1 - list_dot_product(a.z, b.z)), 6) AS pos_loss, 0.0::DOUBLE AS neg_loss,
       round(avg(1 - list_dot_product(a.z, b.z)), 6) AS loss
FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id""".replace("\n, z AS", ", z AS", 1), [], [EMB]))(
    lambda spark, sf: rounded(pg.contrastive_loss(emb(spark, sf), "embedding", "label", 64)))


# GR-20 / GR-21 / GR-22 / GR-23 on the k=10 kNN graph ---------------------------
def sim_graph(spark, sf):
    """The k=10 kNN graph: its edges feed several joins of every hop, so the
    (expensive) kNN result is materialized once instead of being recomputed
    per use."""
    from ..session import cut_lineage
    nodes = emb_nodes(spark, sf)
    edges = cut_lineage(knn.knn_graph(emb(spark, sf), "vec_id", "embedding", 10))
    return nodes, edges


SIM = [EMB, knn_sql(10), "nodes AS (SELECT vec_id AS id, e AS x FROM emb)", "edges AS (SELECT src, dst FROM kn)"]


def _prop_sql(kind: str) -> str:
    if kind == "gcn":
        return f"""
, deg AS (SELECT n.id, 1 + count(e.dst) AS d FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id),
  msg AS (SELECT e.dst, list_transform(n.x, lambda v: v / sqrt(ds.d * dd.d)) AS m
          FROM edges e JOIN nodes n ON n.id = e.src JOIN deg ds ON ds.id = e.src JOIN deg dd ON dd.id = e.dst),
  agg AS (SELECT dst, {sql_elems('sum', 'm')} AS s FROM msg GROUP BY dst),
  out AS (SELECT n.id, list_transform(range(1, {DIM + 1}), lambda i: n.x[i] / deg.d + coalesce(agg.s[i], 0)) AS x
          FROM nodes n JOIN deg ON deg.id = n.id LEFT JOIN agg ON agg.dst = n.id)
""" + sql_explode("out", "id", "x", DIM)
    mean = kind == "sage"
    f = "avg" if mean else "sum"
    combine = "coalesce(agg.s[i], 0)" if mean else "n.x[i] + coalesce(agg.s[i], 0)"
    return f"""
, agg AS (SELECT e.dst, {sql_elems(f, 'n.x')} AS s FROM edges e JOIN nodes n ON n.id = e.src GROUP BY e.dst),
  out AS (SELECT n.id, list_transform(range(1, {DIM + 1}), lambda i: {combine}) AS x FROM nodes n LEFT JOIN agg ON agg.dst = n.id)
""" + sql_explode("out", "id", "x", DIM)


for _kind, _name in (("gcn", "gr20_gcn_propagation"), ("sage", "gr21_sage_propagation"), ("gin", "gr21_gin_propagation")):
    query(_name, with_fx(_prop_sql(_kind).replace("\n, ", ", ", 1), [], SIM))(
        (lambda kind: lambda spark, sf: explode_vec(pg.propagate(*sim_graph(spark, sf), DIM, kind), ["id"]))(_kind))

W_ATT = enc.hash_matrix(DIM, 3, 7, -1.0, 1.0)
A_ATT = [v for v in enc.hash_matrix(1, 6, 8, -1.0, 1.0)[0]]


def _att_sql() -> str:
    a = A_ATT
    zv = " + ".join(f"zv[{i + 1}] * CAST({a[i]!r} AS DOUBLE)" for i in range(3))
    zu = " + ".join(f"zu[{i + 1}] * CAST({a[3 + i]!r} AS DOUBLE)" for i in range(3))
    return f"""
, z AS (SELECT id, {sql_matvec('x', W_ATT)} AS z FROM nodes),
  e2 AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT id, id FROM z),
  j AS (SELECT e2.src, e2.dst, u.z AS zu, v.z AS zv FROM e2 JOIN z u ON u.id = e2.src JOIN z v ON v.id = e2.dst),
  s AS (SELECT *, {zv} + {zu} AS raw FROM j),
  l AS (SELECT *, CASE WHEN raw > 0 THEN raw ELSE raw * 0.2 END AS ee FROM s),
  w AS (SELECT *, exp(ee - max(ee) OVER (PARTITION BY dst)) AS ww FROM l),
  a AS (SELECT *, ww / sum(ww) OVER (PARTITION BY dst) AS alpha FROM w),
  out AS (SELECT dst AS id, [sum(alpha * zu[1]), sum(alpha * zu[2]), sum(alpha * zu[3])] AS x FROM a GROUP BY dst)
""" + sql_explode("out", "id", "x", 3)


query("gr22_attention", with_fx(_att_sql().replace("\n, ", ", ", 1), [], SIM))(
    lambda spark, sf: explode_vec(pg.attend(*sim_graph(spark, sf), W_ATT, A_ATT), ["id"]))

query("gr21_cluster_propagation", with_fx(f"""
, a AS (SELECT e.dst, {sql_elems('sum', 'n.x')} AS s, count(*) AS d FROM edges e JOIN nodes n ON n.id = e.src GROUP BY e.dst),
  out AS (SELECT n.id, list_transform(range(1, {DIM + 1}), lambda i: (n.x[i] + coalesce(a.s[i], 0)) / (coalesce(a.d, 0) + 1)) AS x FROM nodes n LEFT JOIN a ON a.dst = n.id)
{sql_explode("out", "id", "x", DIM)}""".replace("\n, a AS", ", a AS", 1), [], SIM))(
    lambda spark, sf: explode_vec(pg.propagate(*sim_graph(spark, sf), DIM, "cluster"), ["id"]))

query("gr21_arma_propagation", with_fx(f"""
, deg AS (SELECT n.id, count(e.dst) AS d FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id),
  msg AS (SELECT e.dst, list_transform(n.x, lambda v: CASE WHEN ds.d * dd.d > 0 THEN v / sqrt(ds.d * dd.d) ELSE 0 END) AS m
          FROM edges e JOIN nodes n ON n.id = e.src JOIN deg ds ON ds.id = e.src JOIN deg dd ON dd.id = e.dst),
  a AS (SELECT dst, {sql_elems('sum', 'm')} AS s FROM msg GROUP BY dst),
  out AS (SELECT n.id, list_transform(range(1, {DIM + 1}), lambda i: greatest(n.x[i] + coalesce(a.s[i], 0), 0)) AS x FROM nodes n LEFT JOIN a ON a.dst = n.id)
{sql_explode("out", "id", "x", DIM)}""".replace("\n, deg AS", ", deg AS", 1), [], SIM))(
    lambda spark, sf: explode_vec(pg.propagate(*sim_graph(spark, sf), DIM, "arma"), ["id"]))

# GR-22, several heads and the dot-product kind
W_HEADS = [enc.hash_matrix(DIM, 3, s, -1.0, 1.0) for s in (7, 9)]
A_HEADS = [enc.hash_matrix(1, 6, s, -1.0, 1.0)[0] for s in (8, 10)]


def _heads_sql(concat: bool) -> str:
    ctes = []
    for h in (0, 1):
        a = A_HEADS[h]
        e = " + ".join(f"v.z[{i + 1}] * CAST({a[i]!r} AS DOUBLE) + u.z[{i + 1}] * CAST({a[3 + i]!r} AS DOUBLE)" for i in range(3))
        ctes += [f"z{h} AS (SELECT id, {sql_matvec('x', W_HEADS[h])} AS z FROM nodes)",
                 f"s{h} AS (SELECT e2.dst, u.z AS zu, {e} AS raw FROM e2 JOIN z{h} u ON u.id = e2.src JOIN z{h} v ON v.id = e2.dst)",
                 f"l{h} AS (SELECT *, CASE WHEN raw > 0 THEN raw ELSE raw * 0.2 END AS ee FROM s{h})",
                 f"w{h} AS (SELECT *, exp(ee - max(ee) OVER (PARTITION BY dst)) AS ww FROM l{h})",
                 f"o{h} AS (SELECT dst AS id, [sum(ww * zu[1]) / sum(ww), sum(ww * zu[2]) / sum(ww), sum(ww * zu[3]) / sum(ww)] AS x FROM w{h} GROUP BY dst)"]
    x = "list_concat(o0.x, o1.x)" if concat else "[(o0.x[1] + o1.x[1]) / 2, (o0.x[2] + o1.x[2]) / 2, (o0.x[3] + o1.x[3]) / 2]"
    return with_fx(sql_explode("out", "id", "x", 6 if concat else 3), [], SIM + [
        "e2 AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT id, id FROM nodes)", *ctes,
        f"out AS (SELECT o0.id, {x} AS x FROM o0 JOIN o1 ON o0.id = o1.id)"])


for _c, _n in ((True, "gr22_attention_heads_concat"), (False, "gr22_attention_heads_mean")):
    query(_n, _heads_sql(_c))((lambda c: lambda spark, sf: explode_vec(pg.attend_heads(*sim_graph(spark, sf), W_HEADS, A_HEADS, c), ["id"]))(_c))

query("gr22_attention_dot", with_fx(f"""
, q AS (SELECT id, {sql_matvec('x', W_HEADS[0])} AS q, {sql_matvec('x', W_HEADS[1])} AS k FROM nodes),
  s AS (SELECT e.dst, u.k AS k, list_dot_product(v.q, u.k) / sqrt(3.0) AS ee FROM edges e JOIN q u ON u.id = e.src JOIN q v ON v.id = e.dst),
  w AS (SELECT *, exp(ee - max(ee) OVER (PARTITION BY dst)) AS ww FROM s),
  o AS (SELECT dst, [sum(ww * k[1]) / sum(ww), sum(ww * k[2]) / sum(ww), sum(ww * k[3]) / sum(ww)] AS x FROM w GROUP BY dst),
  out AS (SELECT n.id, coalesce(o.x, [0.0, 0.0, 0.0]) AS x FROM nodes n LEFT JOIN o ON o.dst = n.id)
{sql_explode("out", "id", "x", 3)}""".replace("\n, q AS", ", q AS", 1), [], SIM))(
    lambda spark, sf: explode_vec(pg.attend_dot(*sim_graph(spark, sf), W_HEADS[0], W_HEADS[1]), ["id"]))

query("gr23_concat_layers", with_fx((_prop_sql("gcn").split("\nSELECT")[0] + f""",
  agg2 AS (SELECT e.dst, {sql_elems('avg', 'n.x')} AS s FROM edges e JOIN nodes n ON n.id = e.src GROUP BY e.dst),
  out2 AS (SELECT n.id, list_transform(range(1, {DIM + 1}), lambda i: coalesce(agg2.s[i], 0)) AS x FROM nodes n LEFT JOIN agg2 ON agg2.dst = n.id),
  cat AS (SELECT out.id, list_concat(out.x, out2.x) AS x FROM out JOIN out2 ON out.id = out2.id)
""" + sql_explode("cat", "id", "x", 2 * DIM)).replace("\n, ", ", ", 1), [], SIM))(
    lambda spark, sf: (lambda g: explode_vec(pg.concat_layers(pg.propagate(*g, DIM, "gcn"), pg.propagate(*g, DIM, "sage")), ["id"]))(sim_graph(spark, sf)))

# GR-9: constant node features -------------------------------------------------------------------
query("gr9_init_nodes", with_li("""
SELECT ip AS id, 4 AS width, 4.0::DOUBLE AS total FROM (SELECT src_ip AS ip FROM std UNION SELECT dst_ip FROM std)"""))(
    lambda spark, sf: gr.init_nodes(std_li(spark, sf, number=False).select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")), 4)
    .select("id", F.size("x").alias("width"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total")))


query("gr15_masked_batches", with_li("""
SELECT flow_key, CAST(floor((row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) - 1) / 500) AS BIGINT) AS batch_id
FROM std WHERE binary_label = 1"""))(
    lambda spark, sf: gr.edge_batches(std_li(spark, sf, number=False), 500, "flow_key", mask=F.col("binary_label") == 1).select("flow_key", "batch_id"))


# GR-5: endpoint index and edge index ----------------------------------------------------------------
def _host_edges(spark, sf):
    return __import__("flowlens.operators.aggregate", fromlist=["edge_features"]).edge_features(std_li(spark, sf, number=False))


HOST_EDGES = "he AS (SELECT src_ip AS src, dst_ip AS dst, count(*) AS weight, CAST(sum(binary_label) AS BIGINT) AS attack_flows FROM std GROUP BY 1, 2)"
query("gr5_index_graph", with_li("""
, nodes AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS idx FROM (SELECT src AS node FROM he UNION SELECT dst FROM he))
SELECT he.src, he.dst, s.idx AS src_idx, d.idx AS dst_idx FROM he JOIN nodes s ON s.node = he.src JOIN nodes d ON d.node = he.dst"""
    .replace("\n, nodes", ", nodes", 1), extra=[HOST_EDGES]))(
    lambda spark, sf: gr.index_graph(_host_edges(spark, sf))[1].select("src", "dst", "src_idx", "dst_idx"))

# GR-10: random edge removal 20 % ---------------------------------------------------------------------
HE_KEY = "src || '>' || dst"
query("gr10_remove_edges", with_li(f"""
SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {HE_KEY}), {HE_KEY}) AS rn FROM he)
WHERE rn > (SELECT floor(count(*) * 0.2::DOUBLE) FROM he)""", extra=[HOST_EDGES]))(
    lambda spark, sf: gr.remove_edges(_host_edges(spark, sf).withColumn("ek", F.concat_ws(">", "src", "dst")), 0.2, "ek")
    .select("src", "dst"))

# GR-13: duplicate 10 % of edges -------------------------------------------------------------------------
query("gr13_duplicate_edges", with_li(f"""
SELECT src, dst FROM he UNION ALL
SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || {HE_KEY}), {HE_KEY}) AS rn FROM he)
WHERE rn <= (SELECT floor(count(*) * 0.1::DOUBLE) FROM he)""", extra=[HOST_EDGES]))(
    lambda spark, sf: gr.duplicate_edges(_host_edges(spark, sf).withColumn("ek", F.concat_ws(">", "src", "dst")), 0.1, "ek")
    .select("src", "dst"))

# GR-15: shuffled edge mini-batches --------------------------------------------------------------------------
query("gr15_edge_batches", with_li("""
SELECT flow_key, CAST(floor((row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) - 1) / 1000) AS BIGINT) AS batch_id FROM std"""))(
    lambda spark, sf: gr.edge_batches(std_li(spark, sf, number=False), 1000, "flow_key").select("flow_key", "batch_id"))


# GR-4: flow multigraph (undirected doubling, ip:port endpoints) ----------------------------------------------
def _flow_graph(spark, sf, directed=True):
    return gr.flow_graph(std_li(spark, sf), ["bytes_in", "bytes_out", "packets_in", "duration_ms"], "ip:port", directed)


query("gr4_flow_graph_undirected", with_li("""
SELECT flow_id AS eid, src_ip || ':' || CAST(src_port AS VARCHAR) AS src, dst_ip || ':' || CAST(dst_port AS VARCHAR) AS dst, binary_label FROM std
UNION ALL
SELECT flow_id, dst_ip || ':' || CAST(dst_port AS VARCHAR), src_ip || ':' || CAST(src_port AS VARCHAR), binary_label FROM std"""))(
    lambda spark, sf: _flow_graph(spark, sf, directed=False).select("eid", "src", "dst", "binary_label"))

# GR-16: feature permutation across edges -----------------------------------------------------------------------
query("gr16_permute_features", with_li("""
, a AS (SELECT flow_id AS eid, row_number() OVER (ORDER BY flow_id) AS i FROM std),
  b AS (SELECT bytes_in, row_number() OVER (ORDER BY md5('42:' || CAST(flow_id AS VARCHAR)), CAST(flow_id AS VARCHAR)) AS i FROM std)
SELECT a.eid, CAST(b.bytes_in AS DOUBLE) AS h0 FROM a JOIN b ON a.i = b.i""".replace("\n, a AS", ", a AS", 1)))(
    lambda spark, sf: gr.permute_features(_flow_graph(spark, sf), "eid").select("eid", F.col("h")[0].alias("h0")))

# EVL on the scored fixture -----------------------------------------------------------------------------------------
SC = "sc AS (SELECT flow_key, y, score, CAST(score > 0.5 AS INTEGER) AS pred FROM scored)"


def scored(spark, sf):
    return fx.scored(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))


query("evl2_binary_metrics", with_fx("""
, t AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, avg(CAST(y = pred AS DOUBLE)) AS acc FROM sc)
SELECT round(acc, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM t""".replace("\n, t AS", ", t AS", 1),
    ["scored"], [SC]))(lambda spark, sf: rounded(ev.binary_metrics(scored(spark, sf))))

query("evl1_confusion_matrix", with_fx("""
, c AS (SELECT DISTINCT y AS c FROM sc UNION SELECT DISTINCT pred FROM sc)
SELECT a.c AS "true", b.c AS pred, CAST(count(sc.y) AS BIGINT) AS count
FROM c a CROSS JOIN c b LEFT JOIN sc ON sc.y = a.c AND sc.pred = b.c GROUP BY a.c, b.c""".replace("\n, c AS", ", c AS", 1),
    ["scored"], [SC]))(lambda spark, sf: ev.confusion_matrix(scored(spark, sf)))

PER_CLASS = """pc AS (
 SELECT c.cls, coalesce(s.support, 0) AS support, coalesce(s.tp, 0) AS tp, coalesce(p.predicted, 0) AS predicted
 FROM (SELECT y AS cls FROM sc UNION SELECT pred FROM sc) c
 LEFT JOIN (SELECT y AS cls, count(*) AS support, count(*) FILTER (WHERE y = pred) AS tp FROM sc GROUP BY y) s ON s.cls = c.cls
 LEFT JOIN (SELECT pred AS cls, count(*) AS predicted FROM sc GROUP BY pred) p ON p.cls = c.cls),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pm)"""

query("evl3_macro_metrics", with_fx("""
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM pf""",
    ["scored"], [SC, PER_CLASS]))(lambda spark, sf: rounded(ev.macro_metrics(scored(spark, sf))))

query("evl4_classification_report", with_fx("""
SELECT CAST(cls AS VARCHAR) AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CAST(y = pred AS DOUBLE)), 6), count(*) FROM sc""",
    ["scored"], [SC, PER_CLASS]))(lambda spark, sf: rounded(ev.classification_report(scored(spark, sf))))

RANKS = """rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc)"""
query("evl5_auc", with_fx("""
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 6) AS auc FROM rk""",
    ["scored"], [SC, RANKS]))(lambda spark, sf: rounded(ev.auc(scored(spark, sf))))

query("evl6_roc_curve", with_fx("""
, g AS (SELECT score AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY score)
SELECT round(s, 6) AS threshold, round(sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER (), 6) AS fpr,
       round(sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER (), 6) AS tpr FROM g""".replace("\n, g AS", ", g AS", 1),
    ["scored"], [SC]))(lambda spark, sf: rounded(ev.roc_curve(scored(spark, sf))))

# EVL-6, several classes: one-vs-rest and micro curves, their areas and the macro mean ---------------------------------
def class_scores(spark, sf):
    """Labelled vectors with one score per class: the sum of every tenth element."""
    return emb(spark, sf).select(F.col("label").alias("y"), F.array(*[
        F.aggregate(F.array(*[F.col("embedding")[i] for i in range(c, DIM, 10)]), F.lit(0.0), lambda a, b: a + b) for c in range(10)]).alias("p"))


OVR = "ovr AS (SELECT CAST(c AS VARCHAR) AS curve, CAST(label = c AS INTEGER) AS hit, s FROM (" + " UNION ALL ".join(
    f"SELECT label, {c} AS c, " + " + ".join(["0.0::DOUBLE"] + [f"e[{i + 1}]" for i in range(c, DIM, 10)]) + " AS s FROM emb" for c in range(10)) + "))"
OVR_ALL = "oa AS (SELECT * FROM ovr UNION ALL SELECT 'micro', hit, s FROM ovr)"
query("evl6_multiclass_curves", with_fx("""
, g AS (SELECT curve, s, sum(hit) AS pos, sum(1 - hit) AS neg FROM oa GROUP BY curve, s)
SELECT curve, round(s, 6) AS threshold, round(sum(neg) OVER (PARTITION BY curve ORDER BY s DESC) / sum(neg) OVER (PARTITION BY curve), 6) AS fpr,
       round(sum(pos) OVER (PARTITION BY curve ORDER BY s DESC) / sum(pos) OVER (PARTITION BY curve), 6) AS tpr FROM g""".replace("\n, g AS", ", g AS", 1),
    [], [EMB, OVR, OVR_ALL]))(lambda spark, sf: rounded(ev.roc_curves(class_scores(spark, sf), "y", "p", 10)))
query("evl6_macro_curve", with_fx("""
, g AS (SELECT curve, s, sum(hit) AS pos, sum(1 - hit) AS neg FROM ovr GROUP BY curve, s),
  c AS (SELECT curve, sum(neg) OVER (PARTITION BY curve ORDER BY s DESC) / sum(neg) OVER (PARTITION BY curve) AS fpr,
               sum(pos) OVER (PARTITION BY curve ORDER BY s DESC) / sum(pos) OVER (PARTITION BY curve) AS tpr FROM g),
  k AS (SELECT curve, fpr, min(tpr) AS lo, max(tpr) AS hi FROM (SELECT * FROM c UNION ALL SELECT DISTINCT curve, 0.0, 0.0 FROM c) GROUP BY curve, fpr),
  t AS (SELECT n.curve, x.fpr, k.lo, k.hi, CASE WHEN k.hi IS NOT NULL THEN x.fpr END AS px
        FROM (SELECT DISTINCT fpr FROM k) x CROSS JOIN (SELECT DISTINCT curve FROM k) n LEFT JOIN k ON k.curve = n.curve AND k.fpr = x.fpr),
  f AS (SELECT curve, fpr, hi, last_value(px IGNORE NULLS) OVER u AS x0, last_value(hi IGNORE NULLS) OVER u AS y0,
               first_value(px IGNORE NULLS) OVER d AS x1, first_value(lo IGNORE NULLS) OVER d AS y1 FROM t
        WINDOW u AS (PARTITION BY curve ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               d AS (PARTITION BY curve ORDER BY fpr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT round(fpr, 6) AS fpr, round(avg(CASE WHEN hi IS NOT NULL THEN hi ELSE y0 + (fpr - x0) / (x1 - x0) * (y1 - y0) END), 6) AS tpr FROM f GROUP BY fpr"""
    .replace("\n, g AS", ", g AS", 1), [], [EMB, OVR]))(lambda spark, sf: rounded(ev.macro_curve(class_scores(spark, sf), "y", "p", 10)))
query("evl6_multiclass_areas", with_fx("""
, r AS (SELECT curve, hit, rank() OVER (PARTITION BY curve ORDER BY s) + (count(*) OVER (PARTITION BY curve, s) - 1) / 2.0 AS r FROM oa),
  a AS (SELECT curve, (sum(r) FILTER (WHERE hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit)) AS auc FROM r GROUP BY curve)
SELECT curve, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a WHERE curve <> 'micro'""".replace("\n, r AS", ", r AS", 1),
    [], [EMB, OVR, OVR_ALL]))(lambda spark, sf: rounded(ev.roc_areas(class_scores(spark, sf), "y", "p", 10)))

query("evl7_batch_accuracy", with_fx("""
SELECT CAST(floor((row_number() OVER (ORDER BY md5('42:' || flow_key), flow_key) - 1) / 5000) AS BIGINT) AS batch_id,
       y, pred FROM sc""".join(["SELECT batch_id, round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM (", ") GROUP BY batch_id"]),
    ["scored"], [SC]))(
    lambda spark, sf: rounded(gr.edge_batches(scored(spark, sf), 5000, "flow_key").groupBy("batch_id").agg(
        F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))))


def _per_class_recall(spark, sf):
    j = std_li(spark, sf, number=False).select("flow_key", "attack_type").join(scored(spark, sf), "flow_key")
    return rounded(ev.per_class_recall(j))


query("evl8_per_class_recall", with_li("""
, sc AS (SELECT flow_key, CAST(score > 0.5 AS INTEGER) AS pred FROM scored)
SELECT attack_type, count(*) AS n, round(avg(CAST(pred = 1 AS DOUBLE)), 6) AS detection_rate
FROM std JOIN sc USING (flow_key) GROUP BY attack_type""".replace("\n, sc AS", ", sc AS", 1), extra=[f"scored AS ({fx.duck('scored')})"]))(
    _per_class_recall)


# GR-25 with margin 0.2: the negative term summed over block tiles ---------------------------------------------
query("gr25_contrastive_loss_margin", with_fx("""
, z AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS z FROM emb),
  pos AS (SELECT avg(1 - list_dot_product(a.z, b.z)) AS pos_loss FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id),
  neg AS (SELECT avg(greatest(list_dot_product(a.z, b.z) - 0.2, 0)) AS neg_loss FROM z a JOIN z b ON a.label <> b.label)
SELECT round(pos_loss, 6) AS pos_loss, round(neg_loss, 6) AS neg_loss, round(pos_loss + neg_loss, 6) AS loss FROM pos, neg"""
    .replace("\n, z AS", ", z AS", 1), [], [EMB]))(
    lambda spark, sf: rounded(pg.contrastive_loss(emb(spark, sf), "embedding", "label", 64, margin=0.2, id_col="vec_id")))

query("gr25_contrastive_loss_over_all", with_fx("""
, z AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS z FROM emb),
  t AS (SELECT sum(CASE WHEN a.label = b.label THEN 1 - list_dot_product(a.z, b.z) ELSE 0 END) / count(*) AS pos_loss,
               sum(CASE WHEN a.label <> b.label THEN greatest(list_dot_product(a.z, b.z) - 0.2, 0) ELSE 0 END) / count(*) AS neg_loss FROM z a, z b)
SELECT round(pos_loss, 6) AS pos_loss, round(neg_loss, 6) AS neg_loss, round(pos_loss + neg_loss, 6) AS loss FROM t"""
    .replace("\n, z AS", ", z AS", 1), [], [EMB]))(
    lambda spark, sf: rounded(pg.contrastive_loss(emb(spark, sf), "embedding", "label", DIM, margin=0.2, id_col="vec_id", over_all=True)))
