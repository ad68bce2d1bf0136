"""Message passing on node/edge DataFrames (GR-17..25).

Vectors are fixed-width ``array<double>`` columns; weight matrices are small
literal arrays (broadcast as constants in the expression).  A neighbourhood
aggregate is a ``groupBy(dst)`` with one partial sum per vector element, so a
hub node is pre-aggregated in every task (no per-node array collection).
Nodes without in-edges receive zeros (the ``update_all`` convention).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .encode import _attach_one_row, matvec


def _vec_sum_by(df: DataFrame, key: str, vec: str, d: int, weight: Column | None = None, out: str = "agg",
                mean: bool = False) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    aggs = [F.sum(F.col(vec)[i] * w).alias(f"_s{i}") for i in range(d)] + [F.count(F.lit(1)).alias("_deg")]
    g = df.groupBy(key).agg(*aggs)
    if mean:
        arr = F.array(*[F.col(f"_s{i}") / F.col("_deg") for i in range(d)])
    else:
        arr = F.array(*[F.col(f"_s{i}") for i in range(d)])
    return g.select(key, arr.alias(out), F.col("_deg"))


# JN-2 --------------------------------------------------------------------------
def gather_endpoints(edges: DataFrame, nodes: DataFrame, src: dict[str, str] | None = None, dst: dict[str, str] | None = None,
                     id_col: str = "id", hub_edges: int | None = None) -> DataFrame:
    """Edges with node columns of their source (``src``: node column -> name) and of their target (``dst``).

    Edges whose end is not a node are left out.  Nothing is broadcast by hint;
    AQE splits a skewed side of the join.  With ``hub_edges`` the split is
    explicit: a node with more edges than that on a side is copied, once for
    each such number, and its edges are dealt to the copies by hash (hubs are
    at most edges / hub_edges rows)."""
    out = edges
    for end, wanted in (("src", src), ("dst", dst)):
        if not wanted:
            continue
        side = nodes.select(F.col(id_col).alias("_end"), *[F.col(c).alias(n) for c, n in wanted.items()])
        if hub_edges is None:
            out = out.join(side, out[end] == side["_end"]).drop("_end")
            continue
        hubs = out.groupBy(F.col(end).alias("_hub")).agg(F.ceil(F.count(F.lit(1)) / F.lit(hub_edges)).cast("int").alias("_copies")).filter("_copies > 1")
        salted = out.join(hubs, out[end] == hubs["_hub"], "left").drop("_hub") \
            .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in edges.columns]), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
        copies = side.join(hubs, side["_end"] == hubs["_hub"], "left").withColumn(
            "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_hub", "_copies")
        out = salted.join(copies, (salted[end] == copies["_end"]) & (salted["_salt"] == copies["_copy"])).drop("_end", "_salt", "_copy")
    return out


# JN-3 --------------------------------------------------------------------------
def zip_on_key(a: DataFrame, b: DataFrame, key: str = "id", vec: str = "x", check: bool = False) -> DataFrame:
    """Vectors of two tables side by side, matched by a key that both have once for each row.

    ``check`` counts: it raises unless the tables have the same keys, each once."""
    out = a.select(key, vec).join(b.select(key, F.col(vec).alias("_x2")), key).select(key, F.concat(vec, "_x2").alias(vec))
    if check:
        n = a.select(F.lit(0).alias("t"), key).unionByName(b.select(F.lit(1).alias("t"), key)).groupBy(key).agg(
            F.count_if(F.col("t") == 0).alias("l"), F.count_if(F.col("t") == 1).alias("r")).agg(F.count_if((F.col("l") != 1) | (F.col("r") != 1)).alias("bad")).first()["bad"]
        if n:
            raise ValueError(f"{n} keys are not in both tables exactly once")
    return out


def _zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


def relu(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.greatest(x, F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


# GR-20 / GR-21 ---------------------------------------------------------------
def propagate(nodes: DataFrame, edges: DataFrame, d: int, kind: str = "gcn", hops: int = 1,
              eps: float = 0.0, id_col: str = "id", x: str = "x") -> DataFrame:
    """One or more propagation hops (fixed weights = identity):

    * ``gcn``: Â = D^-1/2 (A+I) D^-1/2, degree = in-degree + 1;
    * ``sage``: mean of in-neighbours (zeros when none);
    * ``gin``: (1+eps)·h + sum of in-neighbours;
    * ``cluster``: mean over a node and its in-neighbours, D^-1 (A+I);
    * ``arma``: relu(D^-1/2 A D^-1/2 · h + h_0) with the in-degree (0 gives weight 0) and the features h_0 at the start.
    """
    if kind not in ("gcn", "sage", "gin", "cluster", "arma"):
        raise ValueError(kind)
    cur = nodes.select(F.col(id_col).alias("id"), F.col(x).alias("x"))
    e = edges.select("src", "dst")
    for _ in range(hops):
        if kind in ("gcn", "arma"):
            deg = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_in"))
            nd = cur.join(deg, "id", "left").withColumn("_d", F.coalesce("_in", F.lit(0)) + (1 if kind == "gcn" else 0)).drop("_in")
            msg = gather_endpoints(e, nd, {"x": "_xs", "_d": "_ds"}, {"_d": "_dd"})
            w = F.when(F.col("_ds") * F.col("_dd") > 0, F.lit(1.0) / F.sqrt(F.col("_ds") * F.col("_dd"))).otherwise(F.lit(0.0))
            agg = _vec_sum_by(msg, "dst", "_xs", d, w)
            if kind == "arma":
                x0 = nodes.select(F.col(id_col).alias("id"), F.col(x).alias("_x0"))
                cur = x0.join(agg.withColumnRenamed("dst", "id"), "id", "left") \
                        .select("id", relu(add(F.col("_x0"), F.coalesce(F.col("agg"), _zeros(d)))).alias("x"))
                continue
            self_term = scale(F.col("x"), F.lit(1.0) / F.col("_d"))
            cur = nd.join(agg.withColumnRenamed("dst", "id"), "id", "left") \
                    .select("id", add(self_term, F.coalesce(F.col("agg"), _zeros(d))).alias("x"))
        else:
            msg = gather_endpoints(e, cur, {"x": "_xs"})
            agg = _vec_sum_by(msg, "dst", "_xs", d, mean=(kind == "sage")).withColumnRenamed("dst", "id")
            j = cur.join(agg, "id", "left")
            nb = F.coalesce(F.col("agg"), _zeros(d))
            if kind == "sage":
                cur = j.select("id", nb.alias("x"))
            elif kind == "gin":
                cur = j.select("id", add(scale(F.col("x"), F.lit(1.0 + eps)), nb).alias("x"))
            else:
                both = scale(add(F.col("x"), nb), F.lit(1.0) / (F.coalesce("_deg", F.lit(0)) + 1))
                cur = j.select("id", both.alias("x"))
    return cur


# GR-17 -------------------------------------------------------------------------
def sage_edge_layer(nodes: DataFrame, edges: DataFrame, wm: list[list[float]], wa: list[list[float]],
                    d_msg: int) -> DataFrame:
    """Edge-aware SAGE layer: message W_m·[h_src ‖ e], mean over in-edges,
    h' = relu(W_a·[h ‖ m̄]).  Weights as (d_in x d_out) lists."""
    msg = gather_endpoints(edges, nodes, {"x": "_xs"}).select("dst", matvec(F.concat("_xs", "h"), wm).alias("_m"))
    agg = _vec_sum_by(msg, "dst", "_m", d_msg, mean=True).withColumnRenamed("dst", "id")
    j = nodes.join(agg, "id", "left")
    return j.select("id", relu(matvec(F.concat(F.col("x"), F.coalesce(F.col("agg"), _zeros(d_msg))), wa)).alias("x"))


# GR-18 -------------------------------------------------------------------------
def anomal_layer(nodes: DataFrame, edges: DataFrame, wa: list[list[float]], d_edge: int) -> DataFrame:
    """Edge-only SAGE layer: h' = relu(W_a·[h ‖ mean of in-edge features])."""
    agg = _vec_sum_by(edges, "dst", "h", d_edge, mean=True).withColumnRenamed("dst", "id")
    j = nodes.join(agg, "id", "left")
    return j.select("id", relu(matvec(F.concat(F.col("x"), F.coalesce(F.col("agg"), _zeros(d_edge))), wa)).alias("x"))


# GR-19 -------------------------------------------------------------------------
def score_edges(edges: DataFrame, nodes: DataFrame, w: list[list[float]], keep: list[str] = ()) -> DataFrame:
    """Edge head W·[h_u ‖ h_v] (also the edge embedding of GR-18)."""
    j = gather_endpoints(edges, nodes, {"x": "_xu"}, {"x": "_xv"})
    return j.select("src", "dst", *keep, matvec(F.concat("_xu", "_xv"), w).alias("score"))


# GR-22 -------------------------------------------------------------------------
def attend(nodes: DataFrame, edges: DataFrame, w: list[list[float]], a: list[float], slope: float = 0.2,
           self_loops: bool = True) -> DataFrame:
    """Single-head graph attention: z = h·W; e_uv = LeakyReLU(a·[z_v ‖ z_u])
    over in-edges u->v (plus self loop); α = softmax_v(e); h'_v = Σ α z_u.
    Softmax is stabilised with the per-node max (two grouped passes)."""
    d_out = len(w[0])
    z = nodes.select("id", matvec(F.col("x"), w).alias("z"))
    e = edges.select("src", "dst")
    if self_loops:
        e = e.filter(F.col("src") != F.col("dst")).unionByName(z.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    j = gather_endpoints(e, z, {"z": "zu"}, {"z": "zv"})
    av = F.array(*[F.lit(float(v)) for v in a])
    raw = fn.dot(F.concat("zv", "zu"), av)
    j = j.withColumn("_e", F.when(raw > 0, raw).otherwise(raw * slope))
    mx = j.groupBy("dst").agg(F.max("_e").alias("_mx"))
    j = j.join(mx, "dst").withColumn("_w", F.exp(F.col("_e") - F.col("_mx")))
    den = j.groupBy("dst").agg(F.sum("_w").alias("_den"))
    j = j.join(den, "dst").withColumn("_alpha", F.col("_w") / F.col("_den"))
    out = _vec_sum_by(j, "dst", "zu", d_out, F.col("_alpha")).select(F.col("dst").alias("id"), F.col("agg").alias("x"))
    return z.select("id").join(out, "id", "left").select("id", F.coalesce("x", _zeros(d_out)).alias("x"))


def attend_heads(nodes: DataFrame, edges: DataFrame, ws: list[list[list[float]]], vs: list[list[float]], concat: bool = True,
                 slope: float = 0.2) -> DataFrame:
    """Several heads of ``attend``, side by side (``concat``) or averaged."""
    out = None
    for w, a in zip(ws, vs):
        h = attend(nodes, edges, w, a, slope)
        out = h if out is None else concat_layers(out, h)
    if concat:
        return out
    k, d = len(ws), len(ws[0][0])
    mean = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                       lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, h: s + F.get("x", h * d + i)) / k)
    return out.select("id", mean.alias("x"))


def attend_dot(nodes: DataFrame, edges: DataFrame, wq: list[list[float]] | None = None, wk: list[list[float]] | None = None,
               d: int | None = None) -> DataFrame:
    """Dot-product attention over in-edges without self loops: softmax of (q_v · k_u) / sqrt(d), summing k_u; nodes without
    in-edges receive zeros.  Without weights queries and keys are the features themselves (of width ``d``, or as the first row has)."""
    d = len(wk[0]) if wk else d or len(nodes.first()["x"])
    project = lambda w: matvec(F.col("x"), w) if w else F.col("x")
    both = nodes.select("id", project(wq).alias("q"), project(wk).alias("k"))
    j = gather_endpoints(edges.select("src", "dst"), both, {"k": "k"}, {"q": "q"}).withColumn("_e", fn.dot("q", "k") / F.sqrt(F.lit(float(d))))
    j = j.join(j.groupBy("dst").agg(F.max("_e").alias("_mx")), "dst").withColumn("_w", F.exp(F.col("_e") - F.col("_mx")))
    den = j.groupBy("dst").agg(F.sum("_w").alias("_den"))
    out = _vec_sum_by(j.join(den, "dst"), "dst", "k", d, F.col("_w") / F.col("_den")).select(F.col("dst").alias("id"), F.col("agg").alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", _zeros(d)).alias("x"))


def attention_weights(nodes: DataFrame, edges: DataFrame, w, a, slope: float = 0.2) -> DataFrame:
    """The α of ``attend`` per edge (softmax weights sum to 1 per node)."""
    z = nodes.select("id", matvec(F.col("x"), w).alias("z"))
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst")) \
             .unionByName(z.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    j = gather_endpoints(e, z, {"z": "zu"}, {"z": "zv"})
    raw = fn.dot(F.concat("zv", "zu"), F.array(*[F.lit(float(v)) for v in a]))
    j = j.withColumn("_e", F.when(raw > 0, raw).otherwise(raw * slope))
    mx = j.groupBy("dst").agg(F.max("_e").alias("_mx"))
    j = j.join(mx, "dst").withColumn("_w", F.exp(F.col("_e") - F.col("_mx")))
    den = j.groupBy("dst").agg(F.sum("_w").alias("_den"))
    return j.join(den, "dst").select("src", "dst", (F.col("_w") / F.col("_den")).alias("alpha"))


# GR-23 -------------------------------------------------------------------------
def concat_layers(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return zip_on_key(a, b, id_col)


# GR-24 -------------------------------------------------------------------------
def infomax_loss(pos: DataFrame, neg: DataFrame, w: list[list[float]], d: int) -> DataFrame:
    """summary s = sigmoid(mean(pos embeddings)); score = x·(W s);
    loss = BCE(pos, 1) + BCE(neg, 0), means over rows."""
    s = pos.agg(F.array(*[fn.sigmoid(F.avg(F.col("x")[i])) for i in range(d)]).alias("_s"))
    ws = s.select(matvec(F.col("_s"), [list(r) for r in zip(*w)]).alias("_ws"))

    def scores(df, label):
        j = _attach_one_row(df.select("x"), ws)
        sc = fn.dot(F.col("x"), F.col("_ws"))
        return j.select(F.lit(label).alias("y"), sc.alias("score"))

    both = scores(pos, 1).unionByName(scores(neg, 0))
    # numerically stable BCE with logits
    bce = F.greatest(F.col("score"), F.lit(0.0)) - F.col("score") * F.col("y") + F.log1p(F.exp(-F.abs(F.col("score"))))
    return both.groupBy("y").agg(F.avg(bce).alias("_l")).agg(F.sum("_l").alias("loss"))


# GR-25 -------------------------------------------------------------------------
def contrastive_loss(df: DataFrame, vec: str, label: str, d: int, margin: float = 1.0,
                     include_self: bool = False, id_col: str | None = None, over_all: bool = False) -> DataFrame:
    """Label-contrastive loss on L2-normalised vectors, closed form in O(n·d):
    positive term = mean over same-label pairs of (1 - cos)
                  = Σ_c (n_c² - ‖S_c‖²) / Σ_c n_c(n_c-1)   (self pairs excluded)
    negative term = mean(relu(cos - margin)) over other pairs, exactly 0 for
    margin >= 1 (|cos| <= 1); below that it is summed tile by tile over
    hashed blocks (``knn.negative_pair_term``, needs ``id_col``).
    ``over_all``: both terms are sums divided by all n² ordered pairs, the diagonal included."""
    z = df.select(F.col(label).alias("y"), fn.l2_normalize(F.col(vec)).alias("z"))
    per = z.groupBy("y").agg(F.count(F.lit(1)).alias("n_c"), *[F.sum(F.col("z")[i]).alias(f"_s{i}") for i in range(d)])
    sq = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(d)), F.lit(0.0))
    per = per.select("n_c", sq.alias("_sq"))
    if over_all:
        num, den = F.sum(F.col("n_c") * F.col("n_c") - F.col("_sq")), F.sum("n_c") * F.sum("n_c")
    elif include_self:
        num = F.sum(F.col("n_c") * F.col("n_c") - F.col("_sq"))
        den = F.sum(F.col("n_c") * F.col("n_c"))
    else:
        num = F.sum(F.col("n_c") * F.col("n_c") - F.col("_sq"))
        den = F.sum(F.col("n_c") * (F.col("n_c") - 1))
    out = per.agg((num / den).alias("pos_loss"))
    if margin >= 1.0:
        return out.withColumn("neg_loss", F.lit(0.0)).withColumn("loss", F.col("pos_loss"))
    from .knn import negative_pair_term
    neg = negative_pair_term(df, id_col, vec, label, margin, over_all=over_all)
    return _attach_one_row(out, neg).withColumn("loss", F.col("pos_loss") + F.col("neg_loss"))
