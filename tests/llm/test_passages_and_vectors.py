"""Centroid clustering, hard negatives and duplicate passages against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import LLM_QUERIES
from flowlens.llm.centroid_clustering import Tables, centroid_clusters, digest
from flowlens.llm.hard_negatives import Summary, hard_negatives, open_pairs
from flowlens.llm.substring_dedup import chosen, pieces_of, rolling, substring_dedup, words_of

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# Centroid clustering -------------------------------------------------------------------------------------------------

def brute_clusters(rows, k, rounds, dims, scale=256.0, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [q for _, q in order[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents)) for _, q in kept]
        if step < rounds:
            for j in range(len(cents)):
                own = [q for (_, q), (_, c) in zip(kept, found) if c == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own)]
    per = {}
    for d, c in found if kept else []:
        per[c] = per.get(c, 0) + d
    return sorted((i is None, i or 0, c, d, per[c], sum(per.values()), digest(cents[c])) for (i, _), (d, c) in zip(kept, found if kept else []))


def vector_rows():
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # a third of all are copies: one large cluster
    return rows + [(5, rows[5][1]), (5, [0.5] * 4), (None, [1.0, -1.0, 0.0, 0.0]), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [NAN, 0.0, 0.0, 0.0]),
                   (303, [INF, 0.0, 0.0, 0.0]), (304, [1.0] * 3), (305, []), (306, [0.0] * 4), (307, [9000.0, -9000.0, 3.0, 0.0])]


def test_centroid_clustering_against_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, uid string").repartition(5)
    found, cents = centroid_clusters(df, k=6, rounds=4, dims=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4], digest(cents[r[1]])) for r in found.collect())
    assert got == brute_clusters(rows, 6, 4, 4)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.25])]])
def test_centroid_clustering_of_few_vectors(spark, rows):
    found, cents = centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, rounds=2, dims=2)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4], digest(cents[r[1]])) for r in found.collect()) == brute_clusters(rows, 5, 2, 2)


def test_lookup_tables_grow_and_spread():
    rng = np.random.default_rng(1)
    cents = rng.integers(-500, 500, (7, 3))
    tables = Tables(cents)
    for low, high in ((-10, 10), (-300, 200), (-100_000, 100_000), (0, 5)):
        q = rng.integers(low, high, (200, 3)).astype(np.int32)
        full = ((q[:, None, :].astype(np.int64) - cents) ** 2).sum(axis=2)
        best, distance = tables.nearest(q)
        assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_a_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2)[0].collect()


# Hard negatives ------------------------------------------------------------------------------------------------------

def brute_negatives(rows, positives, negatives, band, modulus, scale=256.0):
    ok = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows if y is not None and v is not None and len(v)
          and all(x is not None and math.isfinite(x) for x in v)]
    big = 1 << 63
    out = []
    for n, (i, y, q) in enumerate(ok):
        if i is None or i % modulus:
            continue
        others = [(-sum(a * b for a, b in zip(q, p)), big if j is None else j, z == y) for m, (j, z, p) in enumerate(ok) if m != n and len(p) == len(q)]
        for s, j, _ in sorted(o for o in others if o[2])[:positives]:
            inside = [o for o in others if not o[2] and band[0] * -s <= 100 * -o[0] <= band[1] * -s]
            out += [(i, None if j == big else j, r + 1, None if t == big else t, -s, -u) for r, (u, t, _) in enumerate(sorted(inside)[:negatives])]
    return sorted(out, key=str)


def labelled_rows(dims, n=150):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(6, dims))
    rows = [(i, (base[i % 6] + rng.normal(size=dims) * 0.7).round(2).tolist(), 1 if i % 3 == 0 else int(i % 4)) for i in range(n)]
    rows += [(500 + i, rows[0][1], 1) for i in range(20)] + [(600 + i, rows[0][1], 2) for i in range(20)]  # ties by the dozen
    return rows + [(10, rows[10][1], 3), (10, rows[10][1], 3), (None, rows[1][1], 2), (None, rows[2][1], 1), (20, None, 1), (30, rows[3][1], None), (40, [NAN] * dims, 1),
                   (50, [None] * dims, 2), (60, rows[4][1][:-1], 1), (70, [], 1), (80, [0.0] * dims, 2), (90, [0.0] * dims, 1), (91, [-1.0] * dims, 7)]


@pytest.mark.parametrize(("dims", "kw"), [(64, {}), (64, {"anchor_block": 3, "row_slice": 17}), (5, {"row_slice": 20}), (1, {}), (19, {"band": (-20, 100), "positives": 2, "negatives": 7})])
def test_hard_negatives_against_brute_force(spark, dims, kw):
    rows = labelled_rows(dims)
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], "vec_id long, embedding array<double>, label int, anchor int, block int").repartition(4)
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, kw.get("positives", 5), kw.get("negatives", 3), kw.get("band", (50, 95)), 10)
    assert want and sorted((tuple(r) for r in found.collect()), key=str) == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, None, None)]])
def test_hard_negatives_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def test_bounds_close_pairs_but_lose_none():
    """Segment bounds keep every pair inside the band, and on vectors with strong means they close most others."""
    rng = np.random.default_rng(3)
    for dims, spread in ((64, 1.0), (64, 0.05), (10, 1.0)):
        a, b = (np.floor(256 * (rng.normal(size=(n, 1)) + spread * rng.normal(size=(n, dims)))).astype(np.int32) for n in (30, 400))
        score = a.astype(np.int64) @ b.astype(np.int64).T
        low, high = np.quantile(score, 0.97, axis=1).astype(np.int64), np.quantile(score, 0.99, axis=1).astype(np.int64)
        i, j, s = open_pairs(Summary(a), Summary(b), np.ones(score.shape, bool), low, high)
        want = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
        assert sorted(zip(i, j)) == sorted(zip(*want)) and (s == score[i, j]).all()
    for level, (m, d) in enumerate(zip(Summary(a).means, Summary(a).devs)):
        x, y = Summary(a), Summary(b)
        mid, off = x.means[level] @ y.means[level].T, x.devs[level] @ y.devs[level].T
        assert (mid - off <= score + 1e-6 * np.abs(score).max()).all() and (score <= mid + off + 1e-6 * np.abs(score).max()).all()


# Duplicate passages --------------------------------------------------------------------------------------------------

def brute_passages(rows, window=50):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[s:s + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s:s + window])] < i:
                gone[s:s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i is None, i or 0, len(w), int(gone.sum()), kept.decode()))
    return sorted(out)


def result(found):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in found.collect())


def passages(seed=11):
    """Documents with shared passages of 49 to 160 words at changing places, near copies, periodic texts and odd rows."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "naïve space", "x" * 300]
    text = lambda n: [vocabulary[k] for k in rng.integers(0, len(vocabulary), n)]
    shared = [text(n) for n in (49, 50, 51, 60, 120, 160)]
    rows = []
    for i in range(60):
        words = text(int(rng.integers(0, 80)))
        for p in rng.permutation(len(shared))[:int(rng.integers(0, 3))]:
            cut = int(rng.integers(0, max(1, len(shared[p]) - 50)))
            words = words + shared[p][cut:] + text(int(rng.integers(0, 30)))
        rows.append((int(rng.integers(0, 50)) * 3, " ".join(words)))
    hot = text(70)
    rows += [(1000 + i, " ".join([*text(3), *hot, *text(3)])) for i in range(90)]  # one passage in a third of all documents
    base = text(300)
    for i in range(30):  # near copies: a word changed here and there
        other = list(base)
        other[int(rng.integers(0, 300))] = "changed"
        rows.append((2000 - i, "  ".join(other)))
    rows += [(3000, "la " * 400), (3001, "la " * 130), (3002, "la lo " * 90), (2999, "lo la " * 60), (3003, "\t\n ".join(base) + "\r\x0b\x0c"),
             (5, None), (6, ""), (7, "   "), (None, " ".join(base)), (None, None), (8, "one"), (9, " ".join(shared[5])), (9, " ".join(shared[5])), (9, " ".join(shared[5][:70])),
             (1, " ".join(shared[5][100:])), (4000, " ".join(text(20_000) + base))]
    return rows


@pytest.mark.parametrize("kw", [{}, {"block": 7}, {"gram": 3, "block": 2}])
def test_substring_dedup_against_brute_force(spark, kw):
    rows = passages()
    df = spark.createDataFrame([(i, t, 1, "s", 3) for i, t in rows], "doc_id long, text string, lo int, g string, n long").repartition(6)
    found = substring_dedup(df, **kw)
    got = result(found)
    assert got == brute_passages(rows)
    assert sum(r[3] for r in got) > 8000


def test_substring_dedup_spans_name_the_removed_words(spark):
    rows = passages(5)[:80]
    for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(s["end"] - s["start"] >= 50 for s in r["spans"])


def test_substring_dedup_short_windows_on_a_small_alphabet(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(rng.choice(["a", "b"], int(rng.integers(0, 60))))) for i in rng.integers(0, 40, 60)]
    for window, gram in ((4, 2), (9, 3)):
        found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=gram, block=3)
        assert result(found) == brute_passages(rows, window)


def test_substring_dedup_of_nothing(spark, nothing):
    assert substring_dedup(nothing).collect() == []


def test_rolling_hash_and_chosen_places():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 300).astype(np.uint64)
    for n in (1, 2, 7, 8, 50):
        mul = np.uint64(0x9E3779B97F4A7C15)
        want = []
        for s in range(len(x) - n + 1):
            h = 0
            for v in x[s:s + n].tolist():
                h = (h * int(mul) + v) % (1 << 64)
            want.append(h)
        assert rolling(x, n, mul).tolist() == want
        assert chosen(x, n).tolist() == [s + int(np.argmin(x[s:s + n])) for s in range(len(x) - n + 1)]


def test_every_window_lies_in_exactly_one_piece():
    import pyarrow as pa
    texts = [t or "" for _, t in passages(8)]
    word, n = words_of(pa.array(texts))
    p = pieces_of(word, n, 50, 8)
    got = sorted((int(d), int(lo + k)) for d, lo, c in zip(p["doc"], p["lo"], p["n"]) for k in range(c))
    assert got == [(d, s) for d, t in enumerate(texts) for s in range(len(t.encode().split()) - 49)]


def test_new_queries_read_whole_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("embeddings", "documents")}
    assert LLM_QUERIES["op11_centroid_clustering"](spark, SF).count() == n["embeddings"]
    assert LLM_QUERIES["op13_substring_dedup"](spark, SF).count() == n["documents"]


def test_new_queries_against_their_sql(spark):
    import duckdb

    from flowlens.llm import LLM_ORACLES
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_centroid_clustering", "op12_hard_negatives", "op13_substring_dedup"):
        found = LLM_QUERIES[name](spark, SF)
        want = con.execute(LLM_ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(found.columns) == sorted(columns)
        assert sorted(map(str, found.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(str(r) for r in want.fetchall())
