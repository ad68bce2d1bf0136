"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import math
import re
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of

FIT_DOCS = {1: 1200, 0: 2000}  # labelled rows used to fit, by label; picked by hash of the id
FIT_CHARS = 24_000_000  # and their total length, shared by the labels as FIT_DOCS is
SEGMENT = 48  # tokens of a training chain
FIT_SEGMENTS = 6000  # chains of them that the weights are fitted on
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 100_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def token_key(token: str) -> str:
    """The word of a token: lower case, without punctuation around it."""
    return EDGE.sub("", token.lower())


def units(key: str) -> list[str]:
    """What of a word is learnt: the word, and its beginnings of 4 to 7 letters (marked ^)."""
    return [key, *("^" + key[:k] for k in STEMS if len(key) > k)]


def shape(token: str, key: str) -> int:
    """Shape class of a token (8): has inner non-letters, is capital, has punctuation around it."""
    return (not key.isalpha()) + 2 * (token.isupper() and len(token) > 1) + 4 * (len(key) != len(token))


@dataclass
class Model:
    """unit -> weight of state toxic against state clean; transitions; calibration of document scores."""

    words: dict[str, float] = field(default_factory=dict)
    shapes: np.ndarray = field(default_factory=lambda: np.full(8, -20.0))
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    start: float = 1.0
    calib: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))


class Emissions(dict):
    """token -> exp(weight), filled on first use and emptied when it has grown too large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        key = token_key(token)
        m = self.model
        known = m.words.get
        e = math.exp(min(30.0, max(-30.0, sum(known(u, 0.0) for u in units(key)) + m.shapes[shape(token, key)])))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = e
        return e


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``e``: emission ratios (toxic to clean) of all tokens, chain by chain, with
    the longest chain first.  Returns P(toxic) of each token, the filtered
    forward values and the backward values (both normalised to sum 1 over states).
    """
    off = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    p, b = np.empty(len(e)), np.empty(len(e))
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains with more than t tokens
    (t00, t01), (t10, t11) = trans
    cur = None
    for t in range(longest):
        k = alive[t]
        at = off[:k] + t
        if t == 0:
            one, zero = start * e[at], 1.0
        else:
            cur = cur[:k]
            one, zero = (cur * t11 + (1 - cur) * t01) * e[at], cur * t10 + (1 - cur) * t00
        cur = one / (one + zero)
        p[at] = cur
    nxt = np.empty(0)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = off[:k] + t
        back = np.full(k, 0.5)
        m = len(nxt)
        if m:
            w = e[at[:m] + 1] * nxt
            one, zero = t11 * w + t10 * (1 - nxt), t01 * w + t00 * (1 - nxt)
            back[:m] = one / (one + zero)
        b[at] = back
        nxt = back
    hit = p * b
    return hit / (hit + (1 - p) * (1 - b)), p, b


def doc_features(marg: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each chain: 1, largest marginal, log of the expected number of toxic tokens, their share."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    full = lengths > 0
    if full.any():
        off = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)[full]
        total = np.add.reduceat(marg, off)
        out[full, 1] = np.maximum.reduceat(marg, off)
        out[full, 2] = np.log1p(total)
        out[full, 3] = total / lengths[full]
    return out


def tag(texts: list[str], emissions: Emissions, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths, marginals, features) for texts, longest first."""
    tokens = [t.split() for t in texts]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-n, kind="stable")
    get = emissions.__getitem__
    e = np.fromiter((x for i in order for x in map(get, tokens[i])), float, int(n.sum()))
    marg, _, _ = marginals(e, n[order], model.trans, model.start)
    return order, n[order], marg, doc_features(marg, n[order])


def toxic_units(pos: list[np.ndarray], neg: list[np.ndarray], n_units: int) -> np.ndarray:
    """Mask of the units that explain the toxic documents, greedily (documents as arrays of distinct unit numbers).

    Each is at least six times as frequent in toxic documents and present in
    some that no earlier one explains.  Units as spread over toxic documents
    as these (a third of the median) join them; rare ones that only come
    along, as in near copies, do not.
    """
    in_pos, in_neg = (np.bincount(np.concatenate([*d, np.empty(0, np.int64)]).astype(np.int64), minlength=n_units) for d in (pos, neg))
    least = max(4, len(pos) // 100)
    odds = np.log((in_pos + 0.5) / (len(pos) + 1)) - np.log((in_neg + 0.5) / (len(neg) + 1))
    may = (in_pos >= least) & (odds > math.log(6))
    may[0] = False
    where: dict[int, set[int]] = {int(u): set() for u in np.flatnonzero(may)}
    for i, d in enumerate(pos):
        for u in d[may[d]].tolist():
            where[u].add(i)
    left, found = set(range(len(pos))), np.zeros(n_units, bool)
    while where:
        u = max(where, key=lambda x: (len(where[x] & left) * odds[x], x))
        if len(where[u] & left) < least:
            break
        found[u] = True
        left -= where.pop(u)
    if found.any():
        found |= may & (in_pos >= max(least, np.median(in_pos[found]) / 3))
    return found


def fit(rows: list[tuple[str, int]], rounds: int = 60, seed: int = 7) -> Model:
    """Fit the chain on labelled tokens: tokens with a toxic unit in toxic documents are toxic, tokens of clean documents clean."""
    model = Model()
    seen, texts, labels = set(), [], []
    for text, label in rows:  # copies count once
        d = hashlib.md5(text.encode()).digest()
        if d not in seen:
            seen.add(d)
            texts.append(text)
            labels.append(label)
    if len(set(labels)) < 2:
        return model
    # words, their units and shapes as numbers; unit 0 is none
    numbers: dict[str, int] = {}
    token_numbers: dict[str, tuple[int, int]] = {}
    unit_numbers: dict[str, int] = {"": 0}
    unit_rows: list[list[int]] = []
    keys, shapes = [], []
    for t in texts:
        own = []
        for token in t.split():
            if token not in token_numbers:
                key = token_key(token)
                if key not in numbers:
                    numbers[key] = len(numbers)
                    ids = [unit_numbers.setdefault(u, len(unit_numbers)) for u in units(key)] if key else [0]
                    unit_rows.append(ids + [0] * (len(STEMS) + 1 - len(ids)))
                token_numbers[token] = (numbers[key], shape(token, key))
            own.append(token_numbers[token])
        pair = np.array(own, np.int32).reshape(-1, 2)
        keys.append(pair[:, 0])
        shapes.append(pair[:, 1].astype(np.int8))
    del token_numbers, numbers
    table = np.array(unit_rows, np.int32).reshape(-1, len(STEMS) + 1)
    y_doc = np.array(labels, int)
    parts = [np.unique(table[np.unique(k)]) for k in keys]
    toxic = toxic_units([p for p, y in zip(parts, labels, strict=True) if y], [p for p, y in zip(parts, labels, strict=True) if not y], len(unit_numbers))
    common = np.bincount(np.concatenate(parts), minlength=len(unit_numbers)) >= 3
    common[0] = False
    del parts
    new_number = np.where(common, np.cumsum(common), 0).astype(np.int32)
    n_vocab = int(common.sum())
    table, hits = new_number[table], toxic[table].any(1)
    word, shp, lab = [], [], []
    for k, s, y in zip(keys, shapes, labels, strict=True):
        hit = hits[k] & bool(y)
        if y and not hit.any():
            continue  # which of its tokens are toxic is not known
        for i in range(0, len(k), SEGMENT):
            word.append(k[i:i + SEGMENT])
            shp.append(s[i:i + SEGMENT])
            lab.append(hit[i:i + SEGMENT].astype(np.int8))
    some = np.array([x.any() for x in lab], bool)
    rng = np.random.default_rng(seed)
    pick = np.concatenate([rng.permutation(np.flatnonzero(some))[:FIT_SEGMENTS // 2], rng.permutation(np.flatnonzero(~some))[:FIT_SEGMENTS // 2]]).astype(int)
    if not len(pick):
        return model
    pick = pick[np.argsort([-len(lab[i]) for i in pick], kind="stable")]
    n = np.array([len(lab[i]) for i in pick])
    w, s, y = (np.concatenate([z[i] for i in pick]) for z in (word, shp, lab))
    del word, shp, lab, keys, shapes
    w, s, y = table[w], s.astype(int), y.astype(int)
    first = np.zeros(len(y), bool)
    first[np.concatenate(([0], np.cumsum(n)[:-1]))] = True
    theta = np.zeros(n_vocab + 1 + 8 + 4 + 1)
    sw, tr = n_vocab + 1, n_vocab + 9
    pair = (np.roll(y, 1) * 2 + y)[~first]
    seen_pairs, seen_start = np.bincount(pair, minlength=4), y[first].sum()
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        e = np.exp(np.clip(theta[w].sum(1) + theta[sw + s], -30, 30))
        trans, start = np.exp(theta[tr:tr + 4]).reshape(2, 2), math.exp(theta[tr + 4])
        marg, p, b = marginals(e, n, trans, start)
        d = marg - y
        i = np.flatnonzero(~first)
        joint = np.stack([(1 - p[i - 1]) * trans[0, 0] * (1 - b[i]), (1 - p[i - 1]) * trans[0, 1] * e[i] * b[i],
                          p[i - 1] * trans[1, 0] * (1 - b[i]), p[i - 1] * trans[1, 1] * e[i] * b[i]])
        joint /= joint.sum(0)
        g = np.concatenate([np.bincount(w.ravel(), np.repeat(d, w.shape[1]), n_vocab + 1), np.bincount(s, d, 8),
                            joint.sum(1) - seen_pairs, [marg[first].sum() - seen_start]])
        g = g / len(n) + 1e-4 * theta
        g[0] = 0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        theta -= 0.25 * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.98 ** r)) + 1e-7)
    model.words = {u: float(theta[new_number[i]]) for u, i in unit_numbers.items() if new_number[i] and abs(theta[new_number[i]]) > 1e-3}
    model.shapes = theta[sw:sw + 8]
    model.trans, model.start = np.exp(theta[tr:tr + 4]).reshape(2, 2), math.exp(theta[tr + 4])
    x, known = np.zeros((len(texts), 4)), Emissions(model)
    for i in range(0, len(texts), 500):
        order, _, _, f = tag(texts[i:i + 500], known, model)
        x[i + order] = f
    c = np.array([-2.0, 2.0, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        c = c - np.clip(np.linalg.solve(h, x.T @ (q - y_doc) + 0.05 * c * (np.arange(4) > 0)), -2, 2)
    model.calib = c
    return model


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that is never learnt from."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of labelled rows outside the held-out fifth: (text, label), at most FIT_DOCS by label and FIT_CHARS in all.

    An id counts once (its smallest text).  Each label has its own share of FIT_CHARS; a text that no longer fits is
    passed by for the next.  If labelled documents of a label exist and none fits, that is an error.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked, most = None, {y: FIT_CHARS * n // sum(FIT_DOCS.values()) for y, n in FIT_DOCS.items()}
    for y, n in FIT_DOCS.items():
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.union(some)
    fits = F.when(F.length("text") <= F.when(F.col("toxic") == 1, most[1]).otherwise(most[0]), F.col("text"))
    rows = stored(text_of(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").withColumn("text", fits)
                  .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).withColumn("h", F.xxhash64("doc_id")), "fit")
    left, chosen, missing = dict(most), [], set(FIT_DOCS)
    there = rows.select("doc_id", F.col("toxic").cast("int").alias("y"), F.length("text").alias("n"), "h").orderBy("h", "doc_id").collect()
    for r in there:
        if r.n is not None and r.n <= left[r.y]:
            left[r.y] -= r.n
            missing.discard(r.y)
            chosen.append(r.doc_id)
    if any(r.y in missing for r in there):
        raise ValueError(f"no picked document of label {sorted(missing)} is short enough to fit on: at most {most} characters")
    if len(missing) == 1 and known.where(F.col("toxic") == min(missing)).limit(1).count():
        warnings.warn(f"label {min(missing)} has labelled ids, but none of the picked ones is among the documents", stacklevel=2)
    kept = rows.where(F.col("doc_id").isin(chosen)).orderBy("h", "doc_id") if chosen else rows.limit(0)
    return [(r.text, int(r.toxic)) for r in kept.select("text", "toxic").toLocalIterator()]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans): P(toxic) of each text and its toxic spans (start, end, probability), in characters.

    Every row and whole text is scored; null counts as empty, which has a
    score too and no spans; repeated rows score alike; an empty table gives an
    empty result.  Only id and text are read.
    """
    t = text_of(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    return map_batches(t, scorer(t, model), f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>", rows=1000)


def scorer(t: DataFrame, model: Model):
    """The function that scores one batch of (doc_id, text); the model, bounded by the fitted sample, is broadcast."""
    shared = t.sparkSession.sparkContext.broadcast((model.words, model.shapes, model.trans, model.start, model.calib))
    held: list[Emissions] = []

    def one(batch):
        if not held:
            held.append(Emissions(Model(*shared.value)))
        m = held[0].model
        texts = batch.column("text").to_pylist()
        order, n, marg, x = tag(texts, held[0], m)
        s = np.empty(len(texts))
        s[order] = 1 / (1 + np.exp(-np.clip(x @ m.calib, -30, 30)))
        spans = [[] for _ in texts]
        at = 0
        for i, k, top in zip(order, n, x[:, 1], strict=True):
            if top >= 0.5:
                runs = spans[i]
                before = -2
                places = [w.span() for w in re.finditer(r"\S+", texts[i])]
                for j in np.flatnonzero(marg[at:at + k] >= 0.5).tolist():
                    pr = float(marg[at + j])
                    if j == before + 1:
                        runs[-1] = {"start": runs[-1]["start"], "end": places[j][1], "p": max(pr, runs[-1]["p"])}
                    else:
                        runs.append({"start": places[j][0], "end": places[j][1], "p": pr})
                    before = j
            at += k
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                                          names=["doc_id", "score", "predicted", "spans"])
    return one


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The documents with a score below ``reject``, with all their columns; rows are judged in place, without a join."""
    model = fit(fit_rows(docs, labels, id_col, text_col))
    one = scorer(docs, model)

    def keep(batch):
        rows = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col).fill_null("")], names=["doc_id", "text"])
        low = one(rows).column("score").to_numpy() < reject
        return batch.filter(pa.array(low))
    return map_batches(docs, keep, docs.schema, rows=1000)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on labelled rows outside the held-out fifth and score every document."""
    return score(docs, fit(fit_rows(docs, labels, id_col, text_col)), id_col, text_col)
