"""Repeated byte strings by a sparse suffix array, sorted deep-shallow.

Sorting every suffix of a large corpus would move every byte's context.  Here
only suffixes at content-chosen anchors are sorted: of each window of
``length`` bytes the place of its smallest ``core``-byte hash.  Equal windows
choose the same place, so two equal windows meet as two suffixes with equal
cores, one for every 120 bytes or so.  Anchors whose core occurs once are
dropped by a count; anchors with equal whole surroundings are one class.  The
classes that share a core are ordered, text after the core and text before it
(reversed), by multikey quicksort to a shallow depth and blind tries below it;
common prefixes of neighbours in both orders give every repeated window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, sorted_groups, stored

LENGTH = 400
CORE = 160
SHALLOW = 16  # bytes that multikey quicksort looks at, in words of 8
BLOCK = 4096  # classes sorted together where a core has too many for one task
WHOLE = 16 * BLOCK  # up to so many they stay together

# ---------------------------------------------------------------- anchors


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit sums."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Prefix sums of two polynomial hashes modulo 2^64 with independent bases and byte values."""

    BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

    def __init__(self) -> None:
        self.size = 0

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        self.size, self.up, self.down = n, [], []
        for base in self.BASES:
            for powers, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                powers.append(np.cumprod(p))
        byte = np.arange(256, dtype=np.uint64)
        self.values = [_mix((byte + np.uint64(1)) * np.uint64(b)) for b in self.BASES]

    def prefix(self, data: np.ndarray, which: int) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[which][data] * self.up[which][:len(data)])))

    def spans(self, sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[which][start]


def slide(x: np.ndarray, w: int, op, fill: int) -> np.ndarray:
    """op over x[i : i + w] for every i, past the end with ``fill``: running values from both ends of blocks of w."""
    n = len(x)
    rows = -(-(n + w - 1) // w)
    a = np.full(rows * w, fill, x.dtype)
    a[:n] = x
    a = a.reshape(rows, w)
    ahead = op.accumulate(a, axis=1).ravel()
    back = op.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1:w - 1 + n])


def find_anchors(texts: list[bytes], sums: Sums, length: int, core: int) -> dict[str, np.ndarray]:
    """Anchors of some texts: text number, place, bytes of context to the left and right, core hash, context hash (two words)."""
    use = [i for i, t in enumerate(texts) if len(t) >= length]
    if not use:
        return {}
    data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    size = np.array([len(texts[i]) for i in use])
    end = np.cumsum(size)
    start = end - size
    sums.grow(len(data) + 1)
    one = sums.prefix(data, 0)
    n = len(data) - core + 1
    at = np.arange(n)
    h = _mix(sums.spans(one, 0, at, at + core))
    top = np.iinfo(np.uint64).max
    whole = np.ones(len(data), bool)  # windows that lie in one text
    for e, s in zip(end.tolist(), start.tolist(), strict=True):
        h[max(s, e - core + 1):e] = top
        whole[max(s, e - length + 1):e] = False
    w = length - core + 1
    low = slide(h, w, np.minimum, top)
    low[~whole[:n]] = 0
    # a place is an anchor if it holds the minimum of one of the windows that begin up to w - 1 before it
    high = slide(low[::-1], w, np.maximum, 0)[::-1]
    pos = np.flatnonzero((high == h) & (h != top))
    doc = np.searchsorted(end, pos, side="right")
    left = np.minimum(pos - start[doc], length - core)
    right = np.minimum(end[doc] - pos, length)
    two = sums.prefix(data, 1)
    edge = (left * 1024 + right).astype(np.uint64)
    c1 = _mix(sums.spans(one, 0, pos - left, pos + right) + edge * np.uint64(0xA0761D6478BD642F))
    c2 = _mix(sums.spans(two, 1, pos - left, pos + right) + edge * np.uint64(0xE7037ED1A0B428DB))
    return {"doc": np.array(use)[doc], "pos": pos - start[doc], "left": left, "right": right, "core": h[pos], "c1": c1, "c2": c2}


def anchors(texts: DataFrame, length: int, core: int) -> DataFrame:
    """Anchor rows of (doc_id, dh, text)."""
    def run(batches):
        sums = Sums()
        for b in small_batches(batches, rows=2000, size=1 << 20):
            a = find_anchors(b.column("text").cast(pa.binary()).to_pylist(), sums, length, core)
            if a:
                d = pa.array(a["doc"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(d), b.column("dh").take(d), pa.array(a["pos"].astype(np.int32)), pa.array(a["left"].astype(np.int16)),
                     pa.array(a["right"].astype(np.int16)), *[pa.array(a[k].view(np.int64)) for k in ("core", "c1", "c2")]],
                    names=["doc_id", "dh", "pos", "left", "right", "core", "c1", "c2"])
    return texts.mapInArrow(run, "doc_id long, dh long, pos int, left short, right short, core long, c1 long, c2 long")


# ---------------------------------------------------------------- deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(items: list[int], strings: list[bytes], depth: int) -> list[tuple[int, int]]:
    """Order of strings that agree up to ``depth``: (item, common prefix with the one before).

    A node keeps only the place where its strings first differ and its branch
    bytes.  A new string walks down blind, comparing branch bytes alone, is
    compared once with a string found there, and then enters at the true place.
    """
    root: list = [len(strings[items[0]]), {-1: [items[0]]}]  # [place, {byte or -1 for the end: node or list of items}]
    for item in items[1:]:
        s = strings[item]
        node = root
        while isinstance(node[1], dict):
            kids = node[1]
            child = kids.get(s[node[0]] if node[0] < len(s) else -1)
            if child is None:
                child = next(iter(kids.values()))
            if not isinstance(child[0], int) or not (len(child) == 2 and isinstance(child[1], dict)):
                break
            node = child
        other = child[0]
        same = common_prefix(s, strings[other])
        parent, key, node = None, None, root
        while node[0] < same:
            parent, key = node, s[node[0]]
            nxt = node[1].get(key)
            if nxt is None or not (len(nxt) == 2 and isinstance(nxt[1], dict)):
                break
            node = nxt
        byte = s[same] if same < len(s) else -1
        if node[0] == same:
            if byte in node[1]:
                node[1][byte].append(item)  # equal strings
            else:
                node[1][byte] = [item]
        elif node[0] > same:
            o = strings[other]
            fresh = [same, {byte: [item], (o[same] if same < len(o) else -1): node}]
            if parent is None:
                root = fresh
            else:
                parent[1][key] = fresh
        else:  # a leaf below this node
            leaf = node[1].get(key)
            if leaf is None:
                node[1][key] = [item]
            else:
                o = strings[leaf[0]]
                a = s[same] if same < len(s) else -1
                b = o[same] if same < len(o) else -1
                if a == b:
                    leaf.append(item)
                else:
                    node[1][key] = [same, {a: [item], b: leaf}]
    out: list[tuple[int, int]] = []
    stack: list = [(root, depth)]
    while stack:
        node, before = stack.pop()
        if len(node) == 2 and isinstance(node[1], dict):
            kids = sorted(node[1].items())
            for i in range(len(kids) - 1, -1, -1):
                stack.append((kids[i][1], before if i == 0 else node[0]))
        else:
            n = len(strings[node[0]])
            out += [(x, before if i == 0 else n) for i, x in enumerate(node)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of strings and common prefixes of neighbours (first: 0)."""
    out: list[tuple[int, int]] = []
    # (items, depth, common prefix with what came before, already told apart)
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        items, depth, before = stack.pop()
        if len(items) == 1:
            out.append((items[0], before))
        elif depth >= SHALLOW:
            some = blind_trie(items, strings, depth)
            out.append((some[0][0], before))
            out += some[1:]
        else:
            word = [strings[i][depth:depth + 8] for i in items]
            pivot = word[len(word) // 2]
            less = [i for i, x in zip(items, word, strict=True) if x < pivot]
            same = [i for i, x in zip(items, word, strict=True) if x == pivot]
            more = [i for i, x in zip(items, word, strict=True) if x > pivot]
            parts = [(less, depth), (same, depth + 8 if len(pivot) == 8 else SHALLOW), (more, depth)]
            for p, d in reversed([x for x in parts if x[0]]):
                stack.append((p, d, -1))
            first = stack.pop()
            stack.append((first[0], first[1], before))
    order = [i for i, _ in out]
    lcp = [x if x >= 0 else common_prefix(strings[order[k - 1]], strings[order[k]]) for k, (_, x) in enumerate(out)]
    return order, lcp


def repeated_windows(left: list[bytes], right: list[bytes], length: int, core: int, every: bool = False):
    """Windows that occur twice around anchors with one core: (member, offset before the anchor), and classes if ``every``.

    ``left``: reversed text before each anchor; ``right``: text after its core.
    The window at offset o holds o bytes before the anchor.  It repeats if two
    members agree in o bytes to the left and length - core - o to the right.
    Only offsets where some common prefix ends can begin or end a repeat, the
    windows between are covered by them; ``every`` takes all offsets instead.
    """
    span = length - core
    if len(left) == 2 and not every:
        a, b = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        a, b = min(a, span), min(b, span)
        return [(m, o) for m in (0, 1) for o in {a, max(0, span - b)}] if a + b >= span else []
    lo, ll = deep_shallow(left)
    ro, rl = deep_shallow(right)
    ll, rl = np.minimum(ll, span), np.minimum(rl, span)
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    lo, ro = np.array(lo), np.array(ro)
    offsets = np.arange(span + 1) if every else np.unique(np.concatenate((ll[1:], span - rl[1:])))
    found = []
    a, b = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
    for o in offsets.tolist():
        ok = (nl >= o) & (nr >= span - o)
        a[lo] = np.cumsum(ll < o)
        b[ro] = np.cumsum(rl < span - o)
        m = np.flatnonzero(ok)
        key = a[m] * (len(lo) + 1) + b[m]
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if every:
            found.append((o, m, count[inverse] > 1, first[inverse] == np.arange(len(m))))
        else:
            found += [(int(x), o) for x in m[count[inverse] > 1]]
    return found


OUT = "doc_id long, dh long, start int, stop int, h1 long, h2 long, known boolean"


def whole_core(cols: dict[str, list], ks: list[int], length: int, core: int):
    """(row, start, stop) of what the repeated windows of each class of a core cover: they all hold the core, so they overlap
    and cover one run, from the one that begins first to the one that begins last."""
    left = [cols["before"][k][::-1] for k in ks]
    right = [cols["after"][k][core:] for k in ks]
    found = np.array(repeated_windows(left, right, length, core), np.int64).reshape(-1, 2)
    least, most = np.full(len(ks), length), np.full(len(ks), -1)
    np.minimum.at(least, found[:, 0], found[:, 1])
    np.maximum.at(most, found[:, 0], found[:, 1])
    for m in np.flatnonzero(most >= 0).tolist():
        p = cols["pos"][ks[m]]
        yield ks[m], p - most[m], p - least[m] + length


def part_of_core(cols: dict[str, list], ks: list[int], length: int, core: int, sums: Sums):
    """Of one block of a core's classes: (row, start, stop, h1, h2, known) arrays.  Known rows without hash are the runs of
    windows that repeat inside the block; known rows with one name each such window once, for the other blocks; the others
    are windows seen once in the block."""
    span = length - core
    before, after = [cols["before"][k] for k in ks], [cols["after"][k] for k in ks]
    if len(ks) > 1:
        found = repeated_windows([b[::-1] for b in before], [a[core:] for a in after], length, core, every=True)
    else:
        ok = [o for o in range(span + 1) if len(before[0]) >= o and len(after[0]) >= length - o]
        found = [(o, np.array([0]), np.array([False]), np.array([True])) for o in ok]
    twice = np.zeros((len(ks), span + 1), bool)
    ask = np.zeros((len(ks), span + 1), bool)  # windows whose hash the other blocks are asked for
    for o, members, again, first in found:
        twice[members, o] = again
        ask[members, o] = ~again | first
    pos = np.array([cols["pos"][k] for k in ks])
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    m, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    row = np.array(ks)
    yield row[m], pos[m] - (hi - 1), pos[m] - lo + length, None, None, np.ones(len(m), bool)
    for x in range(len(ks)):
        o = np.flatnonzero(ask[x])
        if len(o):
            data = np.frombuffer(before[x] + after[x], np.uint8)
            sums.grow(len(data) + 1)
            s = len(before[x]) - o
            h = [sums.spans(sums.prefix(data, q), q, s, s + length).view(np.int64) for q in (0, 1)]
            yield np.full(len(o), ks[x]), pos[x] - o, pos[x] - o + length, h[0], h[1], twice[x, o]


def sort_blocks(batches, length: int, core: int):
    """Of each block of classes with one core: repeated windows as (start, stop); where the core has more blocks also the
    hashes that ``part_of_core`` names."""
    sums = Sums()
    sums.grow(length + 1)
    for t in sorted_groups(batches, ["core", "block"]):
        cols = {k: t.column(k).to_pylist() for k in ("pos", "blocks", "before", "after")}
        ids, dhs = t.column("doc_id").combine_chunks(), t.column("dh").combine_chunks()
        new = np.ones(t.num_rows, bool)
        new[1:] = (np.diff(t.column("core").to_numpy()) != 0) | (np.diff(t.column("block").to_numpy()) != 0)
        edges = [*np.flatnonzero(new).tolist(), t.num_rows]
        held: list[tuple] = []
        size = 0

        def flush():
            row = np.concatenate([x[0] for x in held]).astype(np.int64)
            hash_ = [np.concatenate([x[c] if x[c] is not None else np.zeros(len(x[0]), np.int64) for x in held]) for c in (3, 4)]
            none = np.concatenate([np.full(len(x[0]), x[3] is None) for x in held])
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), dhs.take(pa.array(row)), *[pa.array(np.concatenate([x[c] for x in held]).astype(np.int32)) for c in (1, 2)],
                 *[pa.array(h, mask=none) for h in hash_], pa.array(np.concatenate([x[5] for x in held]))],
                names=["doc_id", "dh", "start", "stop", "h1", "h2", "known"])

        for i, j in zip(edges, edges[1:], strict=False):
            by: dict[bytes, list[int]] = {}  # the core itself decides, not its hash
            for k in range(i, j):
                by.setdefault(cols["after"][k][:core], []).append(k)
            for ks in by.values():
                if cols["blocks"][i] > 1:
                    made = part_of_core(cols, ks, length, core, sums)
                elif len(ks) > 1:
                    rows = list(whole_core(cols, ks, length, core))
                    made = [(*np.array(rows, np.int64).reshape(-1, 3).T, None, None, np.ones(len(rows), bool))] if rows else []
                else:
                    continue
                for x in made:
                    held.append(x)
                    size += len(x[0])
                    if size >= 100_000:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()


# ---------------------------------------------------------------- operator


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, overlapping or touching spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK):
    """(texts, covers): the texts with repeats (doc_id, dh, text) and (doc_id, dh, start, stop) of repeated byte windows; both stored or lazy tables."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")) \
        .withColumn("dh", F.xxhash64("text"))
    key = ["doc_id", "dh"]
    every = stored(anchors(texts.where(F.octet_length("text") >= length), length, core), "anchors")
    # counts are stored, so that a core with very many rows can be split in the join
    often = stored(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "often")
    again = stored(every.join(often, "core"), "repeated")
    kind = ["core", "c1", "c2"]
    classes = stored(again.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "dh", "pos", "left", "right")).alias("one")), "classes")
    whole = again.join(classes.where("n > 1").select(*kind), kind).select(
        *key, (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("stop"))
    shared = stored(classes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    unsure = classes.join(shared, "core").select("core", "m", "one.*")
    places = stored(unsure.groupBy(*key).agg(F.collect_list(F.struct("core", "m", "pos", "left", "right")).alias("places")), "places")
    spans = stored(whole, "whole")
    concerned = spans.select(*key).union(places.select(*key)).distinct().withColumnsRenamed({"doc_id": "__i", "dh": "__h"})
    found = stored(texts.join(concerned, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("dh") == F.col("__h")), "left_semi"), "texts")

    def cut(batch):
        out = {k: [] for k in ("doc_id", "dh", "core", "m", "pos", "before", "after")}
        for i, h, t, ps in zip(batch.column("doc_id").to_pylist(), batch.column("dh").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                               batch.column("places").to_pylist(), strict=True):
            for p in ps:
                at = p["pos"]
                for k, v in zip(out, (i, h, p["core"], p["m"], at, t[at - p["left"]:at], t[at:at + p["right"]]), strict=True):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    once = found.dropDuplicates(key)
    around = map_batches(once.join(places.withColumnsRenamed({"doc_id": "__i", "dh": "__h"}), F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("dh") == F.col("__h")))
                         .select(*key, "text", "places"), cut, "doc_id long, dh long, core long, m long, pos int, before binary, after binary", rows=500)
    blocks = F.when(F.col("m") > block * (WHOLE // BLOCK), F.ceil(F.col("m") / F.lit(block))).otherwise(F.lit(1))
    around = (around.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "dh", "pos"), F.col("blocks")))
              .repartition("core", "block").sortWithinPartitions("core", "block"))
    sorted_ = stored(around.mapInArrow(lambda b: sort_blocks(b, length, core), OUT), "sorted")
    # windows of cores in several blocks: equal ones of different blocks meet by their hash, at most one row of a kind and block;
    # a window with two anchors comes twice, so two different places are asked for
    place = F.struct("doc_id", "dh", "start")
    meet = sorted_.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.collect_list(F.when(~F.col("known"), F.struct("doc_id", "dh", "start", "stop"))).alias("them"))
    met = meet.where("a <> b").select(F.explode("them").alias("x")).select("x.*")
    covers = spans.union(sorted_.where("known").select(*key, "start", "stop")).union(met)
    return found, covers


def suffix_dedup(docs: DataFrame, length: int = LENGTH, core: int = CORE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary: what is left of the text).

    Removed is every byte covered by a ``length``-byte string that starts at
    two places or more, in one or several documents; strings are judged on the
    input, on bytes, and never reach across documents.  Null counts as empty;
    texts under ``length`` bytes lose nothing; of equal texts of at least
    ``length`` bytes every byte goes, in all of them (no copy is spared), also
    for repeated rows with one id.  Empty input gives an empty result.
    """
    def measure(batch):
        t = batch.column("text").cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dh"), pa.array([len(x) for x in t], pa.int64()),
                                           pa.array([hashlib.sha256(x).digest() for x in t], pa.binary())], names=["doc_id", "dh", "n_bytes", "sha"])
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")) \
        .withColumn("dh", F.xxhash64("text")).select("doc_id", "dh", "text")
    rows = stored(map_batches(texts, measure, "doc_id long, dh long, n_bytes long, sha binary"), "measured")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha", F.lit(True).alias("copied"))
    found, covers = repeated_spans(docs, length, core, id_col, text_col, block)
    per_text = covers.groupBy("doc_id", "dh").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def remove(batch):
        n_removed, n_spans, kept = [], [], []
        for t, ss in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = merge([(x["start"], x["stop"]) for x in ss])
            n_removed.append(sum(e - s for s, e in runs))
            n_spans.append(len(runs))
            edges = [0, *(x for r in runs for x in r), len(t)]
            kept.append(b"".join(t[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("dh"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array(kept, pa.binary())],
            names=["__i", "__h", "n_removed", "n_spans", "kept"])

    p = per_text.withColumnsRenamed({"doc_id": "__i", "dh": "__h"})
    cut = map_batches(found.dropDuplicates(["doc_id", "dh"]).join(p, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("dh") == F.col("__h")))
                      .select("doc_id", "dh", "text", "spans"), remove, "__i long, __h long, n_removed long, n_spans long, kept binary", rows=500)
    # what is decided of a text is one row, joined to the texts once
    whole = rows.join(copies, "sha").groupBy(F.col("doc_id").alias("__i"), F.col("dh").alias("__h")).agg(F.lit(True).alias("gone"))
    empty = [F.lit(None).cast(k).alias(n) for n, k in (("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"))]
    decided = cut.withColumn("gone", F.lit(False)).unionByName(whole.select("__i", "__h", *empty, "gone")).groupBy("__i", "__h").agg(
        F.max("gone").alias("gone"), *[F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept")])  # two rows at most
    out = texts.join(decided, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("dh") == F.col("__h")), "left")
    gone, n_bytes = F.coalesce(F.col("gone"), F.lit(False)), F.octet_length("text").cast("long")
    left = F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8")))
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), F.when(gone, n_bytes).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), left.alias("kept"))
