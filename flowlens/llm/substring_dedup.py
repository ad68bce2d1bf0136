"""Duplicate passages of words by relative Lempel-Ziv parsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, sorted_groups, stored

WINDOW = 50
GRAM = 8  # words of an anchor
BLOCK = 8192  # pieces of one reference block
SLICE = 4 << 20  # bytes of text that are hashed together
MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))  # odd multipliers of the two rolling hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, words by text); words are cut at the six ASCII white-space characters."""
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w, 13) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return table[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64), np.bincount(owner, minlength=len(texts))


def rolling(x: np.ndarray, n: int, mul: np.uint64) -> np.ndarray:
    """Polynomial hash of the ``n`` values from each place on (the last n - 1 places are left out), by doubling."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out, have, part, width, factor = None, 0, x, 1, int(mul)
    while True:
        power = np.uint64(factor)
        if n & width:
            piece = part[have:len(x) - n + 1 + have]
            out = piece.copy() if out is None else out * power + piece
            have += width
        if have == n:
            return out
        part = part[:-width] * power + part[width:]
        width, factor = width * 2, factor * factor % (1 << 64)


def chosen(gram: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` places the place of its smallest value, the leftmost of equals."""
    at, value, width = np.arange(len(gram)), gram, 1
    while width * 2 <= span:
        right = value[width:] < value[:-width]
        at = np.where(right, at[width:], at[:-width])
        value = np.where(right, value[width:], value[:-width])
        width *= 2
    if width < span:
        rest = span - width
        right = value[rest:] < value[:-rest]
        at = np.where(right, at[rest:], at[:-rest])
    return at


def pieces_of(word: np.ndarray, n: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Every window of every text in exactly one piece: the run of windows that choose the same anchor.

    An anchor is the gram with the smallest mixed hash in its window, so equal
    windows choose the same gram at the same place.  A piece has its text's
    number, its first window ``lo`` and their number ``n``, the anchor's place
    behind ``lo``, the anchor's hash ``g`` and two hashes of all its words.
    """
    first = np.cumsum(n) - n
    none = np.empty(0, np.int64)
    if len(word) < window:
        return {"doc": none, "lo": none, "n": none, "before": none, "g": none, "s1": none, "s2": none}
    start = np.arange(len(word) - window + 1)
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[start] == doc[start + window - 1]
    grams = _mix(rolling(word, gram, MUL[0]))
    at = chosen(grams, window - gram + 1)
    start, at = start[inside], at[inside]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    lo = start[new]
    count = np.diff(np.append(np.flatnonzero(new), len(start)))
    anchor = at[new]
    # hash of a whole piece: from sums of mixed (place behind the anchor, word), so that prefix sums do for any length
    end = lo + count + window - 1
    hashes = []
    for mul in MUL:
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(word), mul))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(word + mul) * power[:-1])))
        inverse = np.uint64(pow(int(mul), -1, 1 << 64))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(word), inverse))))
        body = (total[end] - total[lo]) * back[lo]
        hashes.append(_mix(body + _mix(((end - lo) * 4096 + (anchor - lo)).astype(np.uint64) ^ mul)))
    return {"doc": doc[lo], "lo": lo - first[doc[lo]], "n": count, "before": anchor - lo, "g": grams[anchor].view(np.int64),
            "s1": hashes[0].view(np.int64), "s2": hashes[1].view(np.int64)}


def factors(doc: np.ndarray, cls: np.ndarray, lead: np.ndarray, words: np.ndarray, size: np.ndarray, count: np.ndarray,
            window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Relative Lempel-Ziv parse of all pieces of a block against the block itself.

    The pieces (sorted by ``cls``, then ``doc``) are the reference; its index
    holds every window under (class, place relative to the anchor, hash).  All
    pieces are parsed side by side: at its place a piece looks its window up
    among pieces of smaller documents and, where there is one, takes the longest
    common run from there as a factor.  Windows that begin in a factor and
    cross its end are looked up next, each by itself, so that a passage cut by
    a factor boundary is not lost; where nothing is found the parse moves on
    by a word.  Returns (piece, first window, windows) of factors of at least
    a window, and the piece and window of those that no smaller document of
    the block has.
    """
    m = len(doc)
    top = int(lead.max(initial=0))
    width = int((top - lead + size).max(initial=0))
    grid = np.zeros((m, width), np.uint64)  # words with all anchors in one column
    begin = np.cumsum(size) - size
    flat_row = np.repeat(np.arange(m), size)
    flat_col = np.arange(len(words)) - np.repeat(begin - (top - lead), size)
    grid[flat_row, flat_col] = words
    left, right = top - lead, top - lead + size
    # index: every window of every piece
    row = np.repeat(np.arange(m), count)
    col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
    hashed = rolling(words, window, MUL[1])[np.repeat(begin, count) + col - np.repeat(left, count)] if len(row) else np.empty(0, np.uint64)
    order = np.lexsort((row, hashed, col, cls[row]))
    new = np.ones(len(order), bool)
    o, p = order[1:], order[:-1]
    new[1:] = (hashed[o] != hashed[p]) | (col[o] != col[p]) | (cls[row[o]] != cls[row[p]])
    head = np.empty(len(order), np.int64)
    head[order] = row[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else row  # first piece with the window: the smallest document
    start_of = np.cumsum(count) - count
    place = np.zeros(m, np.int64)
    alive = np.flatnonzero(count > 0)
    f_row, f_at, f_n, o_row, o_at = [], [], [], [], []
    while len(alive):
        at = place[alive]
        source = head[start_of[alive] + at]
        hit = doc[source] < doc[alive]
        a, s, c = alive[hit], source[hit], (left[alive] + at)[hit]
        if len(a):
            end = np.minimum(right[a], right[s])
            cols = np.arange(width)
            same = (grid[a] == grid[s]) | (cols[None, :] < c[:, None])
            stop = np.where(cols[None, :] >= end[:, None], True, ~same)
            run = np.where(stop.any(axis=1), stop.argmax(axis=1), width) - c
            proven = run >= window  # else two windows share a hash only: parsed as not found
            f_row.append(a[proven])
            f_at.append(at[hit][proven])
            n = np.minimum(run[proven] - window + 1, count[a[proven]] - at[hit][proven])
            f_n.append(n)
            step = np.ones(len(a), np.int64)
            step[proven] = n
            place[a] += step
        miss = alive[~hit]
        o_row.append(miss)
        o_at.append(at[~hit])
        place[miss] += 1
        alive = alive[place[alive] < count[alive]]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(f_row), join(f_at), join(f_n), join(o_row), join(o_at)


FOUND = "g long, s1 long, s2 long, at int, n int, w1 long, w2 long, doc_id long"


def parsed(batches, window: int):
    """Factors of each reference block, and for classes in several blocks the windows that are still open (with their hashes)."""
    for t in sorted_groups(batches, ["g", "block"], rows=2048):
        doc, g, block = (t.column(c).to_numpy() for c in ("doc_id", "g", "block"))
        listed = t.column("words").combine_chunks()
        size = listed.value_lengths().to_numpy().astype(np.int64)
        words = listed.flatten().to_numpy().view(np.uint64)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (block[1:] != block[:-1])
        cls = np.cumsum(new)
        lead, count = (t.column(c).to_numpy().astype(np.int64) for c in ("before", "n"))
        row, at, n, o_row, o_at = factors(doc, cls, lead, words, size, count, window)
        open_ = t.column("blocks").to_numpy()[o_row] > 1
        o_row, o_at = o_row[open_], o_at[open_]
        begin = (np.cumsum(size) - size)[o_row] + o_at
        w1, w2 = (rolling(words, window, mul)[begin].view(np.int64) if len(begin) else np.empty(0, np.int64) for mul in MUL)
        s1, s2 = t.column("s1").to_numpy(), t.column("s2").to_numpy()
        both = np.concatenate([row, o_row])
        is_open = np.arange(len(both)) >= len(row)
        if len(both):
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[both]), pa.array(s1[both]), pa.array(s2[both]), pa.array(np.concatenate([at, o_at]).astype(np.int32)),
                 pa.array(np.concatenate([n, np.ones(len(o_row), np.int64)]).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(len(row), np.int64), w1]), mask=~is_open), pa.array(np.concatenate([np.zeros(len(row), np.int64), w2]), mask=~is_open),
                 pa.array(doc[both])], names=["g", "s1", "s2", "at", "n", "w1", "w2", "doc_id"])


def kept_words(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Result rows from texts and the runs of windows found in them."""
    out = []
    for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
        words = text.split()  # bytes: the six ASCII white-space characters
        spans = []
        for lo, hi in sorted((r["lo"], r["lo"] + r["n"] + window - 1) for r in runs or []):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        kept, last = [], 0
        for lo, hi in spans:
            kept += words[last:lo]
            last = hi
        kept += words[last:]
        out.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept)))
    n, removed, spans, kept = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "n_removed", "spans", "text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (of words), text (the kept words joined by one space).

    A word goes when it is covered by ``window`` consecutive words whose
    sequence also starts in a document with a smaller id, judged on the
    input.  Words are runs without ASCII white space; null text has none.
    Ids must be integers; a document with a null id loses nothing and counts
    for no other; rows of one id do not count for each other, repeated rows
    give repeated results; texts of any length are read whole; empty input
    gives an empty result.  Other columns are not read.

    Every window belongs to one anchor, the gram with its smallest hash, and
    equal windows to equal anchors at equal places; the windows of one anchor
    form a piece of a document.  Pieces that are equal word for word are
    settled by their smallest id, without their words.  Only where different
    pieces share an anchor are the words of one of each fetched: they are the
    reference, dealt to blocks by anchor, and every piece is factored
    greedily against its indexed block, with the windows over factor
    boundaries looked up on their own.  An anchor with more than ``block``
    different pieces is split into several blocks; windows first in a block
    then meet those of the other blocks by a 128-bit hash.
    """
    def with_key(df):
        return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")) \
            .select("doc_id", "text", F.xxhash64("text").alias("v"))  # rows of one id are told apart by v

    def anchors_of(batches):
        for batch in small_batches(batches, 2000, SLICE):
            word, n = words_of(batch.column("text"))
            p = pieces_of(word, n, window, gram)
            at = pa.array(p["doc"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("v").take(at), pa.array(p["g"]), pa.array(p["s1"]), pa.array(p["s2"]),
                 pa.array(p["lo"].astype(np.int32)), pa.array(p["n"].astype(np.int32)), pa.array(p["before"].astype(np.int32))],
                names=["doc_id", "v", "g", "s1", "s2", "lo", "n", "before"])

    texts = with_key(docs)
    known = texts.where("doc_id is not null")
    same = ["g", "s1", "s2"]
    anchors = stored(known.mapInArrow(anchors_of, "doc_id long, v long, g long, s1 long, s2 long, lo int, n int, before int"), "anchors")
    pieces = stored(anchors.groupBy(*same).agg(F.min(F.struct("doc_id", "v", "lo")).alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n"),
                                               F.first("before").alias("before")), "pieces")
    classes = pieces.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    asked = pieces.join(classes, "g").groupBy("rep.doc_id", "rep.v").agg(
        F.collect_list(F.struct(*same, F.col("rep.lo").alias("lo"), "n", "before", "blocks")).alias("asked"))  # at most a document's own pieces

    def fetch(batches):
        for b in small_batches(batches, 500, SLICE):
            word, n = words_of(b.column("text"))
            first = np.cumsum(n) - n
            lists = b.column("asked")
            owner = pc.list_parent_indices(lists).to_numpy()
            one = lists.flatten()
            field = {k: one.field(k).to_numpy() for k in (*same, "lo", "n", "before", "blocks")}
            size = field["n"].astype(np.int64) + window - 1
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - (first[owner] + field["lo"]), size)
            blk = (field["s1"].view(np.uint64) % field["blocks"].astype(np.uint64)).astype(np.int32)
            for s in range(0, len(owner), 20_000):  # batches of bounded size
                e = min(s + 20_000, len(owner))
                listed = pa.ListArray.from_arrays(pa.array((ends[s:e + 1] - ends[s]).astype(np.int32)), pa.array(word[at[ends[s]:ends[e]]].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(field["g"][s:e]), pa.array(blk[s:e]), b.column("doc_id").take(pa.array(owner[s:e])), pa.array(field["s1"][s:e]), pa.array(field["s2"][s:e]),
                     pa.array(field["n"][s:e]), pa.array(field["before"][s:e]), pa.array(field["blocks"][s:e]), listed],
                    names=["g", "block", "doc_id", "s1", "s2", "n", "before", "blocks", "words"])

    reference = texts.join(asked, ["doc_id", "v"]).select("doc_id", "text", "asked").mapInArrow(
        fetch, "g long, block int, doc_id long, s1 long, s2 long, n int, before int, blocks int, words array<long>")
    found = stored(reference.repartition("g", "block").sortWithinPartitions("g", "block", "doc_id").mapInArrow(lambda b: parsed(b, window), FOUND), "factors")
    met = found.where("w1 is not null")
    met = met.join(met.groupBy("w1", "w2").agg(F.min("doc_id").alias("least")), ["w1", "w2"]).where("doc_id > least")
    hits = found.where("w1 is null").select(*same, "at", "n").union(met.select(*same, "at", "n"))
    own = anchors.select("doc_id", "v", *same, "lo", F.col("n").alias("all"))
    whole = own.join(pieces.where("rep.doc_id < last").select(*same, F.col("rep.doc_id").alias("least")), same).where("doc_id > least")
    by_piece = stored(hits.groupBy(*same).agg(F.collect_set(F.struct("at", "n")).alias("f")), "found")  # stored: the join with a frequent piece can be split
    part = own.join(by_piece, same).select("doc_id", "v", "lo", F.explode("f").alias("f"))  # at most a piece's windows
    runs = whole.select("doc_id", "v", "lo", F.col("all").alias("n")).union(part.select("doc_id", "v", (F.col("lo") + F.col("f.at")).alias("lo"), F.col("f.n").alias("n")))
    per = runs.groupBy("doc_id", "v").agg(F.collect_set(F.struct("lo", "n")).alias("runs"))  # at most a document's windows
    return map_batches(texts.join(per, ["doc_id", "v"], "left").select("doc_id", "text", "runs"), lambda b: kept_words(b, window),
                       "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, text string", rows=500)
