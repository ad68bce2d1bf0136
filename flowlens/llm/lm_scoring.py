"""Stupid-backoff language-model scores from the corpus's own n-gram counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

ORDER = 3
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20  # text that is exploded together
MAX_BUCKETS = 1 << 17
START, END = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in ("<s>", "</s>"))
TOTAL = np.uint64(0)  # stands for all tokens


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words with an end mark after each text, words and mark by text)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = words.flatten()
    owner = pc.list_parent_indices(words).to_numpy()
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w, 1) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    hashes = table[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)
    full = pc.binary_length(flat).to_numpy() > 0 if len(flat) else np.empty(0, bool)
    hashes, owner = hashes[full], owner[full]
    n = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    ends = np.cumsum(n) - 1
    at = np.ones(len(out), bool)
    at[ends] = False
    out[at] = hashes
    return out, n


def ngrams(word: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each token; before a text's first word stand start marks."""
    first = np.cumsum(n) - n
    place = np.arange(len(word)) - np.repeat(first, n)
    out = [_mix(word ^ np.uint64(0x5851F42D4C957F2D))]
    grams = word
    for k in range(2, order + 1):
        back = np.concatenate((np.zeros(k - 1, np.uint64), word[:len(word) - k + 1])) if len(word) >= k - 1 else np.zeros(len(word), np.uint64)
        back = np.where(place >= k - 1, back, START)
        grams = _mix(grams * np.uint64(0x2545F4914F6CDD1D) + back * np.uint64(2 * k + 1))
        out.append(_mix(grams ^ np.uint64(k)))
    return out


def chunk_counts(texts: pa.Array, order: int, where: bool = False):
    """(tokens by text, distinct hashes ascending, their counts, place of each token's k-gram among them for k = 1..order,
    places of the start contexts) of a chunk; places only if ``where``.  The start context of each order below the highest
    occurs once a text; the hash 0 stands for all tokens and comes first."""
    word, n = tokens(texts)
    grams = ngrams(word, n, order)
    starts = [s[0] for s in ngrams(np.array([START]), np.array([1]), order)[:order - 1]]
    del word
    keys, *rest, counts = np.unique(np.concatenate([*grams, np.array(starts, np.uint64)]), return_counts=True, return_inverse=where)
    size = len(grams[0])
    del grams
    places = []
    if where:
        at = rest[0].astype(np.int32) + 1
        places = [at[k * size:(k + 1) * size] for k in range(order)]
    keys, counts = np.concatenate(([TOTAL], keys)), np.concatenate(([size], counts))
    first = np.searchsorted(keys, np.array(starts, np.uint64))
    counts[first] += len(n) - 1
    return n, keys, counts, places, first


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes, only as many as the largest needs."""
    x = x.astype("<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T)
    return k.to_bytes(1, "little") + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    k, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], n * k, codec="zstd", asbytes=True), np.uint8).reshape(k, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = planes.T
    return out.view("<u8").ravel()


def pack_hashes(x: np.ndarray) -> bytes:
    """Ascending hashes as the first one and differences."""
    return x[:1].astype("<u8").tobytes() + pack(np.diff(x))


def unpack_hashes(b: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(b, "<u8", count=1), unpack(b[8:]))), dtype=np.uint64)


def dealt(batch: pa.RecordBatch, chunks: int) -> pa.RecordBatch:
    """The rows of a slice as one compressed block (chunk, docs) for each chunk; the j-th of equal rows goes j chunks further, so they spread."""
    h = batch.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    chunk = np.empty(len(h), np.int64)
    chunk[order] = (h[order] % chunks + np.arange(len(h)) - first) % chunks
    rows = pa.table({k: batch.column(k) for k in ("doc_id", "text")})
    order = np.argsort(chunk, kind="stable")
    numbers, start = np.unique(chunk[order], return_index=True)
    blocks = []
    for at in np.split(order, start[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.take(pa.array(at)))
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blocks, pa.binary())], names=["chunk", "docs"])


def opened(blocks: pa.ChunkedArray) -> pa.Table:
    """The rows of a chunk's blocks, in the order of the blocks' bytes, so that both reads see one order."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in sorted(blocks.to_pylist())]).combine_chunks()


def chunks_of(batches):
    """(chunk, table of its rows) of a partition; a chunk is whole in one partition, and only one is open at a time."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if held:
        t = pa.concat_tables(held)
        number = t.column("chunk").to_numpy()
        for c in np.unique(number):
            yield int(c), opened(t.column("docs").filter(pa.array(number == c)))


def exploded(batches, order: int, buckets: int):
    """The n-gram table of each chunk, one row a hash bucket: (bucket, chunk, grams, counts)."""
    for c, t in chunks_of(batches):
        _, keys, counts, _, _ = chunk_counts(t.column("text").combine_chunks(), order)
        b = bucket_of(keys, buckets)
        cut = np.flatnonzero(np.diff(b)) + 1
        edges = [0, *cut.tolist(), len(keys)]
        rows = [(int(b[s]), c, pack_hashes(keys[s:e]), pack(counts[s:e])) for s, e in zip(edges, edges[1:], strict=False)]
        for i in range(0, len(rows), 4096):
            part = list(zip(*rows[i:i + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary()),
                                              pa.array(part[3], pa.binary())], names=["bucket", "chunk", "grams", "counts"])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so a chunk's buckets in order are its hashes in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def joined(batches):
    """Count table of each bucket joined to every chunk's grams: (chunk, bucket, totals)."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not held:
        return
    t = pa.concat_tables(held)
    number = t.column("bucket").to_numpy()
    for b in np.unique(number):
        rows = t.filter(pa.array(number == b))
        grams = [unpack_hashes(x) for x in rows.column("grams").to_pylist()]
        counts = np.concatenate([unpack(x).astype(np.int64) for x in rows.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, counts).astype(np.int64)[which]
        ends = np.cumsum([len(g) for g in grams])[:-1]
        yield pa.RecordBatch.from_arrays([rows.column("chunk").combine_chunks(), rows.column("bucket").combine_chunks(),
                                          pa.array([pack(x) for x in np.split(total, ends)], pa.binary())], names=["chunk", "bucket", "totals"])


def scored(blocks: pa.Table, totals: pa.Table, order: int, backoff: float) -> pa.Table:
    """Scores of one chunk's documents from the totals of its grams."""
    texts = opened(blocks.column("docs"))
    t = totals.sort_by("bucket")
    total = np.concatenate([unpack(x).astype(np.int64) for x in t.column("totals").to_pylist()]) if t.num_rows else np.empty(0, np.int64)
    n, keys, _, places, first = chunk_counts(texts.column("text").combine_chunks(), order, where=True)
    if len(total) != len(keys):
        raise RuntimeError(f"{len(keys)} n-grams but {len(total)} totals; the documents changed between reads")
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    others = float(total[0]) - n  # tokens of all other documents

    def outside(at: np.ndarray) -> np.ndarray:
        """Count of each gram in the other documents: all less the document's own, which is 1 where all is 1."""
        out = total[at] - 1
        more = np.flatnonzero(out > 0)
        _, inverse, own = np.unique(doc[more] * np.int64(len(keys)) + at[more], return_inverse=True, return_counts=True)
        out[more] -= own[inverse] - 1
        return out

    seen = before = outside(places[0])
    log_p = np.log(np.maximum(seen, 1)) - np.log(np.maximum(others, 1))[doc] + (order - 1) * math.log(backoff)
    level = np.ones(len(doc), np.int8)
    for k in range(2, order + 1):
        # the context of a token is the shorter gram that ends one token earlier; the first token's is the start, once a document
        context = np.concatenate((before[:1], before[:-1]))
        context[begin] = total[first[k - 2]] - 1
        f = outside(places[k - 1])
        hit = (f > 0) & (context > 0)
        log_p[hit] = (order - k) * math.log(backoff) + np.log(f[hit]) - np.log(context[hit])
        level[hit] = k
        before = f
    size = len(n)
    sums = np.bincount(doc, log_p, size)
    return pa.table({
        "doc_id": texts.column("doc_id"), "n_tokens": pa.array(n.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": pa.array(sums / n),
        "n_top_order": pa.array(np.bincount(doc, level == order, size).astype(np.int64)), "n_unseen": pa.array(np.bincount(doc, seen == 0, size).astype(np.int64))})


def lm_score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score, n_top_order, n_unseen) of every row.

    The score of a token is f(gram) / f(context) at the highest order at which
    the gram occurs in *other* documents, times ``backoff`` for each order
    below; a word that no other document has counts as seen once.  Counts are
    over all documents, less the scored document's own.  Tokens are
    lower-cased words between ASCII white space and an end mark, so null and
    empty texts have one token.  Repeated rows are documents of their own;
    empty input gives an empty result.

    Documents are dealt to chunks by hash, equal rows to different ones, and
    travel compressed; a chunk's n-grams are exploded and
    counted before they are shuffled, so a frequent n-gram is one row a chunk.
    The count tables are partitioned by ranges of the hash and joined to every
    chunk's n-grams there; the totals return to the chunk, where they are
    summed per document.  Grams are 64-bit hashes.
    """
    if not 1 <= order <= 8:
        raise ValueError("order must be 1 to 8")
    t = text_of(docs, id_col, text_col)
    size = t.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = min(MAX_BUCKETS, max(16, chunks))
    kind = t.schema["doc_id"].dataType.simpleString()
    t = map_batches(t.withColumn("h", F.xxhash64("doc_id", "text")), lambda b: dealt(b, chunks), "chunk long, docs binary", rows=10000).repartition(chunks, "chunk")
    # the same exchange of the texts serves both reads
    totals = (t.mapInArrow(lambda b: exploded(b, order, buckets), "bucket int, chunk long, grams binary, counts binary")
              .repartition(buckets, "bucket").mapInArrow(joined, "chunk long, bucket int, totals binary"))
    return t.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        lambda a, b: scored(a, b, order, backoff),
        f"doc_id {kind}, n_tokens long, log_score double, mean_log_score double, n_top_order long, n_unseen long")
