"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_batches, sorted_groups, stored, text_of, texts_utf8
from .components import components, local_forest

SHINGLE = 3
MAX_BITS = 3
HOT_BUCKET = 4096  # larger anchor buckets are dealt out anew by bytes of the other half
LOW31 = np.uint64(0x7FFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(flat[s:e], 42) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = np.array(h[i:i + 65536], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long; null text counts as empty."""
    def one(batch):
        f = np.array([fingerprint(t, shingle) for t in texts_utf8(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f)], names=["doc_id", "fp"])
    t = text_of(docs, id_col, text_col)
    return map_batches(t, one, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Syndrome of 31-bit words under the Hamming(31, 26) code: the XOR of the 1-based places of their set bits."""
    s = np.zeros(len(x), np.uint64)
    for place in range(1, 32):
        s ^= ((x >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return s


def anchors_near(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codewords within distance 2 of 31-bit words, as (rows, codewords, is nearest).

    The code is perfect with covering radius 1 and minimum distance 3: a
    codeword has itself only; another word has the one at distance 1 (flip the
    bit its syndrome names) and 15 at distance 2 (flip i and j, i xor j = syndrome).
    """
    s, rows = syndrome(x), np.arange(len(x))
    one = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
    out = [(rows, x ^ one, np.ones(len(x), bool))]
    for i in range(1, 32):
        j = s ^ np.uint64(i)
        ok = (s > 0) & (j > i)
        flip = (np.uint64(1) << np.uint64(i - 1)) | (np.uint64(1) << (j[ok] - np.uint64(1)))
        out.append((rows[ok], x[ok] ^ flip, np.zeros(int(ok.sum()), bool)))
    return out


def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Copies of each fingerprint for every anchor of either half within covering radius + half threshold."""
    fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
    keys, fps, nodes, home = [], [], [], []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & LOW31
        for rows, word, near in anchors_near(x):
            keys.append((word | (np.uint64(half) << np.uint64(31))).astype(np.int64))
            fps.append(fp[rows])
            nodes.append(node[rows])
            home.append(near)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(home))],
        names=["anchor", "fp", "node", "home"])


def compare(batches, keys: list[str], max_bits: int):
    """Links within each bucket, from each row whose nearest anchor is this one to every row of the bucket; a spanning forest of them."""
    for t in sorted_groups(batches, keys):
        ks = [t.column(k).to_numpy() for k in keys]
        fp, node, home = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        new = np.ones(len(fp), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in ks], axis=0)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(fp))
        la, lb = [], []
        size = end - start
        # small buckets, all at once: row i against row i + d of its bucket
        last = np.repeat(end, size)
        small = np.repeat(size <= 64, size)
        for d in range(1, 64):
            i = np.flatnonzero(small & (np.arange(len(fp)) + d < last))
            if not len(i):
                break
            i = i[(home[i] | home[i + d])]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            la.append(node[i])
            lb.append(node[i + d])
        for s, e in zip(start[size > 64], end[size > 64], strict=True):
            h = s + np.flatnonzero(home[s:e])
            step = max(1, (1 << 22) // (e - s))
            for i in range(0, len(h), step):
                a, b = np.nonzero(np.bitwise_count(fp[h[i:i + step], None] ^ fp[None, s:e]) <= max_bits)
                v, w = local_forest(node[h[i:i + step]][a], node[s:e][b])
                la.append(v)
                lb.append(w)
        if la:
            v, w = local_forest(np.concatenate(la), np.concatenate(lb))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w)], names=["a", "b"])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links of a spanning forest over distinct fingerprints (fp, node) that differ in at most ``max_bits`` bits.

    Two fingerprints within 3 bits differ by at most 1 in one of their halves
    (of each half the low 31 bits count).  Anchors are the codewords of the
    perfect Hamming(31, 26) code of each half: every word has one within
    distance 1, and its partner lies within 1 + 1 of that one.  So each
    fingerprint is replicated to all anchors within 2 of either half (32
    copies at most) and compared, in full, per anchor with those at home there.
    Buckets above HOT_BUCKET are dealt out again by each byte of the other
    half (within 3 bits of four bytes one agrees), which loses no pair.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the covering radius is chosen for at most 3 differing bits")
    copies = map_batches(fps.select("fp", F.col("node").cast("long").alias("node")), replicate, "anchor long, fp long, node long, home boolean", rows=4000)
    size = copies.groupBy("anchor").agg(F.count("*").alias("n"), F.max(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes = 1").select("anchor", "n")
    # 32 copies a row: Spark sizes them as their one row and would send them all to the driver, so no side is broadcast
    copies = stored(copies.join(size.hint("merge"), "anchor"), "anchors")
    plain = (copies.where(F.col("n") <= HOT_BUCKET).select("anchor", "fp", "node", "home")
             .repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(lambda b: compare(b, ["anchor"], max_bits), "a long, b long"))
    other = F.when(F.shiftrightunsigned("anchor", 31) == 1, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    hot = (copies.where(F.col("n") > HOT_BUCKET)
           .select("anchor", "fp", "node", "home", other.alias("o"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("byte"))
           .withColumn("part", (F.col("byte") * 256 + F.expr("shiftrightunsigned(o, 8 * byte) & 255")).cast("int")).drop("o", "byte")
           .repartition("anchor", "part").sortWithinPartitions("anchor", "part")
           .mapInArrow(lambda b: compare(b, ["anchor", "part"], max_bits), "a long, b long"))
    return plain.union(hot)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id = smallest id reachable over links of at most ``max_bits`` bits.

    Null and empty texts have fingerprint 0 and link like any other; equal
    fingerprints link; repeated rows get one row each.  Ids must be integers;
    a row with a null id keeps a null component unless others share its group.
    Fingerprints are made distinct before any comparison, so groups of copies
    cost one row.  Empty input gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "distinct")
    comp = components(fingerprint_links(fps.where("node is not null"), max_bits))
    named = fps.join(comp.hint("merge"), "node", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "node").alias("c"))
    return rows.join(named.hint("merge"), "fp", "left").select("doc_id", "fp", F.coalesce("c", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id names their group, with all their columns.

    An id that several rows share goes only if all of them would, so no group
    loses the row that stands for it; rows without an id stay.
    """
    found = simhash_groups(docs, id_col, text_col, shingle, max_bits).where("doc_id is not null")
    i = free_name("__id", docs.columns)
    go = found.groupBy(F.col("doc_id").alias(i)).agg(F.min(F.col("doc_id") != F.col("component_id")).alias("go")).where("go").select(i)
    return docs.join(go, F.col(f"`{id_col}`") == F.col(i), "left_anti")
