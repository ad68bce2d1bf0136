"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, process_cache, stored, text_of, tokenizer_path

MAX_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
CACHE_BYTES = 40 << 20  # of either table of ids
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20  # texts encoded together
SALTS = 64


class IdTable:
    """Token ids of strings as flat arrays; beyond ``limit`` bytes only what the last call asked for is kept."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys = pa.array([], pa.large_string())
        self.ids, self.begin = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def ids_of(self, keys: pa.Array, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first place among them, number) for each of distinct keys; ``make`` gives (ids in order, number of each) of the unknown."""
        at = pc.index_in(keys, value_set=self.keys)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        new = keys.filter(pa.array(unknown))
        if len(new):
            ids, size = make(new.to_pylist())
            at[unknown] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))
            self.ids = np.concatenate((self.ids, ids))
        ids, first, size = self.ids, self.begin[at], self.begin[at + 1] - self.begin[at]
        if self.keys.nbytes + self.ids.nbytes + self.begin.nbytes > self.limit:
            self.keys, self.ids, self.begin = keys, gathered(ids, first, size), np.concatenate(([0], np.cumsum(size)))
        return ids, first, size


def gathered(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``first`` with ``size`` members, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((first - ends + size).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return ids[at]


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own, by white-space chunks that are each encoded once.

    The tokenizer drops white space and none of its steps looks across it, so
    a text's ids are those of its chunks in order.  Chunks are cut at the six
    ASCII white-space characters only; other white space stays inside a chunk
    and is the tokenizer's business.  A slice of texts is cut and its chunks are
    numbered by Arrow, so each distinct chunk is handled once, and the ids are
    gathered by number.  Chunks of ASCII and Latin letters and signs are split into
    words here, as the tokenizer's file says, and its model encodes each word
    once; all others, and those that may hold a special token, go through the
    whole tokenizer.  A file with other steps than KNOWN is not cut at all.
    """

    PLAIN = "^[!-~\u00a1-\u012f\u0131-\u024f]+$"  # normalization changes none of these; without the capital that becomes two characters
    LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u024f]+$"  # one word
    WORDS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # a line feed ends a chunk
    # fixed values: the steps that the cuts above follow
    KNOWN = {"normalizer": {"type": "Sequence", "normalizers": [
                {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
             "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
             "post_processor": None}

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)  # the same model, without the steps before it
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = all(spec.get(k) == v for k, v in self.KNOWN.items()) and spec["model"].get("end_of_word_suffix") == "</w>"
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.chunks, self.words = IdTable(CACHE_BYTES), IdTable(CACHE_BYTES)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Model ids of words, many at once; each word ends where a token does that ends one."""
        ids, size = [], []
        for i in range(0, len(words), 8192):
            part = words[i:i + 8192]
            got = np.array(self.model.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            n = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            if len(n) != len(part):
                each = [self.model.encode(w, add_special_tokens=False).ids for w in part]
                got, n = np.array([x for e in each for x in e], "<u4"), np.fromiter(map(len, each), np.int64, len(each))
            ids.append(got)
            size.append(n)
        return np.concatenate(ids), np.concatenate(size)

    def encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings by the whole tokenizer."""
        each = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *each]), np.fromiter(map(len, each), np.int64, len(each))

    def encode_plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, lower-cased; those not of letters alone are split into words together, as lines of one text."""
        low = pc.utf8_lower(chunks)
        single = pc.match_substring_regex(low, self.LETTERS)
        found = pa.array(self.WORDS.findall("\n".join([*low.filter(pc.invert(single)).to_pylist(), ""])), pa.large_string())
        line = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        single = single.to_numpy(zero_copy_only=False)
        owner = np.concatenate((np.flatnonzero(single), np.flatnonzero(~single)[np.cumsum(line)[~line]]))
        coded = pa.concat_arrays([low.filter(pa.array(single)), found.filter(pa.array(~line))]).dictionary_encode()
        order = np.argsort(owner, kind="stable")
        codes = coded.indices.to_numpy()[order]
        ids, first, size = self.words.ids_of(coded.dictionary, self.encode_words)
        of = size[codes]
        return gathered(ids, first[codes], of), np.bincount(owner[order], of, minlength=len(chunks)).astype(np.int64)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text); ``end`` follows every text's ids."""
        if self.known:
            words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
            flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy()
            full = pc.greater(pc.binary_length(flat), 0)
            flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
            coded = flat.dictionary_encode()
            distinct, codes = coded.dictionary, coded.indices.to_numpy()
            del words, flat, full, coded
            plain = pc.and_not(pc.match_substring_regex(distinct, self.PLAIN), pc.match_substring(distinct, "<|"))
            a, n_a = self.encode_plain(distinct.filter(plain))
            b, first_b, n_b = self.chunks.ids_of(distinct.filter(pc.invert(plain)), self.encode_whole)
            plain = plain.to_numpy(zero_copy_only=False)
            first, size = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
            first[plain], size[plain] = np.cumsum(n_a) - n_a, n_a
            first[~plain], size[~plain] = len(a) + first_b, n_b
            of = size[codes]
            ids = gathered(np.concatenate((a, b)), first[codes], of)
            n = np.bincount(owner, of, minlength=len(texts)).astype(np.int64)
        else:
            ids, n = self.encode_whole(texts.to_pylist())
        if end is None:
            return ids, n
        out = np.full(len(ids) + len(n), end, "<u4")
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = ids
        return out, n + 1


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, longer ones cut at ``max_tokens``.

    Null and empty texts are the end id alone.  ``ids``: little-endian 32-bit.
    """
    path = path or tokenizer_path(TOKENIZER)

    def one(batch):
        coder = process_cache(f"encoder:{path}", lambda: Encoder(path))
        ids, n = coder.encode(batch.column("text"), END_ID)
        row, piece, start, length, crc, raw = [], [], [], [], [], []
        whole, at, size = ids.tobytes(), 0, 4 * max_tokens
        for i, own in enumerate((4 * n).tolist()):
            for k, s in enumerate(range(0, own, size)):
                part = whole[at + s:at + min(s + size, own)]
                row.append(i)
                piece.append(k)
                start.append(s // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    raw.append(part)
            at += own
        cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    t = text_of(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    return map_batches(t, one, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, rows=SLICE_ROWS,
                       cache=f"encoder:{path}", size=SLICE_BYTES)


def plan(counts: dict[int, int], room: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, offset).

    The ``number`` pieces of that length from ``first rank`` on go to as many
    sequences from ``first sequence`` on, each at ``offset``.  Equal sequences
    are one group, so the work and the plan depend on the number of lengths
    (``room`` at most) and not on the number of pieces.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free places -> (first sequence, how many)
    free: list[int] = []  # free places that occur, ascending
    out, made = [], 0
    from bisect import bisect_left, insort

    def put(space: int, first: int, n: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(free, space)
        groups[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):  # no open sequence has room: open as many as the rest needs, filled evenly from the front
                n = -(-left // (room // length))
                put(room, made, n)
                made += n
                continue
            space = free[at]
            first, n = groups[space].pop()
            if not groups[space]:
                del groups[space]
                free.pop(at)
            n_put = min(n, left)
            out.append((length, rank, n_put, first, room - space))
            rank += n_put
            left -= n_put
            if n_put < n:
                put(space, first + n_put, n - n_put)
            if space > length:
                put(space - length, first, n_put)
    return out


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The histogram (at most ``max_tokens`` rows) is planned on the driver; the
    plan, bounded by the number of lengths, is broadcast.  Each piece gets its
    rank within its length: a salt from its key splits every length, however
    frequent, ranks are taken per (length, salt), and the salts' counts are
    added up over at most lengths x salts rows.  Pieces must be stored, since
    they are read twice.  Empty input gives an empty result; pieces with equal
    keys are interchangeable.
    """
    spark = parts.sparkSession
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, max_tokens)
    slots = spark.createDataFrame(rows or [], "length long, first_rank long, number long, first_sequence long, offset long")
    w = Window.partitionBy("length", "salt").orderBy(*[F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")])
    ranked = (salted.withColumn("rn", F.row_number().over(w)).join(before, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("rn") - 1))
    hit = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number"))
    return (ranked.join(F.broadcast(slots.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & hit)
            .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
            .select(*parts.columns, "sequence_id", "offset"))


def best_fit_packing(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack documents: the columns of ``pieces`` with sequence_id and offset."""
    return pack(stored(pieces(docs, path, max_tokens, id_col, text_col, keep_ids), "pieces"), max_tokens)
