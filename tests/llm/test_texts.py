"""Operators on documents against brute force, on a table with odd rows and on an empty one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from flowlens.llm import common, exact_dedup, lm_scoring, packing, sentencepiece_bpe, simhash, suffix_dedup


def key(r):
    return tuple((x is not None, x) for x in r)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


# packing -----------------------------------------------------------------------------------


def expected_pieces(rows, most):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(common.tokenizer_path(packing.TOKENIZER))
    out = []
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out += [(i, k, s, len(ids[s:s + most]), zlib.crc32(ids[s:s + most].tobytes())) for k, s in enumerate(range(0, len(ids), most))]
    return sorted(out, key=key)


def test_packing(corpus):
    rows, df = corpus
    got = packing.best_fit_packing(df).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == expected_pieces(rows, 2048)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) * 11 // 9 + 1


def test_packing_empty(nothing):
    assert packing.best_fit_packing(nothing).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    room = rng.choice([5, 16, 64])
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, room + 1), rng.randint(1, room))}
    ranks, used = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, number, seq, offset in packing.plan(counts, room):
        ranks[length] += range(first, first + number)
        for s in range(seq, seq + number):
            used[s].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= room


def test_encoder_on_odd_characters():
    from tokenizers import Tokenizer
    path = common.tokenizer_path(packing.TOKENIZER)
    e, tk, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(2)
    alphabet = "abcXYZ 0123'sŚeéÉİΣσ .,!?<|>\n\t\x1c\x85\xa0 ²ªß\x01\x00中\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["don't I'LL <|endoftext|>a <|startoftext|> b"]
    want = [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]
    for end in (None, 7):
        ids, n = e.encode(pa.array(texts), end)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [w + ([7] if end else []) for w in want]


def test_encoder_of_another_tokenizer_file(tmp_path):
    """A file with other steps is not cut at white space: the library encodes whole texts."""
    import json

    from tokenizers import Tokenizer
    with open(common.tokenizer_path(packing.TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}]}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    e, tk, texts = packing.Encoder(path), Tokenizer.from_file(path), ["Upper lower", "", " a  b ", "don't"]
    ids, n = e.encode(pa.array(texts), 0)
    assert not e.known and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids + [0] for x in tk.encode_batch(texts, add_special_tokens=False)]


def test_encoder_tables_are_bounded_by_bytes(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "CACHE_BYTES", 5000)
    path = common.tokenizer_path(packing.TOKENIZER)
    e, tk, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(8)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 400)}x" for _ in range(20)) for _ in range(3)]
        ids, n = e.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]
        for table in (e.words, e.chunks):
            assert table.keys.nbytes + table.ids.nbytes + table.begin.nbytes < 5000 + 60 * 100


def test_encoder_on_every_plain_character():
    import unicodedata

    from tokenizers import Tokenizer
    path = common.tokenizer_path(packing.TOKENIZER)
    e, tk = packing.Encoder(path), Tokenizer.from_file(path)
    plain = [chr(c) for c in (*range(0x21, 0x7f), *range(0xa1, 0x250))]
    assert all(unicodedata.normalize("NFC", "a" + c + c + "e") == "a" + c + c + "e" for c in plain)
    texts = [f"{c} {c}{c} a{c}b A{c}{d}Z '{c}'S {c}'t{d}" for c, d in zip(plain, plain[7:] + plain[:7], strict=True)]
    ids, n = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]


# SentencePiece ---------------------------------------------------------------------------------


def test_sentencepiece(corpus):
    import sentencepiece
    rows, df = corpus
    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(sentencepiece_bpe.MODEL))
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows_of(sentencepiece_bpe.encode_decode(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def test_sentencepiece_keeps_ids_and_text(corpus):
    rows, df = corpus
    got = sentencepiece_bpe.encode_decode(df.where("doc_id = 9002"), keep=True).first()
    assert got.decoded == "Ä  ß\tx\n" and len(got.ids) == got.n_tokens


def test_sentencepiece_on_odd_characters():
    import sentencepiece
    path = common.tokenizer_path(sentencepiece_bpe.MODEL)
    table, sp, rng = sentencepiece_bpe.PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    alphabet = list("aabbeestth   \n\n\t\r\x00▁éß中文\U0001f600<>0x1A/s' ") + ["<s>", "</s>", "<0x0A>", "   ", "the", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    assert [[int(x) for x in b[:-1].split(b",")] if b else [] for b in table.encode([t.encode() for t in texts])] == sp.encode(texts)


def test_sentencepiece_empty(nothing):
    assert sentencepiece_bpe.encode_decode(nothing).count() == 0


# repeated strings --------------------------------------------------------------------------------


def brute_repeats(rows, width):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p:p + width]] > 1:
                gone[p:p + width] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [4096, 1, 0.25])
def test_suffix_dedup(spark, block):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    lines = [text(rng.randint(5, 30)) for _ in range(8)]
    rows = [(None, None), (0, ""), (1, "a" * 300), (1, "a" * 300), (2, "ab" * 200), (3, "ba" * 50), (4, None)]
    for i in range(5, 90):
        t = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(lines)[rng.randint(0, 10):] + text(rng.randint(0, 15))
        rows.append((i, t))
    rows += [rows[40], (None, rows[50][1]), (300, rows[30][1][:100] + "tail")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = suffix_dedup.suffix_dedup(df, length=40, core=12, block=block)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 40)


def test_suffix_dedup_on_documents(corpus):
    rows, df = corpus
    assert rows_of(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)


def test_suffix_dedup_empty(nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_deep_shallow_sorts():
    import os
    rng = random.Random(1)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[:rng.randint(0, 60)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 40))]
        order, lcp = suffix_dedup.deep_shallow(strings)
        found = [strings[i] for i in order]
        assert sorted(order) == list(range(len(strings))) and found == sorted(strings)
        assert lcp[1:] == [len(os.path.commonprefix(found[k - 1:k + 1])) for k in range(1, len(found))]


# SimHash and exact copies --------------------------------------------------------------------------


def slow_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in ([b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash(corpus, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rows, df = corpus
    rows = [r for r in rows if r[0] is not None]
    f = [slow_fingerprint(t) for _, t in rows]
    root = components_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3])
    low = {}
    for (i, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, i), i)
    want = sorted((i, f"{x:016x}", low[r]) for (i, _), x, r in zip(rows, f, root, strict=True))
    got = sorted((r.doc_id, f"{r.fp & (2 ** 64 - 1):016x}", r.component_id) for r in simhash.simhash_groups(df.where("doc_id is not null")).collect())
    assert got == want


def test_simhash_finds_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 40)).astype(np.uint64)) for k in (1, 2, 3, 3, 4, 5)]]))
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp.view(np.int64))], "fp long, node long")
    got = components_of(len(fp), [(r.a, r.b) for r in simhash.fingerprint_links(df).collect()])
    want = components_of(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_simhash_keeps_one_of_each_group(spark):
    rows = [(5, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (7, "quite another text here"), (8, "ALPHA beta gamma delta"), (None, "x"), (9, "last one")]
    kept = simhash.keep_one_per_group(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=key) == sorted([rows[4], rows[0], rows[1], rows[2], rows[5]], key=key)


def test_simhash_broadcasts_no_table_that_grows(spark, monkeypatch):
    from flowlens.llm import components
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.stored(df, name)
    monkeypatch.setattr(simhash, "stored", seen)
    monkeypatch.setattr(components, "stored", seen)
    docs = spark.createDataFrame([(i, f"one two three four {i // 2} five six") for i in range(20)], "doc_id long, text string")
    out = simhash.simhash_groups(docs)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert out.where("component_id <> doc_id").count() >= 10
    assert {"anchors", "links", "out"} <= {n for n, _ in plans}
    assert [n for n, p in plans if "Broadcast" in p] == []


def test_simhash_empty(nothing):
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("k", [1024, 3])
def test_exact_dedup(corpus, k):
    rows, df = corpus
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode().lower()).digest()].append(i)
    want = sorted(((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=key)
    got = exact_dedup.exact_dedup(df, k=k)
    assert rows_of(got, "doc_id", "keep_id", "group_size") == want
    assert sum(r.kept for r in got.collect()) == len(groups)
    kept = exact_dedup.keep_one_copy(df, k=k)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_exact_dedup_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_one_copy(nothing).count() == 0


# language model --------------------------------------------------------------------------------------


def brute_scores(rows, order, backoff=0.4):
    total, docs = collections.Counter(), []
    for _, t in rows:
        w = [x for x in re.split(r"[ \t\n\r\x0b\x0c]+", (t or "").lower()) if x] + ["</s>"]
        p = ["<s>"] * (order - 1) + w
        c = collections.Counter(tuple(p[i - k + 1:i + 1]) for i in range(order - 1, len(p)) for k in range(1, order + 1))
        c.update(("<s>",) * k for k in range(1, order))
        docs.append((w, p, c))
        total.update(c)
    n, out = sum(len(w) for w, _, _ in docs), []
    for (i, _), (w, p, c) in zip(rows, docs, strict=True):
        s = 0.0
        for j in range(order - 1, len(p)):
            for k in range(order, 0, -1):
                g = tuple(p[j - k + 1:j + 1])
                f = total[g] - c[g]
                if k == 1:
                    s += (order - 1) * math.log(backoff) + math.log(max(f, 1) / max(n - len(w), 1))
                elif f > 0 and total[g[:-1]] - c[g[:-1]] > 0:
                    s += (order - k) * math.log(backoff) + math.log(f / (total[g[:-1]] - c[g[:-1]]))
                    break
        out.append((i, len(w), round(s, 4)))
    return sorted(out, key=key)


@pytest.mark.parametrize("order,chunk", [(1, 8 << 20), (2, 40000), (3, 8 << 20)])
def test_lm_score(corpus, monkeypatch, order, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    rows, df = corpus
    got = [(i, n, round(s, 4)) for i, n, s in rows_of(lm_scoring.lm_score(df, order=order), "doc_id", "n_tokens", "log_score")]
    want = brute_scores(rows, order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-3


def test_lm_score_empty(nothing):
    assert lm_scoring.lm_score(nothing).count() == 0


def test_lm_score_counts_trigrams_in_production(spark):
    rows = [(1, "x a b c"), (2, "y a b c")]
    got = rows_of(lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_tokens", "log_score", "n_top_order")
    assert [(i, n, round(s, 4)) for i, n, s, _ in got] == [(i, n, round(s, 4)) for i, n, s in brute_scores(rows, 3)]
    assert [top for *_, top in got] == [2, 2]  # "a b c" and "b c" with the end; bigrams alone would give 3


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256, 2 ** 64 - 1], list(range(5000))])
def test_packed_integers_and_hashes_come_back(values):
    x = np.array(values, np.uint64)
    assert lm_scoring.unpack(lm_scoring.pack(x)).tolist() == values
    if values:
        assert lm_scoring.unpack_hashes(lm_scoring.pack_hashes(x)).tolist() == values


def test_repeated_rows_are_dealt_to_many_chunks():
    rows = pa.RecordBatch.from_pydict({"doc_id": [7] * 600 + list(range(400)), "text": ["same words"] * 600 + [f"text {i}" for i in range(400)],
                                       "h": [-5] * 600 + list(range(400))})
    out = lm_scoring.dealt(rows, 20)
    parts = [lm_scoring.opened(pa.chunked_array([out.column("docs").slice(i, 1)])) for i in range(out.num_rows)]
    assert sorted(out.column("chunk").to_pylist()) == list(range(20)) and {t.num_rows for t in parts} == {50}
    assert sorted(d for t in parts for d in t.column("doc_id").to_pylist()) == sorted(rows.column("doc_id").to_pylist())


def test_lm_score_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 200)
    rows = [(1, "a b c d e f")] * 40 + [(2, None), (3, "a b x")]
    got = rows_of(lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_tokens", "log_score")
    want = brute_scores(rows, 3)
    assert [x[:2] for x in got] == [x[:2] for x in want] and max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-3
