"""SentencePiece BPE encoding by a prefix table, and decoding."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_batches, process_cache, text_of, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_UNITS = 400_000  # of each generation
CACHE_PAIRS = 2_000_000


class PieceTable:
    """Encoder of a BPE model with byte fallback.

    For every prefix of a string the encoding's last piece is unique: it is
    the one piece that ends there and, after the encoding of what is left,
    makes a pair that the merges themselves would leave as that pair.  An
    Aho-Corasick automaton names the pieces that end at each place, the table
    keeps the one that fits, and the ids are read off from the end.

    No piece holds a space but at its start, so a text's units (spaces and
    what follows) are encoded apart, each once; characters that no piece
    holds become their bytes and split a unit.
    """

    UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {self.piece[i]: (sp.get_score(i), i) for i in plain}
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256 or any(SPACE in p[1:] and p.strip(SPACE) for p in self.score):
            raise ValueError("a BPE model with byte fallback is needed, whose pieces hold spaces at their start only")
        self.chars = {c for p in self.score for c in p}
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.alone = {i: self.merge(self.piece[i]) == [i] for i in plain}
        self.units: tuple[dict, dict] = ({}, {})
        # what the library does to white space, asked of the library itself
        if sp.encode("a  b") != self.encode_units(f"{SPACE}a{SPACE}{SPACE}b"):
            raise ValueError("the model's normalizer is not the identity with a space put before the text")

    def merge(self, s: str) -> list[int]:
        """Ids of a short string by the merges themselves: best score first, then leftmost; -1 for a character without a piece."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.score.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.score[p][1] if p in self.score else -1 for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the pieces a, b as they are when they stand together."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def encode_run(self, s: str) -> list[int]:
        """Ids of a string of known characters by the prefix table."""
        last = [0] * (len(s) + 1)
        size = [0] * (len(s) + 1)
        fits, alone, compatible = self.fits, self.alone, self.compatible
        for end, (token, n) in self.automaton.iter(s):
            stop = end + 1
            if size[stop]:
                continue
            start = stop - n
            if start:
                if not size[start]:
                    continue
                ok = fits.get(last[start] << 32 | token)
                if ok is None:
                    ok = compatible(last[start], token)
            else:
                ok = alone[token]
            if ok:
                last[stop], size[stop] = token, n
        out, at = [], len(s)
        while at:
            if not size[at]:
                raise RuntimeError(f"no piece fits at {at} of {s!r}")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_units(self, s: str) -> list[int]:
        """Ids of a string whose spaces are already marked."""
        out, run = [], []
        for c in s:
            if c in self.chars:
                run.append(c)
                continue
            if run:
                out += self.encode_run("".join(run))
                run = []
            out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return out + self.encode_run("".join(run)) if run else out

    def learn(self, keys: set[bytes]) -> None:
        """Fill the table of units; a key is a unit without its first mark, or begins with a line break that has no space before it."""
        new, old = self.units
        if len(new) + len(keys) > CACHE_UNITS:
            new, old = {}, new
            self.units = (new, old)
        for k in keys:
            if k in old:
                new[k] = old[k]
                continue
            s = k.decode("utf-8", "replace")
            ids = self.encode_units(s if s[:1] == "\n" else SPACE + s.replace(" ", SPACE))
            new[k] = "".join([f"{i}," for i in ids]).encode()

    def keys(self, text: bytes) -> list[bytes]:
        """The units of a text, as keys of the table, in order."""
        if not text:
            return []
        if b"  " not in text and b" \n" not in text and b"\xe2\x96\x81" not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.replace(b"\n", b" \n").split(b" ")
        s = SPACE + text.decode("utf-8", "replace").replace(" ", SPACE)
        out = []
        for u in self.UNITS.findall(s):
            head, *lines = u.split("\n")
            out.append(head[1:].replace(SPACE, " ").encode())
            out += ["\n".encode() + x.encode() for x in lines]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Decimal ids of each text, each followed by a comma."""
        out, flat, ends = [], [], []
        for i, t in enumerate(texts):
            flat += self.keys(t)
            ends.append(len(flat))
            if len(flat) < CACHE_UNITS // 4 and i + 1 < len(texts):
                continue
            ids = list(map(self.units[0].get, flat))
            gaps = [k for k, x in enumerate(ids) if x is None]
            if gaps:
                self.learn({flat[k] for k in gaps})
                known = self.units[0]
                for k in gaps:
                    ids[k] = known[flat[k]]
            out += [b"".join(ids[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
            flat, ends = [], []
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids, by the library."""
        return self.library.decode(ids) if ids else []


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row.

    Ids are those of the library without begin and end marks; null and empty
    texts have none and decode to the empty text.  Rows are handled on their
    own, so repeated rows give equal results and an empty table none; only id
    and text are read.
    """
    path = path or tokenizer_path(MODEL)

    def one(batch):
        table = process_cache(f"pieces:{path}", lambda: PieceTable(path))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
        joined = table.encode(batch.column("text").cast(pa.binary()).to_pylist())
        ids = [np.fromstring(x, np.int32, sep=",").tolist() if x else [] for x in joined]
        texts = table.decode(ids)
        cols = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in joined]),
                pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in texts])]
        if keep:
            cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    t = text_of(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    return map_batches(t, one, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep, rows=1000, cache=f"pieces:{path}")
