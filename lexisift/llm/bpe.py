"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

The encoder reads one vocabulary file (JSON, with ``vocab`` and ``merges``) and gives the ids that applying the merges
in order gives. Longest tokens at each position come from one Aho-Corasick pass; a token may follow another only if
the pair is compatible, that is if no merge across their border would have happened first. When the longest token
cannot follow, the next shorter prefix token is tried, and at a dead end the last token is given back. Each position
is given up at most once, so the work is linear in the length of the piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes stand for themselves, others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Encoder and decoder for one vocabulary file; ``cache`` bounds the pieces whose ids are remembered."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(letters[x] for x in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Tokens are numbered by age: the bytes, then the merges in order. ids maps an age to the id in the file.
        pieces = [bytes([b]) for b in range(256)] + [raw(a) + raw(b) for a, b in merges]
        self.age = {}
        for k, p in enumerate(pieces):
            self.age.setdefault(p, k)
        back = {b: x for x, b in letters.items()}
        self.ids = [vocab.get("".join(back[b] for b in p), -1) for p in pieces]
        self.size = [len(p) for p in pieces]
        self.split = [(k, k) for k in range(256)] + [(self.age[raw(a)], self.age[raw(b)]) for a, b in merges]
        self.pair = {}
        for k, halves in enumerate(self.split[256:], 256):
            self.pair.setdefault(halves, k)
        self.shorter = [next((self.age[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.age), -1) for p in pieces]
        self.matches = ahocorasick.Automaton()
        for p, k in self.age.items():
            self.matches.add_word(p.decode("latin-1"), k)
        self.matches.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.cache = cache
        self.find = regex.compile(PATTERN).findall
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        # The offset table: token i is blob[start[i]:start[i + 1]].
        by_id = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        top = max(by_id) + 1
        self.length = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay apart: undoing their latest merges meets no older merge across the border."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        key, newest = (a, b), 1 << 60
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < newest:
                good = False
                break
            if a <= b and b >= 256:
                newest, b = b + 1, self.split[b][0]
            elif a > b:
                newest, a = a, self.split[a][1]
                if newest < 256:
                    good = True
                    break
            else:
                good = True
                break
        if len(self.fits) >= 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece (no border of the split pattern inside)."""
        whole = self.age.get(data)
        if whole is not None:
            return [self.ids[whole]]
        longest = [0] * len(data)
        size, shorter = self.size, self.shorter
        for end, k in self.matches.iter(data.decode("latin-1")):
            longest[end + 1 - size[k]] = k
        open_at = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, token, n = 0, longest[0], len(data)
        while at < n:
            end = at + size[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
        return [self.ids[k] for k in out]

    def _plain(self, text: str, out: list[int]) -> None:
        words = self.words
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.piece(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= self.cache:
                        words.clear()
                    words[w] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if self.cut is None or not any(x in text for x in self.added):
            self._plain(text, out)
            return out
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                self._plain(part, out)
        return out

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids (array of int).

    Null texts count as empty and give an empty array; long texts are encoded whole. A column named like ``ids`` is
    replaced. Rows are independent, so there is no shuffle and a lost task is simply run again.
    """
    kept = [c for c in df.columns if c != ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != ids) + f", `{ids}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = pa.array([c.encode(x) for x in part.column(part.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in kept), coded], [*kept, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give empty text, invalid UTF-8 gives U+FFFD."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([c.decode(x or []) for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in kept), texts], [*kept, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """For each row of (doc_id, text): counts and digests of the ids and of the text decoded from them.

    Null text counts as empty: no ids, and the digests of nothing. A doc_id of any whole type is given as bigint, null
    stays null. Repeated rows are coded each on their own; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = [str(i) for i in range(len(c.length))]
        for batch in batches:
            counts, coded, texts = [], [], []
            for x in batch.column(1):
                ids = c.encode(x.as_py())
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                texts.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
