"""N-gram counts of several models in one reading of the texts.

A task numbers characters and syllables, packs each n-gram into one integer and counts by sorting, so what leaves it is a
row for each distinct n-gram, not one for each place. Counts are exact: a number stands for one n-gram alone, and what
does not fit 64 bits is counted row by row. Syllables never cross white space, so each distinct word is cut once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.functions.scripts import segmenter
from lexisift.functions.text import BLANKS
from lexisift.operators.ngrams import END, PAD, START, STOP

#: N-grams a task holds of each model before it hands them on, and words and syllables it knows at a time.
HELD, WORDS, KNOWN = 1 << 21, 1 << 19, 1 << 15
#: Syllables that 16 bits number, and characters a task takes at a time.
MOST, SLICE = 1 << 16, 1 << 21

#: White space of the segmenter, which unlike ``BLANKS`` has no separators of information.
_WHITE = re.sub("[\x1c-\x1f]", "", BLANKS)
_SCRIPT = [chr(c) for c in range(0x1780, 0x1800)]


def python_pattern(pattern: str) -> str:
    """A segmenter's pattern for Python's engine."""
    out = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern.replace("(?U)", ""))
    return out.replace(r"\s]", f"{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


def _packed(ids: np.ndarray, stops: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n-grams of ids as integers; stops: places of the last unit of each text, after which none goes on."""
    size = len(ids) - n + 1
    out = ids[:size].astype(np.uint64)
    for k in range(1, n):
        out <<= np.uint64(bits)
        out |= ids[k : size + k]
    fit = np.ones(size, bool)
    for k in range(n - 1):
        at = stops - k
        fit[at[at < size]] = False
    return out[fit]


def _padded(ids: np.ndarray, sizes: np.ndarray, n: int, first: int, last: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of ``sizes`` ids each with n - 1 pads at both ends and a stop, and the places of the stops."""
    ends = np.cumsum(sizes + 2 * n - 1)
    out = np.full(ends[-1] if len(ends) else 0, last, np.uint64)
    begins = ends - sizes - 2 * n + 1
    for k in range(n - 1):
        out[begins + k] = first
    out[np.arange(len(ids)) + np.repeat(begins + n - 1 - (np.cumsum(sizes) - sizes), sizes)] = ids
    out[ends - 1] = stop
    return out, ends - 1


class _Counts:
    """Distinct integers and how often each has come."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        if not len(self.keys):
            self.keys, self.n = keys, n
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        old = self.keys[at] == keys
        self.n[at[old]] += n[old]
        if not old.all():
            both = np.concatenate([self.keys, keys[~old]])
            order = np.argsort(both, kind="stable")
            self.keys, self.n = both[order], np.concatenate([self.n, n[~old]])[order]


def _rows(model: int, ngrams: list[str], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), model, np.int32)), pa.array(ngrams, pa.string()), pa.array(n.astype(np.int64))], ["model", "ngram", "cnt"])


class _Chars:
    """Counts of a text's script part by character models."""

    def __init__(self, models: list[tuple[int, int]], held: int = HELD) -> None:
        self.models, self.counts, self.held = models, {n: _Counts() for _, n in models}, held
        self.letters = np.array([ord(c) for c in ["\x00", *_SCRIPT, *BLANKS, PAD, STOP]], np.uint32)
        self.number = np.zeros(0x110000, np.uint8)
        self.number[self.letters[1:-2]] = np.arange(1, len(self.letters) - 2, dtype=np.uint8)

    def take(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        texts = [x for x in texts if x and not x.isspace()]
        if not texts:
            return
        ids = self.number[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum([0, *map(len, texts[:-1])])
        sizes = np.add.reduceat(ids > 0, starts, dtype=np.int64)
        ids, sizes = ids[ids > 0], sizes[sizes > 0]
        if not len(ids):
            return
        pad, stop = len(self.letters) - 2, len(self.letters) - 1
        for model, n in self.models:
            self.counts[n].add(_packed(*_padded(ids, sizes, n, pad, pad, stop), n, 8))
            if len(self.counts[n].keys) >= self.held:
                yield from self.given(model, n)

    def given(self, model: int, n: int) -> Iterator[pa.RecordBatch]:
        c, self.counts[n] = self.counts[n], _Counts()
        for k in range(0, len(c.keys), 1 << 16):
            keys = c.keys[k : k + (1 << 16), None]
            each = self.letters[(keys >> np.arange(8 * (n - 1), -1, -8, dtype=np.uint64)) & np.uint64(255)]
            whole = each.astype(np.uint32).tobytes().decode("utf-32-le")
            yield _rows(model, [whole[i : i + n] for i in range(0, len(whole), n)], c.n[k : k + (1 << 16)])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for model, n in self.models:
            yield from self.given(model, n)


class _Words(dict):
    """The number of each word, whose valid syllables lie in one array one after another."""

    def __init__(self, method: str) -> None:
        self.cut = re.compile(python_pattern(segmenter(method))).findall
        self.names = [STOP, START, END]
        self.forget()

    def forget(self) -> None:
        """Without words, as they are many; the numbers of valid syllables stay."""
        self.clear()
        self.known = {x: k for k, x in enumerate(self.names) if k > 2}
        self.ids, self.ends = array("q"), array("q", [0])

    def valid(self, x: str) -> bool:
        script = sum("\u1780" <= c <= "\u17ff" for c in x)
        solid = sum(c not in BLANKS for c in x)
        return solid > 0 and len(x) <= 10 and script >= 0.5 * solid

    def __missing__(self, word: str) -> int:
        for x in self.cut(word):
            at = self.known.get(x)
            if at is None:
                at = -1
                if self.valid(x):
                    at = len(self.names)
                    self.names.append(x)
                self.known[x] = at
            if at >= 0:
                self.ids.append(at)
        self.ends.append(len(self.ids))
        self[word] = at = len(self.ends) - 2
        return at


class _Syllables:
    """Counts of a text's valid syllables by syllable models."""

    def __init__(self, models: list[tuple[int, int]], method: str, held: int = HELD, words: int = WORDS, known: int = KNOWN, most: int = MOST) -> None:
        self.models, self.method, self.held, self.limits = models, method, held, (words, known, most)
        self.white = re.compile(f"[^{_WHITE}]+").findall
        self.fresh()

    def fresh(self) -> None:
        self.words, self.counts = _Words(self.method), {n: _Counts() for _, n in self.models}

    def split(self, text: str) -> list[str]:
        text = text.replace("\u200b", "")
        return self.white(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def take(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        if len(self.words.names) > self.limits[1]:
            yield from self.rest()
        elif len(self.words) > self.limits[0]:
            self.words.forget()
        numbers = [list(map(self.words.__getitem__, self.split(x))) for x in texts]
        each = np.array([k for x in numbers for k in x], np.int64)
        ends, ids = np.array(self.words.ends, np.int64), np.array(self.words.ids, np.uint64)
        begins, lengths = ends[:-1][each], (ends[1:] - ends[:-1])[each]
        ids = ids[np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, numbers)])]
        sizes = upto[1:] - upto[:-1]
        for model, n in self.models:
            fit = sizes >= n
            if not fit.any():
                continue
            padded, stops = _padded(ids[np.repeat(fit, sizes)], sizes[fit], n, 1, 2, 0)
            if n <= 4 and len(self.words.names) <= self.limits[2]:
                self.counts[n].add(_packed(padded, stops, n, 16))
                if len(self.counts[n].keys) >= self.held:
                    yield from self.given(model, n)
            else:
                inside = np.ones(len(padded) - n + 1, bool)
                for k in range(n - 1):
                    at = stops - k
                    inside[at[at < len(inside)]] = False
                rows, cnt = np.unique(np.lib.stride_tricks.sliding_window_view(padded, n)[inside], axis=0, return_counts=True)
                yield from self.named(model, rows, cnt)

    def named(self, model: int, rows: np.ndarray, cnt: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = np.array(self.words.names, object)
        for k in range(0, len(cnt), 1 << 16):
            yield _rows(model, [" | ".join(x) for x in names[rows[k : k + (1 << 16)]]], cnt[k : k + (1 << 16)])

    def given(self, model: int, n: int) -> Iterator[pa.RecordBatch]:
        c, self.counts[n] = self.counts[n], _Counts()
        yield from self.named(model, (c.keys[:, None] >> np.arange(16 * (n - 1), -1, -16, dtype=np.uint64)) & np.uint64(65535), c.n)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for model, n in self.models:
            yield from self.given(model, n)
        self.fresh()


def _tasks(texts: Iterator[str], models: list[tuple[str, int]], method: str = "regex_advanced", size: int = SLICE, held: int = HELD, **limits: int) -> Iterator[pa.RecordBatch]:
    """The counts of some texts, an n-gram in one row or several."""
    chars, syllables = ([(k, n) for k, (kind, n) in enumerate(models) if (kind == "char") == c] for c in (True, False))
    counters = [_Chars(chars, held), _Syllables(syllables, method, held, **limits)]
    some, taken = [], 0
    for x in texts:
        some.append(x)
        taken += len(x)
        if taken >= size:
            for c in counters:
                yield from c.take(some)
            some, taken = [], 0
    for c in counters:
        yield from c.take(some)
        yield from c.rest()


def counted(texts: DataFrame, text: str, models: list[tuple[str, int]], method: str = "regex_advanced") -> DataFrame:
    """(model, ngram, cnt) of models (kind, n), model the place in the list: what ``ngrams.train`` counts of their units.

    kind is char, for ``ngrams.char_units``, n at most 8, else that of ``ngrams.syllable_units``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tasks((x or "" for batch in batches for x in batch.column(0).to_pylist()), models, method)

    each = texts.select(text).mapInArrow(run, "model int, ngram string, cnt bigint")
    return each.groupBy("model", "ngram").agg(F.sum("cnt").alias("cnt"))
