"""Words and word shingle sets of whole texts as 64-bit hashes, by numpy over the bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Fixed value: the bytes between words (space and \\t to \\r).
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Words of more bytes are hashed by a digest, so that arrays stay small whatever the text.
_LONG = 1 << 16
_LONG_WORD = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{%d,}" % (_LONG + 1))  # tried at the begin of a word alone
#: A slice's arrays stay in a core's cache.
_SLICE = 1 << 15
_BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _POWERS, _INVERSES = (np.multiply.accumulate(np.array([1] + [x] * (_SLICE + _LONG), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slice_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes' places of the words of a text without long words."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 0x20) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    # Letters weighted by powers of their place in the word, summed over each word: sums over the slice by powers of the
    # place in it, their differences divided by the power of the word's place, which is odd and so has an inverse.
    value = (data | ((data - np.uint8(0x41) < 26).view(np.uint8) << 5)).astype(np.uint64)
    value += np.uint64(1)
    value *= _POWERS[: len(value)]
    sums = np.zeros(len(value) + 1, np.uint64)
    np.add.accumulate(value, out=sums[1:])
    return mix((sums[end] - sums[begin]) * _INVERSES[begin] + (end - begin).astype(np.uint64)), begin


def _may_have_long(text: bytes) -> bool:
    """Whether half a long word's bytes are without a gap somewhere; no long word is missed, and few bytes are read."""
    half = _LONG // 2
    return any(not _GAP.search(text, k, k + half) for k in range(0, len(text) - half + 1, half))


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the text, A-Z lower-cased, in order, and where each begins.

    The text is worked through in slices of some kilobytes that end between words.
    """
    hashes, places, at = [], [], 0

    def plain(end: int) -> None:
        nonlocal at
        while at < end:
            gap = _GAP.search(text, at + _SLICE, end) if end - at > _SLICE else None
            cut = gap.start() if gap else end
            h, b = _slice_words(text[at:cut])
            hashes.append(h)
            places.append(b + at)
            at = cut

    for word in _LONG_WORD.finditer(text) if _may_have_long(text) else ():
        plain(word.start())
        hashes.append(np.frombuffer(hashlib.blake2b(word[0].lower(), digest_size=8).digest(), np.uint64))
        places.append(np.array([word.start()]))
        at = word.end()
    plain(len(text))
    if len(hashes) == 1:
        return hashes[0], places[0]
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *places])


def word_hashes(text: bytes) -> np.ndarray:
    return words_at(text)[0]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``words`` words; of the whole sequence if there are fewer; none without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD1342543DE82EF95) + w[k : len(w) - n + 1 + k]
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))
