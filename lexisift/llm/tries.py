"""Unigram token counts of documents by dynamic programming over a trie of distinct pre-tokens.

A pre-token is segmented into the vocabulary's tokens with the largest sum of scores. The best sum up to a byte depends
on the bytes before it alone, so pre-tokens that share a prefix share its forward scores: each distinct pre-token goes
into a trie, a node's score is computed once, and its terminal count (the tokens on the best path) is stored there.
Pre-tokens of over ``LONG`` bytes share nothing worth a node: they are scored alone, in a ring of the last scores.
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.bpe import PATTERN, byte_letters

#: Scores are whole numbers of this part of a nat, so sums are exact.
SCALE = 1_000_000
LONG = 4096


def scores(path: str) -> dict[bytes, int]:
    """Unigram scores of a vocabulary file's tokens by Zipf's law over their ids: -ln(id + 1), less the same sum for all."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    total = math.log(sum(1 / (i + 1) for i in vocab.values()))
    return {bytes(letters[x] for x in t): round((-math.log(i + 1) - total) * SCALE) for t, i in vocab.items()}


class Trie:
    """The trie of pre-tokens; it starts anew when it has grown to ``most`` nodes (and ``LONG`` at most), which changes no count."""

    def __init__(self, score: dict[bytes, int], most: int = 1_000_000):
        self.score, self.most = score, most
        self.longest = max(map(len, score))
        # Ends of tokens by their reversed bytes: a walk back from a node meets every token that ends there.
        self.ends: dict = {}
        for t, s in score.items():
            at = self.ends
            for b in reversed(t):
                at = at.setdefault(b, {})
            at[-1] = s
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # node * 256 + byte -> node
        self.best, self.count, self.parent, self.byte = array("q", [0]), array("q", [0]), array("q", [0]), bytearray(1)
        self.words: dict[str, int] = {}

    def grow(self, node: int, b: int) -> int:
        """A new child of ``node``, with its forward score and count. Equal sums take the path of fewer tokens."""
        new = len(self.best)
        self.children[node << 8 | b] = new
        best, count, parent, byte = self.best, self.count, self.parent, self.byte
        top, least, at, ends = None, 0, node, self.ends.get(b)
        while ends is not None:
            s = ends.get(-1)
            if s is not None:
                s += best[at]
                if top is None or s > top or s == top and count[at] + 1 < least:
                    top, least = s, count[at] + 1
            if not at:
                break
            ends = ends.get(byte[at])
            at = parent[at]
        best.append(top)
        count.append(least)
        parent.append(node)
        byte.append(b)
        return new

    def alone(self, data: bytes) -> int:
        """The terminal count of a long pre-token, by the same scores in memory for one token's length."""
        ring = self.longest + 1
        best, count = [0] * ring, [0] * ring
        for end in range(1, len(data) + 1):
            top, least, at, ends = None, 0, end - 1, self.ends.get(data[end - 1])
            while ends is not None:
                s = ends.get(-1)
                if s is not None:
                    s += best[at % ring]
                    if top is None or s > top or s == top and count[at % ring] + 1 < least:
                        top, least = s, count[at % ring] + 1
                if not at:
                    break
                at -= 1
                ends = ends.get(data[at])
            best[end % ring], count[end % ring] = top, least
        return count[len(data) % ring]

    def tokens(self, word: str) -> int:
        """The terminal count of a pre-token."""
        n = self.words.get(word)
        if n is None:
            if len(word) > LONG // 4 and len(data := word.encode("utf-8", "surrogatepass")) > LONG:
                return self.alone(data)
            if len(self.best) > self.most:
                self.clear()
            node, children = 0, self.children
            for b in word.encode("utf-8", "surrogatepass"):
                child = children.get(node << 8 | b)
                node = self.grow(node, b) if child is None else child
            n = self.words[word] = self.count[node]
        return n


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """For each row of (doc_id, text): n_bytes, n_pretokens and n_tokens of the whole text.

    Null text counts as empty: no tokens. A null doc_id stays null; repeated rows are counted each on its own; an empty
    table gives no rows; other columns are ignored. Each task keeps a trie of bounded size; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores(path))
        find = regex.compile(PATTERN).findall
        for batch in batches:
            size, pieces, tokens = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                parts = find(text)
                known = trie.words
                total = 0
                for w in parts:
                    n = known.get(w)
                    if n is None:
                        n = trie.tokens(w)
                        known = trie.words
                    total += n
                size.append(len(text.encode("utf-8", "surrogatepass")))
                pieces.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, pieces, tokens))], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
