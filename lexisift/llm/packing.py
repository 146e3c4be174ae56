"""Packing token sequences into windows of fixed length by best-fit decreasing.

A document's tokens (its ids and one end id) are first cut into full windows; what remains (shorter than a window) is
packed by best-fit decreasing: longest first, each into the open window with the least room that still holds it. A
segment tree over the remaining capacities finds that window in logarithmic time. Rows are dealt by a hash of their
place into blocks of about ``block``, each packed on its own, so memory is bounded whatever rows repeat, and all blocks
run in parallel; only one short row for each document is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.bpe import codec
from lexisift.llm.common import stored

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Capacities:
    """Open windows by remaining capacity: a segment tree whose leaves count the windows with that much room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of ``least`` or more."""
        count, k = self.count, least + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until a right neighbour holds something
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """The window and offset of each length (all from 1 to ``window``), and the number of windows. Longest first; ties keep their order."""
    room = Capacities(window)
    at, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        found = room.take(size)
        if found is None:
            found = (window, n)
            n += 1
        left, at[i] = found
        offset[i] = window - left
        if left > size:
            room.add(left - size, at[i])
    return at, offset, n


class Ids:
    """Token ids of texts with an end id, by the fast public encoder on the same vocabulary.

    The merges of the file are checked to be in the order of the ids, which makes that encoder's ranks the same merges.
    Texts on which its splitter gives up (huge runs of white space) go through the codec of this package.
    """

    def __init__(self, path: str, end: int):
        import tiktoken

        self.exact, self.end = codec(path), end
        c = self.exact
        if c.ids[256:] != sorted(c.ids[256:]):
            raise ValueError("the merges are not in the order of the ids")
        self.plain = tiktoken.Encoding("packing", pat_str=c.find.__self__.pattern, mergeable_ranks={p: c.ids[k] for p, k in c.age.items()}, special_tokens=c.added)

    def __call__(self, text: str | None) -> np.ndarray:
        try:
            ids = self.plain.encode(text or "", allowed_special="all")
        except BaseException as e:  # a panic of the splitter, which is no Exception and has no class to import
            if type(e).__name__ != "PanicException":
                raise
            ids = self.exact.encode(text)
        ids.append(self.end)
        return np.array(ids, "<u4")


def tokens(docs: DataFrame, path: str, window: int = 1024, end: int = 0) -> DataFrame:
    """One row for each row of (doc_id, text): doc_tokens and the CRC-32 of each window of its ids, the last one short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(path, end)
        for batch in batches:
            n, sums = [], []
            for x in batch.column(1):
                ids = ids_of(x.as_py())
                n.append(len(ids))
                sums.append([zlib.crc32(ids[k : k + window].tobytes()) for k in range(0, len(ids), window)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, doc_tokens bigint, sums array<bigint>")


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0, block: int = 8192) -> DataFrame:
    """Pieces of all rows of (doc_id, text), each with its place: sequence_id and offset.

    Null text counts as empty and is the end id alone. Repeated rows are packed each on their own; a null doc_id stays
    null. Ties in length keep the order of doc_id, then of the checksums. An empty table gives no rows. Columns besides
    doc_id and text are ignored. Sequences are numbered block by block. Which rows share a block follows from how they
    lie in the files, so the same files give the same places.
    """
    found = stored(tokens(docs, path, window, end), "tokens")
    blocks = max(1, -(-found.count() // block))
    # The place in the written table tells equal rows apart, and is the same when a task is run again.
    dealt = found.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(blocks)))

    def place(group: pa.Table) -> pa.Table:
        group = group.append_column("first", pc.list_element(group["sums"].combine_chunks(), 0))
        group = group.take(pc.sort_indices(group, sort_keys=[(k, "ascending") for k in ("doc_id", "doc_tokens", "first")]))
        base = group["block"][0].as_py() << 40
        sums = group["sums"].to_pylist()
        n = group["doc_tokens"].to_numpy()
        full, rest = n // window, n % window
        short = np.flatnonzero(rest)
        at, offset, used = best_fit(rest[short].tolist(), window)
        # First the full windows in order of the documents, then the remainders.
        which = np.repeat(np.arange(len(n)), full)
        begin = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
        order = np.concatenate([which, short])
        columns = [
            np.concatenate([begin * window, full[short] * window]),
            np.concatenate([np.full(len(which), window), rest[short]]),
            np.array([x for s, k in zip(sums, full) for x in s[:k]] + [sums[i][-1] for i in short], np.int64),
            n[order],
            base + np.concatenate([used + np.arange(len(which)), np.array(at, np.int64)]),
            np.concatenate([np.zeros(len(which), np.int64), np.array(offset, np.int64)]),
        ]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table([group["doc_id"].take(pa.array(order)), *(pa.array(c, pa.int64()) for c in columns)], names)

    return dealt.groupBy("block").applyInArrow(place, PIECES)
