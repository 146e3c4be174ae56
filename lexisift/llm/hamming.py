"""Exact top-k search over binary codes by multi-index hashing with growing radii.

A vector's code has one bit for each dimension, whether the value is positive. A code is cut into segments of about as
many bits as the block's codes need to be told apart; each segment has a table from value to codes. A code within
distance r of a query is within r // segments in some segment, so probing every segment's values at radius 0, 1, 2, ...
finds all codes up to segments * (radius + 1) - 1. A query grows its radius until its k-th verified distance is not
beyond what is covered; nothing else ends the search.

Rows are dealt into blocks of bounded size. A block's index is built once and the queries stream past it as codes of
a few bytes; the k best of each query and block are merged. Equal codes are searched as one and keep only their k
smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id bigint, query bigint, vec_id bigint, distance int"


def codes(vectors: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words with one bit for each dimension, zeros after them."""
    bits = np.packbits(vectors > 0, axis=1, bitorder="little")
    wide = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, wide)))).view(np.uint64)


def segments(dims: int, width: float) -> list[tuple[int, int]]:
    """(first bit, bits) of segments of about ``width`` bits, none across two words."""
    out = []
    for word in range(0, dims, 64):
        bits = min(64, dims - word)
        parts = max(1, round(bits / width))
        ends = [bits * i // parts for i in range(parts + 1)]
        out += [(word + a, b - a) for a, b in zip(ends, ends[1:])]
    return out


class Index:
    """Multi-index hash tables over distinct codes. width: bits of a segment, by default what tells the codes apart."""

    def __init__(self, words: np.ndarray, dims: int, width: float | None = None):
        self.words = words
        self.cuts = segments(dims, width or min(max(np.log2(max(len(words), 1)), 4.0), 22.0))
        self.tables = []
        for a, n in self.cuts:
            v = self.segment(words, a, n)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << n))])))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def segment(words: np.ndarray, a: int, n: int) -> np.ndarray:
        """Bits ``a`` to ``a + n`` of each code."""
        return ((words[:, a // 64] >> np.uint64(a % 64)) & np.uint64((1 << n) - 1)).astype(np.int64)

    def flips(self, n: int, r: int) -> np.ndarray:
        """All masks of ``n`` bits with ``r`` ones."""
        if (n, r) not in self.masks:
            self.masks[n, r] = np.array([sum(1 << i for i in c) for c in combinations(range(n), r)], np.int64)
        return self.masks[n, r]

    def probed(self, asked: np.ndarray, who: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) of all codes that differ from one of the queries ``who`` by ``radius`` bits in a segment."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for (a, n), (order, start) in zip(self.cuts, self.tables):
            if radius <= n:
                v = self.segment(asked[who], a, n)[:, None] ^ self.flips(n, radius)[None]
                low, size = start[v], start[v + 1] - start[v]
                hit = size > 0
                low, size, by = low[hit], size[hit], np.nonzero(hit)[0]
                found.append((np.repeat(who[by], size), order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def search(self, asked: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of the codes that hold the k nearest rows of each query, and each query's last radius.

        Ties at the k-th distance are all there. weight: how many rows each code stands for (k at most).
        """
        open_ = np.arange(len(asked))
        last, worst = np.zeros(len(asked), np.int64), np.full(len(asked), 1 << 30)
        who, code, far = (np.zeros(0, np.int64) for _ in range(3))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(who, code, far)]
        widest = max(n for _, n in self.cuts)
        for radius in range(widest + 1):
            q, c = self.probed(asked, open_, radius)
            d = np.bitwise_count(self.words[c] ^ asked[q]).sum(axis=1, dtype=np.int64)
            use = d <= worst[q]
            key, first = np.unique(np.concatenate([who * len(self.words) + code, q[use] * len(self.words) + c[use]]), return_index=True)
            who, code, far = key // len(self.words), key % len(self.words), np.concatenate([far, d[use]])[first]
            order = np.lexsort((far, who))
            who, code, far = who[order], code[order], far[order]
            total = np.cumsum(weight[code])
            begin = np.searchsorted(who, open_)
            before = np.concatenate([[0], total])[begin]
            at = np.searchsorted(total, before + k)  # where the k-th row of each open query lies, if it has so many
            enough = (at < np.searchsorted(who, open_, side="right")) & (before + k <= (total[-1] if len(total) else 0))
            worst[open_[enough]] = far[at[enough]]
            keep = far <= worst[who]
            who, code, far = who[keep], code[keep], far[keep]
            last[open_] = radius
            closed = worst[open_] <= len(self.cuts) * (radius + 1) - 1
            if radius == widest:
                closed[:] = True  # every value of every segment has been probed
            ends = np.isin(who, open_[closed])
            done.append((who[ends], code[ends], far[ends]))
            who, code, far, open_ = who[~ends], code[~ends], far[~ends], open_[~closed]
            if not len(open_):
                break
        return *(np.concatenate([x[i] for x in done]) for i in range(3)), last


class Block:
    """The rows of a block with codes of one length, and their index."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, dims: int, k: int, width: float | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.k = ids[order], k
        distinct, which = np.unique(words[order], axis=0, return_inverse=True)
        which = which.ravel()
        self.by_code = np.argsort(which, kind="stable")  # within a code, ids grow
        self.start = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(distinct)))])
        self.weight = np.minimum(np.diff(self.start), k)
        self.index = Index(distinct, dims, width)

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest rows of each of ``asked``, ties to the smaller id."""
        who, code, far, _ = self.index.search(asked, self.k, self.weight)
        each = self.weight[code]
        at = np.repeat(self.start[code] - np.cumsum(each) + each, each) + np.arange(each.sum())
        who, far, ids = np.repeat(who, each), np.repeat(far, each), self.ids[self.by_code[at]]
        order = np.lexsort((ids, far, who))
        who, far, ids = who[order], far[order], ids[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return who[first], ids[first], far[first]


def coded(df: DataFrame) -> DataFrame:
    """(id, dims, code) of the usable rows of (vec_id, embedding); the code is a few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths()
            for dims in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, dims))
                found = codes(np.asarray(part.column(1).flatten()).reshape(part.num_rows, dims))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(found), dims), pa.int32()), pa.array([c.tobytes() for c in found], pa.binary())], ["id", "dims", "code"])

    usable = df.where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    return usable.select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: x.cast("float")).alias("vector")).mapInArrow(run, "id bigint, dims int, code binary")


def nearest(rows: DataFrame, asked: DataFrame, k: int = 10, width: float | None = None, row_block: int = 1 << 18, least_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows of smallest Hamming distance for each of ``asked`` (both vec_id, embedding).

    Distances are verified and exact; ties go to the smaller vec_id; a row finds itself. Rows with a null id, a null or
    empty vector or a vector with null values take no part, and vectors are compared with those of their own length.
    Rows with fewer than k partners give fewer rows. Repeated rows take a place each; a query that is repeated with the
    same vector is asked once. Empty tables give no rows. Columns besides vec_id and embedding are ignored.

    A block holds ``row_block`` rows or fewer; inputs of few rows have smaller ones, down to ``least_block``, so that
    all cores have one.
    """
    n = rows.count()
    blocks = max(1, -(-n // row_block), min(-(-n // least_block), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    left = coded(rows).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "dims", F.lit(False).alias("asked"), "id", "code")
    right = coded(asked).dropDuplicates(["id", "dims", "code"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", F.lit(True).alias("asked"), "id", "code")
    # In a partition a block's rows come before its queries.
    dealt = left.union(right).repartition(blocks, "block").sortWithinPartitions("block", "dims", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, held = None, None, []
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)])
            ends = [*np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for a, b in zip([0, *ends], ends):
                of, is_query = (int(key[0, a]), int(key[1, a])), bool(key[2, a])
                if of != here:
                    here, block, held = of, None, []
                words = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.uint64).reshape(b - a, -1)
                ids = batch.column(3).slice(a, b - a).to_numpy()
                if not is_query:
                    held.append((ids, words))
                    continue
                if held:
                    block = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), of[1], k, width)
                    held = []
                for i in range(0, len(ids) if block else 0, 64):
                    who, near, far = block.nearest(words[i : i + 64])
                    # A query is known by its id and its code.
                    name = np.bitwise_xor.reduce(words[i : i + 64] * (2 * np.arange(1, words.shape[1] + 1, dtype=np.uint64) + np.uint64(1)), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64][who]), pa.array(name[who]), pa.array(near, pa.int64()), pa.array(far, pa.int32())], ["query_id", "query", "vec_id", "distance"])

    order = Window.partitionBy("query_id", "query").orderBy("distance", "vec_id")
    ranked = dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.col("distance").cast("bigint").alias("distance"))


#: The same by brute force.
SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda x: CASE WHEN x[1] = x[2] THEN 0 ELSE 1 END)) AS BIGINT) AS distance
FROM codes q CROSS JOIN codes r WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""
