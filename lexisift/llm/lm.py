"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class). The class is a softmax over the sum of weight rows that
hashed features pick: the last word, the word before it (a skip), the pair of the last two words' classes, and the pair
of classes three and four words back (a skip pair). Words fall into classes by frequency and by the kind of document
they live in; the most frequent have a class each. Rare words and unknown ones share one class, in which absolute
discounting sets the mass of unknown words aside, so the model is a distribution over the known words, the end and one
unknown word. Within its class a word has its plain share.

Words are known by a 64-bit hash: at a billion distinct words a collision is expected once in forty corpora, and it
would add two words' counts. Counts come from one aggregation over all training documents. The weights are trained on
all of them in each round: every task takes gradient steps on its documents from the common weights, and the tasks'
steps are averaged, each row by how often a task met it. The table of word rows grows with the root of the number of
training tokens, up to ``most_rows``. The frequent words are sent to the tasks, at most ``head`` of them; the rest are
looked up by a join, so nothing that grows with the corpus without a bound is sent.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import stored
from lexisift.llm.shingles import words_at

#: The hash that stands for the end of a text.
END = 0
KINDS, ALONE, BANDS, CLASSES = 16, 31, 6, 64
RARE = 4096
ROWS_PAIR = CLASSES * CLASSES
BLOCK = 256
#: Lines of a weight row that are added in one turn.
RUN = 16
_ONES = np.ones(CLASSES, np.float32)
PAD = 4
#: Training tokens for each task of a round, of which there are eight at least: the fewer tasks, the fewer tables of steps are shuffled.
SHARD = 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


@dataclass
class Texts:
    """Some whole texts: which rows of which batches they are, their words' hashes one after the other, and numbers of words."""

    places: list
    words: np.ndarray
    sizes: np.ndarray
    letter: np.ndarray  # whether a word begins with a letter

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words, sorted, and the place of each word among them."""
        found = pa.array(self.words).dictionary_encode()
        words = found.dictionary.to_numpy()
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return words[order], rank[found.indices.to_numpy()]


def texts(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 18) -> Iterator[Texts]:
    """The texts of a column, grouped until they have ``size`` bytes. Null counts as empty."""

    def made() -> Texts:
        data = b" ".join(parts)
        words, begin = words_at(data)
        ends = np.cumsum([len(p) + 1 for p in parts])
        first = np.frombuffer(data, np.uint8)[begin] | 0x20 if len(begin) else np.zeros(0, np.uint8)
        sizes = np.diff(np.searchsorted(begin, ends, side="left"), prepend=0)
        return Texts(places, words.view(np.int64), sizes, (first >= 0x61) & (first <= 0x7A) | (first >= 0xA0))

    places, parts, held = [], [], 0
    for batch in batches:
        for k, x in enumerate(batch.column(column)):
            data = x.as_py() or b""
            places.append((batch, k))
            parts.append(data)
            held += len(data) + 1
            if held >= size:
                yield made()
                places, parts, held = [], [], 0
    if parts:
        yield made()


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys (the first one first) and where each run of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def word_counts(doc: np.ndarray, code: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of the distinct words of each text, of ``distinct`` codes in all."""
    both = doc * distinct + code
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    doc, code = np.divmod(both[first], max(distinct, 1))
    return doc, code, np.diff(np.append(first, len(both)))


def kinds(t: Texts, words: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The kind of each text: a hash of its most frequent word that begins with a letter, 0 without one."""
    out = np.zeros(len(t.sizes), np.int64)
    doc, code, times = word_counts(t.docs()[t.letter], code[t.letter], len(words))
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top = np.maximum.reduceat(times * len(words) + code, first) % len(words)  # of equally frequent words the last
        out[doc[first]] = (words[top].view(np.uint64) % np.uint64(KINDS)).astype(np.int64)
    return out


def counted(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(word, c, kind) of all words and ends: the count and the kind of document that has most of the word.

    A task holds sums of at most about ``flush`` words and kinds together before it passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind, word, times = (np.concatenate(c) for c in zip(*held))
            order, first = runs(kind, word)
            return kind[order[first]], word[order[first]], np.add.reduceat(times[order], first)

        def out() -> pa.RecordBatch:
            kind, word, times = held[0]
            return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(kind, pa.int32()), pa.array(times, pa.int64())], ["word", "kind", "c"])

        new = 0
        for t in texts(batches, 0):
            words, code = t.coded()
            kind = kinds(t, words, code)
            ends = np.bincount(kind, minlength=KINDS)
            of, word, times = word_counts(kind[t.docs()], code, len(words))
            held.append((np.concatenate([of, np.flatnonzero(ends)]), np.concatenate([words[word], np.full(np.count_nonzero(ends), END)]), np.concatenate([times, ends[ends > 0]])))
            new += len(word)
            if new > flush // 2:
                held, new = [summed()], 0
                if len(held[0][0]) > flush // 2:
                    yield out()
                    held = []
        if held:
            held = [summed()]
            yield out()

    parts = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "word bigint, kind int, c bigint")
    by_kind = parts.repartition("word").groupBy("word", "kind").agg(F.sum("c").alias("c"))
    return by_kind.groupBy("word").agg(F.sum("c").alias("c"), F.max(F.struct("c", "kind")).alias("top")).select("word", "c", F.col("top.kind").alias("kind"))


@dataclass
class Vocabulary:
    """The frequent words with their classes, and the totals. Its size is bounded by ``head``."""

    key: str
    words: np.ndarray
    classes: np.ndarray
    base: np.ndarray  # log10 of the unigram base
    inside: np.ndarray  # log10 P(word | class)
    prior: np.ndarray  # log P(class)
    tokens: int
    distinct: int
    rare_total: int
    rare_words: int
    discount: float
    rows_word: int

    @property
    def rows(self) -> int:
        return 2 * self.rows_word + 2 * ROWS_PAIR


def vocabulary(counts: DataFrame, head: int, most_rows: int = 1 << 16) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    # How frequent a word must be: by a histogram of a bounded number of steps, so that at most ``head`` words are sent.
    step = F.when(F.col("word") == END, 1 << 20).otherwise(F.floor(F.log2(F.col("c").cast("double")) * 64)).alias("step")
    steps = counts.where((F.col("c") >= 2) | (F.col("word") == END)).groupBy(step).count().orderBy(F.desc("step")).collect()
    sums = np.cumsum([r["count"] for r in steps])
    least = min((r["step"] for r, k in zip(steps, sums) if k <= head), default=1 << 20)
    rows = counts.where((F.col("c") >= 2) | (F.col("word") == END)).where(step >= least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    n, v = total["n"], total["v"]
    c = rows["c"].to_numpy(np.int64)
    mass = Counter()
    for k, x in zip(rows["kind"], c):
        mass[int(k)] += int(x)
    main = {k: i for i, (k, _) in enumerate(sorted(mass.items(), key=lambda x: (-x[1], x[0]))[: (CLASSES - 1 - ALONE) // BANDS - 1])}
    groups = len(main) + 1
    classes = np.zeros(len(c), np.int64)
    classes[:ALONE] = np.arange(1, min(ALONE, len(c)) + 1)
    rest = c[ALONE:]
    if len(rest):
        band = np.minimum((np.cumsum(rest) - rest) * BANDS // rest.sum(), BANDS - 1)
        group = np.array([main.get(int(k), groups - 1) for k in rows["kind"][ALONE:]], np.int64)
        classes[ALONE:] = 1 + ALONE + group * BANDS + band
    sums = np.bincount(classes, c, CLASSES)
    rare = int(n - c.sum())
    sums[0] = rare
    discount = total["one"] / (total["one"] + 2 * total["two"]) if total["one"] else 0.5
    below = math.log10(n + 0.1 * (v + 1))
    smooth = sums + 0.5
    inside = np.log10(c / np.maximum(sums[classes], 1)) if len(c) else np.zeros(0)
    rows_word = min(max(2048, -(-int(1.4 * math.sqrt(n)) // BLOCK) * BLOCK), most_rows, 1 << 16)
    return Vocabulary(uuid.uuid4().hex, rows["word"].to_numpy(np.int64), classes, np.log10(c + 0.1) - below, inside, np.log(smooth / smooth.sum()), n, v, rare, v - len(c), min(max(discount, 0.01), 0.99), rows_word)


class Ids:
    """Ids of hashed words: frequent ones by rank, others one of a few that only features use; the last id is padding."""

    def __init__(self, voc: Vocabulary):
        self.known, self.pad = len(voc.words), len(voc.words) + RARE
        self.order = np.argsort(voc.words)
        self.sorted = voc.words[self.order]
        self.end = int(self(np.zeros(1, np.int64) + END)[0])
        self.classes = np.concatenate([voc.classes, np.zeros(RARE + 1, np.int64)])
        self.short = self.classes.astype(np.uint16)
        self.hashed = (((np.arange(self.pad + 1) * 2654435761) % 4294967291) % voc.rows_word).astype(np.uint16)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        rare = self.known + (words.view(np.uint64) % np.uint64(RARE)).astype(np.int64)
        if not self.known:
            return rare
        at = np.minimum(np.searchsorted(self.sorted, words), self.known - 1)
        return np.where(self.sorted[at] == words, self.order[at], rare)

    def sequence(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """One id sequence of all texts, PAD ids before and the end after each, and where each text's PAD ids begin."""
        n, d = len(t.words), len(t.sizes)
        x = np.full(n + d * (PAD + 1), self.pad, np.int64)
        words, code = t.coded()
        x[np.arange(n) + t.docs() * (PAD + 1) + PAD] = self(words)[code]
        x[np.cumsum(t.sizes) + np.arange(d) * (PAD + 1) + PAD] = self.end
        return x, np.cumsum(t.sizes) - t.sizes + np.arange(d) * (PAD + 1)


_LOCAL: dict[str, Ids] = {}


def local(voc: Vocabulary) -> Ids:
    """The id table, made once for each worker process."""
    if voc.key not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[voc.key] = Ids(voc)
    return _LOCAL[voc.key]


def rows_of(x: np.ndarray, ids: Ids) -> np.ndarray:
    """The weight row of each of the four templates at each place of the id sequence ``x`` from PAD on, within the template."""
    hashed, c, n = ids.hashed[x], ids.short[x], len(x)
    back = lambda a, k: a[PAD - k : n - k]
    return np.stack([back(hashed, 1), back(hashed, 2), back(c, 1) * np.uint16(CLASSES) + back(c, 2), back(c, 3) * np.uint16(CLASSES) + back(c, 4)])


def templates(weights: np.ndarray) -> list[np.ndarray]:
    """The rows of each template, as views."""
    rows_word = (len(weights) - 2 * ROWS_PAIR) // 2
    ends = np.cumsum([rows_word, rows_word, ROWS_PAIR])
    return np.split(weights, ends)


def softmax(weights: list[np.ndarray], prior: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of the classes' scores, less the largest where they could overflow, and their sums."""
    z = weights[0].take(rows[0], axis=0)
    z += prior
    for w, r in zip(weights[1:], rows[1:]):
        z += w.take(r, axis=0)
    if z.max() > 60:  # no row is low throughout: gradients add up to zero over the classes, so a row's mean is the prior's
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ _ONES


def first_lines(p: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups in the order of their sizes, and the sums of at most RUN lines of each: ``p[order[first : first + size]]``."""
    size = np.minimum(size, RUN)
    by = np.argsort((RUN - size).astype(np.uint8), kind="stable")
    first = first[by]
    sums = p.take(order[first], axis=0)
    more = len(size) - np.cumsum(np.bincount(size, minlength=RUN + 1))  # groups with more than k lines come first
    for k in range(1, RUN):
        m = more[k]
        if not m:
            break
        sums[:m] += p.take(order[first[:m] + k], axis=0)
    return by, sums


def sorted_sums(p: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of the sorted ``at``, the sums of the lines ``p[order]`` that belong to each, and how many these are.

    The first RUN lines of each are added one by one, for all together; what is left is cut into runs of RUN lines, and
    their sums are added in the same way. So each line is touched once.
    """
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, len(at)))
    by, sums = first_lines(p, order, first, size)
    first, size = first[by], size[by]
    left = np.flatnonzero(size > RUN)
    if len(left):
        count = (size[left] - 1) // RUN
        owner = np.repeat(left, count)
        k = np.arange(1, len(owner) + 1) - np.repeat(np.cumsum(count) - count, count)
        by, runs = first_lines(p, order, first[owner] + k * RUN, size[owner] - k * RUN)
        to, more, _ = sorted_sums(runs, np.argsort(by), owner)
        sums[to] += more
    return at[first], sums, size


def row_sums(p: np.ndarray, rows: np.ndarray, begins: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``rows``, the sums of the lines of ``p`` that belong to each, and how many these are.

    ``rows`` may be those of several templates, one beside the other, and ``begins`` where the rows of each begin.
    """
    order = np.argsort(rows, kind="stable")
    at = np.take_along_axis(rows, order, -1) + begins
    return sorted_sums(p, order.ravel(), at.ravel())


def train_round(docs: DataFrame, voc, shared, rate: float, step: int = 4096) -> np.ndarray:
    """The weights after one round over ``docs``, from the broadcast weights ``shared``."""
    v = voc.value
    shards = max(8, -(-v.tokens // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc.value
        ids = local(v)
        prior = v.prior.astype(np.float32)
        start = shared.value
        weights, met, energy = start.copy(), np.zeros(v.rows, np.float32), np.full(v.rows, 1e-6, np.float32)
        parts, begins = templates(weights), np.cumsum([[0], [v.rows_word], [v.rows_word], [ROWS_PAIR]])[:, None]
        for t in texts(batches, 0):
            x, _ = ids.sequence(t)
            for k in range(0, len(x) - PAD, 1 << 16):
                part = x[k : k + (1 << 16) + PAD]
                rows, target = rows_of(part, ids), ids.classes[part[PAD:]]
                real = np.flatnonzero(part[PAD:] != ids.pad)
                rows, target = rows[:, real], target[real]
                for i in range(0, len(target), step):
                    r, y = rows[:, i : i + step], target[i : i + step]
                    p, total = softmax(parts, prior, r)
                    p *= (-1 / total)[:, None]
                    p[np.arange(len(y)), y] += 1
                    to, grad, seen = row_sums(p, r, begins)
                    energy[to] += np.einsum("ij,ij->i", grad, grad)
                    grad *= (rate / np.sqrt(energy[to]))[:, None]
                    grad += weights.take(to, axis=0)
                    weights[to] = grad
                    met[to] += seen
        if met.any():
            moved = np.clip(weights - start, -60, 60).astype(np.float16)
            task = TaskContext.get().partitionId()
            n = v.rows // BLOCK
            blocks = [moved[k * BLOCK : (k + 1) * BLOCK].tobytes() + met[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, task % 32), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part", "moved"])

    def add(group: pa.Table) -> pa.Table:
        """The mean of the tasks' steps, each row by how often a task met it."""
        total, weight = np.zeros((BLOCK, CLASSES), np.float32), np.zeros(BLOCK, np.float32)
        for x in group["moved"]:
            data = x.as_py()
            met = np.frombuffer(data, np.float32, BLOCK, 2 * BLOCK * CLASSES)
            total += np.frombuffer(data, np.float16, BLOCK * CLASSES).reshape(BLOCK, CLASSES) * met[:, None]
            weight += met
        mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float16)
        return pa.table([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([group["part"][0].as_py()], pa.int32()), pa.array([mean.tobytes() + weight.tobytes()], pa.binary())], ["block", "part", "moved"])

    schema = "block int, part int, moved binary"
    # Two levels of means: no task holds the rows of more than a part of the tasks.
    steps = docs.select(F.col("text").cast("string").cast("binary").alias("text")).coalesce(shards).mapInArrow(run, schema)
    weights = shared.value.copy()
    for row in steps.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect():  # one row for each block: a bounded number
        weights[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(row["moved"], np.float16, BLOCK * CLASSES).reshape(BLOCK, CLASSES)
    return weights


SCORED = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<bigint>, times array<bigint>"


def factors(weights: list[np.ndarray], prior: np.ndarray) -> list[np.ndarray]:
    """The exponentials of the weights, each row less its largest: products of rows are those of the scores but for a factor."""
    out = [w + prior if k == 0 else w.copy() for k, w in enumerate(weights)]
    for w in out:
        w -= w.max(axis=1, keepdims=True)
        np.exp(w, out=w)
    return out


def token_scores(x: np.ndarray, v: Vocabulary, ids: Ids, weights: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 P(word | context) of each place of the sequence ``x``: of frequent words whole, of rare ones the class alone.

    ``tables``: the weights' ``factors``, made anew without them. Where products come near to nothing, scores are added.
    """
    prior, inside, weights = v.prior.astype(np.float32), np.concatenate([v.inside, np.zeros(RARE + 1)]), templates(weights)
    tables = tables or factors(weights, prior)
    out = np.zeros(len(x))
    for k in range(0, len(x) - PAD, 4096):
        part = x[k : k + 4096 + PAD]
        rows, y = rows_of(part, ids), ids.classes[part[PAD:]]
        z = tables[0].take(rows[0], axis=0)
        for w, r in zip(tables[1:], rows[1:]):
            z *= w.take(r, axis=0)
        total, chosen = z @ _ONES, z[np.arange(len(y)), y]
        weak = np.flatnonzero(chosen < 1e-20)
        if len(weak):
            z, total[weak] = softmax(weights, prior, rows[:, weak])
            chosen[weak] = z[np.arange(len(weak)), y[weak]]
        out[PAD + k : PAD + k + len(y)] = np.log10(np.maximum(chosen, 1e-30)) - np.log10(total)
    out += inside[x]
    out[x == ids.pad] = 0
    return out


def score_frequent(docs: DataFrame, voc, weights) -> DataFrame:
    """For each row the sums over its frequent words and all classes, and its rare words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = voc.value, weights.value
        ids = local(v)
        tables = factors(templates(w), v.prior.astype(np.float32))
        base = np.concatenate([v.base, np.zeros(RARE + 1)])
        rid = TaskContext.get().partitionId() << 33
        for t in texts(batches, 2):
            x, begin = ids.sequence(t)
            at = token_scores(x, v, ids, w, tables)
            score, plain, head = np.add.reduceat(at, begin), np.add.reduceat(base[x], begin), np.add.reduceat((x < ids.known).astype(np.int64), begin)
            n = len(t.sizes)
            odd = np.flatnonzero(x[np.arange(len(t.words)) + t.docs() * (PAD + 1) + PAD] >= ids.known)
            words, code = np.unique(t.words[odd], return_inverse=True)
            doc, code, times = word_counts(t.docs()[odd], code, len(words))
            word = words[code]
            if ids.end >= ids.known:  # without training texts the end is as rare as all else
                doc, word, times = np.append(doc, np.arange(n)), np.append(word, np.full(n, END)), np.append(times, np.ones(n, np.int64))
                order = np.argsort(doc, kind="stable")
                doc, word, times = doc[order], word[order], times[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + n), pa.int64()),
                    pa.array([b.column(0)[k].as_py() for b, k in t.places], pa.int64()),
                    pa.array([b.column(1)[k].as_py() for b, k in t.places], pa.bool_()),
                    pa.array(t.sizes + 1, pa.int64()),
                    pa.array(head, pa.int64()),
                    pa.array(plain, pa.float64()),
                    pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array(word, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                [f.split()[0] for f in SCORED.split(", ")],
            )
            rid += n

    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCORED)


def score(docs: DataFrame, head: int = 1 << 17, rounds: int = 2, rate: float = 0.3, most_rows: int = 1 << 16) -> DataFrame:
    """Scores of all rows of (doc_id, text), learned from the rows that are not held out.

    Null text counts as empty and is the end alone. A null doc_id is held out. Repeated rows count and are scored each
    on its own. Without training rows every word is unknown: the base is uniform and the model gives its one class.
    An empty table gives no rows. Other columns are ignored.

    rounds: passes over all training rows. head: how many frequent words have a place in the model of their own; all
    others are told apart by their counts alone. most_rows: where the table of word rows stops to grow (65,536 at most). How rows are
    dealt into files decides which steps are averaged, so scores differ a little between layouts of the same rows.
    """
    sc = docs.sparkSession.sparkContext
    training = docs.where(~held_out(F.col("doc_id")))
    counts = stored(counted(training), "counts")
    v = vocabulary(counts, head, most_rows)
    voc = sc.broadcast(v)
    weights = np.zeros((v.rows, CLASSES), np.float32)
    for k in range(rounds):
        shared = sc.broadcast(weights)
        weights = train_round(training, voc, shared, rate / (k + 1))
        shared.unpersist()
    shared = sc.broadcast(weights)
    rows = stored(score_frequent(docs, voc, shared), "scored")
    shared.unpersist()
    voc.unpersist()
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    below = math.log10(v.tokens + 0.1 * (v.distinct + 1))
    # Within the rare class a word has its count less the discount; one unknown word has all that is taken off.
    unknown = math.log10(max(v.discount * v.rare_words, 1e-9) / v.rare_total) if v.rare_total else 0.0
    inside = F.when(c == 0, F.lit(unknown)).otherwise(F.log10(F.greatest(c - v.discount, F.lit(1e-9)) / max(v.rare_total, 1)))
    joined = rare.join(counts.select("word", "c"), "word", "left")
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (F.log10(c + 0.1) - below)).alias("rare_base"),
        F.sum(F.col("times") * inside).alias("rare_score"),
    )
    zero = lambda k: F.coalesce(k, F.lit(0))
    return rows.drop("rare", "times").join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )
