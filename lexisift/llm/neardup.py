"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A set's minhashes form two small collections of ``blocks`` blocks of ``width`` values. Each table's key combines one
block of the first collection with one of the second, so ``blocks`` ** 2 tables of keys made of 2 * ``width`` values
need only 2 * ``blocks`` * ``width`` minhashes: about the square root of what independent tables need. A pair of
similarity s shares a table with probability (1 - (1 - s ** width) ** blocks) ** 2.

Documents with equal sets form one class; only one of each class goes on. Candidates are then confirmed on the sets:

1. Every class is compared with the centre of its tables, the member that shares the most large tables with others;
   that costs one comparison for each class, however large a table is. Linked classes join one component. Where a
   crowd is left that is not linked to its centre, it gets a centre of its own and the step is repeated, as long as
   that finds links.
2. In tables that still hold several components, each member x is compared with the table's centre c, which leaves the
   difference D(x) between x and c. Two members reach the similarity only if their differences share many elements,
   the more the longer the differences are; so x can only be linked to a member that shares one of the rarest elements
   of D(x), of which a fixed share of the set's size is enough (a prefix filter on differences). Where copies of one
   text are edited in different places their differences have nothing in common, and no pair is formed at all.

The second step is exact: no table is cut, and no link between different texts that share a table is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import stored
from lexisift.llm.shingles import common, mix, shingle_set

SIGNED = "doc_id bigint, n_shingles bigint, set_id string, left array<bigint>, right array<bigint>"


def factors(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def signatures(docs: DataFrame, words: int, width: int, blocks: int) -> DataFrame:
    """The set size, a digest of the set and both collections of block hashes for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors(2 * blocks * width, 1)
        fold = factors(width, 2)
        for batch in batches:
            sizes, ids, sides = [], [], ([], [])
            for x in batch.column(1):
                s = shingle_set(x.as_py(), words)
                sizes.append(len(s))
                if not len(s):
                    ids.append(None)
                    for side in sides:
                        side.append(None)
                    continue
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                least = np.full(len(by), np.uint64(0xFFFFFFFFFFFFFFFF))
                for k in range(0, len(s), 8192):
                    np.minimum(least, np.multiply.outer(by, s[k : k + 8192]).min(axis=1), out=least)
                block = mix((mix(least).reshape(2 * blocks, width) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64)
                sides[0].append(block[:blocks])
                sides[1].append(block[blocks:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in sides)], ["doc_id", "n_shingles", "set_id", "left", "right"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


COMPARED = "a bigint, b bigint, linked boolean, size bigint, differ array<bigint>"


def compared(pairs: DataFrame, docs: DataFrame, words: int, percent: int, differ: bool = False) -> DataFrame:
    """Whether the full sets of each of ``pairs`` (a, b) of doc_ids reach the similarity; with the size of a's set.

    differ: if asked for, the elements of just one of both sets. b may be the same for very many rows: its text joins
    first, while rows are short, and an adaptive join deals a hot b out over many tasks.
    """
    with_b = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None  # neighbours often share b
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                linked, sizes, rest = [], [], []
                for text, other in zip(part.column(2), part.column(3)):
                    x, other = shingle_set(text.as_py(), words), other.as_py()
                    if other != last:
                        last, y = other, shingle_set(other, words)
                    n = common(x, y)
                    linked.append(bool(n) and 100 * n >= percent * (len(x) + len(y) - n))
                    sizes.append(len(x))
                    rest.append(np.setxor1d(x, y, assume_unique=True).view(np.int64) if differ else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "linked", "size", "differ"])

    return both.mapInArrow(run, COMPARED)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for each of ``nodes`` (node).

    Labels spread along links and then jump to the label of the label, so rounds grow with the logarithm of a
    component's span. Each round is a written table; nothing but a count comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = nodes.select("node", F.col("node").alias("label")).distinct()
    if both.isEmpty():
        return labels
    labels = stored(labels.join(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "node").select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        after = stored(spread.join(ahead, "label").select("node", "old", F.least("label", "ahead").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            break
    return nodes.distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def centred(tables: DataFrame) -> DataFrame:
    """(key, rep, comp, score, centre, centre_comp) for each row of ``tables`` (key, rep, comp).

    A table's centre is its member with the largest sum of table sizes, which finds the original among its edited
    copies; ties go to the smallest.
    """
    sized = stored(tables.join(tables.groupBy("key").agg(F.count("*").alias("size")), "key"), "sized")
    scored = sized.join(sized.groupBy("rep").agg(F.sum("size").alias("score")), "rep")
    top = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("lower"), "comp")).alias("top"))
    return sized.join(top, "key").select("key", "rep", "comp", F.col("top.score").alias("score"), (-F.col("top.lower")).alias("centre"), F.col("top.comp").alias("centre_comp"))


def star_pairs(met: DataFrame) -> DataFrame:
    """One pair (a, b) for each member a of other component than its centres: the centre with which it shares the most tables."""
    met = met.where("comp <> centre_comp")
    shared = met.groupBy("rep", "centre").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    best = shared.groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("n", "score", (-F.col("centre")).alias("lower"))).alias("best"))
    return best.select("a", (-F.col("best.lower")).alias("b"))


def rare_pairs(met: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be linked, of rows (a, b = centre, linked, size, differ) with the same centre.

    With d the size of a difference, two sets of sizes m and n are linked if and only if the differences share
    (d1 + d2 - (m + n) * (100 - percent) / (100 + percent)) / 2 elements or more. For members of different components
    that is at least one, and partners may have no less than d - size * (100 - percent) / percent; so the rarest
    size * (100 - percent) / percent + 1 elements of each difference must meet. What comes after a shared element
    bounds how many more there can be.
    """
    met = met.join(comps.select(F.col("rep").alias("a"), "comp"), "a").withColumn("d", F.size("differ"))
    each = stored(met.select("a", "b", "comp", "linked", "size", "d", F.explode("differ").alias("e")), "differences")
    often = each.groupBy("b", "e").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, ["b", "e"])
    ordered = shared.groupBy("a", "b").agg(F.first("comp").alias("comp"), F.first("linked").alias("linked"), F.first("size").alias("size"), F.first("d").alias("d"), F.sort_array(F.collect_list(F.struct("often", "e"))).alias("es"))
    first = ordered.select("a", "b", "comp", "linked", "size", "d", (F.col("d") - F.size("es")).alias("alone"), F.posexplode("es").alias("i", "x"))
    first = first.withColumn("at", F.col("alone") + F.col("i")).where(F.col("at") <= F.col("size") * (100 - percent) / percent)
    first = stored(first.select("a", "b", "comp", "linked", "size", "d", (F.col("d") - F.col("at")).alias("left"), F.col("x.e").alias("e")), "prefixes")
    y = first.alias("y")

    def allowed(x: str, y: str, comp: bool = False) -> Column:
        """Whether sizes and what is left of the differences allow a link; of a component its most favourable figures."""
        f = lambda side, name: F.col(f"{side}.{name}")
        lower, upper = ("low_size", "high_size") if comp else ("size", "size")
        sizes = (100 * f(x, "size") >= percent * f(y, lower)) & (100 * f(y, upper) >= percent * f(x, "size"))
        return sizes & ((100 + percent) * (f(x, "d") + f(y, "d")) - (100 - percent) * (f(x, "size") + f(y, upper)) <= 2 * (100 + percent) * F.least(f(x, "left"), f(y, "left")))

    # Members meet other components that share the element before they meet their members: those of one component never face each other.
    comps = first.groupBy("b", "e", "comp").agg(F.min("d").alias("d"), F.min("size").alias("low_size"), F.max("size").alias("high_size"), F.max("left").alias("left"), F.bool_and("linked").alias("linked"))
    mixed = comps.join(comps.groupBy("b", "e").agg(F.count("*").alias("n")).where("n > 1"), ["b", "e"]).alias("k")
    open_ = ~(F.col("x.linked") & F.col("k.linked"))
    meeting = first.alias("x").join(mixed, (F.col("x.b") == F.col("k.b")) & (F.col("x.e") == F.col("k.e")) & (F.col("x.comp") < F.col("k.comp")) & open_ & allowed("x", "k", comp=True))
    x = meeting.select("x.*", F.col("k.comp").alias("other")).alias("x")
    near = (F.col("x.b") == F.col("y.b")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.other") == F.col("y.comp")) & ~(F.col("x.linked") & F.col("y.linked")) & allowed("x", "y")
    return x.join(y, near).select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()


#: A table whose unlinked rest has no more members than this may form all their pairs.
CROWD = 16


def star_links(tables: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to the centres of ``tables`` (key, rep), and the components (node, label) these make.

    Members that are not linked to a table's centre get a new centre among themselves while they are a crowd, unless
    the last round linked less than an eighth of what it compared: then they are alike to few others.
    """
    rest, links, labels = tables.select("key", "rep"), None, nodes.select("node", F.col("node").alias("label"))
    while True:
        label = labels.select(F.col("node").alias("rep"), F.col("label").alias("comp"))
        met = stored(centred(rest.join(label, "rep")), "centres")
        pairs = stored(compared(star_pairs(met), texts, words, percent).select("a", "b", "linked"), "stars")
        new = pairs.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        labels = stored(components(nodes, links), "components")
        seen = pairs.agg(F.count("*").alias("n"), F.count_if("linked").alias("linked")).first()
        if seen["linked"] * 8 < seen["n"] or not seen["n"]:
            return links, labels
        label = labels.select(F.col("node").alias("rep"), F.col("label").alias("own"))
        centre = labels.select(F.col("node").alias("centre"), F.col("label").alias("its"))
        apart = met.select("key", "rep", "centre").join(label, "rep").join(centre, "centre").where("own <> its").select("key", "rep")
        rest = stored(apart.join(apart.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "key").select("key", "rep"), "rest")
        if rest.isEmpty():
            return links, labels


def open_tables(tables: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``tables`` (key, rep) whose table holds several components, with the component."""
    labelled = tables.select("key", "rep").join(labels.select(F.col("node").alias("rep"), F.col("label").alias("comp")), "rep")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return stored(labelled.join(mixed, "key").select("key", "rep", "comp"), "open")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, width: int = 2, blocks: int = 8) -> DataFrame:
    """For each row of (doc_id, text): n_shingles, component_id and kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles (of the
    whole sequence, if shorter). component_id is the smallest doc_id reachable over links; kept is
    doc_id = component_id. A text without words, null or empty, links with nothing. Rows that repeat a doc_id are one
    document for links. A row without doc_id is compared with nothing: its component_id is null and it is kept. An
    empty table gives no rows. Other columns are ignored.
    """
    signed = stored(signatures(docs, words, width, blocks), "signed")
    classes = signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    sides = signed.where("set_id is not null").select(F.col("doc_id").alias("rep"), "set_id", "left", "right").join(classes.select("rep", "set_id"), ["rep", "set_id"], "left_semi")
    keys = sides.select("rep", F.posexplode("left").alias("i", "x"), "right").select("rep", "i", "x", F.posexplode("right").alias("j", "y"))
    keys = stored(keys.select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep"), "keys")
    tables = stored(keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key"), "tables")
    nodes = tables.select(F.col("rep").alias("node")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), "texts")
    links, labels = star_links(tables, nodes, texts, words, percent)
    left = open_tables(tables, labels)
    if not left.isEmpty():
        pairs = centred(left).where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
        met = stored(compared(pairs, texts, words, percent, differ=True), "met")
        rest = rare_pairs(met, left.select("rep", "comp").distinct(), percent)
        more = stored(compared(rest, texts, words, percent).where("linked").select("a", "b"), "confirmed")
        links = links.union(met.where("linked").select("a", "b")).union(more)
        labels = stored(components(nodes, links), "components")
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("set_id", F.coalesce("label", "rep").alias("component_id"))
    named = stored(named, "named")
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
