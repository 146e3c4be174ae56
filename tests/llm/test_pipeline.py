"""The pipeline on the smallest tables, and its registration."""

import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lexisift.llm import quality
from lexisift.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids
        ids = kept
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[3] < sizes[2]
    texts = [r["text"] for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


def lines_by_hand(docs):
    """Texts after the line stage, by dictionaries: lines on five sites go from all but their first document, proven copies of one stay whole."""
    sites, first = defaultdict(set), {}
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    for i, text, site in docs:
        for line in text.split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
                first[line.strip(" ")] = min(i, first.get(line.strip(" "), i))
    size = {i: (len(re.findall(r"[\x20\x09-\x0D]", text)) + 1, text.count("\n") + 1) for i, text, _ in docs}
    out = {}
    for i, text, _ in docs:
        cut = {x for x in (line.strip(" ") for line in text.split("\n")) if x and len(sites[x]) >= 5 and first[x] != i}
        common = defaultdict(list)
        for x in cut:
            common[first[x]].append(len(words(x)))
        best = max(((sum(n), len(n), *size[k]) for k, n in common.items()), default=None)
        if best:
            runs = best[0] - 4 * (size[i][1] + best[3] - 2 * best[1] + 1)
            if 180 * runs >= 80 * (size[i][0] + best[2] - 8):
                cut = set()
        left = "\n".join(x for x in text.split("\n") if not x.strip(" ") or x.strip(" ") not in cut)
        if not cut or left.strip():
            out[i] = left
    return out


def test_stages_by_brute_force(spark):
    """Each stage's result on the smallest tables equals a plain version of it, on the stage's own input."""
    docs = table(spark, SF, "documents")
    good = stored(corpus_pipeline.quality_stage(spark, docs, SF), "good")
    judged = {r["doc_id"] for r in quality.assess(docs, table(spark, SF, "labels")).where("keep").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    assert {i for i, *_ in rows} == judged
    cut = stored(corpus_pipeline.line_stage(spark, good, SF), "cut")
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == lines_by_hand(rows)
    sets = {}
    for i, text in got.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n) and n]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    near = stored(corpus_pipeline.near_stage(spark, cut, SF), "near")
    kept = {r["doc_id"]: r["text"] for r in near.collect()}
    assert set(kept) == {i for i in label if label[i] == i}
    tokenizer, seen, used = Tokenizer.from_file(corpus_pipeline.vocabulary()), defaultdict(int), defaultdict(list)
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in kept.items()}
    for p in corpus_pipeline.packing_stage(spark, near, SF).collect():
        assert zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        seen[p["doc_id"]] += p["length"]
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_odd_rows(spark):
    """Nulls, repeated and missing doc_ids, extra columns and empty tables pass through every stage."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "t", 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' AS keep", "'y' AS component_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert stage(spark, df.limit(0), SF).count() == 0
        got = [r["doc_id"] for r in out.collect()]
        if name == "near_duplicates":
            assert sorted(map(str, got)) == ["1", "1", "2", "3", "None"]
        elif name in ("lines", "packing"):
            assert len(got) == 6


def test_good_documents_stay(spark):
    labels = table(spark, SF, "labels").toPandas()
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, table(spark, SF, "documents"), SF).select("doc_id").collect()}
    good, bad = set(labels[labels.quality == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_lines_go_from_documents_that_are_no_copies(spark):
    """Boilerplate of over three tenths of a text is cut; a copy of one other document stays whole for the next stage."""
    banner, body = "a banner line that many sites show at the top", "\n".join("body line %d of the copied document" % k for k in range(30))
    rows = [(i, f"{banner}\nown words of document {i}", "en", f"s{i}", 0) for i in range(10)] + [(100 + i, f"{body}\nedit {i}", "en", f"s{i}", 0) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, df, SF).collect()}
    assert [i for i in range(10) if banner in got[i]] == [0]
    assert all(got[100 + i] == f"{body}\nedit {i}" for i in range(6))


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "packing"]
