"""Goldens and properties of the library proper."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
import regex
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.scripts import METHODS
from lexisift.functions.segment import compare_methods, segment, syllables
from lexisift.operators import dedup, frequency, ngrams, rules, stats, synth, vocab, voting
from lexisift.sources import files, sinks


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


GOLDENS = {
    "អ្នកគ្រួបង្រៀនភាសាខ្មែរ": "អ្ន|ក|គ្រួ|ប|ង្រៀ|ន|ភា|សា|ខ្មែ|រ",
    "ខ្ញុំចង់រៀន។ ក": "ខ្ញុំ|ច|ង់|រៀ|ន|។| |ក",
    "ឲ្យ": "ឲ្យ",
    "Apple ឲ្យប្រើ": "Apple| |ឲ្យ|ប្រើ",
    "ខ្ញុំ   ចង់": "ខ្ញុំ|   |ច|ង់",
    "123 ABC": "123| |ABC",
    "២០២៥": "២០២៥",
    "": "",
}


@pytest.mark.parametrize("text", GOLDENS)
def test_segmentation_goldens(spark, text):
    row = compare_methods(spark.createDataFrame([(text,)], "text string")).first()
    assert row["consistent"]
    for m in METHODS:
        assert "|".join(row[m]) == GOLDENS[text]


def test_methods_differ_on_dangling_coeng(spark):
    row = compare_methods(spark.createDataFrame([("ក្",)], "text string")).first()
    assert not row["consistent"] and row["regex_basic"] == ["ក", "្"] and row["no_regex"] == ["ក្"]


def test_long_repeats_do_not_overflow(spark):
    texts = ["ក" + "ា" * 20000, "ក" + "្ក" * 20000, "ក" + "្ា" * 20000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(*(F.size(syllables("t", m)) for m in METHODS))
    assert all(x > 0 for row in df.collect() for x in row)


def test_segment_api(spark):
    df = spark.createDataFrame([("ក ខ",), ("  ",), (None,)], "text string")
    rows = segment(df).collect()
    assert [r["success"] for r in rows] == [True, True, False]
    assert [r["syllable_count"] for r in rows] == [3, 0, 0]
    assert not segment(df, method="none").first()["success"]


def test_cleaning(spark):
    assert one(spark, "<b>a</b>&amp;&#39; x", T.clean_markup("t"))[0] == "a x"
    # a phone-like run takes the white space around it
    assert one(spark, "a [b] (c) http://x.y/z me@a.bc 012-345-6789 !!! ???", T.clean_text("t"))[0] == "a! ?"
    assert one(spark, "é​ x", T.clean_unicode("t"))[0] == "é x"
    assert one(spark, None, T.clean_text("t"))[0] == ""
    assert one(spark, "A  B!", T.normal_form("t"))[0] == "a b"


def test_quality_and_rejects(spark):
    rows = [("",), ("abc " * 30,), ("កខគ " * 40,), ("ក" * 60,)]
    out = T.with_quality(spark.createDataFrame(rows, "t string"), "t").select("length", "khmer_ratio", "quality_score", T.reject_reason().alias("why")).collect()
    assert [r["why"] for r in out] == ["length", "khmer_ratio", None, "encoding"]
    assert out[2]["khmer_ratio"] == 1.0


def test_number_and_syllable_types(spark):
    cases = {"១": "single_khmer", "2": "single_arabic", "២០": "multi_khmer", "20": "multi_arabic", "១2": "mixed_digits", "a1": "not_number"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.number_type("t").alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == cases
    kinds = {"ការ": "khmer", ".": "punctuation", " ": "empty", "hello": "non_khmer", "កa": "mixed", "12": "number"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", T.syllable_type("t").alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == kinds


def test_smoothing_by_hand(spark):
    counts = [100, 80, 60, 40, 20, 10, 5, 2, 1]
    grams = spark.createDataFrame([(str(i), "c", c) for i, c in enumerate(counts)], "ngram string, context string, cnt bigint")
    model = ngrams.Model(2, "", grams, spark.createDataFrame([("c", 318)], "context string, cnt bigint"), spark.createDataFrame([(50, 318)], "vocabulary bigint, total bigint"))
    got = {r["method"]: r for r in ngrams.smoothing_statistics(model).collect()}
    assert got["laplace"]["unseen_probability"] == pytest.approx(1 / 368) and got["laplace"]["coverage"] == pytest.approx(318 / 368)
    assert got["good_turing"]["unseen_probability"] == pytest.approx(1 / 318) and got["simple_backoff"]["unseen_probability"] == pytest.approx(0.008)
    gt = {r["cnt"]: r["adjusted"] for r in ngrams.good_turing(grams).collect()}
    assert gt[1] == 2.0 and gt[5] == 5.0


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(stats.ngrams(F.col("t"), 2, "-").alias("g"))
    assert [r["g"] for r in df.collect()] == [["a-b", "b-c"], [], []]
    assert one(spark, "ab漢", stats.char_runs(F.col("t"), 2))[0] == ["ab", "b漢"]


def test_rules(spark):
    texts = spark.createDataFrame([(1, "្ក"), (2, "្្"), (3, "។"), (4, "aំ")], "id bigint, t string")
    got = {}
    for r in rules.sequence_rows(texts, "id", "t").collect():
        got.setdefault(r["id"], []).append(r["type"])
    assert got == {2: ["invalid_unicode_sequence"], 4: ["invalid_character_sequence"]}
    alone = spark.createDataFrame([(1, "ក្"), (1, "្ា"), (2, "កាិ"), (3, None)], "id bigint, t string")
    found = rules.with_errors(alone, "t", syllables("t"))
    got = [sorted((e["position"], e["length"], e["type"]) for e in r["rule_errors"]) for r in found.collect()]
    assert got[0] == [(1, 1, "invalid_coeng_usage"), (1, 1, "invalid_coeng_usage"), (1, 1, "orphaned_combining_mark")]  # rows of equal id do not mix
    assert (1, 2, "invalid_vowel_combination") in got[2] and got[3] == []
    scores = [(r["n_errors"], r["n_warnings"], r["is_valid"]) for r in rules.rule_summary(alone, "id", "t", syllables("t")).collect()]
    assert scores[0] == (3, 0, False) and scores[3] == (0, 0, True)
    one = rules.batch_statistics(alone, "t", syllables("t")).first()
    assert one["n_texts"] == 4 and one["n_errors"] == sum(x[0] for x in scores) and [x["n"] for x in one["by_type"]] == sorted((x["n"] for x in one["by_type"]), reverse=True)


def test_running_starts(spark):
    from lexisift.functions.arrays import starts

    sizes = [random.Random(2).randrange(9) for _ in range(1000)]
    got = spark.createDataFrame([(sizes,), ([],), ([5],)], "s array<int>").select(starts(F.col("s"))).collect()
    assert [r[0] for r in got] == [[sum(sizes[:k]) for k in range(1000)], [], [0]]


def test_cleaning_takes_long_runs(spark):
    """A run of a megabyte without its end is cleaned in one pass, by every pattern."""
    import time

    began = time.time()
    runs = ["<" * 10**6, "[" * 10**6, "(" * 10**6, "a" * 10**6, "a@" * 500_000, " " * 10**6 + "x", "mailto:" * 150_000, "&a" * 500_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "id bigint, t string")
    got = {r["id"]: r["n"] for r in df.select("id", F.length(T.clean_text("t")).alias("n")).collect()}
    assert got[0] == got[1] == got[3] == 10**6 and got[5] == 1  # a run of "(" goes as a telephone number
    assert got[2] == 0 and time.time() - began < 40


def test_emails_and_brackets(spark):
    text = "mail a@b.c now x@y z@.w @b.c a@b. (in) [out] <b>bold</b> (open [open <open"
    assert one(spark, text, T.clean_text("t"))[0] == "mail now x@y z@.w @b.c a@b. bold (open [open <open"


def test_votes_without_weight(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.0, 0.7), (2, 0.0, 1.0, 0.9)], "id bigint, score double, weight double, confidence double")
    got = {r["id"]: (r["vote"], r["vote_confidence"]) for r in voting.weighted_vote(rows, "id").collect()}
    assert got == {1: (0.5, 0.0), 2: (0.0, 0.0)}
    assert len(voting.weight_grid()) == 20


def test_types_are_worked_out_for_each_syllable_not_each_token(spark):
    tokens = spark.createDataFrame([("a",), ("a",), ("ក",)], "syllable string")
    counts = frequency.typed_counts(tokens).where("included")
    assert [tuple(r) for r in counts.select("syllable", "cnt").collect()] == [("ក", 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "Filter" not in below and "RLIKE" not in below


def test_counted_is_included(spark):
    r = random.Random(7)
    tokens = {"".join(r.choice("ក១1a!។ \x1c\u00a0\x85\n") for _ in range(r.randrange(1, 5))) for _ in range(800)}
    df = spark.createDataFrame([(x,) for x in sorted(tokens)], "t string")
    got = df.select("t", F.col("t").rlike(T.COUNTED).alias("a"), T.included("t", T.syllable_type("t")).alias("b")).collect()
    assert [x["t"] for x in got if x["a"] != x["b"]] == []


def test_text_validity_joins_nothing(spark):
    r = random.Random(9)
    words = ["ក", "ខ្ក", "គា", "ឃ", "hello", "l'un", "12", "1", "១២", "១", "!?", "។", " ", "\n", "\x1c", "\u00a0", "\u200b", "é"]
    rows = [(r.choice([1, 2, 3, None, k]), "".join(r.choice(words) for _ in range(r.randrange(12)))) for k in range(60)] + [(900, None), (901, " "), (902, "គា៉ ច")]
    df = spark.createDataFrame(rows, "doc_id bigint, t string")
    out = frequency.text_validity(df, "t")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    lists = [(x["doc_id"], x["s"]) for x in df.select("doc_id", F.filter(syllables("t"), lambda x: x.rlike(f"[^{T.SPACE}]")).alias("s")).collect()]
    tokens = spark.createDataFrame([(x,) for _, s in lists for x in s], "syllable string")
    known = {x["syllable"] for x in frequency.typed_counts(tokens).where("included and cnt >= 2").collect()}
    want = {}
    for doc, s in lists:
        total, valid = want.get(doc, (0, 0))
        want[doc] = (total + len(s), valid + sum(x in known for x in s))
    assert {x["doc_id"]: (x["total"], x["valid"], x["unknown"]) for x in out.collect()} == {d: (n, v, n - v) for d, (n, v) in want.items() if n}


def test_confidence_by_places(spark):
    lists = spark.createDataFrame([(["a"] * 20 + ["ក", "a", "ខ", "ក"],), (["ខ"],), (["a"],), ([],), (None,)], "s array<string>")
    out = frequency.places(lists, "s", T.INCLUDED)
    assert {tuple(r) for r in out.collect()} == {("ក", 2, 1), ("ខ", 2, 1)}
    assert {r["syllable"]: r["confidence_score"] for r in frequency.confidence(out).collect()} == pytest.approx({"ក": 0.703, "ខ": 0.703})


def test_suggestions_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
    unknown, known = {word() for _ in range(20)}, {word() for _ in range(40)}
    frame = lambda s: spark.createDataFrame([(x,) for x in sorted(s)], "syllable string")
    got = {(x["syllable"], x["suggestion"]): x["similarity"] for x in frequency.suggestions(frame(unknown), frame(known), k=1000).collect()}
    same = lambda a, b: sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))
    want = {(a, b): same(a, b) for a in unknown for b in known if a != b and same(a, b) > 0.5}
    assert got == pytest.approx(want)


def matched(x, y):
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def greedy_by_hand(texts, least=0.85):
    kept = []
    for i, t in sorted(texts):
        if not any(matched(t, k) >= least for _, k in kept):
            kept.append((i, t))
    return {i for i, _ in kept}


def test_counts_settle_pairs_without_the_matcher(monkeypatch):
    from lexisift.functions import udfs

    r = random.Random(11)
    texts = ["".join(r.choice("abcd") for _ in range(r.randrange(12))) for _ in range(60)]
    seen = {}
    for least in (0.0, 0.5, 0.85, 0.9):
        for a in texts:
            for b in texts:
                want = matched(a, b)
                assert udfs.ratio_at_least(a, b, least, seen) == (want if want >= least else None)
    monkeypatch.setattr(udfs, "SequenceMatcher", None)  # no pair of these is handed to it
    assert udfs.ratio_at_least("abcdefgh", "abcdexyz", 0.85, {}) is None
    assert udfs.ratio_at_least("abc", "abcabcabc", 0.85, {}) is None


def test_blocks_by_arrays_equal_the_matcher(monkeypatch):
    from lexisift.functions import udfs

    r = random.Random(4)
    kinds = ["ab", "abcdefgh ", "".join(map(chr, range(0x4E00, 0x4F30))), "etaoin shrdluABCDEFGHIJKLMNOPQRSTUVWXYZ😀" + "etaoin " * 60]
    for _ in range(400):
        letters, n = r.choice(kinds), r.choice([1, 5, 40, 190, 205, 400, 900])
        a = "".join(r.choices(letters, k=n))
        b = "".join(c for c in a if r.random() > 0.05) + "a" if r.random() < 0.5 else "".join(r.choices(letters, k=n + r.randrange(9)))
        whole, blocks = SequenceMatcher(None, a, b), udfs.Blocks(a, b, Counter(b), 1)
        for part in [(0, len(a), 0, len(b))] + [(i, r.randrange(i, len(a)) + 1, j, r.randrange(j, len(b)) + 1) for i, j in [(r.randrange(len(a)), r.randrange(len(b))) for _ in range(4)]]:
            assert blocks.longest(*part) == tuple(whole.find_longest_match(*part))
        want = whole.ratio()
        for least in (0.2, 0.85, 0.9):
            assert {udfs.matched_ratio(a, b, least, Counter(b), large) for large in (1, 400)} == {want if want >= least else None}
    monkeypatch.setattr(udfs, "SequenceMatcher", None)  # large texts that differ are settled without it
    a, b = ("".join(r.choices(kinds[3], k=5000)) for _ in range(2))
    assert udfs.ratio_at_least(a, b, 0.85, {}) is None


def test_matcher_runs_in_all_tasks(spark):
    texts = spark.createDataFrame([(k, "abcdefgh" * 3 + "xy"[k % 2]) for k in range(40)], "seq bigint, t string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 40)], "a bigint, b bigint")
    out = dedup.matched(texts, pairs, "seq", 0.85).withColumn("task", F.spark_partition_id())
    assert out.count() == 39 and out.select("task").distinct().count() > 1


def test_fuzzy_duplicates_against_matcher(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choices(words, k=40)) for _ in range(6)]
    texts = [(i, b) for i, b in enumerate(base)] + [(10 + i, b.replace(" ", " x ", 1)) for i, b in enumerate(base)] + [(20, "short"), (21, None)]
    tails = [" ".join("t%d" % r.randrange(9999) for _ in range(14)) for _ in range(2)]
    body = " ".join(r.choices(words, k=200))
    texts += [(30, body), (31, body + " " + tails[0]), (32, body + " " + tails[1]), (33, tails[0]), (34, tails[1])]  # tails that others share
    script = "".join(chr(0x4E00 + r.randrange(300)) for _ in range(400))  # no spaces
    texts += [(40, script), (41, script[:200] + "រ" + script[201:])]
    third = " ".join(r.choices(words, k=60)).split()
    texts += [(50, " ".join(third)), (51, " ".join(w + "z" if k % 3 == 0 else w for k, w in enumerate(third)))]
    df = spark.createDataFrame(texts, "seq bigint, content string")
    got = {(p["a"], p["b"]) for p in dedup.fuzzy_pairs(df).collect()}
    want = {(a, b) for a, x in texts for b, y in texts if b < a and matched(x, y) >= 0.85}
    assert got == want and {(31, 30), (32, 30), (41, 40)} <= got
    kept = {x["seq"] for x in dedup.fuzzy_kept(df).collect() if x["kept"]}
    assert kept == greedy_by_hand([(i, t or "") for i, t in texts])
    assert {x["seq"] for x in dedup.greedy(df.select("seq"), dedup.fuzzy_pairs(df)).collect() if x["kept"]} == kept


def test_fuzzy_duplicates_of_a_table(spark):
    """The smallest table: what is kept equals comparing each article with all kept ones, at all four checks."""
    from lexisift.sources.corpus import articles

    rows = articles(spark, "/root/testdata/sf0.001").select("seq", "title", "content")
    got = {x["seq"]: (x["duplicate_type"], x["original"]) for x in dedup.deduplicated(rows).collect()}
    data = rows.withColumns({"t": T.normal_form("title"), "c": T.normal_form("content")}).orderBy("seq").collect()

    def near(x, y, least):
        if not x or not y or 2 * min(len(x), len(y)) < least * (len(x) + len(y)):
            return False
        m = SequenceMatcher(None, x, y)
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    seen, unique, kept, want = set(), [], [], {}
    for r in data:
        if len(r["content"]) < 50:
            want[r["seq"]] = "short_content"
        elif r["c"] in seen:
            want[r["seq"]] = "exact_content"
        else:
            seen.add(r["c"])
            unique.append(r)
    for r in unique:
        if any(near(r["c"], k["c"], 0.85) for k in kept):
            want[r["seq"]] = "fuzzy_content"
        else:
            kept.append(r)
    titled, first, left = [], {}, []
    for r in kept:
        if r["t"] and r["t"] in first:
            want[r["seq"]] = "title"
        else:
            first[r["t"]] = r["seq"]
            left.append(r)
    for r in left:
        if any(near(r["t"], k["t"], 0.9) for k in titled):
            want[r["seq"]] = "title"
        else:
            titled.append(r)
            want[r["seq"]] = "unique"
    assert {k: v for k, (v, _) in got.items()} == want
    assert all((o is None) == (k in ("unique", "short_content")) or k == "unique" for k, o in got.values())


def test_vocabulary_round_trip(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "token string, cnt bigint")
    v = vocab.build(freq)
    assert {r["token"]: r["id"] for r in v.collect()} == {"a": 4, "b": 5}
    lists = spark.createDataFrame([(1, ["a", "z", "b"]), (2, [])], "id bigint, s array<string>")
    ids = vocab.encode(lists, "id", "s", v, 4)
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [4, 1, 5, 0], 2: [0, 0, 0, 0]}
    assert {r["id"]: r["text"] for r in vocab.decode(ids, "id", v).collect()} == {1: "a<UNK>b", 2: ""}


def test_synthetic_families(spark):
    got = {k: d.distinct().count() for k, d in synth.families(spark).items()}
    assert got["cluster"] == 1190 and got["independent"] == 190 and got["digits"] == 110 and got["consonant_vowel"] == 875
    tokens = {r["token"] for r in synth.all_tokens(spark).collect()}
    assert {"ស្ត្រ", "ហ្វ្រ", "ង្ក្រ", "សាស្ត្រ", "ស្ត្រី", "សាស្ត្រា", "ហ្វ្រង្ក", "អង្ក្រង"} <= tokens


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ក\nខ".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfea\0")
    (tmp_path / "c.bin").write_bytes(b"x")
    docs = {r["filename"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(docs) == {"a.txt", "b.txt"} and docs["a.txt"]["line_count"] == 2 and docs["b.txt"]["content"] == "a"
    groups = files.line_groups(spark.createDataFrame([("aaa\nbbb\ncccccccccc\nd",)], "content string"), most=8).first()["groups"]
    assert groups == ["aaa\nbbb", "cccccccccc", "d"]
    units = spark.createDataFrame([("<<ab<<",)], "u string")
    model = ngrams.train(units, "u", 3, "")
    sinks.save_model(model, str(tmp_path / "m"))
    back = sinks.load_model(spark, str(tmp_path / "m"), 3, "")
    assert {r["ngram"] for r in back.ngrams.collect()} == {r["ngram"] for r in model.ngrams.collect()} == {"<<a", "<ab", "ab<", "b<<"}


def test_streaming_validation(spark, tmp_path):
    from lexisift.streaming import scoring

    df = spark.createDataFrame([(1, "កខគ " * 10), (2, None)], "id bigint, text string")
    df.write.parquet(str(tmp_path / "in"))
    out = scoring.validated(scoring.texts(spark, str(tmp_path / "in"), df.schema)).select("id", "is_valid", "syllable_count")
    scoring.run_to(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {r["id"]: r["is_valid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: False}


def test_white_space_as_python(spark):
    text = "a b　c\x1cd\te"
    assert one(spark, text, T.words("t"))[0] == text.split()
    assert regex.split(r"\s", "a b") == ["a", "b"]


def test_error_merge(spark):
    from lexisift.operators import neural

    rows = [(1, 0, "x", "rule", 0.5, "a", 0), (1, 0, "x", "char", 0.58, "b", 1), (1, 0, "x", "syll", 0.52, "c", 2), (1, 5, "y", "rule", 0.9, "a", 0), (1, 5, "y", "char", 0.3, "b", 1)]
    rows = [(*x, x[3]) for x in rows]
    df = spark.createDataFrame(rows, "id bigint, position bigint, segment string, type string, confidence double, description string, ord int, source string")
    got = {r["position"]: (r["type"], r["confidence"], r["description"]) for r in neural.merged_errors(df, "id").collect()}
    assert got == {0: ("char", 0.58, "b (also detected by syll)"), 5: ("rule", 0.9, "a")}


def test_final_score(spark):
    from lexisift.operators import neural

    df = spark.createDataFrame([(0.8, None, 1.0, 0), (None, None, 1.0, 0), (0.9, 0.9, 0.5, 0)], "a double, b double, g double, n int")
    score, valid = neural.final_score({"a": F.col("a"), "b": F.col("b")}, {"a": 0.6, "b": 0.4}, F.col("g"), F.col("n"))
    got = [(round(r[0], 6), r[1]) for r in df.select(score, valid).collect()]
    assert got == [(0.8, True), (0.0, False), (0.675, True)]


def test_ranked_slices(spark):
    r = random.Random(12)
    keys = r.sample(range(10**6), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {}
    for x in voting.ranked_slices(df, "k", [0, 1000, 2990], 20).collect():
        got.setdefault(x["fold"], set()).add(x["k"])
    s = sorted(keys)
    assert got == {0: set(s[:20]), 1: set(s[1000:1020]), 2: set(s[2990:])}


def test_greedy_decides_long_chains(spark):
    keys = spark.range(200).withColumnRenamed("id", "seq")
    pairs = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    assert {x["seq"]: x["kept"] for x in dedup.greedy(keys, pairs).collect()} == {k: k % 2 == 0 for k in range(200)}


@pytest.mark.parametrize("name", ["ensemble_metrics", "ensemble_votes", "hybrid_performance", "fusion_sweep"])
def test_models_are_trained_and_joined_once(spark, monkeypatch, name):
    from lexisift.plans import registry

    trained = []
    train = ngrams.train
    monkeypatch.setattr(ngrams, "train", lambda *a, **k: trained.append(a) or train(*a, **k))
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(trained) == 6
    assert "context_cnt" not in plan


def test_models_counted_together_equal_each_alone(spark):
    from lexisift.operators import counting
    from lexisift.plans.models import _ALL

    r = random.Random(3)
    letters = "កខគរសាិុេំ៉្្ឥ។៥៦ <a1​\t\n\x1c 　\x00😀"
    texts = ["", None, " ", "​", "abc", "a b", "ក", "ក ខ", "ក\x1cខ គ", "<<", "\x00ក", "ក" * 30] + ["".join(r.choices(letters, k=r.randrange(1, 80))) for _ in range(120)]
    df = spark.createDataFrame([(x,) for x in texts], "kt string")
    want = {}
    for k, (kind, n) in enumerate(_ALL):
        units, sep = (ngrams.char_units("kt", n), "") if kind == "char" else (ngrams.syllable_units("kt", n), " | ")
        want |= {(k, x["ngram"]): x["cnt"] for x in ngrams._counts(df.select(units.alias("u")), "u", n, sep).collect()}
    rows = lambda: [(x["model"], x["ngram"], x["cnt"]) for x in counting.counted(df, "kt", _ALL).collect()]
    got = rows()
    assert len(got) == len(want) and {(m, g): c for m, g, c in got} == want
    batches = list(counting._tasks([x or "" for x in texts], _ALL, held=40, words=5, known=9, most=11, size=60))
    small = Counter()
    for b in batches:
        for m, g, c in zip(*(c.to_pylist() for c in b.columns)):
            small[m, g] += c
    assert dict(small) == want and len(batches) > 20


@pytest.mark.parametrize("name", ["ensemble_metrics", "ensemble_votes", "hybrid_performance", "fusion_sweep"])
def test_corpus_is_read_once_for_all_models(spark, monkeypatch, name):
    from lexisift.plans import models, registry

    read = []
    real = models.projected
    monkeypatch.setattr(models, "projected", lambda *a: read.append(a) or real(*a))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(read) == 1
