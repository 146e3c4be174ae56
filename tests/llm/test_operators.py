"""Brute-force checks and edge cases of the training-data operators."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexisift.llm import avi, bpe, chat, hamming, linededup, lm, neardup, packing, quality, shingles, tries

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "héllo <|endoftext|> 漢字 😀"), (6, "x" * 30000), (7, "word " * 9000)]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None if i == 2 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({"ids": F.lit("x"), "kept": F.lit(1), "n_lines": F.lit(2), "score": F.lit("y"), "keep": F.lit(0)}) if extra else df


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


# 4: encoding and decoding


def test_codec_equals_the_library(tokenizer):
    c, r = bpe.Codec(PATH), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzAB  \n\t.,!'éüßñ0123ក្កñ漢字😀​\u0085"
    texts = ["".join(r.choice(letters[: r.randrange(2, len(letters))]) for _ in range(r.randrange(80))) for _ in range(1500)] + [t or "" for _, t in ODD]
    for x in texts:
        ids = tokenizer.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == ids
        assert c.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_tokens_and_pairs_equal_the_library(tokenizer):
    """The text of each token, and of tokens side by side, is coded as the library does."""
    c, r = bpe.Codec(PATH), random.Random(17)
    pieces = [p.decode() for p in c.age if p.isascii()]
    for x in r.sample(pieces, 3000) + [a + b for a, b in zip(r.sample(pieces, 3000), r.sample(pieces, 3000))]:
        assert c.encode(x) == tokenizer.encode(x, add_special_tokens=False).ids


def test_codec_frames(spark, tokenizer):
    coded = bpe.encode(docs(spark, ODD, extra=True), PATH)
    back = bpe.decode(coded, PATH).select("text", "decoded", "ids").collect()
    for r in back:
        assert r["decoded"] == (r["text"] or "") and r["ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
    digests = bpe.round_trip(docs(spark, ODD), PATH).collect()
    assert len(digests) == len(ODD)
    assert {d["ids_sha256"] for d in digests if d["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.round_trip(docs(spark, []), PATH).count() == 0


# 10: packing


def test_capacities_against_search():
    r = random.Random(2)
    tree, open_at = packing.Capacities(50), []
    for k in range(3000):
        if open_at and r.random() < 0.6:
            least = r.randrange(1, 51)
            best = min((x for x in open_at if x >= least), default=None)
            found = tree.take(least)
            assert (found and found[0]) == best
            if found:
                open_at.remove(found[0])
        else:
            open_at.append(x := r.randrange(1, 51))
            tree.add(x, k)


def test_packing(spark, tokenizer):
    rows = ODD + [(100 + k, "lorem ipsum " * (k % 97)) for k in range(300)]
    out = packing.pack(docs(spark, rows, extra=True), PATH, block=100).toPandas()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    seen = defaultdict(int)
    for p in out.itertuples():
        key = None if p.doc_id != p.doc_id else int(p.doc_id)
        part = ids[key][p.start : p.start + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[key])
        seen[key] += p.length
    copies = Counter(i for i, _ in rows)
    assert seen == {i: len(ids[i]) * n for i, n in copies.items()}
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
    assert out["length"].sum() / (1024 * out["sequence_id"].nunique()) > 0.93
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_best_fit_against_naive_search():
    """Windows, offsets and their number equal those of a plain best-fit decreasing that looks at every open window."""
    r = random.Random(21)
    for _ in range(30):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 200))]
        room, at = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [w for w, x in enumerate(room) if x >= lengths[i]]
            least = min((room[w] for w in fits), default=None)
            if least is None:
                room.append(64)
                least = 64
            at[i] = least
            w = max((w for w, x in enumerate(room) if x == least))
            room[w] -= lengths[i]
        got, offset, n = packing.best_fit(lengths, 64)
        assert n == len(room) and [64 - o for o in offset] == [at[i] for i in range(len(lengths))]
        assert sorted(64 - sum(x for x, w in zip(lengths, got) if w == k) for k in range(n)) == sorted(room)


def test_packing_deals_repeated_rows(spark):
    """Equal rows without doc_id do not meet in one block."""
    out = packing.pack(docs(spark, [(None, "same text")] * 3000), PATH, block=100)
    sizes = [x["count"] for x in out.groupBy(F.shiftright("sequence_id", 40).alias("block")).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200


# 5: near duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    rows = [(i, t) for i, t in ODD if i not in (None, 4)] + [(4, "a b c")]
    for g in range(6):  # groups whose copies are edited in different places, around the threshold
        base = r.choices(words, k=120)
        for k in range(12):
            edited = list(base)
            for _ in range(r.randrange(0, 8)):
                edited[r.randrange(120)] = "e%d" % r.randrange(10**6)
            rows.append((1000 - 20 * g - k, " ".join(edited)))
    rows += [(2000 + k, "Copy of  this TEXT") for k in range(5)] + [(3000, "one"), (3001, "ONE"), (3002, "one two")]
    for n, percent in ((3, 85), (5, 80)):
        label, size = brute_components(rows, n, percent)
        got = neardup.near_duplicates(docs(spark, rows, extra=True), words=n, percent=percent, blocks=8).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == label
        assert all(x["n_shingles"] == size[x["doc_id"]] and x["kept"] == (label[x["doc_id"]] == x["doc_id"]) for x in got)


def test_near_duplicates_centre_is_an_outsider(spark, monkeypatch):
    """A crowd that is alike among itself but not like its table's centre gets its own centre: no pairs within it are formed."""
    r = random.Random(5)
    base = ["w%d" % k for k in range(100)]
    crowd = [base[:k] + ["e%d" % k] + base[k + 1 :] for k in range(40)]  # each one word off
    far = [base[:60] + ["o%d" % r.randrange(10**6) for _ in range(40)] for _ in range(5)]
    rows = [(i, " ".join(w)) for i, w in enumerate(far + crowd)]
    tables = spark.createDataFrame([(1, i) for i in range(45)] + [(2, i) for i in range(5)], "key bigint, rep bigint")  # one is centre of all
    seen = []
    real = neardup.compared
    monkeypatch.setattr(neardup, "compared", lambda pairs, *a, **b: seen.append(pairs.count()) or real(pairs, *a, **b))
    links, labels = neardup.star_links(tables, tables.selectExpr("rep as node").distinct(), docs(spark, rows), 5, 80)
    assert seen[0] == 44 and sum(seen) < 3 * 45
    first = {x["node"]: x["label"] for x in labels.collect()}
    assert all(first[i] == i for i in range(5))
    monkeypatch.setattr(neardup, "CROWD", 2)
    label, _ = brute_components(rows, 5, 80)
    got = neardup.near_duplicates(docs(spark, rows), words=5, percent=80).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == label


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] is None] == [(None, True)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


# 7: lines


def sql_rows(sql, **tables):
    c = duckdb.connect()
    for k, v in tables.items():
        c.register(k, v)
    return c.execute(sql).fetchall()


def test_spread_lines_against_sql(spark):
    r = random.Random(6)
    lines = ["line %d" % k for k in range(60)]
    rows = [(i, "\n".join(r.choices(lines, k=r.randrange(1, 6))), "en", f"s{r.randrange(8)}" if i % 9 else None, 1) for i in range(150)] + [(500, None, "en", "s1", 0), (501, "", "en", "s2", 0), (None, " line 1 \nline 2", "en", "s3", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = linededup.drop_spread_lines(df.withColumn("n_lines", F.lit("old"))).collect()
    want = sql_rows(linededup.SQL, documents=df.toPandas().astype({"doc_id": "Int64"}))
    key = lambda x: repr((x[0], x[1]))
    assert sorted([(x["doc_id"], x["text"], x["n_lines"], x["n_removed"]) for x in got], key=key) == sorted([(x[0], x[1], x[5], x[6]) for x in want], key=key)
    assert linededup.drop_spread_lines(docs(spark, [])).count() == 0
    same = "\n".join("five words are in line %d" % k for k in range(30))
    rows = [(k, same + "\nedited in copy %d" % k, "en", f"s{k}", 1) for k in range(8)] + [(20 + k, "\n".join(same.split("\n")[:15] + ["own %d words of %d" % (k, j) for j in range(15)]), "en", f"s{k}", 1) for k in range(5)]
    copies = spark.createDataFrame(rows, DOCS)
    removed = {x["doc_id"]: x["n_removed"] for x in linededup.drop_spread_lines(copies, spare_copies=True).collect()}
    assert removed == {k: 0 for k in range(8)} | {20 + k: 15 for k in range(5)}
    assert {x["n_removed"] for x in linededup.drop_spread_lines(copies).where("doc_id between 1 and 7").collect()} == {30}


def test_spared_copies_are_near_duplicates(spark):
    """Every document that is spared reaches the similarity of the next stage with an earlier one."""
    r = random.Random(61)
    rows = []
    for g in range(12):
        base = [" ".join(r.choices("alpha beta gamma delta eps zeta".split(), k=r.randrange(1, 14))) + f" g{g} l{k}" for k in range(r.randrange(8, 40))]
        for k in range(6):
            text = [x if r.random() > 0.02 * (g % 6) else x + " edit%d" % r.randrange(999) for x in base]
            rows.append((100 * g + k, "\n".join(text), "en", f"s{k}", 1))
    spared = {x["doc_id"] for x in linededup.drop_spread_lines(spark.createDataFrame(rows, DOCS), spare_copies=True).where("n_removed = 0").collect()}
    label, _ = brute_components([(i, t) for i, t, *_ in rows], 5, 80)
    assert all(label[i] < i for i in spared if i % 100) and len(spared) > 20


# 2: quality


def test_quality_posteriors(spark):
    good, bad = "Some plain words in a calm line of text.\nAnother line follows here.", "BUY!! NOW!! CHEAP!! DEAL!! | x | y |"
    rows = [(i, (bad if i % 5 == 0 else good) + " %d" % i, "en", "big" if i % 3 else f"tiny{i}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.assess(df, labels).collect()}
    assert all(got[i]["keep"] == (i % 5 != 0) for i in range(300))
    mean = sum(x["doc_score"] for x in got.values()) / 300 / quality.UNIT
    host = {h: [x for x in got.values() if x["source"] == h] for h in {x["source"] for x in got.values()}}
    for members in host.values():  # a posterior lies between the site's own mean and the prior's
        own = sum(x["doc_score"] for x in members) / len(members) / quality.UNIT
        assert min(own, mean) - 1e-6 <= members[0]["host_posterior"] <= max(own, mean) + 1e-6
    big, tiny = host["big"][0]["host_posterior"], [m[0]["host_posterior"] for h, m in host.items() if h != "big"]
    assert max(abs(x - mean) for x in tiny) < 0.5 and abs(big - mean) < 0.1
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 240


def test_quality_by_brute_force(spark):
    """Posteriors and scores of a small table equal loops over the documents' own probabilities."""
    r = random.Random(31)
    rows = [(i, r.choice(["Calm words here, all fine.", "BUY!! NOW!! | x |"]) + " t%d" % r.randrange(50), r.choice(["en", "de"]), "h%d" % min(r.randrange(12), 7), 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int("BUY" not in rows[i][1]), 0) for i in range(0, 200, 3)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.assess(spark.createDataFrame(rows, DOCS), labels).collect()}
    p = {i: got[i]["doc_score"] / quality.UNIT for i in got}
    mean = sum(p.values()) / len(p)

    def weight(groups, prior):
        n, squares = sum(len(g) for g in groups.values()), sum(len(g) ** 2 for g in groups.values())
        spread = sum(len(g) * (sum(g) / len(g) - prior[k]) ** 2 for k, g in groups.items())
        within = max(mean * (1 - mean), 1e-6)
        between = (spread - (len(groups) - 1) * within) / (n - squares / n)
        return round(min(max(within / max(between, 1e-9) - 1, 1.0), 10_000.0), 3)

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, lang, source, _ in rows:
        hosts[source].append(p[i])
        paths[source, lang].append(p[i])
    k = weight(hosts, {h: mean for h in hosts})
    host = {h: (sum(g) + k * mean) / (len(g) + k) for h, g in hosts.items()}
    k = weight(paths, {x: host[x[0]] for x in paths})
    path = {x: (sum(g) + k * host[x[0]]) / (len(g) + k) for x, g in paths.items()}
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i, _, lang, source, _ in rows:
        z = odds(p[i]) + odds(path[source, lang]) - odds(mean)
        assert got[i]["host_posterior"] == pytest.approx(host[source], abs=2e-6) and got[i]["path_posterior"] == pytest.approx(path[source, lang], abs=2e-6)
        assert got[i]["quality_score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6) and got[i]["keep"] == (got[i]["quality_score"] >= 0.5)


def test_quality_fit_is_bounded(spark):
    """Rows that repeat a labelled doc_id come to the driver once."""
    many = docs(spark, [(1, "text %d" % i) for i in range(300)] + [(2, "BUY!!")])
    model = quality.fit(many, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int"), most=10)
    assert model.prior == 0.5


def test_site_parts(spark):
    df = spark.createDataFrame([("https://A.org/x/y",), ("http://b.net",), (None,), ("no address",)], "url string")
    assert [tuple(x) for x in df.select(*quality.site_parts(F.col("url"))).collect()] == [("a.org", "/x"), ("b.net", ""), ("", ""), ("", "")]


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.assess(docs(spark, ODD, extra=True), none).collect()
    assert len(got) == len(ODD) and all(x["keep"] for x in got)
    kept = quality.keep_good(docs(spark, ODD, extra=True), none)
    assert kept.count() == len(ODD) and {r["keep"] for r in kept.collect()} == {0}
    assert quality.assess(docs(spark, []), none).count() == 0


# 3: token counts


def test_trie_counts_against_brute_force(spark):
    score = tries.scores(PATH)
    longest = max(map(len, score))

    def brute(piece):
        b = piece.encode()
        best = [(0, 0)]
        for e in range(1, len(b) + 1):
            best.append(max((best[i][0] + score[b[i:e]], best[i][1] - 1) for i in range(max(0, e - longest), e) if b[i:e] in score))
        return -best[-1][1]

    find = bpe.Codec(PATH).find
    texts = [(i, t) for i, t in ODD if t is None or len(t) < 100]
    got = tries.count_tokens(docs(spark, texts, extra=True), PATH).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"]) for x in got) == sorted((str(i), sum(map(brute, find(t or "")))) for i, t in texts)
    small = tries.Trie(score, most=50)
    assert [small.tokens(w) for w in ("therefore", " banana", "漢字", "therefore")] == [brute(w) for w in ("therefore", " banana", "漢字", "therefore")]
    assert tries.count_tokens(docs(spark, ODD), PATH).count() == len(ODD)
    r = random.Random(13)
    word = "".join(r.choices("abcdetion", k=6000))
    big = tries.Trie(score)
    assert big.tokens(word) == brute(word) and len(big.best) == 1  # long runs put nothing in the trie


# 6: media


def test_avi_round_trip(spark):
    r = random.Random(8)
    for n in (0, 1, 575, 576, 577, 5000):
        data = bytes(r.randrange(256) for _ in range(n))
        payload = data + b"\xff" * (576 if not n else -n % 576)
        found, rate = avi.frames(avi.write(payload))
        assert avi.samples(found).tobytes() == payload and rate == 25
    picture = avi.pixels(found[0])
    assert (picture.reshape(18, 8, 32, 8).min(axis=(1, 3)).ravel() == np.frombuffer(payload[:576], np.uint8)).all()
    assert (picture.reshape(18, 8, 32, 8).max(axis=(1, 3)).ravel() == np.frombuffer(payload[:576], np.uint8)).all()
    with pytest.raises(ValueError):
        avi.frames(b"RIFF....WAVE")
    rows = {x["doc_id"]: x for x in avi.digests(docs(spark, [(1, None), (2, ""), (3, "é" * 400), (4, "é" * 400)])).collect()}
    assert rows[1]["payload_sha256"] == rows[2]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert rows[3]["n_bytes"] == 800 and rows[3]["payload_bytes"] == 1152 and rows[3]["feature"] == rows[4]["feature"]
    assert rows[1]["tail_crc32"] == zlib.crc32(b"\xff" * 32)


def test_clips(spark):
    dark, light = bytes([10]) * 576, bytes([240]) * 576
    media = avi.write(dark * 5 + light * 7)
    files = spark.createDataFrame([(1, media), (2, None)], "doc_id bigint, media binary")
    assert [tuple(x) for x in avi.clips(files).orderBy("clip").collect()] == [(1, 0, 0, 200, 0, 5, None), (1, 1, 200, 480, 5, 7, None)]
    made = avi.media(docs(spark, ODD))
    assert made.count() == len(ODD) and avi.clips(made.select("doc_id", "media")).where("error is null").count() >= len(ODD)
    bad = spark.createDataFrame([(1, b"no media"), (2, media[:300]), (3, media[:-1000]), (4, b""), (None, media)], "doc_id bigint, media binary")
    got = avi.clips(bad.withColumns({"clip": F.lit(1), "text": F.lit("x")})).collect()
    assert sorted(x["doc_id"] for x in got if x["error"]) == [1, 2, 3, 4] and all(x["clip"] is None for x in got if x["error"]) and len(got) == 6


def test_shots_against_plain_rule():
    """Cuts equal those of a loop that keeps every difference within the shot."""
    r = np.random.default_rng(14)
    level = np.repeat(r.integers(0, 200, 25), r.integers(1, 9, 25))
    values = np.clip(level[:, None] + r.integers(0, 40, (len(level), 576)), 0, 255).astype(np.uint8)
    hist = [[int((row >> 4 == b).sum()) for b in range(16)] for row in values]
    cuts, within = [0], []
    for k in range(1, len(hist)):
        j = sum(abs(a - b) for a, b in zip(hist[k], hist[k - 1]))
        near = within[-8:]
        m = sum(near) / len(near) if near else 0
        s = math.sqrt(sum((x - m) ** 2 for x in near) / len(near)) if near else 0
        if j > 200 and j > m + 3 * s:
            cuts.append(k)
            within = []
        else:
            within.append(j)
    assert avi.shots(avi.histograms(values)) == cuts and len(cuts) > 10


def test_colour_frames():
    """A colour frame with halved colour planes and a size that is no multiple of its units."""
    dc, ac = [(1, 0), (2, 4)], [(1, 0)]
    quant = avi._segment(0xDB, b"\0" + bytes([8] * 64))
    size = avi._segment(0xC0, bytes([8, 0, 20, 0, 18, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head = b"\xff\xd8" + quant + size + avi._segment(0xC4, avi._table(0, dc) + avi._table(0x10, ac)) + avi._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    unit = "10" + "1010" + "0" + ("0" + "0") * 3  # luma: a difference of 10 once, then none
    bits = unit + ("0" + "0") + ("10" + "1000" + "0") + (("0" + "0") * 6) * 3  # blue 0, red 8, and three units without change
    bits += "1" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    y, cb, cr = avi.planes(frame)
    assert y.shape == (20, 18) and cb.shape == cr.shape == (10, 9)
    assert (y == 138).all() and (cb == 128).all() and (cr == 136).all()
    assert (avi.picture(frame) == np.array([149, 132, 138])).all()
    assert avi.frame_histograms([memoryview(frame)])[0].tolist() == [0] * 8 + [576] + [0] * 7
    for cut in (10, len(head), len(frame) - 4):
        with pytest.raises((ValueError, IndexError, KeyError)):
            avi.pixels(frame[:cut])


def test_general_frames():
    """A frame with AC coefficients and other tables, decoded symbol by symbol."""
    dc, ac = [(2, 0), (2, 3), (3, 5)], [(1, 0), (2, 2)]
    head = b"\xff\xd8" + avi._segment(0xDB, b"\0" + bytes([2] * 64)) + avi._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + avi._segment(0xC4, avi._table(0, dc) + avi._table(0x10, ac)) + avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = "01" + "101" + "10" + "11" + "0"  # DC of 3 bits: 5; AC of 2 bits: 3; end
    bits += "1" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    k = np.arange(8)
    want = np.rint(128 + 10 / 8 + 6 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * k + 1) * np.pi / 16))
    assert (avi.pixels(frame) == want[None]).all()


# 8: search


@pytest.mark.parametrize("dims", [64, 16, 40])
def test_hamming_against_brute_force(spark, dims):
    r = np.random.default_rng(9)
    x = r.normal(size=(400, dims)).astype(np.float32)
    x[100:220] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (900, None), (901, [])], "vec_id bigint, embedding array<float>")
    twice = df.where("vec_id % 20 = 0").withColumns({"code": F.lit("x"), "block": F.lit(1)})
    got = hamming.nearest(df.withColumns({"code": F.lit("x"), "block": F.lit(1)}), twice.union(twice), k=10, row_block=150).collect()
    b = x > 0
    want = []
    for q in range(0, 400, 20):
        d = (b != b[q]).sum(axis=1)
        want += [(q, k + 1, int(i), int(d[i])) for k, i in enumerate(np.lexsort((np.arange(400), d))[:10])]
    assert sorted(map(tuple, got)) == want
    assert hamming.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3").union(spark.createDataFrame([(7, [1.0, None]), (8, [1.0, -1.0]), (8, [1.0, -1.0])], "vec_id bigint, embedding array<float>"))
    small = [tuple(x) for x in hamming.nearest(few, few.where("vec_id >= 2"), k=10).collect()]
    assert sorted(x[2] for x in small if x[0] == 2) == [0, 1, 2] and sorted(x for x in small if x[0] > 2) == [(8, 1, 8, 0), (8, 2, 8, 0)]


def test_hamming_radius_ends_by_its_cover():
    """The search stops as soon as the k-th distance is covered, far from probing everything, and is exact."""
    r = np.random.default_rng(12)
    x = r.normal(size=(4096, 64))
    x[1:2000:2] = x[:2000:2] + 0.15 * r.normal(size=(1000, 64))  # half have a near neighbour
    words = hamming.codes(x)
    distinct = np.unique(words, axis=0)
    index = hamming.Index(distinct, 64)
    assert [n for _, n in index.cuts] == [12, 13, 13, 13, 13]
    asked = words[:128]
    for k in (1, 2, 10):
        who, code, far, last = index.search(asked, k, np.ones(len(distinct), np.int64))
        d = np.bitwise_count(distinct[None] ^ asked[:, None]).sum(axis=2)
        for q in range(128):
            kth = np.sort(d[q])[k - 1]
            assert sorted(far[who == q]) == sorted(d[q][d[q] <= kth])
            assert last[q] == max(0, -(-(int(kth) + 1) // 5) - 1)  # the first radius that covers the k-th distance
        assert last.max() < 13


# 1: preferences


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "longer answer"), (1, 1, "assistant", "longer answer"), (2, 0, "user", "hi"), (2, 1, "assistant", "short"), (3, 0, "user", "alone"), (3, 1, "assistant", "reply"), (None, 0, "user", "x"), (4, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = {x["chosen_id"]: x for x in chat.preferences(chat.paired(chat.conversations(df))).collect()}
    assert set(out) == {1, 3, 4} and out[1]["rejected_id"] == 2
    p = out[1]
    assert p["prompt"] == "<|user|>\nhi<|end|>\n" and p["prompt_turns"] == 1
    assert [p["chosen_text"][a:b] for a, b in p["chosen_spans"]] == ["longer answer<|end|>"]
    assert [p["rejected_text"][a:b] for a, b in p["rejected_spans"]] == ["short<|end|>"]
    assert out[3]["rejected_text"] == "" and out[3]["prompt_turns"] == 1
    assert chat.preferences(chat.paired(chat.conversations(df.limit(0)))).count() == 0


# 9: language model


def test_language_model(spark):
    r = random.Random(10)
    en, de = ["the", "cat", "sat", "on", "mat"], ["der", "hund", "lag", "im", "bett"]
    rows = [(i, " ".join(r.choices(de if i % 3 == 0 else en, k=40)) + (" rare%d" % i)) for i in range(400)] + [(1000, None), (1001, ""), (None, "the cat")]
    out = lm.score(docs(spark, rows, extra=True), rounds=2).collect()
    words = {i: (re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [" "]) for i, t in rows}
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for x in out:
        ws = words[x["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert x["base_score"] == pytest.approx(base, rel=1e-9) and x["n_tokens"] == len(ws) and x["n_known"] == sum(c[w] > 0 for w in ws)
        assert x["held_out"] == held[x["doc_id"]] and x["train_tokens"] == n and x["score"] < 0
    test = [x for x in out if x["held_out"] and x["n_tokens"] > 10]
    assert sum(x["score"] for x in test) > sum(x["base_score"] for x in test)
    assert lm.score(docs(spark, [])).count() == 0


def test_language_model_is_a_distribution(spark):
    """Over all known words, the end and one unknown word, probabilities after a context sum to one."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choices(["w%d" % k for k in range(60)], weights=[1 / (k + 1) ** 2 for k in range(60)], k=12))) for i in range(60)]
    df = docs(spark, rows)
    counts = lm.counted(df)
    voc = lm.vocabulary(counts, 1000)
    inside = np.zeros(lm.CLASSES)
    for k in range(len(voc.words)):
        inside[voc.classes[k]] += 10 ** voc.inside[k]
    used = np.unique(voc.classes)
    assert inside[used] == pytest.approx(1.0)
    rare = [x["c"] for x in counts.collect() if x["word"] not in set(voc.words.tolist())]
    assert len(rare) == voc.rare_words and sum(rare) == voc.rare_total
    if rare:
        assert sum(x - voc.discount for x in rare) / voc.rare_total + voc.discount * voc.rare_words / voc.rare_total == pytest.approx(1.0)


def trained(spark, df, rounds=1, head=1000):
    sc = spark.sparkContext
    voc = sc.broadcast(lm.vocabulary(lm.counted(df), head))
    weights = np.zeros((voc.value.rows, lm.CLASSES), np.float32)
    for _ in range(rounds):
        weights = lm.train_round(df, voc, sc.broadcast(weights), 0.3)
    return voc.value, weights


def test_language_model_trains_all_templates(spark):
    """One short document moves the weights of all four feature templates."""
    v, weights = trained(spark, docs(spark, [(1, "the cat sat on the mat and the dog lay on the rug")]))
    sizes = [v.rows_word, v.rows_word, lm.ROWS_PAIR, lm.ROWS_PAIR]
    assert all(np.abs(weights[end - size : end]).max() > 0 for end, size in zip(np.cumsum(sizes), sizes))


def test_language_model_scores_by_brute_force(spark):
    """Scores of whole texts equal sums taken word by word from the weights, and a second round fits better."""
    rows = [(i, " ".join("the cat sat on a mat while dogs ran by".split()[: 2 + i % 8]) + (" odd%d" % i if i % 3 == 0 else "")) for i in range(1, 40)]
    df = docs(spark, rows)
    v, weights = trained(spark, df)
    counts = {x["word"]: x["c"] for x in lm.counted(df).collect()}
    ids = lm.Ids(v)
    rank = {w: k for k, w in enumerate(v.words.tolist())}

    def place(w):
        return rank.get(w, ids.known + w % 2**64 % lm.RARE)

    def one(text):
        words = [int(lm.words_at(w.encode())[0].view(np.int64)[0]) for w in text.split()] + [lm.END]
        seen, total = [ids.pad] * lm.PAD + [place(w) for w in words], 0.0
        for k, w in enumerate(words, lm.PAD):
            back = [seen[k - j] for j in (1, 2, 3, 4)]
            h = [x * 2654435761 % 4294967291 % v.rows_word for x in back]
            c = [int(ids.classes[x]) for x in back]
            at = [h[0], v.rows_word + h[1], 2 * v.rows_word + c[0] * 64 + c[1], 2 * v.rows_word + 4096 + c[2] * 64 + c[3]]
            z = v.prior + sum(weights[a].astype(float) for a in at)
            total += math.log10(math.exp(z[ids.classes[seen[k]]]) / np.exp(z).sum())
            total += v.inside[rank[w]] if w in rank else math.log10((counts[w] - v.discount) / v.rare_total)
        return total

    def whole(text, weights):
        sc = spark.sparkContext
        got = lm.score_frequent(docs(spark, [(1, text)]), sc.broadcast(v), sc.broadcast(weights)).collect()[0]
        return got["score"] + sum(n * math.log10((counts[w] - v.discount) / v.rare_total) for w, n in zip(got["rare"], got["times"]))

    for i in (3, 8, 9):
        assert whole(rows[i - 1][1], weights) == pytest.approx(one(rows[i - 1][1]), rel=1e-4)
    _, more = trained(spark, df, rounds=2)
    assert sum(whole(t, more) for _, t in rows[:6]) > sum(whole(t, weights) for _, t in rows[:6])


def test_language_model_row_sums():
    r = np.random.default_rng(3)
    rows = r.integers(0, 40, 500).astype(np.int32)
    p = r.normal(size=(500, 8)).astype(np.float32)
    to, sums, seen = lm.row_sums(p, rows)
    for a, s, n in zip(to, sums, seen):
        assert n == (rows == a).sum() and s == pytest.approx(p[rows == a].sum(axis=0), abs=1e-4)


def test_language_model_row_sums_of_several_templates():
    """All templates in one go, with rows met more often than a run of runs is long."""
    r = np.random.default_rng(4)
    rows = np.stack([np.where(r.random(3000) < 0.6, 7, r.integers(0, 900, 3000)), r.integers(0, 3, 3000)]).astype(np.uint16)
    p = r.normal(size=(3000, 8)).astype(np.float32)
    to, sums, seen = lm.row_sums(p, rows, np.array([[0], [900]]))
    assert sorted(to) == sorted({*rows[0].tolist(), *(900 + rows[1].astype(int)).tolist()})
    for a, s, n in zip(to, sums, seen):
        of = rows[0] == a if a < 900 else rows[1] == a - 900
        assert n == of.sum() and s == pytest.approx(p[of].sum(axis=0), abs=1e-3)


def test_language_model_scores_without_exponentials_of_tokens(monkeypatch):
    """Scores come from products of the rows' exponentials, and from sums where products come near to nothing."""
    r = np.random.default_rng(5)
    head, prior = 50, np.full(lm.CLASSES, -math.log(lm.CLASSES))
    v = lm.Vocabulary("test", np.arange(head), np.arange(head) + 1, np.zeros(head), np.zeros(head), prior, 1000, head, 0, 0, 0.5, 2048)
    ids = lm.Ids(v)
    x = np.concatenate([np.full(lm.PAD, ids.pad), r.integers(0, head, 300)])
    softmax, asked = lm.softmax, []
    monkeypatch.setattr(lm, "softmax", lambda w, p, rows: asked.append(rows.shape[1]) or softmax(w, p, rows))
    for scale, least, most in ((0.5, 0, 0), (5.0, 1, 299)):
        weights = r.normal(size=(v.rows, lm.CLASSES)).astype(np.float32) * np.float32(scale)
        asked.clear()
        got = lm.token_scores(x, v, ids, weights)[lm.PAD :]
        assert least <= sum(asked) <= most
        z = prior + sum(w[k].astype(float) for w, k in zip(lm.templates(weights), lm.rows_of(x, ids)))
        z -= z.max(axis=1, keepdims=True)
        want = (z[np.arange(300), x[lm.PAD :] + 1] - np.log(np.exp(z).sum(axis=1))) / math.log(10)
        near = want > -25
        assert near.sum() > 100 and got[near] == pytest.approx(want[near], abs=2e-4)


def test_language_model_frequent_words_have_a_class_each(spark):
    """The 31 most frequent words are alone in their classes, of 64."""
    df = docs(spark, [(i, " ".join("w%d" % k for k in range(40) for _ in range(40 - k))) for i in range(3)])
    voc = lm.vocabulary(lm.counted(df), 1000)
    assert lm.CLASSES == 64 and np.bincount(voc.classes, minlength=64)[1:32].tolist() == [1] * 31


def test_words_of_long_texts():
    """Slices and digests of long words change nothing but the hash of a word of over 65,536 bytes, equal words still equal."""
    text = ("Some words, " * 200_000 + "X" * 70_000 + " end " + "x" * 70_000).encode()
    h, at = lm.words_at(text)
    assert len(h) == len(text.split()) and at.tolist() == [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert len(np.unique(h)) == 4 and h[-1] == h[-3] and (h[:2] == lm.words_at(b"some WORDS,")[0]).all()


def test_words_of_texts_are_hashed_by_letters_and_in_linear_time():
    """A word's hash is the sum of its lower-case bytes plus one by powers of their places, wherever it stands."""

    def one(word):
        h = (sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word.lower())) + len(word)) % (1 << 64)
        return int(shingles.mix(np.array([h], np.uint64))[0])

    r = random.Random(6)
    parts = [bytes(r.choice([x for x in range(256) if x not in b" \t\n\x0b\x0c\r"]) for _ in range(r.randrange(1, 9))) for _ in range(20_000)] + [b"AZ[`az{@"]
    assert lm.words_at(b" \n".join(parts))[0].tolist() == [one(w) for w in parts]
    before = time.process_time()
    assert len(lm.words_at(b" ".join([b"x" * 65_000] * 20))[0]) == 20  # each byte began a search for a long word
    assert time.process_time() - before < 5


# all ten: odd tables

LONG_TEXT = "word line\n" * 250_000 + "x" * 2_500_000
CLASH = ("block", "id", "h", "cut_hashes", "hit_doc", "text_left", "lines_left", "common", "site_host", "site_path", "host", "path", "sums", "rid", "set_id", "key", "rep", "comp", "label", "node", "size", "word", "kind", "c", "x", "code", "dims", "asked", "_host", "_path", "_hit_doc", "_cut_hashes", "_text_left", "_lines_left", "bucket", "opening", "said")
NO_LABELS = "doc_id bigint, quality int, toxic int"
TABLE_OPERATORS = {
    "quality": lambda d: quality.assess(d, d.sparkSession.createDataFrame([], NO_LABELS)),
    "keep_good": lambda d: quality.keep_good(d, d.sparkSession.createDataFrame([(1, 1, 0), (6, 0, 0)], NO_LABELS)),
    "tries": lambda d: tries.count_tokens(d, PATH),
    "codec": lambda d: bpe.round_trip(d, PATH),
    "near": neardup.near_duplicates,
    "media": avi.digests,
    "lines": linededup.drop_spread_lines,
    "copies": lambda d: linededup.drop_spread_lines(d, spare_copies=True),
    "model": lm.score,
    "packing": lambda d: packing.pack(d, PATH),
}


@pytest.mark.parametrize("name", sorted(TABLE_OPERATORS))
def test_odd_tables(spark, name):
    """Nulls, empty and long texts, ties, repeats, int ids, columns with clashing names and an empty table."""
    f = TABLE_OPERATORS[name]
    rows = [*ODD, (8, LONG_TEXT), (9, "ab " * 3), (10, "ab " * 3), (None, None)]
    df = docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int")).withColumns({c: F.lit("x") for c in CLASH})
    got = f(df).collect()
    ids = [x["doc_id"] for x in got]
    assert len(set(ids)) >= (1 if name == "keep_good" else len({i for i, _ in rows})) and (name in ("packing", "keep_good") or len(got) == len(rows))
    assert f(df.limit(0)).count() == 0


def test_odd_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [1.0]), (None, [1.0]), (4, None)], "vec_id int, embedding array<double>").withColumns({c: F.lit("x") for c in CLASH})
    got = sorted(tuple(x) for x in hamming.nearest(vectors, vectors, k=2).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0), (3, 1, 3, 0)]
    assert hamming.nearest(vectors.limit(0), vectors).count() == 0


def test_odd_conversations(spark):
    """A long conversation, an opening over all buckets, ties, an end mark in a text, nulls and clashing columns."""
    turns = [(0, k, "user" if k % 2 == 0 else "assistant", "t%d " % k + "x" * 50) for k in range(3000)] + [(c, k, "user" if k == 0 else "assistant", "same" if k == 0 else "answer <|end|>\n") for c in range(1, 900) for k in range(2)]
    df = spark.createDataFrame([*turns, (5000, None, None, None), (None, 1, "user", "x")], "conv_id int, turn int, role string, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = chat.preferences(chat.paired(chat.conversations(df)).withColumns({"prompt": F.lit("x")})).collect()
    used = [x for r in got for x in {r["chosen_id"], r["rejected_id"]}]
    assert sorted(used) == [*range(900), 5000]
    tied = [r for r in got if r["chosen_id"] != r["rejected_id"]]
    assert len(tied) >= 449 and all(r["prompt_turns"] == 2 and r["chosen_text"] == r["rejected_text"] == "" for r in tied)
    long = next(r for r in got if r["chosen_id"] == 0)
    assert long["prompt_turns"] == 2999 and [long["chosen_text"][a:b] for a, b in long["chosen_spans"]] == ["t2999 " + "x" * 50 + "<|end|>"]
