"""Settings, scorers, sinks, sites, reports, fusion and parameter search."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift import config, reports, service
from lexisift.operators import integrator, neural, ngrams, recurrent, search, voting
from lexisift.sources import files, sinks, sites


def test_settings(spark, tmp_path):
    assert config.overlaid({"a": 1, "b": 2}, '{"b": 3}') == {"a": 1, "b": 3} and config.overlaid({"a": 1}, "no json") == {"a": 1}
    config.save(spark, {"rule_weight": 0.5}, str(tmp_path / "c"))
    assert config.load(spark, str(tmp_path / "c"))["rule_weight"] == 0.5
    assert config.load(spark, str(tmp_path / "none")) == config.SERVICE
    assert config.integrator(config.ENSEMBLE) == integrator.Settings()


def weights(r, units=11, size=4, embedding=3, layers=2):
    w = {"embedding": r.normal(size=(units, embedding)), "out.weight": r.normal(size=(units, 2 * size)), "out.bias": r.normal(size=units), "attention.weight": r.normal(size=2 * size), "attention.bias": np.zeros(1)}
    for k in range(layers):
        for d in "fb":
            w |= {f"lstm.{k}.{d}.w_in": r.normal(size=(4 * size, embedding if k == 0 else 2 * size)), f"lstm.{k}.{d}.w_rec": r.normal(size=(4 * size, size)), f"lstm.{k}.{d}.bias": r.normal(size=4 * size)}
    for name in ("query", "key", "value", "project"):
        w |= {f"{name}.weight": r.normal(size=(2 * size, 2 * size)), f"{name}.bias": r.normal(size=2 * size)}
    return w


def test_recurrent_states_step_by_step():
    """One layer's states equal the cell's equations unit by unit."""
    w = weights(np.random.default_rng(1), layers=1)
    ids = np.array([[1, 5, 2]])
    got = recurrent.states(ids, w)[0]
    sig = lambda v: 1 / (1 + np.exp(-v))
    for d, order, half in (("f", (0, 1, 2), slice(0, 4)), ("b", (2, 1, 0), slice(4, 8))):
        h = c = np.zeros(4)
        for t in order:
            g = w[f"lstm.0.{d}.w_in"] @ w["embedding"][ids[0, t]] + w[f"lstm.0.{d}.w_rec"] @ h + w[f"lstm.0.{d}.bias"]
            c = sig(g[4:8]) * c + sig(g[:4]) * np.tanh(g[8:12])
            h = sig(g[12:]) * np.tanh(c)
            assert got[t, half] == pytest.approx(h)


def test_recurrent_scorers(spark, tmp_path):
    w = weights(np.random.default_rng(2))
    sinks.save_weights(spark, w, str(tmp_path / "w"))
    back = sinks.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all((back[k] == w[k]).all() for k in w)
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [1, 2, 3])], "id bigint, ids array<int>")
    for kind, f in (("char", recurrent.char_logits), ("syllable", recurrent.syllable_logits)):
        got = {r["id"]: r["x"] for r in df.withColumn("x", recurrent.predictor(w, kind, 5, 0.7)("ids")).collect()}
        p = recurrent.probabilities(f(np.array([[0, 0, 1, 2, 3]]), w), 0.7)[0]
        assert got[1]["unit"] == p.argmax() and got[1]["confidence"] == pytest.approx(p.max()) and got[1] == got[4] and got[2] == got[3]
        drawn = [r["x"]["unit"] for r in df.withColumn("x", recurrent.predictor(w, kind, 5, top=2, seed=3)("ids")).orderBy("id").collect()]
        assert drawn[0] == drawn[3]
        each = {r["id"]: r["x"] for r in df.withColumn("x", recurrent.unit_perplexities(w, kind, 5)("ids")).collect()}
        q = recurrent.softmax(f(np.array([[0, 0, 0, 0, 1]]), w))[0, 2]
        assert each[1][0] == each[1][1] == pytest.approx(1 / q) and each[2] == each[3] == []
    info = recurrent.model_info(w)
    assert info["total_parameters"] == sum(x.size for x in w.values()) and info["vocabulary"] == 11 and info["layers"] == 2
    history = spark.createDataFrame([(1, 3.0, 2.5, 1.0), (2, 2.0, 2.1, 1.0), (3, 1.5, 2.2, 1.0)], "epoch int, train_loss double, val_loss double, seconds double")
    row = recurrent.training_summary(history).first()
    assert (row["best_epoch"], row["final_train_loss"], row["epochs"]) == (2, 1.5, 3)


def test_fused_scores(spark):
    df = spark.createDataFrame([(0.9, 0.8), (0.9, 0.5), (0.2, 0.8), (0.2, 0.5), (0.0, 0.0)], "n double, s double")
    by = lambda k: [round(r[0], 6) for r in df.select(neural.fused_score(F.col("n"), F.col("s"), k)).collect()]
    assert by("majority_vote") == [0.85, 0.9, 0.8, 0.2, 0.0]
    assert by("confidence_based") == [round(1.45 / 1.7, 6), round(1.06 / 1.4, 6), 0.68, round(0.29 / 0.7, 6), 0.0]
    assert by("weighted_average") == by("any other") == [0.83, 0.62, 0.62, 0.41, 0.0]
    stat = spark.createDataFrame([(1, 0.9, True), (2, 0.1, False)], "id bigint, confidence double, valid boolean")
    alone = {r["id"]: (r["is_valid"], r["method"]) for r in neural.hybrid(None, stat, "id").collect()}
    assert alone == {1: (True, "statistical_fallback"), 2: (False, "statistical_fallback")}


def test_service(spark):
    assert service.health(dict.fromkeys(service.COMPONENTS, True))["status"] == "healthy" and service.health({"rules": True})["status"] == "degraded"
    units = spark.createDataFrame([("កខគ" * 20,)], "t string")
    models = [ngrams.train(units.select(ngrams.syllable_units("t", n).alias("u")), "u", n, " | ", (ngrams.START, ngrams.END)) for n in (2, 3)]
    df = spark.createDataFrame([(1, "កខគកខ"), (2, None), (3, "")], "id bigint, t string")
    got = {r["id"]: r for r in service.validate(df, "id", "t", models).collect()}
    assert got[1]["syllable_count"] == 5 and not got[2]["success"] and not got[2]["is_valid"] and got[3]["success"]
    r = spark.range(1).select(service.rating(F.lit(5.0), F.lit(2000.0), F.lit(0.2)).alias("r")).first()["r"]
    assert (r["latency"], r["errors"], r["overall"]) == ("Excellent", "Good", "Production Ready - Good")


def test_sites(spark):
    with pytest.raises(ValueError):
        sites.site("none")
    assert len(sites.site("voa").listings()) == 40 and len(sites.site("rfa").listings()) == 4
    html = '<a href="/a/1">x</a><a href="/b">y</a><a href="/a/1">x</a><a href="https://z/a/2">z</a>'
    body = "<html><h1>T</h1><article>" + "កខគឃងច" * 10 + "</article></html>"
    pages = spark.createDataFrame([(1, "u1", html), (2, "u2", body), (3, "u3", body), (4, "u2", body), (5, "u5", "<article>plain latin text</article>")], "page_id bigint, url string, html string")
    links = sites.article_links(pages, sites.site("voa"), 5).collect()
    assert [x["link"] for x in links] == ["https://www.voakhmernews.com/a/1", "https://z/a/2"]
    assert [(r["page_id"], r["title"]) for r in sites.articles(pages, "voa").collect()] == [(2, "T")]


def test_sinks(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([("a", True, 3), ("a", False, 2), ("b", True, 5)], "filename string, is_valid boolean, length int")
    total = {r["filename"]: (r["texts"], r["valid"], r["characters"]) for r in sinks.file_runs(rows, path("runs"), "r1").collect()}
    assert total == {"a": (2, 1, 5), "b": (1, 1, 5), None: (3, 2, 10)}
    v = spark.createDataFrame([("a|b", 4, 2)], "token string, id int, cnt bigint")
    sinks.save_vocabulary(v, path("v"))
    assert sinks.load_vocabulary(spark, path("v")).collect() == v.collect() and sinks.optional(sinks.load_vocabulary, spark, path("no")) is None
    tables = {"syllables": v, "bigrams": spark.createDataFrame([("a|b", "c", 1)], "s1 string, s2 string, cnt bigint"), "trigrams": v}
    sinks.save_frequencies(tables, path("f"))
    assert sinks.load_frequencies(spark, path("f"))["bigrams"].first()["s1"] == "a|b"
    sinks.synthetic_tokens(spark.createDataFrame([("bb",), ("c",), ("a",)], "token string"), path("t"))
    assert [r["value"] for r in spark.read.text(path("t")).collect()] == ["a", "c", "bb"]
    sinks.articles(spark.createDataFrame([(1, "T", "C", "u", None, "s")], "seq bigint, title string, content string, url string, date string, source string"), path("art"))
    assert "=== Article 1 ===" in [r["value"] for r in spark.read.text(path("art")).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("x")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for settings in ({"batch_size": 1}, {"batch_size": 1, "other": 2}, {"batch_size": 2}):
        assert sinks.cached(spark, files.scan(spark, path("in")), settings, path("cache"), make).count() == 3
    assert len(made) == 2  # the second settings differ in nothing that counts


def test_reports(spark):
    text = reports.report("R", {"one": spark.createDataFrame([(1234, 0.5)], "n bigint, x double"), "none": spark.range(0)})
    assert "n: 1,234" in text and "x: 0.5" in text and "nothing to report" in text
    errors = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    assert [(r["name"], r["rank"], r["n"]) for r in voting.error_report(errors, "source").orderBy("rank").collect()] == [("a", 1, 2), ("b", 2, 1)]


def test_parameter_search(spark):
    near = lambda p: 1 - sum((p[k] - (a + b) / 2) ** 2 for k, (a, b) in search.SPACE.items())
    found = {"genetic": search.genetic(near), "guided": search.guided(near)}
    assert found == {"genetic": search.genetic(near), "guided": search.guided(near)} and min(s for _, s in found.values()) > 0.8
    rows = search.compared(found)
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["behind"] == 0
    grid = search.grid(spark, 3)
    assert search.budgeted(grid, 10).collect() == search.budgeted(grid, 10).collect() and search.budgeted(grid, 10).count() == 10
    folds = search.contiguous_folds(spark.range(23).withColumnRenamed("id", "k"), "k", 5).collect()
    assert all(r["fold"] == min(r["k"] // 4, 4) for r in folds)
    assert {r["fold"] for r in search.contiguous_folds(spark.range(3).withColumnRenamed("id", "k"), "k", 5).collect()} == {0}
    assert voting.chosen_weights("genetic") == voting.DEFAULT_WEIGHTS and json.loads(json.dumps(voting.chosen_weights("cross_validation", lambda: voting.weight_grid()[0])))["rule"] == 0.2


def test_quick_preview_and_sample(spark):
    docs = spark.createDataFrame([("a", "p/a", 3, "កខ\nx"), ("b", "p/b", 9, "ក")], "filename string, path string, size bigint, content string")
    assert files.quick_preview(docs, files=1).count() == 2
    row = files.token_sample(spark.createDataFrame([(1, "កខ x"), (2, "គ")], "id bigint, t string"), "t", "id", rows=1).first()
    assert (row["tokens"], row["script_tokens"], row["other_examples"]) == (3, 2, ["x"])
