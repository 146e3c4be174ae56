"""Document quality by a classifier combined with host and path posteriors, by hierarchical empirical Bayes.

A logistic model over shape features of the whole text gives each document a probability. Grouped sums of these give
each host and each path in it a posterior mean (a table of documents without addresses has ``source`` as host, and
its language section, ``lang``, stands in for the path; ``site_parts`` takes both from an address): a host is shrunk toward the
global mean, a path toward its host, by as many pseudo-documents as the spread between groups calls for (method of
moments). So sparse sites follow their prior and large ones their own documents. The log-odds of document and path
then add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import fresh, stored

#: Probabilities are summed as whole millionths, so sums do not depend on their order.
UNIT = 1_000_000

NAMES = ["upper", "digit", "space", "newline", "bang", "bar", "dot", "comma", "other_punct", "high", "length", "word_length", "short_words", "distinct", "top_word", "capital_words", "bare_words", "lines", "distinct_lines", "line_length", "mark_ends"]


def features(text: str | None) -> list[float]:
    """Shape features of a whole text; all defined for null or empty text, which counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(int(c[0x41:0x5B].sum() + c[0x61:0x7B].sum() + c[0x80:].sum()), 1)
    named = c[[0x21, 0x7C, 0x2E, 0x2C]]
    punct = int(c[0x21:0x30].sum() + c[0x3A:0x41].sum() + c[0x5B:0x61].sum() + c[0x7B:0x7F].sum() - named.sum())
    words = data.split()
    w = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    return [
        c[0x41:0x5B].sum() / letters, c[0x30:0x3A].sum() / n, c[0x20] / n, c[0x0A] / n, *(named / n).tolist(), punct / n, c[0x80:].sum() / n,
        math.log1p(len(data)), sum(map(len, words)) / w, sum(len(x) <= 2 for x in words) / w, len(seen) / w, max(seen.values(), default=0) / w,
        sum(x[:1].isupper() for x in words) / w, sum(not x.isalnum() for x in words) / w,
        math.log1p(len(lines)), len(set(lines)) / m, math.log1p(sum(map(len, lines)) / m), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
    ]


@dataclass
class Model:
    """A logistic model on standardised features; without weights every document gets the prior."""

    centre: list[float]
    scale: list[float]
    weights: list[float]
    prior: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(rows), self.prior)
        z = expand((rows - np.array(self.centre)) / np.array(self.scale)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """A constant, the clipped features and their squares."""
    z = np.clip(z, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z * z])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, ridge: float = 1.0) -> Model:
    """A model of ``labels`` (doc_id, quality) on at most ``most`` labelled documents, taken in the order of a hash.

    That bound keeps the fit on the driver small whatever the input. Rows with null id or label do not count; several
    labels of one document vote, ties are good; of several rows with one doc_id that of the smallest features counts.
    With one class or none at all, the model is its share (one half).
    """
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("good"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x.as_py()) for x in batch.column(2)], pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    # At most ``most`` rows of two numbers: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text").mapInArrow(run, "doc_id bigint, good int, x array<double>").groupBy("doc_id", "good").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    y = rows["good"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model([], [], [], float(y.mean()) if len(y) else 0.5)
    x = np.array(rows["x"].tolist())
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = expand((x - centre) / scale)
    weights = np.zeros(a.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(centre.tolist(), scale.tolist(), weights.tolist(), float(y.mean()))


def evidence(docs: DataFrame, model: Model, name: str = "doc_score") -> DataFrame:
    """``docs`` with the classifier's probability in millionths (bigint)."""
    kept = [c for c in docs.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != name) + f", `{name}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            x = np.array([features(v.as_py()) for v in batch.column(at)]).reshape(-1, len(NAMES))
            p = np.rint(model.probability(x) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(p)], [*kept, name])

    return docs.mapInArrow(run, schema)


def pseudo_count(mean: float, groups: int, n: float, squares: float, spread: float) -> float:
    """How many pseudo-documents the prior of a group is worth: large where groups differ no more than chance.

    n: all documents, squares: the sum of squared group sizes, spread: the sum over groups of size times the squared
    difference between group mean and prior mean.
    """
    within = max(mean * (1 - mean), 1e-6)
    if groups < 2 or n <= squares / n:
        return 10.0
    between = (spread - (groups - 1) * within) / (n - squares / n)
    return float(min(max(within / max(between, 1e-9) - 1, 1.0), 10_000.0))


def site_parts(url: Column) -> tuple[Column, Column]:
    """Host and path (the first folder) of an address, empty where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)/", 1), F.lit(""))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) of rows of (source, lang, doc_score), and the global mean.

    Only grouped sums are shuffled; a host of any size is pre-aggregated by the tasks that read it.
    """
    path = stored(scored.groupBy(F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path")).agg(F.count("*").alias("n"), F.sum("doc_score").alias("good")), "paths")
    host = path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = host.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.count("*").alias("groups"), F.sum(F.col("host_n").cast("double") ** 2).alias("squares")).first()
    if not whole["n"]:
        return path.select("host", "path", F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), 0.5
    mean = whole["good"] / UNIT / whole["n"]
    spread = host.agg(F.sum(F.col("host_n") * (F.col("host_good") / UNIT / F.col("host_n") - mean) ** 2)).first()[0]
    k = round(pseudo_count(mean, whole["groups"], whole["n"], whole["squares"], spread), 3)
    host = host.withColumn("host_posterior", (F.col("host_good") / UNIT + k * mean) / (F.col("host_n") + k))
    both = path.join(host.select("host", "host_posterior"), "host")
    inner = both.agg(F.count("*").alias("groups"), F.sum(F.col("n").cast("double") ** 2).alias("squares"), F.sum(F.col("n") * (F.col("good") / UNIT / F.col("n") - F.col("host_posterior")) ** 2).alias("spread")).first()
    k = round(pseudo_count(mean, inner["groups"], whole["n"], inner["squares"], inner["spread"]), 3)
    return both.select("host", "path", "host_posterior", ((F.col("good") / UNIT + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), mean


def combined(scored: DataFrame, sites: DataFrame, mean: float, threshold: float) -> DataFrame:
    """``scored`` with host_posterior, path_posterior, quality_score and keep. ``sites`` is joined by host and path."""
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda p: F.ln(clip(p) / (1 - clip(p)))
    out = scored.drop("host_posterior", "path_posterior", "quality_score", "keep")
    host, path = fresh(out.columns, "site_host", "site_path")
    sites = sites.select(F.col("host").alias(host), F.col("path").alias(path), "host_posterior", "path_posterior")
    out = out.join(sites, (F.coalesce("source", F.lit("")) == F.col(host)) & (F.coalesce("lang", F.lit("")) == F.col(path))).drop(host, path)
    z = odds(F.col("doc_score") / UNIT) + odds(F.col("path_posterior")) - odds(F.lit(mean))
    score = F.round(1 / (1 + F.exp(-z)), 6)
    return out.withColumn("host_posterior", F.round("host_posterior", 6)).withColumn("path_posterior", F.round("path_posterior", 6)).withColumn("quality_score", score).withColumn("keep", score >= threshold)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """Scores for each row of (doc_id, text, source, lang), without the text.

    Null source or lang is a group of its own; null text counts as empty; a null doc_id stays null. Repeated rows are
    scored alike and each counts for its site. Empty tables give no rows. Without usable labels every document scores
    one half and is kept.
    """
    model = fit(docs, labels, most)
    scored = stored(evidence(docs.select("doc_id", "source", "lang", "text"), model).drop("text"), "evidence")
    sites, mean = posteriors(scored)
    return combined(scored, stored(sites, "sites"), mean, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with the columns of ``docs`` alone.

    Texts are read twice and scored twice rather than written or shuffled once more. Nulls, repeats and empty tables
    are treated as there; columns named like those that ``assess`` adds pass through.
    """
    model = fit(docs, labels, most)
    added = [c for c in docs.columns if c.lower() in ("doc_score", "host_posterior", "path_posterior", "quality_score", "keep")]
    own = dict(zip(added, fresh(docs.columns, *(f"{c}_own" for c in added))))
    scored = evidence(docs.withColumnsRenamed(own), model)
    sites, mean = posteriors(evidence(docs.select("source", "lang", "text"), model).drop("text"))
    kept = combined(scored, stored(sites, "sites"), mean, threshold).where("keep")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
