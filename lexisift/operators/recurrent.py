"""Recurrent scorers: forward passes of bidirectional LSTM models with attention, on weights trained elsewhere.

Weights are arrays by name: ``embedding``, for each layer k and direction (``f`` and ``b``) ``w_in``, ``w_rec`` and
``bias`` as ``lstm.k.f.w_in`` (gates in the order input, forget, cell, output), the attention's arrays, and
``out.weight`` and ``out.bias``. They are sent to the tasks once and batches run through numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _direction(x: np.ndarray, w: Weights, name: str, back: bool) -> np.ndarray:
    """The hidden states (batch, steps, size) of one direction of a layer."""
    w_rec = w[f"{name}.w_rec"]
    size = w_rec.shape[1]
    h = c = np.zeros((len(x), size))
    given = x @ w[f"{name}.w_in"].T + w[f"{name}.bias"]
    out = np.empty((len(x), x.shape[1], size))
    for t in range(x.shape[1])[:: -1 if back else 1]:
        i, f, g, o = np.split(given[:, t] + h @ w_rec.T, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


def states(ids: np.ndarray, w: Weights) -> np.ndarray:
    """The last layer's hidden states of both directions side by side (batch, steps, 2 * size)."""
    x, k = w["embedding"][ids], 0
    while f"lstm.{k}.f.w_in" in w:
        x = np.concatenate([_direction(x, w, f"lstm.{k}.f", False), _direction(x, w, f"lstm.{k}.b", True)], axis=2)
        k += 1
    return x


def char_logits(ids: np.ndarray, w: Weights) -> np.ndarray:
    """Logits of the next character: the states' mean under additive attention, projected. Without attention the last state."""
    h = states(ids, w)
    if "attention.weight" in w:
        a = softmax(h @ w["attention.weight"] + w["attention.bias"], axis=1)
        pooled = (h * a[:, :, None]).sum(axis=1)
    else:
        pooled = h[:, -1]
    return pooled @ w["out.weight"].T + w["out.bias"]


def syllable_logits(ids: np.ndarray, w: Weights, heads: int = 8) -> np.ndarray:
    """Logits of the next syllable: the last states of both directions ask all states by ``heads`` heads of attention."""
    h = states(ids, w)
    size = h.shape[2] // 2
    last = np.concatenate([h[:, -1, :size], h[:, 0, size:]], axis=1)
    if "query.weight" in w:
        part = lambda x, name: (x @ w[f"{name}.weight"].T + w[f"{name}.bias"]).reshape(*x.shape[:-1], heads, -1)
        q, k, v = part(last, "query"), part(h, "key"), part(h, "value")
        a = softmax(np.einsum("bhd,bthd->bht", q, k) / np.sqrt(q.shape[-1]), axis=2)
        last = np.einsum("bht,bthd->bhd", a, v).reshape(len(h), -1) @ w["project.weight"].T + w["project.bias"]
    return last @ w["out.weight"].T + w["out.bias"]


def probabilities(logits: np.ndarray, temperature: float = 1.0, top: int | None = None) -> np.ndarray:
    """Probabilities at a temperature; with ``top`` only that many of the likeliest units have any."""
    z = logits / temperature
    if top is not None and top < z.shape[1]:
        least = -np.sort(-z, axis=1)[:, top - 1 : top]
        z = np.where(z >= least, z, -np.inf)
    return softmax(z)


def _matrix(lists: pd.Series, length: int) -> np.ndarray:
    """The last ``length`` ids of each list, filled up with 0 at the left."""
    out = np.zeros((len(lists), length), np.int64)
    for k, x in enumerate(lists):
        x = [] if x is None else list(x)[-length:]
        if x:
            out[k, length - len(x) :] = x
    return out


def predictor(weights: Weights, kind: str = "char", length: int = 20, temperature: float = 1.0, top: int | None = None, seed: int | None = None):
    """A column function: an array of ids as struct(unit, confidence), the next unit.

    The likeliest unit, or with a ``seed`` one drawn by its probability; draws depend on the seed and the row's ids,
    not on how rows are dealt. Null and empty lists are padding alone.
    """
    spread = char_logits if kind == "char" else syllable_logits

    @F.pandas_udf("unit int, confidence double")
    def predicted(lists: pd.Series) -> pd.DataFrame:
        ids = _matrix(lists, length)
        p = probabilities(spread(ids, weights), temperature, top) if len(ids) else np.zeros((0, 1))
        if seed is None:
            unit = p.argmax(axis=1)
        else:
            unit = np.array([np.random.default_rng([seed, *row.tolist()]).choice(len(q), p=q) for row, q in zip(ids, p)], np.int64)
        return pd.DataFrame({"unit": unit.astype(np.int32), "confidence": p[np.arange(len(p)), unit]})

    return predicted


def unit_perplexities(weights: Weights, kind: str = "char", length: int = 20):
    """A column function: an array of ids as the perplexity 1 / P of each, given those before it; the first has the second's, one alone has 1."""
    spread = char_logits if kind == "char" else syllable_logits

    @F.pandas_udf("array<double>")
    def each(lists: pd.Series) -> pd.Series:
        out = []
        for x in lists:
            x = [] if x is None else [int(i) for i in x]
            if len(x) < 2:
                out.append([1.0] * len(x))
                continue
            found: list[float] = []
            for at in range(1, len(x), 256):  # contexts of a long text in parts
                targets = x[at : at + 256]
                p = softmax(spread(_matrix(pd.Series([x[max(0, i - length) : i] for i in range(at, at + len(targets))]), length), weights))
                found += (1 / np.maximum(p[np.arange(len(targets)), targets], 1e-10)).tolist()
            out.append([found[0], *found])
        return pd.Series(out)

    return each


def sequence_perplexity(each: Column) -> Column:
    """The geometric mean of an array of perplexities; null for an empty one."""
    n = F.size(each)
    return F.when(n > 0, F.exp(F.aggregate(each, F.lit(0.0), lambda s, x: s + F.ln(x)) / n))


def model_info(weights: Weights) -> dict[str, float]:
    """How many numbers a model has, and their megabytes at four bytes each."""
    n = sum(int(x.size) for x in weights.values())
    return {"total_parameters": n, "model_size_mb": n * 4 / (1024 * 1024), "layers": sum(k.endswith(".f.w_in") for k in weights), "vocabulary": int(weights["embedding"].shape[0])}


def training_summary(history):
    """One row of a history (epoch, train_loss, val_loss, seconds): the best epoch by val_loss, the last losses and totals."""
    return history.agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
        F.count("*").alias("epochs"),
        F.sum("seconds").alias("seconds"),
    )
