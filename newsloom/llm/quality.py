"""Quality by a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from newsloom.llm.sample import labelled_sample
from newsloom.llm.scoring import with_columns
from newsloom.llm.words import utf8

CHUNK, STEP = 384, 360
WIDTH, HOP, DEPTH, FILTERS = 6, 3, 8, 16
_PAD = 256
_AT_ONCE = 512


@dataclass
class QualityModel:
    """Byte vectors, filters over ``WIDTH`` bytes, and the output weights."""

    letters: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    out: np.ndarray
    bias: float


def chunks(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end of the row, row) of every chunk; chunks overlap and leave no byte out.

    A text without bytes is one chunk of padding.
    """
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][row] + number * STEP, offsets[1:][row], row


def codes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    out = np.full(at.shape, _PAD, np.int64)
    out[inside] = values[at[inside]]
    return out


def _windows(vectors: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * DEPTH) view of byte vectors (chunks, CHUNK, DEPTH)."""
    flat = np.ascontiguousarray(vectors).reshape(len(vectors), CHUNK * DEPTH)
    places = (CHUNK - WIDTH) // HOP + 1
    a, b = flat.strides
    return np.lib.stride_tricks.as_strided(flat, (len(flat), places, WIDTH * DEPTH), (a, b * HOP * DEPTH, b))


def pooled(model: QualityModel, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest activation per chunk and filter, where it is, the windows)."""
    windows = _windows(model.letters[code])
    lifted = windows.reshape(-1, WIDTH * DEPTH) @ model.filters
    lifted = lifted.reshape(len(code), -1, FILTERS)
    where = lifted.argmax(1)
    top = np.take_along_axis(lifted, where[:, None, :], 1)[:, 0, :] + model.offsets
    return np.maximum(top, 0), where, windows


def fit(texts: list[str], labels: np.ndarray, epochs: int = 12, per_text: int = 6, rate: float = 0.01, seed: int = 5) -> QualityModel:
    """Adam on the log loss of single chunks, at most ``per_text`` of each text, drawn over its whole length.

    Without both labels the probability is the share of label 1 everywhere.
    """
    random = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    shape = lambda *n: (random.standard_normal(n) * 0.3).astype(np.float32)
    p = {"letters": shape(257, DEPTH), "filters": shape(WIDTH * DEPTH, FILTERS), "offsets": np.zeros(FILTERS, np.float32), "out": np.zeros(FILTERS, np.float32), "bias": np.array([np.log(share / (1 - share))], np.float32)}
    p["letters"][_PAD] = 0
    if len(set(labels.tolist())) == 2:
        values, offsets = utf8(pa.array(texts, pa.large_string()))
        starts, ends, row = chunks(values, offsets)
        mixed = random.permutation(len(row))
        _, turn = np.unique(row[mixed], return_index=True)
        order = mixed[np.argsort(row[mixed], kind="stable")]
        number = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        chosen = order[number < per_text]
        code, target = codes(values, starts[chosen], ends[chosen]), labels[row[chosen]]
        # Each text counts once and each label half, however many chunks and rows there are.
        weight = 1 / np.bincount(row[chosen], minlength=len(texts))[row[chosen]]
        for side in (0, 1):
            weight[target == side] /= weight[target == side].sum()
        weight *= len(chosen) / 2
        first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        p["out"] = shape(FILTERS)
        for _ in range(epochs):
            for batch in np.array_split(random.permutation(len(chosen)), max(1, len(chosen) // 128)):
                t += 1
                gradient = _gradient(p, code[batch], target[batch], weight[batch])
                for k, g in gradient.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
                p["letters"][_PAD] = 0
    return QualityModel(p["letters"], p["filters"], p["offsets"], p["out"], float(p["bias"][0]))


def _gradient(p: dict, code: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
    model = QualityModel(p["letters"], p["filters"], p["offsets"], p["out"], float(p["bias"][0]))
    top, where, windows = pooled(model, code)
    error = (1 / (1 + np.exp(-(top @ model.out + model.bias))) - target) * weight / len(code)
    back = error[:, None] * model.out * (top > 0)
    at = np.arange(len(code))[:, None]
    seen = windows[at, where]
    filters = np.einsum("cfw,cf->wf", seen, back)
    letters = np.zeros_like(p["letters"])
    byte = code[at[:, :, None], where[:, :, None] * HOP + np.arange(WIDTH)]
    toward = back[:, :, None, None] * model.filters.T.reshape(FILTERS, WIDTH, DEPTH)
    np.add.at(letters, byte.ravel(), toward.reshape(-1, DEPTH))
    return {"letters": letters, "filters": filters + 1e-4 * p["filters"], "offsets": back.sum(0), "out": top.T @ error + 1e-4 * p["out"], "bias": np.array([error.sum()], np.float32)}


def score(model: QualityModel, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of good quality: the chunks' log odds, averaged over the whole text."""
    starts, ends, row = chunks(values, offsets)
    odds = np.concatenate([pooled(model, codes(values, starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE]))[0] @ model.out + model.bias for i in range(0, len(starts), _AT_ONCE)] or [np.zeros(0)])
    n = len(offsets) - 1
    return 1 / (1 + np.exp(-np.bincount(row, odds, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1000, max_chars: int = 20_000) -> QualityModel:
    """Fitted on at most ``per_class`` labelled rows of each label, of at most ``max_chars`` characters."""
    rows = labelled_sample(docs, labels, "quality", usable, per_class, max_chars)
    return fit(rows["text"].tolist(), (rows["label"] == "1").to_numpy())


def quality(docs: DataFrame, model: QualityModel, text: str = "text", accept: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``accept`` or more).

    A null or empty text is one chunk of padding. No shuffle; the model is a few tens of KB.
    """

    def add(shared, values, offsets):
        p = score(shared, values, offsets)
        return [p, (p >= accept).astype(np.int32)]

    return with_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], model, add, text)
