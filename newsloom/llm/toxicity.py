"""Toxicity by multiple-instance learning: sentences scored, joined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from newsloom.llm.sample import labelled_sample
from newsloom.llm.scoring import with_columns
from newsloom.llm.words import SYMBOLS, blocks, hashed_words, prefix_hashes, utf8

BITS = 18
#: Word beginnings that are features beside the whole word, in bytes: inflected forms share them.
BEGINNINGS = (4, 5)
RATE = 0.05
#: Sentence ends: full stop, question and exclamation mark, line end; and those of three bytes in UTF-8.
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".?!\n"]] = True
_WIDE_ENDS = "。！？…"
#: A sentence of this probability or more is given out as a toxic one.
LOCATED = 0.5


@dataclass
class ToxicityModel:
    """Weights of hashed words, the sentences' common bias, and the leak of the noisy-or."""

    weights: np.ndarray
    bias: float
    leak: float


def _plain_ends(values: np.ndarray) -> np.ndarray:
    """The same number of bytes, with wide sentence ends as two spaces and a line end."""
    for mark in _WIDE_ENDS:
        a, b, c = mark.encode()
        at = np.flatnonzero(values[:-2] == a)
        at = at[(values[at + 1] == b) & (values[at + 2] == c)]
        if len(at):
            values = values.copy()
            values[at] = values[at + 1] = ord(" ")
            values[at + 2] = ord("\n")
    return values


def _bags(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence number, row of every sentence, its first byte): words and word beginnings of sentences.

    A sentence lies within one row. ``values`` have plain ends.
    """
    hashes, rows, starts = hashed_words(values, offsets, SYMBOLS)
    ended = np.append(0, np.cumsum(_ENDS[values]))[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ended[1:] != ended[:-1])
    sentence = np.cumsum(new) - 1
    found, where = [hashes], [sentence]
    for length in BEGINNINGS:
        longer, begun = prefix_hashes(values, offsets, rows, starts, length, SYMBOLS)
        found.append(begun)
        where.append(sentence[longer])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where), rows[new], starts[new]


def _texts(values: np.ndarray, plain: np.ndarray, offsets: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> list[str]:
    """Texts of the sentences of rows ``owner`` that begin at the bytes ``begin``, with their end marks."""
    stops = np.append(np.flatnonzero(_ENDS[plain]) + 1, len(plain))
    end = np.minimum(stops[np.searchsorted(stops, begin, "right")] if len(begin) else begin, offsets[owner + 1])
    return [values[s:e].tobytes().decode("utf-8", "replace").strip() for s, e in zip(begin, end, strict=True)]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sentence_scores(model: ToxicityModel, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[feature], minlength=n)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 400, rare: int = 3, shrink: float = 1e-4) -> ToxicityModel:
    """Gradient descent on the likelihood of document labels under a noisy-or over sentences.

    A document is clean if no sentence is toxic and the leak does not fire; the leak takes up labels
    that no sentence explains. Words in fewer than ``rare`` documents keep weight 0. Without both
    labels every score is the share of label 1.
    """
    labels = np.asarray(labels, float)
    model = ToxicityModel(np.zeros(1 << BITS), -20.0, float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6)))
    if len(set(labels.tolist())) < 2:
        return model
    values, offsets = utf8(pa.array(texts, pa.large_string()))
    feature, sentence, owner, _ = _bags(_plain_ends(values), offsets)
    in_document = np.unique(owner[sentence] << BITS | feature)
    spread = np.bincount(in_document & ((1 << BITS) - 1), minlength=1 << BITS)
    seen = spread[feature] >= rare
    ids, feature = np.unique(feature[seen], return_inverse=True)
    sentence = sentence[seen]
    weights, bias, leak = np.zeros(len(ids)), -9.0, -3.0
    n, docs = len(owner), len(labels)
    speed, squares = np.zeros(len(ids) + 2), np.zeros(len(ids) + 2)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights[feature], minlength=n)
        total = np.bincount(owner, _softplus(z), minlength=docs) + _softplus(leak)
        slope = 1 - labels / -np.expm1(-np.maximum(total, 1e-9))
        by_sentence = slope[owner] / (1 + np.exp(-z))
        by_weight = np.bincount(feature, by_sentence[sentence], minlength=len(ids)) / docs + shrink * np.sign(weights)
        gradient = np.append(by_weight, [by_sentence.sum() / docs, slope.sum() / (1 + np.exp(-leak)) / docs])
        speed, squares = 0.9 * speed + 0.1 * gradient, 0.99 * squares + 0.01 * gradient**2
        step = RATE * (speed / (1 - 0.9**t)) / (np.sqrt(squares / (1 - 0.99**t)) + 1e-5)
        weights, bias, leak = weights - step[:-2], bias - step[-2], leak - step[-1]
    model.weights[ids] = weights
    model.bias, model.leak = float(bias), float(1 / (1 + np.exp(-leak)))
    return model


def _any(model: ToxicityModel, z: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    return 1 - (1 - model.leak) * np.exp(-np.bincount(owner, _softplus(z), minlength=rows))


def score(model: ToxicityModel, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability that a document is toxic; a text without words has the leak alone."""
    feature, sentence, owner, _ = _bags(_plain_ends(values), offsets)
    return _any(model, _sentence_scores(model, feature, sentence, len(owner)), owner, len(offsets) - 1)


def located(model: ToxicityModel, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``score``, the number of toxic sentences, and the text of the worst of them (the first of equals) or None."""
    plain, rows = _plain_ends(values), len(offsets) - 1
    feature, sentence, owner, begin = _bags(plain, offsets)
    z = _sentence_scores(model, feature, sentence, len(owner))
    hit = np.flatnonzero(1 / (1 + np.exp(-z)) >= LOCATED)
    order = hit[np.lexsort((hit, -z[hit], owner[hit]))]
    worst = order[np.append(True, owner[order[1:]] != owner[order[:-1]])[: len(order)]]
    text = np.full(rows, None, object)
    text[owner[worst]] = _texts(values, plain, offsets, owner[worst], begin[worst])
    return _any(model, z, owner, rows), np.bincount(owner[hit], minlength=rows), text


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1000, max_chars: int = 20_000) -> ToxicityModel:
    """Fitted on at most ``per_class`` labelled rows of each label, of at most ``max_chars`` characters."""
    rows = labelled_sample(docs, labels, "toxic", usable, per_class, max_chars)
    return fit(rows["text"].tolist(), (rows["label"] == "1").to_numpy())


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", reject: float = 0.7, sentences: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``reject`` or more).

    With ``sentences`` also ``toxic_sentences``, the number of sentences that are toxic by themselves, and
    ``worst_sentence``, the text of the first of the worst of them or null. A null or empty text scores the leak.
    No shuffle; whole texts; the model is a fixed 2 MB.
    """

    def add(shared, values, offsets):
        p, *more = located(shared, values, offsets) if sentences else (score(shared, values, offsets),)
        return [p, (p >= reject).astype(np.int32), *more]

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if sentences:
        added += [T.StructField("toxic_sentences", T.LongType()), T.StructField("worst_sentence", T.StringType())]
    return with_columns(docs, added, model, add, text)


def toxic_sentences(docs: DataFrame, model: ToxicityModel, ident: str = "doc_id", text: str = "text", threshold: float = LOCATED) -> DataFrame:
    """(id, sentence, score) of each sentence of its own probability ``threshold`` or more."""
    source = docs.select(docs[ident].alias("_id"), docs[text].alias("_text"))
    schema = T.StructType([source.schema["_id"], T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for a, b in blocks(offsets):
                own, at = values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                plain = _plain_ends(own)
                feature, sentence, owner, begin = _bags(plain, at)
                p = 1 / (1 + np.exp(-_sentence_scores(shared.value, feature, sentence, len(owner))))
                hit = np.flatnonzero(p >= threshold)
                found = _texts(own, plain, at, owner[hit], begin[hit])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[hit] + a)), pa.array(found, pa.string()), pa.array(p[hit])], names=["_id", "sentence", "score"])

    return source.mapInArrow(run, schema).withColumnRenamed("_id", ident)
