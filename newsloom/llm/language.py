"""Language identification: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from newsloom.llm.sample import own_sample
from newsloom.llm.scoring import with_columns
from newsloom.llm.words import blocks, utf8

BITS = 15
LONGEST = 3
_ROWS = 64
#: Familiarity: bits of the table of grams; the quantile of held-out rows (in a thousand) and how far below it
#: the bound lies; how much further below it a text of n distinct grams may lie, times the square root of n.
_COMMON_BITS, _BEYOND, _MARGIN, _SHORT = 18, 5, 0.7, 20.0
#: Letters as they are (A-Z as a-z), everything else in ASCII as a blank.
_FOLD = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)
_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])


@dataclass
class LanguageModel:
    """One response per language, collapsed onto the grams: columns times landmarks times ridge weights."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    #: Log probability of every hashed three-byte gram in the language where it is most common, and
    #: the least mean of it in a long text of the learned languages. Without a bound, everything is familiar.
    common: np.ndarray | None = None
    least: float = -np.inf


def presence(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 rows over hashed grams of 1 to ``LONGEST`` bytes; runs of blanks count as one."""
    n = len(offsets) - 1
    flags = np.zeros((n, 1 << BITS), bool)
    folded = _FOLD[values]
    blank = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep[offsets[:-1][offsets[:-1] < len(folded)]] = True
    code, row = folded[keep].astype(np.uint32), row[keep]
    gram = np.zeros(len(code), np.uint32)
    for size in range(1, LONGEST + 1):
        gram = gram[: len(code) - size + 1] << np.uint32(8) | code[size - 1 :]
        if not len(gram):
            break
        inside = row[: len(gram)] == row[size - 1 :]
        bucket = (gram + np.uint32(size * 0x1F35)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        flags[row[: len(gram)][inside], bucket[inside]] = True
    return flags


def _unit(flags: np.ndarray) -> np.ndarray:
    """Rows over the square root of their number of grams, so that dot products are the kernel."""
    rows = flags.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def _trigrams(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed gram, row) of all three-byte runs; accented capitals count as small, runs of blanks as one."""
    folded, row = _FOLD[values].astype(np.uint32), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    capital = np.zeros(len(folded), bool)  # U+00C0 to U+00DE
    capital[1:] = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97)
    folded[capital] += np.uint32(0x20)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20) | (row[1:] != row[:-1])
    code, row = folded[keep], row[keep]
    gram = code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]
    inside = row[:-2] == row[2:]
    return gram[inside] * np.uint32(2654435761) >> np.uint32(32 - _COMMON_BITS), row[:-2][inside]


def _common(counts: np.ndarray) -> np.ndarray:
    """Log probability of every gram in the language (a row) that has it most often; half a count is added to each."""
    best = np.full(counts.shape[1], -np.inf)
    for count in counts:
        best = np.maximum(best, np.log((count + 0.5) / (count.sum() + 0.5 * len(count))))
    return best


def _likeness(common: np.ndarray, gram: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Mean log probability of every row's grams, plus what few distinct ones are allowed; infinite without grams."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    seen, out = np.zeros(1 << _COMMON_BITS, bool), np.full(n, np.inf)
    for i in np.flatnonzero(np.diff(ends)):
        own = gram[ends[i] : ends[i + 1]]
        seen[own] = True
        out[i] = common[own].mean(dtype=float) + _SHORT / np.sqrt(np.count_nonzero(seen))
        seen[own] = False
    return out


def _familiarity(values: np.ndarray, offsets: np.ndarray, language: np.ndarray, turn: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(common, least): the bound is a low quantile of each half of the rows under the other half's counts."""
    parts = [(a, b, lambda a=a, b=b: _trigrams(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
    half, counts = turn % 2, np.zeros((2, n, 1 << _COMMON_BITS), np.int32)
    for a, b, grams in parts:
        gram, row = grams()
        for h, k in set(zip(half[a:b].tolist(), language[a:b].tolist(), strict=True)):
            own = (half[a:b] == h) & (language[a:b] == k)
            counts[h, k] += np.bincount(gram[own[row]], minlength=1 << _COMMON_BITS).astype(np.int32)
    common = _common(counts.sum(0)).astype(np.float32)
    other = [_common(counts[1 - h]) for h in (0, 1)]
    like = [np.where(half[a:b] == 0, *(_likeness(c, *got, b - a) for c in other)) for a, b, grams in parts for got in [grams()]]
    held = np.sort(np.concatenate(like))
    held = held[np.isfinite(held)]
    return common, float(held[len(held) * _BEYOND // 1000]) - _MARGIN if len(held) and turn.max() else -np.inf


def fit(texts: list[str], labels: list[str], landmarks: int = 256, ridge: float = 0.05) -> LanguageModel:
    """Kernel ridge regression of 0/1 targets, one per language, on Nyström features.

    Landmarks are taken in turn from each language. Grams, landmarks and weights multiply out to one
    matrix (grams x languages), so scoring is a single product of a batch of rows with it.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    values, offsets = utf8(pa.array(texts, pa.large_string()))
    labels = np.array(labels)
    turn = np.zeros(len(labels), int)
    for language in languages:
        own = np.flatnonzero(labels == language)
        turn[own] = np.arange(len(own))
    common, least = _familiarity(values, offsets, np.searchsorted(languages, labels), turn, len(languages))
    units = lambda rows: np.concatenate([_unit(presence(values[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])) for i in rows])
    chosen = np.lexsort((np.arange(len(labels)), turn))[:landmarks]
    own = units(chosen)
    kernel = np.concatenate([units(range(a, min(a + _ROWS, len(labels)))) @ own.T for a in range(0, len(labels), _ROWS)])
    value, vector = np.linalg.eigh(own @ own.T)
    root = vector / np.sqrt(np.maximum(value, 1e-4 * value.max())) @ vector.T
    features = kernel @ root
    targets = (labels[:, None] == np.array(languages)[None, :]).astype(np.float64)
    middle, mean = features.mean(0), targets.mean(0)
    centred = (features - middle).astype(np.float64)
    solved = np.linalg.solve(centred.T @ centred + ridge * len(texts) / landmarks * np.eye(len(chosen)), centred.T @ (targets - mean))
    weights = own.T @ (root @ solved)
    return LanguageModel(languages, weights.astype(np.float32), (mean - middle @ solved).astype(np.float32), common, least)


def responses(model: LanguageModel, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(offsets) - 1, _ROWS):
        at = offsets[a : a + _ROWS + 1]
        out.append(_unit(presence(values[at[0] : at[-1]], at - at[0])) @ model.weights + model.bias)
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), np.float32)


def has_letter(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    marked = np.append(0, np.cumsum(_LETTER[values]))
    found = marked[offsets[1:]] > marked[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in values[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(model: LanguageModel, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score in 0..1); ``und`` and 0 for a text without letters."""
    n = len(offsets) - 1
    if not model.languages:
        return np.full(n, "und", object), np.zeros(n)
    response = responses(model, values, offsets)
    best = response.argmax(1)
    lettered = has_letter(values, offsets)
    names = np.array(model.languages, object)[best]
    names[~lettered] = "und"
    return names, np.where(lettered, np.clip(response[np.arange(n), best].astype(float), 0, 1), 0.0)


def familiar(model: LanguageModel, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for texts whose grams are as common in the learned languages as those of held-out training rows, else 0.

    Each gram counts in the language where it is most common, so a text in several of them is familiar.
    The fewer distinct grams, the wider the bound; without grams a text is familiar.
    """
    n = len(offsets) - 1
    if model.common is None:
        return np.ones(n, int)
    return (_likeness(model.common, *_trigrams(values, offsets), n) >= model.least).astype(int)


def train(docs: DataFrame, usable: Column, per_class: int = 500, max_chars: int = 20_000, label: str = "lang") -> LanguageModel:
    """Fitted on at most ``per_class`` rows of each language, of at most ``max_chars`` characters."""
    rows = own_sample(docs, label, usable, per_class, max_chars)
    return fit(rows["text"].tolist(), rows["label"].tolist())


def language(docs: DataFrame, model: LanguageModel, text: str = "text", known: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from whole texts; ``und`` for null or letterless ones.

    With ``known``, a column of that name has 1 for texts that look like the learned languages and 0 for
    others. No shuffle. The model has a fixed size per language; a batch of rows is one matrix product.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if known is None:
        return with_columns(docs, added, model, lambda shared, values, offsets: list(predict(shared, values, offsets)), text)
    added.append(T.StructField(known, T.IntegerType()))
    return with_columns(docs, added, model, lambda shared, values, offsets: [*predict(shared, values, offsets), familiar(shared, values, offsets)], text)
