"""Texts in sentence-packed pieces, and pieces back into texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import batches, fixed

LIMIT = 1_200
RETRY_LIMIT = 350

#: The white space of the column functions, with code points as Python writes them.
_SPACE = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", fixed.WHITESPACE)
_SENTENCES = re.compile(f"(?<={fixed.SENTENCE_END}){_SPACE}+|\n+")
_EDGES = re.compile(rf"\A{_SPACE}+|{_SPACE}+\Z")


def packed(whole: str, limit: int) -> list[str]:
    """Sentences joined by a space up to ``limit`` characters; a longer sentence is cut hard.

    One pass over the sentences: a piece is a run of them, joined when it is full.
    """
    if len(whole) <= limit:
        return [whole]
    done, run, size = [], [], 0
    for sentence in _SENTENCES.split(whole):
        sentence = _EDGES.sub("", sentence)
        if not sentence:
            continue
        if run and size + 1 + len(sentence) <= limit:
            run.append(sentence)
            size += 1 + len(sentence)
            continue
        if run:
            done.append(" ".join(run))
        cuts = [sentence[i : i + limit] for i in range(0, len(sentence), limit)]
        done += cuts[:-1]
        run, size = cuts[-1:], len(cuts[-1])
    return [*done, " ".join(run)] if run else done or [whole]


def pieces(whole: Column, limit: int) -> Column:
    """The pieces of a text, in order; null for null.

    Texts go through Arrow once and whole, and only a few of a batch are Python strings at a time. A fold of
    column functions would copy all finished pieces for every sentence.
    """

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return batches.each(texts, lambda t: None if t is None else packed(t, limit), pa.list_(pa.string()))

    return pack(whole)


def chunk_rows(blocks: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: all other columns, ``chunk_no`` and ``chunk``."""
    keep = [c for c in blocks.columns if c != column]
    return blocks.select(*keep, F.posexplode(pieces(F.col(column), limit)).alias("chunk_no", "chunk"))


def reassemble(chunks: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from translated pieces in order; a missing piece keeps its source text.

    A group is one block of one article, so it is as small as an article's block.
    """
    joined = chunks.join(translated.select(*keys, "chunk_no", "translated"), [*keys, "chunk_no"], "left")
    piece = F.struct("chunk_no", F.coalesce("translated", "chunk").alias("piece"))
    return joined.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["piece"]), " ").alias("text")
    )
