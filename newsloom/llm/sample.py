"""Bounded, repeatable training samples and hold-out marks for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts in which a label's rows are cut down before they meet.
SALTS = 32


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % modulus


def held_out(ident: str, modulus: int, rest: int) -> Column:
    """Whether a row is kept out of training. A row without id is never learned from either."""
    return F.coalesce(remainder(ident, modulus) == rest, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_chars: int, text: str = "text", ident: str = "doc_id") -> pd.DataFrame:
    """(text, label) rows: at most ``per_class`` of each label, each of at most ``max_chars`` characters.

    The ids with the smallest hashes are taken, so the sample depends on the rows only, not on their
    order or number of partitions. Several labels of one id: the largest counts; several texts: the
    smallest. Only ids and lengths are shuffled; texts are read for the taken ids alone, whose
    number (classes times ``per_class``) bounds both the broadcast and what the driver gets.
    """
    marks = labels.filter(F.col(ident).isNotNull() & F.col(label).isNotNull()).groupBy(ident).agg(F.max(label).cast("string").alias("_label"))
    fits = F.col(text).isNotNull() & (F.length(text) <= max_chars) & F.col(ident).isNotNull() & usable
    there = docs.filter(fits).select(ident).distinct()
    return _read(docs, fits, there.join(marks, ident), per_class, text, ident)


def own_sample(docs: DataFrame, label: str, usable: Column, per_class: int, max_chars: int, text: str = "text", ident: str = "doc_id") -> pd.DataFrame:
    """As ``labelled_sample``, with the label in a column of ``docs``."""
    fits = F.col(text).isNotNull() & (F.length(text) <= max_chars) & F.col(ident).isNotNull() & usable
    marks = docs.filter(fits & F.col(label).isNotNull()).groupBy(ident).agg(F.max(label).cast("string").alias("_label"))
    return _read(docs, fits, marks, per_class, text, ident)


def _read(docs: DataFrame, fits: Column, marks: DataFrame, per_class: int, text: str, ident: str) -> pd.DataFrame:
    order = [F.xxhash64(F.col(ident).cast("string")), F.col(ident).cast("string")]
    taken = marks.withColumn("_salt", F.pmod(F.xxhash64(F.col(ident).cast("string"), F.lit(1)), F.lit(SALTS)))
    for keys in (["_label", "_salt"], ["_label"]):  # a frequent label is cut down in parts first
        taken = taken.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= per_class)
    taken = taken.select(ident, "_label")
    texts = docs.filter(fits).select(F.col(ident), F.col(text).alias("_text")).join(F.broadcast(taken), ident)
    rows = texts.groupBy(ident, "_label").agg(F.min("_text").alias("text")).toPandas()
    rows["_order"] = rows[ident].astype(str)
    return rows.sort_values("_order").rename(columns={"_label": "label"})[["text", "label"]].reset_index(drop=True)
