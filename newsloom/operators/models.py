"""Where a caller's models plug in: any column function of text, usually a pandas UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.stories import with_vectors


def embed(df: DataFrame, model: Callable[[Column], Column], title: str = "title", context: str = "context") -> DataFrame:
    """Headline, body and blended vectors from a model of text; a blank context has no body vector."""
    body = F.when(F.trim(context) != "", model(F.substring(context, 1, 4_000)))
    return with_vectors(df.withColumn("headline", model(F.col(title))).withColumn("body", body))


def summarise(df: DataFrame, model: Callable[[Column], Column], text: str, out: str = "digest") -> DataFrame:
    """Digest of a text column by a model; rows that have one already keep it."""
    made = model(F.col(text))
    return df.withColumn(out, F.coalesce(F.col(out), made) if out in df.columns else made)
