"""Title similarity of items to the picks of their reader (at most a budget each, never all pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import curate


def related_to_picks(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows (reader_id, item_id, pick_id, similarity, duplicate) for related titles within 48 hours.

    The theta join runs row by row against the reader's packed picks; its output per item is
    bounded by the budget. Large readers are met in parts.
    """
    row = {name: F.col(name) for name in ("tokens", "published_at", "source_key")}
    packed = curate.packed_picks(picks)
    near = F.filter("picks", lambda p: curate.is_near(row["tokens"], row["published_at"], p))
    sizes = candidates.groupBy("reader_id").agg(F.count("*").alias("candidates"))
    hits = (
        curate.with_reader(candidates.filter(F.size("tokens") >= 3), packed, sizes)
        .select("reader_id", "item_id", *row, F.explode(near).alias("p"))
        .filter(F.col("item_id") != F.col("p.item_id"))
    )
    return hits.select(
        "reader_id", "item_id", F.col("p.item_id").alias("pick_id"),
        text.title_similarity(F.col("tokens"), F.col("p.tokens")).alias("similarity"),
        curate.is_duplicate(row, F.col("p")).alias("duplicate"),
    )
