"""Language tagging by word weights learned from labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import durable


def _words(df: DataFrame, keep: list[str], text_column: str) -> DataFrame:
    words = F.split(F.lower(text_column), r"[^\p{L}\p{M}\p{N}]+", -1)
    return df.select(*keep, F.explode(words).alias("word")).filter("word != ''")


def language_profile(labelled: DataFrame, text_column: str, language_column: str) -> DataFrame:
    """(language, word, weight): share of the word among the words of its language."""
    words = _words(labelled.withColumnRenamed(language_column, "language"), ["language"], text_column)
    counts = words.groupBy("language", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    return counts.join(totals, "language").select("language", "word", (F.col("n") / F.col("total")).alias("weight"))


#: Rows up to which a profile, or its most frequent words, is joined where the texts are (about 50 bytes each).
MAP_SIDE_ROWS = 1_000_000


def detect_language(df: DataFrame, id_column: str, text_column: str, profile: DataFrame) -> DataFrame:
    """Best language per row, ``und`` where no word is known.

    A profile of measured size is joined where the texts are, and a task adds up its rows' votes, so
    only a row and its languages are shuffled. Of a larger profile the most frequent words are joined so;
    only occurrences of all other words are shuffled, by word, to the rest of the profile.
    """
    words = _words(df, [id_column], text_column)
    profile = durable(profile)
    if profile.count() <= MAP_SIDE_ROWS:
        met = words.join(F.broadcast(profile), "word")
    else:
        languages = profile.select("language").distinct().count()
        most = profile.groupBy("word").agg(F.max("weight").alias("most")).orderBy(F.desc("most"), "word")
        frequent = durable(most.select("word").limit(max(1, MAP_SIDE_ROWS // languages)))
        near = words.join(F.broadcast(profile.join(F.broadcast(frequent), "word", "left_semi")), "word")
        far = words.join(F.broadcast(frequent), "word", "left_anti").join(profile.join(F.broadcast(frequent), "word", "left_anti").hint("merge"), "word")
        met = near.unionByName(far)
    votes = met.groupBy(id_column, "language").agg(F.round(F.sum("weight"), 9).alias("vote"))
    best = votes.groupBy(id_column).agg(F.min_by("language", F.struct(-F.col("vote"), "language")).alias("detected"))
    return df.select(id_column).join(best, id_column, "left").select(
        id_column, F.coalesce("detected", F.lit("und")).alias("detected")
    )
