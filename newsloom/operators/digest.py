"""Digests and briefings: source texts, cache lookups, extractive fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text


def flag_blocks(items: DataFrame, blocks: str, irrelevant: Column) -> DataFrame:
    """One row per block with a flag for the positions in ``irrelevant``."""
    rows = items.withColumn("_irrelevant", irrelevant)
    keep = [c for c in items.columns if c != blocks]
    return rows.select(*keep, "_irrelevant", F.posexplode(blocks).alias("position", "block")).select(
        *keep, "position", "block", F.array_contains("_irrelevant", F.col("position")).alias("irrelevant")
    )


def preferred_blocks() -> Column:
    """Extracted blocks, else paragraphs of content, summary or snippet, else that text itself."""
    raw = F.coalesce("content", "summary", "snippet", F.lit(""))
    parts = text.bind(
        raw, lambda r: text.bind(text.paragraphs(r), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(r)))
    )
    return F.when(F.size("block_texts") > 0, F.col("block_texts")).otherwise(parts)


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), content), 256)


def source_hash() -> Column:
    """Hash of title and preferred blocks: what a digest was made from."""
    return content_hash(F.col("title"), F.array_join(preferred_blocks(), "\n"))


def _matching(items: DataFrame, digests: DataFrame, version: int, language: str) -> DataFrame:
    usable = digests.filter((F.col("prompt_version") == version) & (F.col("output_language") == language))
    return items.select("item_id", "source_hash").join(usable, ["item_id", "source_hash"])


def _latest(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c != "item_id"]
    best = F.max_by(F.struct(*fields), F.struct("generated_at", "digest_id")).alias("best")
    return rows.groupBy("item_id").agg(best).select("item_id", "best.*")


def current_digests(
    items: DataFrame, digests: DataFrame, version: int, language: str, model_kind: str | None = None
) -> DataFrame:
    """Newest digest made from exactly the item's present text."""
    rows = _matching(items, digests, version, language)
    return _latest(rows.filter(F.col("model_kind") == model_kind) if model_kind else rows)


def cached_digests(
    items: DataFrame, digests: DataFrame, version: int, language: str, model_available: bool, now: Column
) -> DataFrame:
    """Digests that may be reused: model-made always, extractive while young or without a model."""
    young = F.col("generated_at") > now - F.expr("interval 6 hours")
    extractive = (F.col("model_kind") == "extractive") & (F.lit(not model_available) | young)
    usable = (F.col("model_kind") == "onDevice") | extractive
    return _latest(_matching(items, digests, version, language).filter(usable))


def stale_items(items: DataFrame, digests: DataFrame, version: int, language: str) -> DataFrame:
    """Items without a digest of their present text, version and language: the re-work list."""
    return items.join(_matching(items, digests, version, language).select("item_id"), "item_id", "left_anti")


def briefing_hashes(picks: DataFrame) -> DataFrame:
    """Hash per reader over the ordered top items (at most a handful per reader)."""
    body = F.coalesce(F.array_join("block_texts", "\n"), "content", "summary", "snippet", F.lit(""))
    part = F.concat_ws("\n", F.col("item_id").cast("string"), "title", body)
    ordered = F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))
    material = F.array_join(F.transform(ordered, lambda x: x["part"]), "\n---\n")
    return picks.groupBy("reader_id").agg(content_hash(F.lit("briefing"), material).alias("source_hash"))


def cached_briefings(wanted: DataFrame, briefings: DataFrame, version: int, language: str) -> DataFrame:
    """Newest saved briefing for each wanted (reader_id, source_hash)."""
    usable = briefings.filter((F.col("prompt_version") == version) & (F.col("output_language") == language))
    newest = usable.groupBy("source_hash").agg(
        F.max_by(F.struct("briefing_id", "text"), F.struct("generated_at", "briefing_id")).alias("best")
    )
    return wanted.join(newest, "source_hash").select("reader_id", "source_hash", "best.*")


def extractive_briefings(picks: DataFrame, opening: str, closing: str) -> DataFrame:
    """One spoken-style text per reader over its ordered top items."""
    line = F.concat(
        F.lit("From "), F.coalesce("feed_title", F.lit("your feeds")), F.lit(": "), F.col("title"), F.lit(". "),
        F.substring(F.coalesce("snippet", "title"), 1, 140), F.lit("."),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    lines = F.transform(ordered, lambda x: x["line"])
    return picks.groupBy("reader_id").agg(
        F.array_join(F.concat(F.array(F.lit(opening)), lines, F.array(F.lit(closing))), " ").alias("briefing")
    )
