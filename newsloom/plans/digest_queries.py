"""Queries of digests, briefings and chunked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed, text
from newsloom.operators import chunks, curate, digest, library, merge
from newsloom.operators.ranking import top_k
from newsloom.plans import derived, duck
from newsloom.plans.curation import _WALK
from newsloom.plans.registry import query

_BASE = f"WITH {duck.ITEMS_BASE}"
_RAW = "coalesce(content, summary, '')"
_BLOCKS = f"CASE WHEN len(block_texts) > 0 THEN block_texts WHEN len(ps) > 0 THEN ps ELSE [{_RAW}] END"
_HASHED = f"""{duck.ITEMS_BASE}, hashed AS (SELECT item_id, published_at, title, {_BLOCKS} AS blocks, sha256(title || chr(10) || array_to_string({_BLOCKS}, chr(10))) AS source_hash
  FROM (SELECT *, {duck.paragraphs(_RAW)} AS ps FROM items_base))"""
_DIGESTS = f"""digests AS (
  SELECT item_id * 3 AS digest_id, item_id, 'onDevice' AS model_kind, CASE WHEN item_id % 2 = 0 THEN source_hash ELSE 'stale' END AS source_hash, 3 AS prompt_version, 'en' AS output_language, published_at + INTERVAL 1 HOUR AS generated_at FROM hashed
  UNION ALL SELECT item_id * 3 + 1, item_id, 'extractive', source_hash, 3, CASE WHEN item_id % 7 = 0 THEN 'de' ELSE 'en' END, {duck.NOW} - to_hours(item_id % 12) FROM hashed
  UNION ALL SELECT item_id * 3 + 2, item_id, 'onDevice', source_hash, CASE WHEN item_id % 5 = 0 THEN 3 ELSE 2 END, 'en', published_at + INTERVAL 2 HOUR FROM hashed)"""


def _hashed(spark, sf) -> DataFrame:
    items = derived.items(spark, sf).withColumn("snippet", F.lit(None).cast("string"))
    return text.settle(items, source_hash=digest.source_hash()).select("item_id", "published_at", "source_hash")


def _digests(hashed: DataFrame) -> DataFrame:
    """Three digests per item: maybe stale, maybe in another language, maybe of an older prompt."""
    n = F.col("item_id")
    rows = F.array(
        F.struct((n * 3).alias("digest_id"), F.lit("onDevice").alias("model_kind"), F.when(n % 2 == 0, F.col("source_hash")).otherwise("stale").alias("source_hash"),
                 F.lit(3).alias("prompt_version"), F.lit("en").alias("output_language"), (F.col("published_at") + F.expr("interval 1 hour")).alias("generated_at")),
        F.struct((n * 3 + 1).alias("digest_id"), F.lit("extractive").alias("model_kind"), F.col("source_hash"),
                 F.lit(3).alias("prompt_version"), F.when(n % 7 == 0, "de").otherwise("en").alias("output_language"),
                 (derived.now() - F.make_dt_interval(hours=(n % 12).cast("int"))).alias("generated_at")),
        F.struct((n * 3 + 2).alias("digest_id"), F.lit("onDevice").alias("model_kind"), F.col("source_hash"),
                 F.when(n % 5 == 0, 3).otherwise(2).alias("prompt_version"), F.lit("en").alias("output_language"),
                 (F.col("published_at") + F.expr("interval 2 hours")).alias("generated_at")),
    )
    return hashed.select("item_id", F.inline(rows))


@query("c31_preferred_blocks", f"""WITH {_HASHED} SELECT item_id, len(blocks) AS n_blocks, source_hash FROM hashed""")
def c31_preferred_blocks(spark, sf):
    items = derived.items(spark, sf).withColumn("snippet", F.lit(None).cast("string"))
    return items.select("item_id", F.size(digest.preferred_blocks()).alias("n_blocks"), digest.source_hash().alias("source_hash"))




@query("j7_current_digests", f"""WITH {_HASHED}, {_DIGESTS} SELECT d.item_id, digest_id, model_kind, {duck.stamp("generated_at")} AS generated_at FROM digests d JOIN hashed h ON h.item_id = d.item_id AND h.source_hash = d.source_hash
  WHERE prompt_version = 3 AND output_language = 'en' QUALIFY row_number() OVER (PARTITION BY d.item_id ORDER BY generated_at DESC, digest_id DESC) = 1""")
def j7_current_digests(spark, sf):
    hashed = _hashed(spark, sf)
    found = digest.current_digests(hashed, _digests(hashed), 3, "en")
    return found.select("item_id", "digest_id", "model_kind", derived.stamp("generated_at").alias("generated_at"))


@query("j8_cached_digests", f"""WITH {_HASHED}, {_DIGESTS} SELECT d.item_id, digest_id FROM digests d JOIN hashed h ON h.item_id = d.item_id AND h.source_hash = d.source_hash
  WHERE prompt_version = 3 AND output_language = 'en' AND (model_kind = 'onDevice' OR generated_at > {duck.NOW} - INTERVAL 6 HOUR)
  QUALIFY row_number() OVER (PARTITION BY d.item_id ORDER BY generated_at DESC, digest_id DESC) = 1""")
def j8_cached_digests(spark, sf):
    hashed = _hashed(spark, sf)
    return digest.cached_digests(hashed, _digests(hashed), 3, "en", True, derived.now()).select("item_id", "digest_id")


@query("m4_stale_digests", f"""WITH {_HASHED}, {_DIGESTS} SELECT item_id FROM hashed h WHERE NOT EXISTS (FROM digests d WHERE d.item_id = h.item_id AND d.source_hash = h.source_hash AND prompt_version = 3 AND output_language = 'de')""")
def m4_stale_digests(spark, sf):
    hashed = _hashed(spark, sf)
    return digest.stale_items(hashed, _digests(hashed), 3, "de").select("item_id")


@query("m3_cleared_digests", f"""WITH {_HASHED}, {_DIGESTS} SELECT h.item_id, count(d.digest_id) AS n_before, 0::BIGINT AS n_after, true AS is_stale FROM hashed h LEFT JOIN digests d USING (item_id) GROUP BY h.item_id""")
def m3_cleared_digests(spark, sf):
    """Digests before and after the derived tables are cleared, and that every item is due again."""
    hashed = _hashed(spark, sf)
    before = _digests(hashed)
    after = merge.clear_derived(before)
    due = digest.stale_items(hashed, after, 3, "en").select("item_id", F.lit(True).alias("is_stale"))
    counted = lambda rows, name: rows.groupBy("item_id").agg(F.count("*").alias(name))
    joined = hashed.select("item_id").join(counted(before, "n_before"), "item_id", "left").join(counted(after, "n_after"), "item_id", "left").join(due, "item_id", "left")
    return joined.select("item_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("is_stale", F.lit(False)).alias("is_stale"))


_TOP = f"""{_WALK}, {duck.FEEDS}, kept AS (SELECT reader_id, item_id FROM picks UNION SELECT reader_id, item_id FROM items WHERE is_starred),
  top AS (SELECT i.*, row_number() OVER (PARTITION BY i.reader_id ORDER BY published_at DESC, item_id) AS rank FROM items i JOIN kept USING (reader_id, item_id) WHERE NOT is_read QUALIFY rank <= 5)"""


def _briefing_picks(spark, sf) -> DataFrame:
    """The five newest unread items of each curated feed."""
    items = derived.items(spark, sf)
    unread = curate.curated_feed(items, derived.now()).filter("not is_read")
    titles = derived.feeds(spark, sf).select("feed_id", F.col("title").alias("feed_title"))
    return top_k(unread, ["reader_id"], library.newest_first(), 5).join(titles, "feed_id", "left")


@query("c33_extractive_briefing", f"""{_TOP} SELECT reader_id, 'Here is your briefing. ' || string_agg('From ' || f.title || ': ' || top.title || '. ' || left(coalesce(snippet, top.title), 140) || '.', ' ' ORDER BY rank)
  || ' That concludes your latest updates.' AS briefing FROM top JOIN feeds f USING (feed_id) GROUP BY reader_id""")
def c33_extractive_briefing(spark, sf):
    return digest.extractive_briefings(
        _briefing_picks(spark, sf), "Here is your briefing.", "That concludes your latest updates."
    )


@query("c17_briefing_hash", f"""{_TOP} SELECT reader_id, sha256('briefing' || chr(10) || string_agg(item_id || chr(10) || title || chr(10) || coalesce(array_to_string(block_texts, chr(10)), content, summary, snippet, ''), chr(10) || '---' || chr(10) ORDER BY rank)) AS source_hash
  FROM top GROUP BY reader_id""")
def c17_briefing_hash(spark, sf):
    return digest.briefing_hashes(_briefing_picks(spark, sf))


@query("j9_cached_briefings", """SELECT reader_id, md5(CAST(reader_id AS VARCHAR)) AS source_hash, max(doc_id) FILTER (WHERE doc_id % 3 <> 0) AS briefing_id, 'Briefing ' || max(doc_id) FILTER (WHERE doc_id % 3 <> 0) AS text
  FROM (SELECT doc_id, doc_id % 8 AS reader_id FROM documents) GROUP BY reader_id""")
def j9_cached_briefings(spark, sf):
    n = F.col("doc_id")
    docs = derived.table(spark, sf, "documents").select(n, (n % 8).alias("reader_id"), F.md5((n % 8).cast("string")).alias("source_hash"))
    saved = docs.select(
        n.alias("briefing_id"), F.concat(F.lit("Briefing "), n.cast("string")).alias("text"), "source_hash",
        F.when(n % 3 == 0, 1).otherwise(2).alias("prompt_version"), F.lit("en").alias("output_language"),
        F.timestamp_seconds(n / 10).alias("generated_at"),
    )
    wanted = docs.select("reader_id", "source_hash").distinct()
    return digest.cached_briefings(wanted, saved, 2, "en")


# --- chunks -----------------------------------------------------------------------------------


def _chunks(spark, sf) -> DataFrame:
    blocks = derived.table(spark, sf, "documents").select("doc_id", F.lit(0).alias("block"), "text")
    return chunks.chunk_rows(blocks, "text", chunks.RETRY_LIMIT)


@query("c37_chunk_summary", """SELECT doc_id, md5(regexp_replace(text, '\\s', '', 'g')) AS letters, true AS within_limit, length(text) > 350 AS split FROM documents""")
def c37_chunk_summary(spark, sf):
    """Every piece within the limit, none empty, nothing lost: checked over all documents."""
    rows = _chunks(spark, sf)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), "")
    return rows.groupBy("doc_id").agg(
        F.md5(F.regexp_replace(whole, r"\s", "")).alias("letters"),
        F.bool_and(F.length("chunk").between(1, chunks.RETRY_LIMIT)).alias("within_limit"),
        (F.count("*") > 1).alias("split"),
    )


_SENTENCES = f"""string_split_regex(regexp_replace(text, '({fixed.SENTENCE_END}){fixed.WHITESPACE}+', '\\1' || chr(10), 'g'), '\\n+')"""
_PIECE_SQL = f"""WITH parts AS (
    SELECT doc_id, text, list_transform(list_filter(list_transform({_SENTENCES}, lambda s: regexp_replace(s, '^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$', '', 'g')), lambda s: s <> ''),
      lambda s: struct_pack(done := []::VARCHAR[], open := s)) AS p FROM documents),
  folded AS (
    SELECT doc_id, text, list_reduce(p, lambda acc, x: CASE
      WHEN acc.open <> '' AND length(acc.open) + 1 + length(x.open) <= 350 THEN struct_pack(done := acc.done, open := acc.open || ' ' || x.open)
      ELSE struct_pack(done := list_concat(list_concat(acc.done, CASE WHEN acc.open <> '' THEN [acc.open] ELSE [] END), list_transform(range(0, (length(x.open) - 1) // 350), lambda i: substr(x.open, i * 350 + 1, 350))),
        open := substr(x.open, (length(x.open) - 1) // 350 * 350 + 1)) END, struct_pack(done := []::VARCHAR[], open := '')) AS f FROM parts),
  pieces AS (SELECT doc_id, CASE WHEN length(text) <= 350 OR len(f.done) = 0 AND f.open = '' THEN [text] WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END AS c FROM folded)
  SELECT doc_id, 0 AS block, unnest(range(0, len(c)))::INT AS chunk_no, unnest(c) AS chunk FROM pieces"""


@query("c37_chunks", _PIECE_SQL)
def c37_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "block", "chunk_no", "chunk")


@query("c38_reassembled_blocks", f"""SELECT doc_id, md5(regexp_replace(text, '\\s', '', 'g')) AS letters FROM documents""")
def c38_reassembled_blocks(spark, sf):
    """Every third piece comes back translated (here: respaced), the others keep their source."""
    rows = _chunks(spark, sf)
    translated = rows.filter(F.col("chunk_no") % 3 == 0).select(
        "doc_id", "block", "chunk_no", F.concat(F.lit(" "), F.regexp_replace("chunk", " ", "  ")).alias("translated")
    )
    done = chunks.reassemble(rows, translated, ["doc_id", "block"])
    return done.select("doc_id", F.md5(F.regexp_replace("text", r"\s", "")).alias("letters"))


@query("c38_untranslated_text", """SELECT doc_id, length(text) <= 350 AS whole, md5(CASE WHEN length(text) <= 350 THEN text ELSE regexp_replace(text, '\\s', '', 'g') END) AS digest FROM documents""")
def c38_untranslated_text(spark, sf):
    """Pieces put back without a translation: a text of one piece comes back as it was, the others with all their letters."""
    rows = _chunks(spark, sf)
    done = chunks.reassemble(rows, rows.withColumn("translated", F.col("chunk")), ["doc_id", "block"])
    short = derived.table(spark, sf, "documents").select("doc_id", (F.length("text") <= chunks.RETRY_LIMIT).alias("whole"))
    digest = F.md5(F.when(F.col("whole"), F.col("text")).otherwise(F.regexp_replace("text", r"\s", "")))
    return done.join(short, "doc_id").select("doc_id", "whole", digest.alias("digest"))
