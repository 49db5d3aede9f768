"""Queries of library views, merging, retention and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import library, merge
from newsloom.operators.ranking import rank_all, top_k
from newsloom.plans import derived, duck
from newsloom.plans.registry import query

_BASE = f"WITH {duck.ITEMS_BASE}"
_ITEMS = f"WITH {duck.ITEMS}"
_N = duck.NOW


def _items(spark, sf):
    return derived.items(spark, sf)


_CONFIG = library.FilterConfig(
    include_unread=True, include_starred=True, only_with_media=True, excluded_feeds=["src1", "src2"]
)


@query("f2_composable_filter", f"""{_BASE} SELECT item_id FROM items_base WHERE feed_id NOT IN ('src1', 'src2')
  AND (NOT is_read OR is_starred) AND trim(image_url) <> ''""")
def f2_composable_filter(spark, sf):
    return _items(spark, sf).filter(library.config_predicate(_CONFIG, derived.now())).select("item_id")


@query("f2_vip_today_filter", f"""{_BASE} SELECT item_id FROM items_base WHERE is_vip
  AND published_at >= {_N} - INTERVAL 24 HOUR AND published_at < {_N}""")
def f2_vip_today_filter(spark, sf):
    config = library.FilterConfig(only_today=True, only_vip_feeds=True)
    yesterday = derived.now() - F.expr("interval 1 hour")
    return _items(spark, sf).filter(library.config_predicate(config, yesterday)).select("item_id")


@query("f3_search", f"""{_ITEMS}, {duck.FEEDS} SELECT item_id FROM items LEFT JOIN feeds USING (feed_id)
  WHERE NOT is_read AND (coalesce(contains(lower(items.title), 'ion'), false) OR coalesce(contains(lower(translated_title), 'ion'), false)
  OR coalesce(contains(lower(author), 'ion'), false) OR coalesce(contains(lower(snippet), 'ion'), false)
  OR coalesce(contains(lower(summary), 'ion'), false) OR coalesce(contains(lower(feeds.title), 'ion'), false))""")
def f3_search(spark, sf):
    return library.search(_items(spark, sf), derived.feeds(spark, sf), "  ION ", hide_read=True).select("item_id")


@query("f4_recent_window", f"""{_BASE} SELECT item_id FROM items_base
  WHERE published_at BETWEEN TIMESTAMP '2024-01-29 23:00:00' AND TIMESTAMP '2024-01-31 12:30:00'""")
def f4_recent_window(spark, sf):
    now = F.lit("2024-01-31 12:30:00").cast("timestamp")
    return _items(spark, sf).filter(
        library.recent_window(F.col("published_at"), now, "Europe/Berlin")
    ).select("item_id")


_EXPIRED = f"""(is_read AND NOT is_starred AND published_at < {_N} - INTERVAL 10 DAY)
  OR (NOT is_read AND NOT is_starred AND published_at < {_N} - INTERVAL 20 DAY)"""


@query("f10_retention", f"{_BASE} SELECT item_id FROM items_base WHERE NOT ({_EXPIRED})")
def f10_retention(spark, sf):
    return library.retain(_items(spark, sf), 10, 20, derived.now()).select("item_id")


@query("a4_pruning_report", f"""{_BASE} SELECT count(*) FILTER (WHERE is_read) AS read_pruned, count(*) FILTER (WHERE NOT is_read) AS unread_pruned,
  count(*) AS total_pruned FROM items_base WHERE {_EXPIRED}""")
def a4_pruning_report(spark, sf):
    return library.pruning_report(_items(spark, sf), 10, 20, derived.now())


@query("t7_refresh_retention", f"""{_BASE} SELECT item_id FROM items_base
  WHERE NOT (is_read AND NOT is_starred AND published_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY)""")
def t7_refresh_retention(spark, sf):
    from newsloom.streaming.refresh import after_refresh_retention

    later = F.lit("2024-02-15 00:00:00").cast("timestamp")
    return after_refresh_retention(_items(spark, sf), 0, later).select("item_id")


@query("f11_promotional_sweep", f"{_BASE} SELECT item_id FROM items_base WHERE NOT is_starred AND NOT is_vip AND {duck.promotional('title', 'link')}")
def f11_promotional_sweep(spark, sf):
    return library.promotional_history(_items(spark, sf), derived.vip_feeds(spark, sf)).select("item_id")


@query("f14_irrelevant_blocks", f"""{_BASE}, b AS (SELECT item_id, unnest(range(len(block_texts))) AS position, len(block_texts) AS n FROM items_base)
  SELECT item_id, position, position IN (0, item_id % 3, n - 1) AS irrelevant FROM b""")
def f14_irrelevant_blocks(spark, sf):
    from newsloom.operators.digest import flag_blocks

    flagged = F.array(F.lit(0), (F.col("item_id") % 3).cast("int"), F.size("block_texts") - 1)
    return flag_blocks(_items(spark, sf), "block_texts", flagged).select("item_id", "position", "irrelevant")


@query("f15_annotation_queue", """SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id
  WHERE lang = 'fr' AND l.doc_id IS NULL AND contains(lower(text || ' ' || source), 'pour')""")
def f15_annotation_queue(spark, sf):
    from newsloom.sources.corpus import annotation_queue

    corpus = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("publisher_key"),
        F.col("lang").alias("language"),
    )
    labels = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    found = annotation_queue(corpus, labels, language="fr", unlabelled_only=True, needle="Pour")
    return found.select(F.col("id").alias("doc_id"))


# --- merge ------------------------------------------------------------------------------------

_STORED = f"""stored AS (SELECT item_id, feed_id,
    CASE WHEN item_id % 3 = 0 THEN guid ELSE 'x' || item_id END AS guid,
    CASE WHEN item_id % 3 = 1 THEN link ELSE 'https://old.example.com/' || item_id END AS link,
    CASE WHEN item_id % 4 = 2 THEN title ELSE 'Old ' || title END AS title, published_at FROM items_base)"""
_REASONS = f"""{_BASE}, {_STORED}, judged AS (SELECT i.item_id, i.feed_id, CASE
    WHEN i.guid <> '' AND EXISTS (FROM stored s WHERE s.feed_id = i.feed_id AND trim(s.guid) = trim(i.guid) AND trim(i.guid) <> '') THEN 'dup_guid'
    WHEN EXISTS (FROM stored s WHERE s.feed_id = i.feed_id AND s.link = i.link) THEN 'dup_link'
    WHEN EXISTS (FROM stored s WHERE s.feed_id = i.feed_id AND s.title = i.title AND s.published_at = i.published_at) THEN 'dup_fallback'
    WHEN NOT is_vip AND {duck.promotional("title", "link")} THEN 'noise' ELSE 'inserted' END AS reason FROM items_base i)"""


def _stored(spark, sf):
    """What an earlier refresh left: every item, each recognisable by another identity."""
    n = F.col("item_id")
    return _items(spark, sf).select(
        "item_id", "feed_id",
        F.when(n % 3 == 0, F.col("guid")).otherwise(F.concat(F.lit("x"), n.cast("string"))).alias("guid"),
        F.when(n % 3 == 1, F.col("link")).otherwise(F.concat(F.lit("https://old.example.com/"), n.cast("string"))).alias("link"),
        F.when(n % 4 == 2, F.col("title")).otherwise(F.concat(F.lit("Old "), "title")).alias("title"),
        "published_at",
    )


_INCOMING = ["item_id", "feed_id", "guid", "link", "title", "published_at", "is_vip"]


@query("j1_dedupe_merge", f"{_REASONS} SELECT item_id FROM judged WHERE reason = 'inserted'")
def j1_dedupe_merge(spark, sf):
    return merge.merge_new(_items(spark, sf).select(*_INCOMING), _stored(spark, sf)).select("item_id")


@query("j1a_merge_report", f"{_REASONS} SELECT feed_id, reason, count(*) AS n FROM judged GROUP BY ALL")
def j1a_merge_report(spark, sf):
    return merge.merge_report(merge.merge_reasons(_items(spark, sf).select(*_INCOMING), _stored(spark, sf)))


@query("s12_initial_load", f"{_BASE} SELECT item_id, false AS is_read, false AS is_starred FROM items_base")
def s12_initial_load(spark, sf):
    loaded = merge.merge_new(_items(spark, sf).select(*_INCOMING), _stored(spark, sf), dedupe=False, drop_noise=False)
    return loaded.select("item_id", "is_read", "is_starred")


def _fetched(spark, sf):
    return derived.feeds(spark, sf).select(
        "feed_id",
        F.when(F.col("enabled"), F.concat(F.lit("New "), "title")).otherwise(F.lit("")).alias("title"),
        F.when(F.col("category") == "Tech", F.lit("https://new.example.com/")).alias("site_url"),
        F.concat(F.lit("About "), "feed_id").alias("description"),
        F.lit("").alias("icon_url"),
        F.when(F.col("enabled"), F.concat(F.lit("e-"), "feed_id")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.concat("url", F.lit("?final")).alias("final_url"),
    )


@query("j2_feed_upsert", f"""WITH {duck.FEEDS} SELECT feed_id, CASE WHEN enabled THEN 'New ' || title ELSE title END AS title,
  CASE WHEN category = 'Tech' THEN 'https://new.example.com/' ELSE site_url END AS site_url, 'About ' || feed_id AS description, icon_url,
  CASE WHEN enabled THEN 'e-' || feed_id ELSE 'old' END AS etag, 'then' AS last_modified, url || '?final' AS url FROM feeds""")
def j2_feed_upsert(spark, sf):
    stored = derived.feeds(spark, sf).select(
        "feed_id", "title", "url", "site_url", F.lit("x").alias("description"), "icon_url",
        F.lit("old").alias("etag"), F.lit("then").alias("last_modified"),
    )
    return merge.upsert_feed_metadata(stored, _fetched(spark, sf))


@query("j3_item_with_feed", f"""{_BASE}, {duck.FEEDS} SELECT item_id, coalesce(f.title, 'Feed') AS feed_title FROM items_base i
  LEFT JOIN (SELECT * FROM feeds WHERE enabled) f USING (feed_id)""")
def j3_item_with_feed(spark, sf):
    titles = derived.feeds(spark, sf).filter("enabled").select("feed_id", F.col("title").alias("feed_title"))
    return _items(spark, sf).select("item_id", "feed_id").join(titles, "feed_id", "left").select(
        "item_id", F.coalesce("feed_title", F.lit("Feed")).alias("feed_title")
    )


@query("j4_vip_membership", f"{_BASE} SELECT item_id, is_vip FROM items_base")
def j4_vip_membership(spark, sf):
    rows = _items(spark, sf).select("item_id", "reader_id", "feed_id")
    return library.with_vip(rows, derived.vip_feeds(spark, sf)).select("item_id", "is_vip")


@query("j4_vip_only", f"{_BASE} SELECT item_id FROM items_base WHERE is_vip")
def j4_vip_only(spark, sf):
    rows = _items(spark, sf).select("item_id", "reader_id", "feed_id")
    return library.only_vip(rows, derived.vip_feeds(spark, sf)).select("item_id")


@query("j13_new_subscriptions", f"""WITH {duck.FEEDS}, found AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://src' || (page_id % 40) || '.example.com/rss'
    ELSE url END AS xml_url FROM pages)
  SELECT xml_url, min(page_id) AS doc_id FROM found WHERE xml_url NOT IN (SELECT url FROM feeds) GROUP BY xml_url""")
def j13_new_subscriptions(spark, sf):
    n = F.col("page_id")
    found = derived.table(spark, sf, "pages").select(
        n.alias("doc_id"), F.lit(0).alias("position"),
        F.when(n % 2 == 0, F.concat(F.lit("https://src"), (n % 40).cast("string"), F.lit(".example.com/rss")))
        .otherwise(F.col("url")).alias("xml_url"),
    )
    return merge.new_subscriptions(found, derived.feeds(spark, sf)).select("xml_url", "doc_id")


@query("j14_lookup_ids", f"{_BASE} SELECT item_id, title FROM items_base WHERE item_id IN (SELECT doc_id FROM labels)")
def j14_lookup_ids(spark, sf):
    wanted = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return _items(spark, sf).select("item_id", "title").join(wanted, "item_id", "left_semi")


# --- counts, sections, lists ------------------------------------------------------------------


@query("a1_unread_counts", f"""{_BASE}, {duck.FEEDS}, u AS (SELECT reader_id, coalesce(trim(category), '') AS folder, feed_id, NOT is_read AS unread
    FROM items_base LEFT JOIN feeds USING (feed_id))
  SELECT reader_id, CASE WHEN grouping(folder) = 1 THEN 'reader' WHEN grouping(feed_id) = 1 THEN 'folder' ELSE 'feed' END AS level, folder, feed_id,
    count(*) FILTER (WHERE unread) AS unread FROM u GROUP BY GROUPING SETS ((reader_id, folder, feed_id), (reader_id, folder), (reader_id))""")
def a1_unread_counts(spark, sf):
    return library.unread_counts(_items(spark, sf), derived.feeds(spark, sf))


@query("a1_library_counts", f"""{_BASE} SELECT reader_id, count(*) FILTER (WHERE NOT is_read) AS unread,
  count(*) FILTER (WHERE NOT is_read AND published_at >= TIMESTAMP '2024-01-30') AS unread_today,
  count(*) FILTER (WHERE is_starred) AS starred FROM items_base GROUP BY reader_id""")
def a1_library_counts(spark, sf):
    return library.library_counts(_items(spark, sf), derived.now() - F.expr("interval 1 hour"))


@query("a2_folder_sizes", f"WITH {duck.FEEDS} SELECT coalesce(trim(category), '') AS folder, count(*) AS n_feeds FROM feeds GROUP BY 1")
def a2_folder_sizes(spark, sf):
    return library.folder_sizes(derived.feeds(spark, sf))


_SECTION = f"""CASE WHEN published_at >= TIMESTAMP '2024-01-30' THEN 'today' WHEN published_at >= TIMESTAMP '2024-01-29' THEN 'yesterday'
  WHEN published_at >= TIMESTAMP '2024-01-23' THEN 'thisWeek' ELSE 'older' END"""


@query("a3_timeline_sections", f"""{_BASE} SELECT reader_id, item_id, {_SECTION} AS section,
  row_number() OVER (PARTITION BY reader_id, {_SECTION} ORDER BY published_at DESC, item_id) AS position FROM items_base""")
def a3_timeline_sections(spark, sf):
    return library.timeline(_items(spark, sf), derived.now() - F.expr("interval 1 hour"))


def _ledger(spark, sf):
    return _items(spark, sf).select(F.col("published_at").alias("cleaned_at"), (F.col("item_id") % 5).alias("n"))


@query("a5_cleanup_ledger", f"""{_BASE} SELECT sum(item_id % 5) AS lifetime, sum(item_id % 5) FILTER (WHERE published_at > TIMESTAMP '2024-01-20') AS reported FROM items_base""")
def a5_cleanup_ledger(spark, sf):
    return library.cleanup_delta(_ledger(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp"), derived.now())


@query("a18_feed_freshness", f"{_BASE} SELECT feed_id, {duck.stamp('max(published_at)')} AS newest_at FROM items_base GROUP BY feed_id")
def a18_feed_freshness(spark, sf):
    return library.feed_freshness(_items(spark, sf)).select("feed_id", derived.stamp("newest_at").alias("newest_at"))


@query("w11_top_lists", f"""{_BASE} SELECT reader_id, item_id, rank, rank <= 5 AS in_briefing, rank <= 6 AS in_menu FROM (SELECT *,
  row_number() OVER (PARTITION BY reader_id ORDER BY published_at DESC, item_id) AS rank FROM items_base) WHERE rank <= 25""")
def w11_top_lists(spark, sf):
    best = library.top_lists(_items(spark, sf).select("reader_id", "item_id", "published_at"), 25)
    return best.select(
        "reader_id", "item_id", "rank", (F.col("rank") <= 5).alias("in_briefing"), (F.col("rank") <= 6).alias("in_menu")
    )


@query("w11_latest_unread", f"""{_BASE} SELECT reader_id, item_id FROM items_base WHERE NOT is_read
  QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY published_at DESC, item_id) = 1""")
def w11_latest_unread(spark, sf):
    unread = _items(spark, sf).filter("not is_read").select("reader_id", "item_id", "published_at")
    return top_k(unread, ["reader_id"], library.newest_first(), 1).select("reader_id", "item_id")


@query("w12_sorted_library", f"""{_BASE} SELECT item_id, row_number() OVER (ORDER BY published_at DESC, item_id) AS newest_rank,
  row_number() OVER (ORDER BY published_at, item_id DESC) AS oldest_rank FROM items_base""")
def w12_sorted_library(spark, sf):
    narrow = _items(spark, sf).select("item_id", "published_at")
    newest = rank_all(narrow, [], library.newest_first(), "newest_rank")
    oldest = rank_all(narrow, [], [F.col("published_at"), F.col("item_id").desc()], "oldest_rank")
    return newest.drop("published_at").join(oldest.drop("published_at"), "item_id")


@query("w13_language_batches", f"""{_BASE} SELECT item_id, language, (row_number() OVER (PARTITION BY language ORDER BY published_at, item_id) - 1) // 12 AS batch
  FROM items_base""")
def w13_language_batches(spark, sf):
    narrow = _items(spark, sf).select("item_id", "language", "published_at")
    return merge.batch_numbers(narrow, ["language"], [F.col("published_at"), F.col("item_id")]).drop("published_at")


_SNAP = duck.strip_tags("(CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE content END)")


@query("s10_snapshot", f"""{_BASE}, {duck.FEEDS} SELECT reader_id, rank, item_id, i.title, f.title AS feed_title,
  {duck.stamp("published_at")} AS published_at, nullif(left({_SNAP}, 180), '') AS summary, is_read
  FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY published_at DESC, discovered_at DESC, item_id) AS rank FROM items_base) i
  JOIN feeds f USING (feed_id) WHERE rank <= 10""")
def s10_snapshot(spark, sf):
    rows = library.snapshot(_items(spark, sf), derived.feeds(spark, sf))
    return rows.withColumn("published_at", derived.stamp("published_at"))


# --- state ------------------------------------------------------------------------------------


@query("m1_read_events", f"""{_BASE}, last AS (SELECT user_id, max_by(event_type IN ('view', 'click'), struct_pack(ts := ts, event_id := event_id)) AS set_read
    FROM events GROUP BY user_id)
  SELECT item_id, coalesce(set_read, is_read) AS is_read FROM items_base LEFT JOIN last ON user_id = item_id""")
def m1_read_events(spark, sf):
    log = derived.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), "event_id", F.col("ts").alias("event_at"),
        F.col("event_type").isin("view", "click").alias("set_read"),
    )
    return merge.apply_read_events(_items(spark, sf).select("item_id", "is_read"), log)


@query("m1_mark_all_read", f"{_BASE} SELECT item_id, true AS set_read FROM items_base WHERE feed_id = 'src3' AND NOT is_read")
def m1_mark_all_read(spark, sf):
    scope = library.scope("one_feed", derived.now(), feed_id="src3")
    return merge.mark_all_read(_items(spark, sf), scope, derived.now()).select("item_id", "set_read")


@query("m2_cascade_delete", f"""{_BASE}, {duck.FEEDS} SELECT item_id FROM items_base WHERE feed_id IN (SELECT feed_id FROM feeds WHERE enabled)""")
def m2_cascade_delete(spark, sf):
    gone = derived.feeds(spark, sf).filter("not enabled")
    items = _items(spark, sf).select("item_id", "feed_id")
    kept = merge.delete_feeds(items, gone)
    return merge.delete_orphans(items.select("item_id"), kept)


@query("m5_folder_rename", f"""WITH {duck.FEEDS} SELECT feed_id, CASE WHEN trim(category) = 'World' THEN 'Planet' WHEN category = 'Tech' THEN NULL ELSE category END AS category
  FROM feeds""")
def m5_folder_rename(spark, sf):
    renamed = merge.rename_folder(derived.feeds(spark, sf), "World", "Planet")
    return merge.rename_folder(renamed, "Tech", "  ").select("feed_id", "category")


@query("t2_refresh_state", f"""WITH log AS (SELECT event_id AS fetch_id, 'src' || (user_id % 20) AS feed_id, ts AS fetched_at,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'error' THEN 500 ELSE 200 END AS status,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'e' || event_id END AS etag FROM events)
  SELECT feed_id, {duck.stamp("max(fetched_at)")} AS last_attempt, {duck.stamp("max(fetched_at) FILTER (WHERE status IN (200, 304))")} AS last_success,
    CASE WHEN max_by(status, fetch_id) = 500 THEN 'status 500' END AS refresh_error, max_by(etag, fetch_id) FILTER (WHERE status = 200 AND etag IS NOT NULL) AS etag,
    count(*) FILTER (WHERE status = 500) AS failures FROM log GROUP BY feed_id""")
def t2_refresh_state(spark, sf):
    return merge.refresh_state(_fetch_log(spark, sf)).select(
        "feed_id", derived.stamp("last_attempt").alias("last_attempt"), derived.stamp("last_success").alias("last_success"),
        "refresh_error", "etag", "failures",
    )


def _fetch_log(spark, sf):
    """The event log read as a log of fetches."""
    status = (
        F.when(F.col("event_type") == "click", 304).when(F.col("event_type") == "error", 500).otherwise(200)
    )
    return derived.table(spark, sf, "events").select(
        F.col("event_id").alias("fetch_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("feed_id"),
        F.col("ts").alias("fetched_at"), status.alias("status"),
        F.when(F.col("event_type").isin("view", "purchase"), F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(status == 500, F.lit("status 500")).alias("refresh_error"),
    )


@query("t2_conditional_headers", """WITH log AS (SELECT event_id AS fetch_id, 'src' || (user_id % 20) AS feed_id,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'e' || event_id END AS etag FROM events WHERE event_type NOT IN ('click', 'error'))
  SELECT l.feed_id, CASE WHEN d.feed_id IS NOT NULL THEN max_by(etag, fetch_id) FILTER (WHERE etag IS NOT NULL) END AS if_none_match, CAST(NULL AS VARCHAR) AS if_modified_since
  FROM log l LEFT JOIN (SELECT DISTINCT source AS feed_id FROM documents) d ON d.feed_id = l.feed_id GROUP BY l.feed_id, d.feed_id""")
def t2_conditional_headers(spark, sf):
    """Validators go out only for feeds that have items; the log has feeds that no item is of."""
    return merge.conditional_headers(merge.refresh_state(_fetch_log(spark, sf)), _items(spark, sf))


@query("c35_vip_lists", f"""SELECT reader_id, string_agg(upper(u), ',' ORDER BY upper(u)) AS encoded, count(*) AS n_feeds FROM (
  SELECT DISTINCT doc_id % 8 AS reader_id, 'abcdef00-0000-4000-8000-' || lpad(substr(source, 4), 12, '0') AS u FROM documents) GROUP BY reader_id""")
def c35_vip_lists(spark, sf):
    from newsloom.functions.vip import decode_vip, encode_vip

    ident = F.concat(F.lit("abcdef00-0000-4000-8000-"), F.lpad(F.substring("source", 4, 10), 12, "0"))
    rows = derived.table(spark, sf, "documents").select((F.col("doc_id") % 8).alias("reader_id"), ident.alias("u")).distinct()
    # A reader's trusted feeds are a short list by nature: at most one id per feed of the library.
    lists = rows.groupBy("reader_id").agg(encode_vip(F.array_agg("u")).alias("encoded"))
    decoded = decode_vip(F.concat("encoded", F.lit(",not-an-id,")))
    return lists.select("reader_id", "encoded", F.size(decoded).cast("bigint").alias("n_feeds"))
