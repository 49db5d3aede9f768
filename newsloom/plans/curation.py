"""Queries of scoring and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.operators import curate
from newsloom.operators.ranking import rank_all, top_k
from newsloom.plans import derived, duck
from newsloom.plans.registry import query

_ITEMS = f"WITH {duck.ITEMS}"
_SCORED = f"""{_ITEMS}, scored AS (SELECT *, {duck.AGE} AS age, {duck.CANDIDATE} AS is_candidate, {duck.score(duck.AGE)} AS score FROM items)"""
_BEST = "score DESC, published_at DESC, item_id"
_COUNTS = """counts AS (SELECT reader_id, count(*) AS total, count(*) FILTER (WHERE is_candidate) AS candidates FROM scored GROUP BY reader_id),
limits AS (SELECT *, greatest(6, CAST(ceil(budget * 0.5) AS INTEGER)) AS source_cap, greatest(4, CAST(ceil(budget / 6.0) AS INTEGER)) AS topic_cap
  FROM (SELECT *, CASE WHEN candidates = 0 THEN 0 WHEN candidates <= 30 THEN candidates
    ELSE least(80, greatest(30, least(candidates, CAST(floor(sqrt(total) * 2.5) AS BIGINT)))) END AS budget FROM counts))"""


def _scored(spark, sf):
    return curate.scored(derived.items(spark, sf), derived.now())


@query("f5_freshness_gate", f"{_SCORED} SELECT item_id, round(age, 3) AS age, is_candidate FROM scored")
def f5_freshness_gate(spark, sf):
    return _scored(spark, sf).select("item_id", F.round("age", 3).alias("age"), "is_candidate")


@query("w1_score", f"{_SCORED} SELECT item_id, score FROM scored")
def w1_score(spark, sf):
    return _scored(spark, sf).select("item_id", "score")


@query("w2_candidate_rank", f"""{_SCORED} SELECT reader_id, item_id, row_number() OVER (PARTITION BY reader_id ORDER BY {_BEST}) AS rank
  FROM scored WHERE is_candidate""")
def w2_candidate_rank(spark, sf):
    narrow = _scored(spark, sf).filter("is_candidate").select("reader_id", "item_id", "score", "published_at")
    return rank_all(narrow, ["reader_id"], curate.best_first()).select("reader_id", "item_id", "rank")


@query("w2_top_candidates", f"""{_SCORED}, {duck.FEEDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY {_BEST}) AS rank
  FROM scored WHERE is_candidate)
  SELECT reader_id, rank, item_id, ranked.title, coalesce(feeds.title, 'Feed') AS feed_title, score, snippet
  FROM ranked LEFT JOIN feeds USING (feed_id) WHERE rank <= 20""")
def w2_top_candidates(spark, sf):
    """Flagship: clean, gate, score and rank every item; the best 20 per reader with their feed."""
    ranked = top_k(_scored(spark, sf).filter("is_candidate"), ["reader_id"], curate.best_first(), 20)
    feed = derived.feeds(spark, sf).select("feed_id", F.col("title").alias("feed_title"))
    return ranked.join(feed, "feed_id", "left").select(
        "reader_id", "rank", "item_id", "title", F.coalesce("feed_title", F.lit("Feed")).alias("feed_title"), "score", "snippet"
    )


@query("w3_selection_budget", f"{_SCORED}, {_COUNTS} SELECT reader_id, total, candidates, budget, source_cap, topic_cap FROM limits")
def w3_selection_budget(spark, sf):
    return curate.budgets(_scored(spark, sf))


_WALK = f"""{_SCORED.replace("WITH ", "WITH RECURSIVE ", 1)}, {_COUNTS}, ranked AS (
  SELECT s.reader_id, item_id, score, published_at AS ts, is_vip, {duck.canonical("link")} AS link_key,
    {duck.normalize_title("title")} AS title_key, {duck.tokens("title")} AS toks, feed_id AS source_key,
    budget, source_cap, topic_cap, row_number() OVER (PARTITION BY s.reader_id ORDER BY {_BEST}) AS rn
  FROM scored s JOIN limits USING (reader_id) WHERE is_candidate),
walk AS (
  SELECT reader_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(item_id BIGINT, link_key VARCHAR, title_key VARCHAR, source_key VARCHAR, toks VARCHAR[], ts TIMESTAMP)[]) AS acc,
    CAST(NULL AS BIGINT) AS covers FROM limits
  UNION ALL
  SELECT reader_id, rn, CASE WHEN repeated OR dup IS NOT NULL OR (NOT is_vip AND len(near) >= topic_cap) THEN acc
      ELSE list_append(acc, struct_pack(item_id := item_id, link_key := link_key, title_key := title_key, source_key := source_key, toks := toks, ts := ts)) END,
    CASE WHEN NOT repeated THEN dup END
  FROM (SELECT *, list_filter(near, lambda p: p.source_key <> source_key AND len(toks) >= 4 AND len(p.toks) >= 4
        AND len(list_intersect(toks, p.toks)) / (len(toks) + len(p.toks) - len(list_intersect(toks, p.toks))) >= 0.65)[1].item_id AS dup
    FROM (SELECT c.*, w.acc,
        coalesce(len(list_filter(w.acc, lambda p: p.link_key = c.link_key OR (c.title_key <> '' AND p.title_key = c.title_key))) > 0, false)
          OR len(list_filter(w.acc, lambda p: p.source_key = c.source_key)) >= c.source_cap * CASE WHEN c.is_vip THEN 2 ELSE 1 END AS repeated,
        list_filter(w.acc, lambda p: len(c.toks) >= 3 AND len(p.toks) >= 3 AND abs(epoch(p.ts) - epoch(c.ts)) <= 172800
          AND len(list_intersect(c.toks, p.toks)) >= 3
          AND len(list_intersect(c.toks, p.toks)) / (len(c.toks) + len(p.toks) - len(list_intersect(c.toks, p.toks))) >= 0.3) AS near
      FROM walk w JOIN ranked c ON c.reader_id = w.reader_id AND c.rn = w.rn + 1 WHERE len(w.acc) < c.budget))),
final AS (SELECT reader_id, acc FROM walk QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY rn DESC) = 1),
picks AS (SELECT reader_id, unnest(acc).item_id AS item_id, unnest(range(len(acc))) AS position FROM final)"""


@query("w4_curated_picks", f"{_WALK} SELECT reader_id, item_id, position FROM picks")
def w4_curated_picks(spark, sf):
    return curate.curated_picks(derived.items(spark, sf), derived.now()).select("reader_id", "item_id", "position")


@query("w4a_coverage", f"""{_WALK}, hits AS (SELECT reader_id, covers AS item_id, count(*) AS n FROM walk WHERE covers IS NOT NULL GROUP BY ALL)
  SELECT p.reader_id, p.item_id, position, coalesce(n, 0) + 1 AS coverage_count, score + coalesce(n, 0) * 20 AS boosted_score
  FROM picks p JOIN scored USING (reader_id, item_id) LEFT JOIN hits ON hits.reader_id = p.reader_id AND hits.item_id = p.item_id""")
def w4a_coverage(spark, sf):
    items = derived.items(spark, sf)
    run = curate.prepared(items, derived.now())
    return curate.coverage(items, derived.now(), curate.curated_picks(items, derived.now(), run=run), run=run)


@query("u1_curated_union", f"""{_WALK} SELECT reader_id, item_id FROM picks
  UNION SELECT reader_id, item_id FROM items WHERE is_starred""")
def u1_curated_union(spark, sf):
    return curate.curated(derived.items(spark, sf), derived.now())


@query("f1_library_scopes", f"""{_WALK}, kept AS (SELECT reader_id, item_id FROM picks UNION SELECT reader_id, item_id FROM items WHERE is_starred)
  SELECT i.item_id, published_at >= {duck.NOW} - INTERVAL 0 DAY AS today, NOT is_read AS unread, is_starred AS starred,
    feed_id = 'src3' AS one_feed, k.item_id IS NOT NULL AS curated
  FROM items i LEFT JOIN kept k USING (reader_id, item_id)""")
def f1_library_scopes(spark, sf):
    from newsloom.operators import library

    items = derived.items(spark, sf)
    picked = curate.curated(items, derived.now()).withColumn("curated", F.lit(True))
    marks = items.select(
        "reader_id", "item_id",
        *[library.scope(s, derived.now(), feed_id="src3").alias(s) for s in ["today", "unread", "starred", "one_feed"]],
    )
    return marks.join(picked, ["reader_id", "item_id"], "left").select(
        "item_id", "today", "unread", "starred", "one_feed", F.coalesce("curated", F.lit(False)).alias("curated")
    )


@query("f8_may_alert", f"""{_ITEMS} SELECT item_id, is_starred OR (length(trim(title)) >= 15 AND (is_vip OR NOT {duck.promotional("trim(title)", "link")})
  AND NOT {duck.clickbait("title")} AND {duck.score("0.0", "false")} >= 85) AS may_alert FROM items""")
def f8_may_alert(spark, sf):
    return derived.items(spark, sf).select("item_id", rules.may_alert().alias("may_alert"))


@query("f9_title_may_alert", f"""WITH {duck.ITEMS_BASE} SELECT item_id, length(trim(title)) >= 15 AND NOT {duck.promotional("title")}
  AND NOT {duck.clickbait("title")} AS may_alert FROM items_base""")
def f9_title_may_alert(spark, sf):
    return derived.items(spark, sf).select("item_id", rules.title_may_alert(F.col("title")).alias("may_alert"))


_UNREAD_WALK = _WALK.replace("AS score FROM items)", "AS score FROM items WHERE NOT is_read)")


@query("a1_curated_unread", f"""{_UNREAD_WALK} SELECT reader_id, count(*) AS curated_unread FROM (
  SELECT reader_id, item_id FROM picks UNION SELECT reader_id, item_id FROM scored WHERE is_starred) GROUP BY reader_id""")
def a1_curated_unread(spark, sf):
    """Badge of the curated feed: curation over the unread items alone."""
    unread = derived.items(spark, sf).filter("not is_read")
    return curate.curated(unread, derived.now()).groupBy("reader_id").agg(F.count("*").alias("curated_unread"))
