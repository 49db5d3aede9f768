"""Queries of evaluation, corpus files and story views."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import evaluate, story_views
from newsloom.plans import derived, duck
from newsloom.plans.registry import query
from newsloom.session import run_dir
from newsloom.sources import corpus

_BASE = f"WITH {duck.ITEMS_BASE}"
_PREDS = """WITH preds AS (SELECT doc_id, 'g' || (doc_id % 37) AS gold,
  'p' || CASE WHEN doc_id % 5 = 0 THEN doc_id % 41 ELSE doc_id % 37 END AS pred, lang FROM documents)"""
_PAIRS = f"""{_PREDS}, pairs AS (SELECT least(a.lang, b.lang) || '|' || greatest(a.lang, b.lang) AS language_pair,
    a.gold = b.gold AS same_gold, a.pred = b.pred AS same_pred FROM preds a JOIN preds b ON a.doc_id < b.doc_id),
  sums AS (SELECT {{key}} count(*) AS article_pairs, count(*) FILTER (WHERE same_gold AND same_pred) AS tp,
    count(*) FILTER (WHERE same_pred AND NOT same_gold) AS fp, count(*) FILTER (WHERE same_gold AND NOT same_pred) AS fn FROM pairs {{group}})"""
_QUALITY = """round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p = 0 OR r = 0 THEN 0.0 END, 6) AS f1"""
_RATIOS = "(SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM sums)"


def _predictions(spark, sf):
    n = F.col("doc_id")
    pred = F.when(n % 5 == 0, n % 41).otherwise(n % 37).cast("string")
    return derived.table(spark, sf, "documents").select(
        n.cast("string").alias("article_id"), F.concat(F.lit("g"), (n % 37).cast("string")).alias("gold_story_id"),
        F.concat(F.lit("p"), pred).alias("predicted_cluster_id"), F.col("lang").alias("language"),
    )


def _table(spark, sf):
    return evaluate.contingency(_predictions(spark, sf))


@query("a6_pair_confusion", f"{_PAIRS.format(key='', group='')} SELECT tp, fp, fn FROM sums")
def a6_pair_confusion(spark, sf):
    return evaluate.narrow(evaluate.pair_counts(_table(spark, sf)).select("tp", "fp", "fn"))


@query("a7_pair_quality", f"{_PAIRS.format(key='', group='')} SELECT tp, fp, fn, {_QUALITY} FROM {_RATIOS}")
def a7_pair_quality(spark, sf):
    return evaluate.narrow(evaluate.pairwise_quality(evaluate.pair_counts(_table(spark, sf))))


@query("a8_language_pairs", f"""{_PAIRS.format(key='language_pair,', group='GROUP BY language_pair')}
  SELECT language_pair, article_pairs, tp, fp, fn, tp + fp + fn AS scored_pairs, {_QUALITY} FROM {_RATIOS}""")
def a8_language_pairs(spark, sf):
    return evaluate.narrow(evaluate.per_language_pair(_table(spark, sf)))


_CLUSTERS = f"""{_PREDS}, by_pair AS (SELECT pred, gold, count(*) AS n FROM preds GROUP BY ALL),
  cl AS (SELECT pred, sum(n) AS articles, count(*) AS golds, sum(n) - max(n) AS outside FROM by_pair GROUP BY pred)"""


@query("a9_false_merges", f"""{_CLUSTERS}, pc AS (SELECT sum(articles * (articles - 1) // 2) AS pp FROM cl), tp AS (SELECT sum(n * (n - 1) // 2) AS tp FROM by_pair)
  SELECT count(*) FILTER (WHERE golds > 1) AS contaminated_clusters, count(*) AS predicted_clusters,
    round(count(*) FILTER (WHERE golds > 1) / count(*), 6) AS false_merge_rate,
    round((any_value(pp) - any_value(tp)) / any_value(pp), 6) AS false_positive_pair_rate FROM cl, pc, tp""")
def a9_false_merges(spark, sf):
    return evaluate.narrow(evaluate.report(_predictions(spark, sf)).select(
        "contaminated_clusters", "predicted_clusters", "false_merge_rate", "false_positive_pair_rate"
    ))


@query("a10_contaminated_clusters", f"""{_CLUSTERS} SELECT pred AS predicted_cluster_id, articles, golds AS gold_stories,
  round(outside / articles, 6) AS contamination_rate FROM cl WHERE golds > 1""")
def a10_contaminated_clusters(spark, sf):
    return evaluate.contaminated_clusters(_table(spark, sf))


@query("a10_contaminating_stories", f"""{_CLUSTERS} SELECT pred AS predicted_cluster_id, gold AS gold_story_id FROM by_pair
  WHERE pred IN (SELECT pred FROM cl WHERE golds > 1)""")
def a10_contaminating_stories(spark, sf):
    return evaluate.contaminating_stories(_table(spark, sf))


@query("a11_split_stories", f"""{_PREDS} SELECT gold AS gold_story_id, count(DISTINCT pred) AS clusters FROM preds GROUP BY gold HAVING count(DISTINCT pred) > 1""")
def a11_split_stories(spark, sf):
    return evaluate.split_stories(_table(spark, sf))


@query("a12_evaluation_report", f"""{_PAIRS.format(key='', group='')}, by_pair AS (SELECT pred, gold, count(*) AS n FROM preds GROUP BY ALL),
  cl AS (SELECT pred, sum(n) AS articles, count(*) AS golds, sum(n) - max(n) AS outside FROM by_pair GROUP BY pred),
  c AS (SELECT count(*) AS predicted_clusters, count(*) FILTER (WHERE golds > 1) AS contaminated_clusters, sum(outside) AS contaminated_articles, sum(articles) AS articles FROM cl),
  g AS (SELECT count(*) AS gold_stories, count(*) FILTER (WHERE k > 1) AS split_stories FROM (SELECT gold, count(DISTINCT pred) AS k FROM preds GROUP BY gold))
  SELECT articles, tp, fp, fn, tp + fp AS predicted_pairs, tp + fn AS gold_pairs, predicted_clusters, gold_stories, {_QUALITY},
    contaminated_clusters, round(contaminated_clusters / predicted_clusters, 6) AS false_merge_rate, round(fp / (tp + fp), 6) AS false_positive_pair_rate,
    split_stories, round(split_stories / gold_stories, 6) AS false_split_rate, contaminated_articles,
    round(contaminated_articles / articles, 6) AS contamination_rate FROM {_RATIOS}, c, g""")
def a12_evaluation_report(spark, sf):
    return evaluate.narrow(evaluate.report(_predictions(spark, sf)))


# --- corpus -----------------------------------------------------------------------------------

_GOOD = """'{"articleID": "' || doc_id || '", "goldStoryID": " g' || (doc_id % 37) || ' ", "predictedClusterID": "p' || (doc_id % 41) || '"'"""


def _corpus_lines(spark, sf):
    """JSON lines in every state of repair, one or two per document."""
    n = F.col("doc_id")
    num = n.cast("string")
    good = F.concat(
        F.lit('{"articleID": "'), num, F.lit('", "goldStoryID": " g'), (n % 37).cast("string"),
        F.lit(' ", "predictedClusterID": "p'), (n % 41).cast("string"), F.lit('"'),
    )
    line = (
        F.when(n % 20 == 1, F.concat(F.lit('{"articleID": "'), num))
        .when(n % 20 == 2, F.concat(F.lit("["), num, F.lit("]")))
        .when(n % 20 == 3, F.concat(F.lit('{"articleID": '), num, F.lit(', "goldStoryID": "  "}')))
        .when(n % 20 == 4, F.concat(good, F.lit(', "language": " "}')))
        .when(n % 20 == 5, F.concat(good, F.lit(', "language": " '), F.upper("lang"), F.lit('"}')))
        .otherwise(F.concat(good, F.lit("}")))
    )
    copies = F.when(n % 20 == 6, F.array(line, line, F.lit("   "))).otherwise(F.array(line))
    path = run_dir(spark, "corpus")
    derived.table(spark, sf, "documents").select(F.explode(copies).alias("value")).write.text(path)
    return path


@query("s8_corpus_records", """SELECT CAST(doc_id AS VARCHAR) AS article_id, 'g' || (doc_id % 37) AS gold_story_id, 'p' || (doc_id % 41) AS predicted_cluster_id,
  CASE WHEN doc_id % 20 = 5 THEN lang ELSE 'und' END AS language FROM documents, range(2) t(copy)
  WHERE doc_id % 20 NOT IN (1, 2, 3, 4) AND (copy = 0 OR doc_id % 20 = 6)""")
def s8_corpus_records(spark, sf):
    return corpus.read_corpus(spark, _corpus_lines(spark, sf))[0]


@query("s8_corpus_problems", f"""SELECT record, reason FROM (
  SELECT '{{"articleID": "' || doc_id AS record, 'invalid JSON' AS reason FROM documents WHERE doc_id % 20 = 1
  UNION ALL SELECT '[' || doc_id || ']', 'expected a JSON object' FROM documents WHERE doc_id % 20 = 2
  UNION ALL SELECT '{{"articleID": ' || doc_id || ', "goldStoryID": "  "}}', 'missing or empty ' || f FROM documents,
    (VALUES ('articleID'), ('goldStoryID'), ('predictedClusterID')) t(f) WHERE doc_id % 20 = 3
  UNION ALL SELECT {_GOOD} || ', "language": " "}}', 'blank language' FROM documents WHERE doc_id % 20 = 4
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'duplicate articleID, extra records: 1' FROM documents WHERE doc_id % 20 = 6)""")
def s8_corpus_problems(spark, sf):
    return corpus.read_corpus(spark, _corpus_lines(spark, sf))[1].select("record", "reason")


def _assigned(spark, sf):
    n = F.col("doc_id")
    return derived.table(spark, sf, "documents").select(
        n.alias("id"), F.when(n % 4 != 0, F.concat(F.lit("story-"), (n % 53).cast("string"))).alias("story_id"),
        F.when(n % 9 != 0, F.col("lang")).alias("language"),
    )


@query("s9_predictions", """SELECT CAST(doc_id AS VARCHAR) AS article_id, 'g' || (doc_id % 37) AS gold_story_id,
  CASE WHEN doc_id % 4 <> 0 THEN 'story-' || (doc_id % 53) ELSE 'unassigned-' || doc_id END AS predicted_cluster_id,
  CASE WHEN doc_id % 9 <> 0 THEN lang ELSE 'und' END AS language FROM documents""")
def s9_predictions(spark, sf):
    """Prediction sink and source: written as JSON lines, read back and validated."""
    records = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("g"), (F.col("doc_id") % 37).cast("string")).alias("gold_story_id")
    )
    path = run_dir(spark, "predictions")
    corpus.write_predictions(corpus.predictions(records, _assigned(spark, sf)), path)
    return corpus.read_corpus_strict(spark, path)


@query("j10_prediction_gold", """SELECT 'g' || (doc_id % 37) AS gold_story_id, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 0) AS singletons
  FROM documents GROUP BY 1""")
def j10_prediction_gold(spark, sf):
    records = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("g"), (F.col("doc_id") % 37).cast("string")).alias("gold_story_id")
    )
    rows = corpus.predictions(records, _assigned(spark, sf))
    single = F.col("predicted_cluster_id").startswith("unassigned-")
    return rows.groupBy("gold_story_id").agg(F.count("*").alias("n"), F.count_if(single).alias("singletons"))


_COLLECTED = f"""collected AS (SELECT source AS feed_id, doc_id AS position, {duck.squash(duck.sub("text", "<[^>]+>", " "))} AS title,
    CASE WHEN doc_id % 3 = 0 THEN 'other.example.org' ELSE source || '.example.com' END AS publisher_key,
    {duck._PUBLISHED} AS published_at, CASE WHEN doc_id % 4 = 0 THEN 'g' || doc_id ELSE 'https://x.example.com/' || doc_id END AS url
  FROM documents WHERE doc_id % 11 <> 0 AND {duck._PUBLISHED} >= TIMESTAMP '2024-01-05')"""


def _collected(spark, sf, per_feed=100):
    n = F.col("doc_id")
    published = F.timestamp_seconds(F.lit(derived.BASE_SECONDS) + (n * 37 % 720) * 3600)
    parsed = derived.table(spark, sf, "documents").select(
        F.col("source").alias("feed_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")).alias("feed_url"),
        n.alias("position"), F.concat(F.lit("<b>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</b>")).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://x.example.com/"), n.cast("string"))).alias("link"),
        F.concat(F.lit("g"), n.cast("string")).alias("guid"),
        F.when(n % 3 == 0, F.lit("https://Other.example.org/feed")).alias("source_url"),
        F.when(n % 11 != 0, F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date_text"),
        F.col("lang").alias("language"),
    )
    return corpus.collect_items(parsed, F.lit("2024-01-05 00:00:00").cast("timestamp"), per_feed)


@query("s11_corpus_collection", f"""WITH {_COLLECTED} SELECT feed_id, position, publisher_key, url, md5(title) AS title_digest, {duck.stamp("published_at")} AS published_at
  FROM collected WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY position) <= 20""")
def s11_corpus_collection(spark, sf):
    return _collected(spark, sf, 20).select(
        "feed_id", "position", "publisher_key", "url", F.md5("title").alias("title_digest"),
        derived.stamp("published_at").alias("published_at"),
    )


_IDENT = "publisher_key || '|' || url"
_UNIQUE = f"""{_COLLECTED}, titled AS (SELECT *, sha256({_IDENT}) AS id FROM collected WHERE title <> ''),
  uniq AS (SELECT * FROM titled QUALIFY row_number() OVER (PARTITION BY publisher_key, lower(strip_accents(title)) ORDER BY published_at DESC,
    substr(id, 1, 12), '8' || substr(id, 14, 3)) = 1)"""


@query("w5_distinct_titles", f"WITH {_UNIQUE} SELECT publisher_key, url FROM uniq")
def w5_distinct_titles(spark, sf):
    return corpus.distinct_stories(_collected(spark, sf, None)).select("publisher_key", "url")


@query("w6_balanced_sample", f"""WITH {_UNIQUE}, rounds AS (SELECT *, row_number() OVER (PARTITION BY publisher_key ORDER BY published_at DESC, id) AS round FROM uniq),
  chosen AS (SELECT * FROM rounds WHERE round <= 30 ORDER BY round, publisher_key LIMIT 200)
  SELECT publisher_key, url, round, row_number() OVER (ORDER BY published_at DESC, id) AS rank FROM chosen""")
def w6_balanced_sample(spark, sf):
    sample = corpus.balanced_sample(corpus.distinct_stories(_collected(spark, sf, None)), limit=200)
    return sample.select("publisher_key", "url", "round", "rank")


@query("a20_collection_stats", f"""WITH {_UNIQUE}, rounds AS (SELECT row_number() OVER (PARTITION BY publisher_key ORDER BY published_at DESC, id) AS round FROM uniq)
  SELECT (SELECT count(DISTINCT source) FROM documents) AS n_feeds, (SELECT count(DISTINCT source) FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 10 <> 9) AS ok_feeds,
    (SELECT count(*) FROM uniq) AS unique_items, least(200, (SELECT count(*) FROM rounds WHERE round <= 30)) AS emitted_items""")
def a20_collection_stats(spark, sf):
    fetched = derived.feeds(spark, sf).select("feed_id", F.when(~F.col("enabled"), F.lit("timeout")).alias("error"))
    unique = corpus.distinct_stories(_collected(spark, sf, None))
    return corpus.collection_stats(fetched, unique, corpus.balanced_sample(unique, limit=200))


@query("a19_label_progress", """SELECT count(*) AS rows, count(l.doc_id) AS labelled, count(*) FILTER (WHERE d.doc_id % 7 = 0) AS provisional
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def a19_label_progress(spark, sf):
    rows = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 == 0).alias("provisional"))
    labels = derived.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    return corpus.label_progress(rows, labels)


@query("a19_label_counts", "SELECT 'q' || quality || 't' || toxic AS story, count(*) AS n FROM labels GROUP BY 1")
def a19_label_counts(spark, sf):
    story = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    return corpus.label_counts(derived.table(spark, sf, "labels").select(story.alias("story")))


# --- story views ------------------------------------------------------------------------------

_STORIES = f"""{_BASE}, asg AS (SELECT item_id, published_at, feed_id AS publisher_key, 's' || CASE WHEN item_id % 10 = 0 THEN item_id ELSE item_id % 211 END AS story_id FROM items_base),
  grp AS (SELECT story_id, count(*) AS n_items, count(DISTINCT publisher_key) AS publisher_count, max(published_at) AS newest_at FROM asg GROUP BY story_id),
  useful AS (SELECT * FROM grp WHERE n_items >= 2 AND publisher_count >= 2), mem AS (SELECT asg.* FROM asg JOIN useful USING (story_id)),
  topics AS (SELECT doc_id AS item_id, unnest([' ' || CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '! ',
      regexp_extract(text, '[\\p{{L}}]+') || CASE WHEN doc_id % 3 = 0 THEN '...' ELSE '' END, '?']) AS topic FROM documents),
  labelled AS (SELECT item_id, regexp_replace(trim(topic), '^\\p{{P}}+|\\p{{P}}+$', '', 'g') AS label FROM topics),
  linked AS (SELECT lower(strip_accents(label)) AS key, label, mem.story_id, CASE WHEN mem.story_id IS NULL THEN l.item_id END AS item_id
    FROM labelled l LEFT JOIN mem USING (item_id) WHERE label <> '')"""


def _assignments(spark, sf):
    n = F.col("item_id")
    story = F.concat(F.lit("s"), F.when(n % 10 == 0, n).otherwise(n % 211).cast("string"))
    return derived.items(spark, sf).select("item_id", "published_at", F.col("feed_id").alias("publisher_key"), story.alias("story_id"))


def _story_parts(spark, sf):
    assigned = _assignments(spark, sf)
    shown = story_views.useful(story_views.groups(assigned))
    inside = assigned.join(shown.select("story_id"), "story_id", "left_semi")
    n = F.col("doc_id")
    dots = F.when(n % 3 == 0, F.lit("...")).otherwise(F.lit(""))
    language = F.concat(F.lit(" "), F.when(n % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("! "))
    topics = derived.table(spark, sf, "documents").select(
        n.alias("item_id"),
        F.explode(F.array(language, F.concat(F.regexp_extract("text", r"[\p{L}]+", 0), dots), F.lit("?"))).alias("topic"),
    )
    return topics, inside, story_views.unassigned(assigned, inside)


@query("a13_story_groups", f"{_STORIES} SELECT story_id, n_items, publisher_count, row_number() OVER (ORDER BY newest_at DESC, story_id) AS rank FROM useful")
def a13_story_groups(spark, sf):
    shown = story_views.useful(story_views.groups(_assignments(spark, sf)))
    return story_views.ordered_groups(shown).drop("newest_at")


@query("a13_story_members", f"{_STORIES} SELECT story_id, item_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, item_id) AS position FROM mem")
def a13_story_members(spark, sf):
    assigned = _assignments(spark, sf)
    shown = story_views.useful(story_views.groups(assigned))
    return story_views.members(assigned, shown).drop("published_at")


@query("f12_useful_stories", f"{_STORIES} SELECT story_id FROM useful")
def f12_useful_stories(spark, sf):
    return story_views.useful(story_views.groups(_assignments(spark, sf))).select("story_id")


@query("u2_unassigned_items", f"{_STORIES} SELECT item_id FROM asg WHERE item_id NOT IN (SELECT item_id FROM mem)")
def u2_unassigned_items(spark, sf):
    return _story_parts(spark, sf)[2].select("item_id")


@query("a14_daily_categories", f"""{_STORIES}, spelled AS (SELECT key, label, count(*) AS n FROM linked GROUP BY ALL),
  titles AS (SELECT key, label AS title FROM spelled QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, label) = 1)
  SELECT key, any_value(title) AS title, count(DISTINCT story_id) AS n_stories, count(DISTINCT item_id) AS n_items FROM linked JOIN titles USING (key) GROUP BY key""")
def a14_daily_categories(spark, sf):
    return story_views.categories(*_story_parts(spark, sf))


@query("j12_category_members", f"{_STORIES} SELECT DISTINCT key, story_id, item_id FROM linked")
def j12_category_members(spark, sf):
    return story_views.category_members(*_story_parts(spark, sf))


_RECENT = "published_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31'"


@query("f13_rewindow_groups", f"""{_STORIES} SELECT story_id, count(*) AS n_items, least(any_value(publisher_count), count(*)) AS publisher_count
  FROM mem JOIN useful USING (story_id) WHERE {_RECENT} GROUP BY story_id""")
def f13_rewindow_groups(spark, sf):
    assigned = _assignments(spark, sf)
    shown = story_views.useful(story_views.groups(assigned))
    inside = assigned.join(shown.select("story_id"), "story_id", "left_semi")
    window = F.col("published_at").between(F.lit("2024-01-15").cast("timestamp"), derived.now())
    return story_views.rewindow_groups(shown, story_views.rewindow_members(inside, window))


@query("f13_rewindow_categories", f"""{_STORIES} SELECT DISTINCT key, story_id, item_id FROM linked
  WHERE story_id IN (SELECT story_id FROM mem WHERE {_RECENT}) OR item_id IN (SELECT item_id FROM asg WHERE {_RECENT})""")
def f13_rewindow_categories(spark, sf):
    topics, inside, alone = _story_parts(spark, sf)
    window = F.col("published_at").between(F.lit("2024-01-15").cast("timestamp"), derived.now())
    links = story_views.category_members(topics, inside, alone)
    recent = story_views.rewindow_members(inside, window).select("story_id").distinct()
    return story_views.rewindow_categories(links, recent, alone.filter(window))


@query("t8_coverage_windows", f"""{_STORIES}, w AS (SELECT story_id, publisher_key, unnest(generate_series(date_trunc('hour', published_at) - INTERVAL 71 HOUR, date_trunc('hour', published_at), INTERVAL 1 HOUR)) AS ws FROM asg)
  SELECT story_id, {duck.stamp("ws")} AS window_start, count(DISTINCT publisher_key) AS publisher_count FROM w GROUP BY story_id, ws""")
def t8_coverage_windows(spark, sf):
    return story_views.coverage_windows(_assignments(spark, sf)).withColumn("window_start", derived.stamp("window_start"))


@query("t9_weekly_cleanup", f"""{_BASE} SELECT {duck.stamp("time_bucket(INTERVAL 7 DAY, published_at, TIMESTAMP '1970-01-01')")} AS week_start, sum(item_id % 5) AS cleaned FROM items_base GROUP BY 1""")
def t9_weekly_cleanup(spark, sf):
    from newsloom.streaming.windows import weekly_cleanup

    ledger = derived.items(spark, sf).select(F.col("published_at").alias("cleaned_at"), (F.col("item_id") % 5).alias("n"))
    return weekly_cleanup(ledger).withColumn("week_start", derived.stamp("week_start"))


_ATEXT = f"array_to_string(list_filter([trim(title), {duck.sub('coalesce(summary, chr(32))', '^[[:space:]]+|[[:space:]]+$', '')}, {duck.sub('body_text', '^[[:space:]]+|[[:space:]]+$', '')}], lambda p: p <> ''), chr(10) || chr(10))"


@query("f16_text_readiness", f"""{_BASE} SELECT item_id, CASE WHEN n < 8 THEN 'insufficientText' WHEN item_id % 12 = 0 THEN 'unsupportedLanguage'
    WHEN language IN ('en', 'fr') THEN 'ready' ELSE 'translationNotInstalled' END AS readiness FROM (
  SELECT item_id, language, {duck.words(duck.squash("left(t, 12000)"))} AS n FROM (SELECT item_id, language, CASE WHEN item_id % 5 = 0 THEN title ELSE {_ATEXT} END AS t FROM items_base))""")
def f16_text_readiness(spark, sf):
    short = F.when(F.col("item_id") % 5 != 0, F.coalesce("summary", F.lit(" ")))
    body = F.when(F.col("item_id") % 5 != 0, F.col("body_text"))
    t = story_views.analysis_text(F.col("title"), short, body)
    language = F.when(F.col("item_id") % 12 != 0, F.col("language"))
    state = story_views.readiness(text.count_words(t), language, "en", F.col("language") == "fr")
    return derived.items(spark, sf).select("item_id", state.alias("readiness"))


_ASSIGN = f"""{_BASE}, run AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'insufficientText' WHEN 1 THEN 'translationNotInstalled' WHEN 2 THEN 'unsupportedLanguage' ELSE 'ready' END AS readiness,
  {duck.words(duck.squash("body_text"))} AS body_words, item_id % 5 = 0 AS has_digest FROM items_base)"""


@query("a15_readiness_metrics", f"""{_ASSIGN} SELECT count(*) AS analyzed, count(*) FILTER (WHERE readiness = 'ready') AS ready, count(*) FILTER (WHERE body_words >= 120) AS with_body,
  count(*) FILTER (WHERE has_digest) AS enriched, count(*) FILTER (WHERE readiness = 'translationNotInstalled') AS waiting_for_translation,
  count(*) FILTER (WHERE readiness = 'unsupportedLanguage') AS unsupported_language, count(*) FILTER (WHERE readiness = 'insufficientText') AS other_failures FROM run""")
def a15_readiness_metrics(spark, sf):
    n = F.col("item_id") % 6
    state = (
        F.when(n == 0, "insufficientText").when(n == 1, "translationNotInstalled")
        .when(n == 2, "unsupportedLanguage").otherwise("ready")
    )
    run = derived.items(spark, sf).select(
        state.alias("readiness"), F.when(state == "ready", F.lit("s")).alias("story_id"),
        text.count_words(F.col("body_text")).alias("body_words"), (F.col("item_id") % 5 == 0).alias("has_digest"),
    )
    return story_views.readiness_metrics(run)


@query("c28_analysis_text", f"{_BASE} SELECT item_id, md5(left(t, 12000)) AS digest, length(left(t, 12000)) AS chars FROM (SELECT item_id, {_ATEXT} AS t FROM items_base)")
def c28_analysis_text(spark, sf):
    t = story_views.analysis_text(F.col("title"), F.coalesce("summary", F.lit(" ")), F.col("body_text"))
    return derived.items(spark, sf).select("item_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


_TB = duck.sub("body_text", r"^[\s]+|[\s]+$", "")


@query("c29_analysis_context", f"""{_BASE}, s AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN title ELSE {_TB} END AS src, 'Digest ' || trim(title) || chr(10) || 'point one' AS dig,
    item_id % 3 = 0 AS same FROM items_base)
  SELECT item_id, md5(c) AS digest, length(c) AS chars FROM (SELECT item_id, CASE WHEN same THEN left(src, 3400) || chr(10) || chr(10) ||
    left(dig, CAST(least(600, greatest(0, 3998 - length(left(src, 3400)))) AS BIGINT)) ELSE left(src, 4000) END AS c FROM s)""")
def c29_analysis_context(spark, sf):
    body = F.when(F.col("item_id") % 4 != 0, F.col("body_text"))
    c = story_views.analysis_context(
        F.col("title"), F.lit(" "), body, F.concat(F.lit("Digest "), "title"), F.array(F.lit("point one"), F.lit(" ")),
        F.col("item_id") % 3 == 0,
    )
    return derived.items(spark, sf).select("item_id", F.md5(c).alias("digest"), F.length(c).alias("chars"))


_EX = "array_to_string(block_texts, chr(10))"
_CW = duck.words("c")
_EWORDS = duck.words(duck.squash("e"))


@query("c30_preferred_body", f"""{_BASE}, s AS (SELECT item_id, nullif({duck.sub(_EX, "^[[:space:]]+|[[:space:]]+$", "")}, '') AS e, {duck.strip_tags("content")} AS c FROM items_base)
  SELECT item_id, md5(b) AS digest, words FROM (SELECT item_id, CASE WHEN {_EWORDS} >= 120 THEN e WHEN {_CW} >= 120 THEN c ELSE coalesce(e, nullif(c, '')) END AS b,
    CASE WHEN {_EWORDS} >= 120 THEN {_EWORDS} WHEN coalesce({_CW}, 0) >= 120 THEN {_CW} ELSE coalesce({_EWORDS}, {_CW}, 0) END AS words FROM s)""")
def c30_preferred_body(spark, sf):
    extracted = F.array_join("block_texts", "\n")
    return derived.items(spark, sf).select(
        "item_id", F.md5(story_views.preferred_body(extracted, F.col("content"))).alias("digest"),
        story_views.body_words(extracted, F.col("content")).alias("words"),
    )
