"""Queries of story clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed, text, vectors
from newsloom.operators import curate, library, related, similarity, stories, story_views
from newsloom.operators.ranking import top_k
from newsloom.plans import derived, duck
from newsloom.plans.curation import _WALK
from newsloom.plans.registry import query
from newsloom.plans.scalars import _DOT, _LEN, _PAIRED, _VEC, _paired

HOUR = 3_600
WINDOW = 72 * HOUR
THRESHOLD = 0.6


@query("j5_related_titles", f"""{_WALK}, pk AS (SELECT p.reader_id, p.item_id AS pick_id, toks AS ptoks, ts AS pts, source_key AS psource FROM picks p JOIN ranked r ON r.reader_id = p.reader_id AND r.item_id = p.item_id),
  pairs AS (SELECT r.reader_id, r.item_id, pick_id, toks, ptoks, source_key, psource, len(list_intersect(toks, ptoks)) AS shared FROM ranked r JOIN pk USING (reader_id)
    WHERE r.item_id <> pick_id AND len(toks) >= 3 AND len(ptoks) >= 3 AND abs(epoch(ts) - epoch(pts)) <= 172800)
  SELECT reader_id, item_id, pick_id, round(shared / (len(toks) + len(ptoks) - shared), 6) AS similarity,
    source_key <> psource AND len(toks) >= 4 AND len(ptoks) >= 4 AND shared / (len(toks) + len(ptoks) - shared) >= 0.65 AS duplicate
  FROM pairs WHERE shared >= 3 AND shared / (len(toks) + len(ptoks) - shared) >= 0.3""")
def j5_related_titles(spark, sf):
    items = derived.items(spark, sf)
    run = curate.prepared(items, derived.now())
    found = related.related_to_picks(curate.of_run(run), curate.curated_picks(items, derived.now(), run=run))
    return found.withColumn("similarity", F.round("similarity", 6))


def _at(factor: int):
    return F.timestamp_seconds(F.lit(derived.BASE_SECONDS) + (F.col("vec_id") * factor % 720) * HOUR)


def _at_sql(factor: int, ident: str = "vec_id") -> str:
    return f"make_timestamp(({derived.BASE_SECONDS} + ({ident} * {factor} % 720) * 3600) * 1000000)"


def _story_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Stories are the vectors themselves; items blend each vector with its successor."""
    paired = _paired(spark, sf)
    items = paired.select(
        F.lit(0).alias("corpus_id"), F.col("vec_id").alias("left_id"),
        vectors.blend(F.col("a"), F.col("b")).alias("vector"), _at(53).alias("left_at"),
    )
    existing = derived.table(spark, sf, "embeddings").select(
        F.lit(0).alias("corpus_id"), F.col("vec_id").alias("right_id"),
        F.col("embedding").cast("array<double>").alias("vector"), _at(37).alias("right_at"),
    )
    return items, existing


_COSINES = f"""WITH {_PAIRED}, its AS (SELECT vec_id AS left_id, list_transform(list_zip(a, b), lambda z: z[1] * 0.4 + z[2] * 0.6) AS v, {_at_sql(53)} AS left_at FROM paired),
  sts AS (SELECT vec_id AS right_id, {_VEC} AS w, {_at_sql(37)} AS right_at FROM embeddings),
  cs AS (SELECT left_id, right_id, list_cosine_similarity(v, w) AS similarity FROM its JOIN sts ON right_at <= left_at AND left_at - right_at <= INTERVAL 72 HOUR)"""


@query("j6_story_candidates", f"{_COSINES} SELECT left_id, right_id, round(similarity, 6) AS similarity FROM cs WHERE similarity >= 0.2")
def j6_story_candidates(spark, sf):
    items, existing = _story_sides(spark, sf)
    return similarity.story_candidates(items, existing, WINDOW, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("w8_nearest_candidates", f"""{_COSINES} SELECT left_id, right_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY left_id ORDER BY round(similarity, 6) DESC, right_id) AS rank FROM cs
  QUALIFY rank <= 10""")
def w8_nearest_candidates(spark, sf):
    items, existing = _story_sides(spark, sf)
    pairs = similarity.nearest_stories(items, existing, WINDOW, 10)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("k6_story_graph", f"""WITH RECURSIVE {_PAIRED}, pts AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: z[1] * 0.4 + z[2] * 0.6) AS v, {_at_sql(7)} AS ts FROM paired),
  near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM pts x JOIN pts y ON y.ts <= x.ts AND x.ts - y.ts <= INTERVAL 72 HOUR AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.4),
  edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
  reach AS (SELECT vec_id AS node, vec_id AS comp FROM pts UNION SELECT e.b, r.comp FROM reach r JOIN edges e ON e.a = r.node)
  SELECT node AS vec_id, min(comp) AS story FROM reach GROUP BY node""")
def k6_story_graph(spark, sf):
    """Stories as components of the similarity graph: the variant without an order of arrival."""
    points = _paired(spark, sf).select(
        F.lit(0).alias("corpus_id"), "vec_id", vectors.blend(F.col("a"), F.col("b")).alias("vector"), _at(7).alias("at")
    )
    return similarity.story_graph(points, "vec_id", WINDOW, 0.4).select(F.col("node").alias("vec_id"), F.col("component").alias("story"))


def _corpus(spark, sf) -> DataFrame:
    """Clustering input with planted stories: five neighbours share the body vector of their anchor."""
    n = F.col("vec_id")
    own = derived.table(spark, sf, "embeddings").select(n, F.col("embedding").cast("array<double>").alias("headline"))
    anchors = own.groupBy(F.floor(n / 5).alias("anchor")).agg(F.min_by("headline", n).alias("body"))
    rows = own.withColumn("anchor", F.floor(n / 5)).join(anchors, "anchor").select(
        (F.col("anchor") % 4).alias("corpus_id"), n.alias("item_id"),
        _at(7).alias("published_at"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("publisher_key"),
        "headline", F.when(n % 11 != 0, F.col("body")).alias("body"),
        F.when(n % 4 == 0, F.array(F.lit("approve"))).when(n % 4 == 1, F.array(F.lit("reject"))).otherwise(F.expr("cast(array() as array<string>)")).alias("actions"),
        F.when(n % 3 == 1, F.col("body")).when(n % 6 == 2, F.col("headline")).alias("signature"),
        F.when(n % 4 == 3, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("a"), (n % 4).cast("string")), F.concat(F.lit("a"), (n % 2).cast("string")))).alias("actors"),
    )
    return stories.with_vectors(rows)


def _folded_sql(threshold: float, window: int, slack: float = 0.055, override: float = 0.985, signature: float = 0.86) -> str:
    """Common tables over ``its`` (corpus_id, item_id, at_s, pub, h, b, c, acts, sig, actors): the sequential loop, one item a step.

    ``folded`` has a row per item with its story and the ``seen`` stories, nearest first.
    """
    story = "STRUCT(story_id VARCHAR, at_s BIGINT, n BIGINT, h DOUBLE[], b DOUBLE[], c DOUBLE[], rep DOUBLE[], acts VARCHAR[], sig DOUBLE[], actors VARCHAR[], recent DOUBLE[][], pubs VARCHAR[])"
    seen = "STRUCT(o DOUBLE, k BIGINT, story_id VARCHAR, cen DOUBLE, hea DOUBLE, bod DOUBLE, rep DOUBLE, rec DOUBLE, sig DOUBLE, overlap BOOLEAN, compatible BOOLEAN, decision VARCHAR)"
    cos = lambda a, b: f"list_cosine_similarity({a}, {b})"
    mean = lambda x: f"list_transform(list_zip(best.{x}, {x}), lambda z: (z[1] * best.n + z[2]) / (best.n + 1))"
    fresh = "{'story_id': 'story-' || item_id, 'at_s': at_s, 'n': 1, 'h': h, 'b': b, 'c': c, 'rep': c, 'acts': acts, 'sig': sig, 'actors': actors, 'recent': [c], 'pubs': [pub]}"
    grown = f"""{{'story_id': best.story_id, 'at_s': at_s, 'n': best.n + 1, 'h': {mean("h")}, 'b': CASE WHEN b IS NULL THEN best.b WHEN best.b IS NULL THEN b ELSE {mean("b")} END,
        'c': {mean("c")}, 'rep': best.rep, 'acts': best.acts, 'sig': best.sig, 'actors': best.actors, 'recent': list_append(best.recent, c)[-12:], 'pubs': list_distinct(list_append(best.pubs, pub))}}"""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY at_s, item_id) AS p FROM its),
  folded AS (
    SELECT corpus_id, 0::BIGINT AS p, []::{story}[] AS st, NULL::BIGINT AS item_id, NULL::VARCHAR AS story_id, NULL::DOUBLE AS similarity, NULL::INT AS publisher_count, []::{seen}[] AS seen FROM (SELECT DISTINCT corpus_id FROM its)
    UNION ALL
    SELECT corpus_id, p, CASE WHEN hit IS NULL THEN list_append(st, now) ELSE list_transform(st, lambda s, k: CASE WHEN k = hit THEN now ELSE s END) END,
      item_id, now.story_id, CASE WHEN hit IS NULL THEN list_max(list_transform(met, lambda m: m.cen)) ELSE met[hit].cen END, len(now.pubs)::INT, list_sort(met)
    FROM (SELECT *, CASE WHEN hit IS NULL THEN {fresh} ELSE {grown} END AS now
      FROM (SELECT *, st[hit] AS best FROM (SELECT *, list_position(list_transform(met, lambda m: CASE WHEN m.decision = 'accepted' THEN m.cen ELSE -9 END), list_max(list_transform(list_filter(met, lambda m: m.decision = 'accepted'), lambda m: m.cen))) AS hit
        FROM (SELECT * EXCLUDE pre, list_transform(pre, lambda m: {{'o': -round(m.cen, 6), 'k': m.k, 'story_id': m.story_id, 'cen': m.cen, 'hea': m.hea, 'bod': m.bod, 'rep': m.rep, 'rec': m.rec, 'sig': m.sig, 'overlap': m.overlap, 'compatible': NOT m.clash OR m.rep >= {override},
            'decision': CASE WHEN m.cen < {threshold} THEN 'rejectedCentroidSimilarity' WHEN m.sig < {signature} THEN 'rejectedEventSignatureMismatch' WHEN m.clash AND m.rep < {override} THEN 'rejectedActionMismatch'
              WHEN m.rep < {threshold - slack!r} THEN 'rejectedRepresentativeSimilarity' WHEN m.rec < {threshold - slack!r} THEN 'rejectedRecentMemberSupport' ELSE 'accepted' END}}) AS met
          FROM (SELECT *, list_transform(st, lambda s, k: {{'k': k, 'story_id': s.story_id, 'cen': {cos("s.c", "c")}, 'hea': {cos("s.h", "h")}, 'bod': {cos("s.b", "b")}, 'rep': {cos("s.rep", "c")},
              'rec': list_avg(list_transform(s.recent[-3:], lambda r: {cos("r", "c")})), 'sig': {cos("s.sig", "sig")}, 'overlap': CASE WHEN len(actors) > 0 AND len(s.actors) > 0 THEN list_has_any(actors, s.actors) END, 'clash': len(acts) > 0 AND len(s.acts) > 0 AND NOT list_has_any(acts, s.acts)}}) AS pre
            FROM (SELECT i.*, list_filter(f.st, lambda s: i.at_s - s.at_s <= {window}) AS st FROM folded f JOIN ordered i ON i.corpus_id = f.corpus_id AND i.p = f.p + 1)))))))"""


_CORPUS_SQL = f"""own AS (SELECT vec_id, {_VEC} AS v FROM embeddings), anchors AS (SELECT vec_id // 5 AS anchor, arg_min(v, vec_id) AS body FROM own GROUP BY ALL),
  u AS (SELECT vec_id, vec_id // 5 % 4 AS corpus_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS h,
    CASE WHEN vec_id % 11 <> 0 THEN list_transform(body, lambda x: x / sqrt(list_sum(list_transform(body, lambda y: y * y)))) END AS b, v AS raw, body AS raw_body FROM own JOIN anchors ON anchor = vec_id // 5),
  its AS (SELECT corpus_id, vec_id AS item_id, {derived.BASE_SECONDS} + (vec_id * 7 % 720) * 3600 AS at_s, 'p' || vec_id % 3 AS pub, h, b, CASE WHEN b IS NULL THEN h ELSE list_transform(list_zip(h, b), lambda z: z[1] * 0.4 + z[2] * 0.6) END AS c,
    CASE vec_id % 4 WHEN 0 THEN ['approve'] WHEN 1 THEN ['reject'] ELSE []::VARCHAR[] END AS acts,
    CASE WHEN vec_id % 3 = 1 THEN raw_body WHEN vec_id % 6 = 2 THEN raw END AS sig, CASE WHEN vec_id % 4 = 3 THEN []::VARCHAR[] ELSE ['a' || vec_id % 4, 'a' || vec_id % 2] END AS actors FROM u)"""
ASSIGNED_SQL = f"""WITH RECURSIVE {_CORPUS_SQL}, {_folded_sql(THRESHOLD, WINDOW)}"""


@query("k1_story_assignments", f"{ASSIGNED_SQL} SELECT item_id, story_id, round(similarity, 6) AS similarity, publisher_count FROM folded WHERE p > 0")
def k1_story_assignments(spark, sf):
    assigned = stories.assign_stories(_corpus(spark, sf), THRESHOLD, WINDOW)
    return assigned.select("item_id", "story_id", F.round("similarity", 6).alias("similarity"), "publisher_count")


@query("k3_story_diagnostics", f"""{ASSIGNED_SQL}, shown AS (SELECT item_id, story_id AS own, unnest(seen) AS m, unnest(range(len(seen))) AS r FROM folded WHERE p > 0)
  SELECT item_id, CASE WHEN r < 10 THEN r ELSE 10 END::INT AS position, m.story_id AS candidate_id, round(m.cen, 6) AS centroid, round(m.hea, 6) AS headline, round(m.bod, 6) AS body, round(m.rep, 6) AS representative,
    round(m.rec, 6) AS recent, round(m.sig, 6) AS signature, m.overlap AS actor_overlap, m.compatible AS actions_compatible, m.decision, m.story_id = own AS selected FROM shown WHERE r < 10 OR m.story_id = own""")
def k3_story_diagnostics(spark, sf):
    found = stories.diagnostics(_corpus(spark, sf), THRESHOLD, WINDOW)
    numbers = ["centroid", "headline", "body", "representative", "recent", "signature"]
    return found.select(*[F.round(c, 6).alias(c) if c in numbers else F.col(c) for c in found.columns])


@query("k2_candidate_evaluation", f"""WITH {_PAIRED}, e AS (SELECT vec_id, {_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}) AS c FROM paired)
  SELECT vec_id, round(c, 6) AS centroid, 1.0 AS representative, round((1 + 2 * c) / 3, 6) AS recent,
    CASE WHEN c < 0.1 THEN 'rejectedCentroidSimilarity' WHEN vec_id % 2 = 0 AND c < 0.86 THEN 'rejectedEventSignatureMismatch'
      WHEN (1 + 2 * c) / 3 < 0.045 THEN 'rejectedRecentMemberSupport' ELSE 'accepted' END AS decision FROM e""")
def k2_candidate_evaluation(spark, sf):
    a, b = F.col("a"), F.col("b")
    none = F.lit(None).cast("array<double>")
    pairs = _paired(spark, sf).select(
        "vec_id", a.alias("i_headline"), none.alias("i_body"), a.alias("i_combined"), F.array(F.lit("approve")).alias("i_actions"),
        b.alias("s_headline"), none.alias("s_body"), b.alias("s_combined"), a.alias("s_representative"),
        F.array(a, a, b, b, a).alias("s_recent"), F.array(F.lit("reject")).alias("s_actions"),
        F.when(F.col("vec_id") % 2 == 0, a).alias("i_signature"), b.alias("s_signature"),
    )
    found = stories.evaluate_pairs(pairs, 0.1)
    return found.select("vec_id", F.round("centroid", 6).alias("centroid"), F.round("representative", 6).alias("representative"), F.round("recent", 6).alias("recent"), "decision")


def _run(spark, sf) -> DataFrame:
    """Items with vectors where there are any, and their readiness."""
    vecs = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("headline"))
    words = text.count_words(F.col("body_text"))
    language = F.when(F.col("item_id") % 12 != 0, F.col("language"))
    rows = derived.items(spark, sf).select(
        F.col("reader_id").alias("corpus_id"), "item_id", "published_at", F.col("feed_id").alias("publisher_key"), "language", "title",
        story_views.readiness(words, language, "en", F.col("language") == "fr").alias("readiness"), words.alias("body_words"),
    )
    joined = rows.join(vecs, "item_id", "left").withColumn("body", F.col("headline"))
    return stories.with_vectors(joined).withColumn("actions", F.expr("cast(array() as array<string>)"))


def _run_sql(threshold: float, window: int, recent: str = "true") -> str:
    """Common tables: ``r`` with every item's readiness and ``folded`` with the assignment of the ready ones."""
    return f"""WITH RECURSIVE {duck.ITEMS_BASE}, r AS (SELECT item_id, reader_id, feed_id, published_at, CASE WHEN {duck.words(duck.squash("body_text"))} < 8 THEN 'insufficientText' WHEN item_id % 12 = 0 THEN 'unsupportedLanguage'
    WHEN language IN ('en', 'fr') THEN 'ready' ELSE 'translationNotInstalled' END AS readiness, vec_id, {_VEC} AS v FROM items_base LEFT JOIN embeddings ON vec_id = item_id WHERE {recent}),
  its AS (SELECT reader_id AS corpus_id, item_id, epoch(published_at)::BIGINT AS at_s, feed_id AS pub, h, h AS b, list_transform(list_zip(h, h), lambda z: z[1] * 0.4 + z[2] * 0.6) AS c, []::VARCHAR[] AS acts, NULL::DOUBLE[] AS sig, []::VARCHAR[] AS actors
    FROM (SELECT *, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS h FROM r WHERE readiness = 'ready' AND vec_id IS NOT NULL)), {_folded_sql(threshold, window)}"""


@query("k4_unready_rows", f"""{_run_sql(0.82, WINDOW)}
  SELECT r.item_id, CASE WHEN readiness = 'ready' AND vec_id IS NULL THEN 'embeddingUnavailable' ELSE readiness END AS readiness, f.story_id, coalesce(f.publisher_count, 0) AS publisher_count
  FROM r LEFT JOIN (SELECT * FROM folded WHERE p > 0) f USING (item_id)""")
def k4_unready_rows(spark, sf):
    return stories.assignments(_run(spark, sf), 0.82, WINDOW).select("item_id", "readiness", "story_id", "publisher_count")


@query("k5_story_preview", f"""{_run_sql(0.2, 48 * HOUR, f"published_at BETWEEN date_trunc('day', {duck.NOW}) - INTERVAL 1 DAY AND {duck.NOW}")},
  placed AS (SELECT f.story_id, item_id, published_at, feed_id FROM folded f JOIN r USING (item_id) WHERE p > 0),
  shown AS (SELECT story_id FROM placed GROUP BY story_id HAVING count(*) >= 2 AND count(DISTINCT feed_id) >= 2)
  SELECT story_id, item_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, item_id) AS position FROM placed SEMI JOIN shown USING (story_id)
  UNION ALL SELECT NULL, item_id, NULL FROM r WHERE item_id NOT IN (SELECT item_id FROM placed SEMI JOIN shown USING (story_id))""")
def k5_story_preview(spark, sf):
    """The daily preview: recent items, assignment, useful stories and what stays outside them."""
    run = _run(spark, sf).filter(library.recent_window(F.col("published_at"), derived.now()))
    assigned = stories.assignments(run, 0.2, 48 * HOUR).filter("story_id is not null")
    shown = story_views.useful(story_views.groups(assigned))
    inside = story_views.members(assigned, shown)
    outside = story_views.unassigned(run.select("item_id"), inside)
    return inside.select("story_id", "item_id", "position").unionByName(
        outside.select(F.lit(None).cast("string").alias("story_id"), "item_id", F.lit(None).cast("bigint").alias("position"))
    )


@query("k6_story_shards", f"""WITH RECURSIVE {_CORPUS_SQL}, edges AS (SELECT a.item_id AS x, b.item_id AS y FROM its a JOIN its b ON a.corpus_id = b.corpus_id AND a.item_id <> b.item_id AND list_cosine_similarity(a.c, b.c) >= {THRESHOLD} - 0.055),
  reach AS (SELECT item_id AS node, item_id AS comp FROM its UNION SELECT y, comp FROM reach JOIN edges ON x = node), least_of AS (SELECT node, min(comp) AS comp FROM reach GROUP BY node)
  SELECT node AS item_id, comp AS shard, count(*) OVER (PARTITION BY comp) AS n FROM least_of""")
def k6_story_shards(spark, sf):
    """What story assignment is split by: components of everything similar, whatever its time, and their sizes."""
    graph = similarity.story_graph(_corpus(spark, sf).withColumnRenamed("combined", "vector"), "item_id", None, THRESHOLD - fixed.COHESION_SLACK)
    sizes = graph.groupBy("component").agg(F.count("*").alias("n"))
    return graph.join(sizes, "component").select(F.col("node").alias("item_id"), F.col("component").alias("shard"), "n")


_MEMBERS = f"members AS (SELECT 's' || label AS story_id, vec_id AS item_id, {_at_sql(7)} AS ts, {_VEC} AS v FROM embeddings)"


def _members(spark, sf) -> DataFrame:
    return derived.table(spark, sf, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("story_id"), F.col("vec_id").alias("item_id"), _at(7).alias("published_at"),
        F.col("embedding").cast("array<double>").alias("combined"),
    )


@query("a16_mean_pooled", f"""WITH {_MEMBERS}, d AS (SELECT story_id, unnest(range(len(v))) AS dim, unnest(v) AS x FROM members)
  SELECT story_id, dim, round(avg(x), 6) AS x FROM d GROUP BY ALL""")
def a16_mean_pooled(spark, sf):
    pooled = stories.mean_pooled(_members(spark, sf), ["story_id"], "combined")
    return pooled.select("story_id", F.posexplode("vector").alias("dim", "x")).select("story_id", "dim", F.round("x", 6).alias("x"))


@query("a17_running_centroids", f"""WITH {_MEMBERS}, d AS (SELECT story_id, item_id, ts, unnest(range(len(v))) AS dim, unnest(v) AS x FROM members)
  SELECT story_id, item_id, dim, row_number() OVER w AS position, round(avg(x) OVER w, 6) AS x FROM d WINDOW w AS (PARTITION BY story_id, dim ORDER BY ts, item_id ROWS UNBOUNDED PRECEDING)""")
def a17_running_centroids(spark, sf):
    return stories.running_centroids(_members(spark, sf)).select("story_id", "item_id", "position", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("a17_running_mean_step", f"""WITH {_PAIRED}, d AS (SELECT vec_id, unnest(range(len(a))) AS dim, unnest(a) AS x, unnest(b) AS y FROM paired)
  SELECT vec_id, dim, round(CASE WHEN vec_id % 4 = 0 THEN y ELSE (x * (vec_id % 4) + y) / (vec_id % 4 + 1) END, 6) AS x FROM d""")
def a17_running_mean_step(spark, sf):
    mean = vectors.running_mean(F.col("a"), F.col("b"), F.col("vec_id") % 4)
    return _paired(spark, sf).select("vec_id", F.posexplode(mean).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query("w7_recent_support", f"""WITH {_MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY ts, item_id) AS position FROM members)
  SELECT a.story_id, a.item_id, a.position, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS recent_support FROM r a JOIN r b ON a.story_id = b.story_id AND b.position BETWEEN a.position - 3 AND a.position - 1 GROUP BY ALL""")
def w7_recent_support(spark, sf):
    return stories.recent_support(_members(spark, sf)).withColumn("recent_support", F.round("recent_support", 6))
