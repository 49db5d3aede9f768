"""Queries over text, link, date and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, fixed, rules, text, urls, vectors
from newsloom.plans import derived, duck
from newsloom.plans.registry import query

_BASE = f"WITH {duck.ITEMS_BASE}"
_ITEMS = f"WITH {duck.ITEMS}"


@query("c1_strip_tags", f"""{_BASE} SELECT item_id, md5(t) AS digest, length(t) AS chars, left(t, 60) AS head
FROM (SELECT item_id, {duck.strip_tags("content")} AS t FROM items_base)""")
def c1_strip_tags(spark, sf):
    out = derived.items(spark, sf).select("item_id", text.strip_tags(F.col("content")).alias("t"))
    return out.select("item_id", F.md5("t").alias("digest"), F.length("t").alias("chars"), F.substring("t", 1, 60).alias("head"))


@query("c1_strip_tags_pages", f"""SELECT page_id, md5(t) AS digest, length(t) AS chars
FROM (SELECT page_id, {duck.strip_tags("html")} AS t FROM pages)""")
def c1_strip_tags_pages(spark, sf):
    out = derived.table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query("c2_paragraphs", f"""{_BASE} SELECT item_id, n AS position, md5(p[n]) AS digest, length(p[n]) AS chars FROM (
  SELECT item_id, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT item_id, {duck.paragraphs("content")} AS p FROM items_base))""")
def c2_paragraphs(spark, sf):
    out = derived.items(spark, sf).select("item_id", F.posexplode(text.paragraphs(F.col("content"))).alias("n", "p"))
    return out.select(
        "item_id", (F.col("n") + 1).alias("position"), F.md5("p").alias("digest"), F.length("p").alias("chars")
    )


@query("c3_squash", f"""SELECT doc_id, md5({duck.squash("text")}) AS digest, {duck.words(duck.squash("text"))} AS words FROM documents""")
def c3_squash(spark, sf):
    flat = text.squash(F.col("text"))
    return derived.table(spark, sf, "documents").select(
        "doc_id", F.md5(flat).alias("digest"), text.count_words(F.col("text")).alias("words")
    )


_GLUED = "replace(text, '. ', '.')"


@query("c4_sentence_spacing", f"""SELECT doc_id, md5({duck.spaced(_GLUED)}) AS digest,
  length({duck.spaced(_GLUED)}) - length({_GLUED}) AS restored FROM documents""")
def c4_sentence_spacing(spark, sf):
    glued = F.replace("text", F.lit(". "), F.lit("."))
    fixed_text = text.space_sentences(glued)
    return derived.table(spark, sf, "documents").select(
        "doc_id", F.md5(fixed_text).alias("digest"), (F.length(fixed_text) - F.length(glued)).alias("restored")
    )


_ENTITIES = " &amp;lt; &#233;&#x1F600; &bogus; &NBSP;|&hellip;&#55300;&#99999999999;&shy;&Quot; "


@query("c5_decode_entities", f"""SELECT doc_id, md5(t) AS digest, length(t) AS chars, right(t, 60) AS tail FROM (
  SELECT doc_id, {duck.decode("s")} AS t FROM (SELECT doc_id, text || {duck.lit(_ENTITIES)} || doc_id AS s FROM documents))""")
def c5_decode_entities(spark, sf):
    s = F.concat("text", F.lit(_ENTITIES), F.col("doc_id").cast("string"))
    out = derived.table(spark, sf, "documents").select("doc_id", text.decode_entities(s).alias("t"))
    return out.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"), F.right("t", F.lit(60)).alias("tail"))


@query("c6_snippet", f"{_ITEMS} SELECT item_id, snippet FROM items")
def c6_snippet(spark, sf):
    return derived.items(spark, sf).select("item_id", "snippet")


_BLOCK_WORDS = duck.words(duck.squash("array_to_string(block_texts, ' ')"))


@query("c7_reading_minutes", f"""{_ITEMS} SELECT item_id, reading_minutes,
  CASE WHEN has_full_text THEN CAST(greatest(1, ceil({_BLOCK_WORDS} / 220.0)) AS INTEGER) END AS extracted_minutes FROM items""")
def c7_reading_minutes(spark, sf):
    extracted = text.minutes_for_words(text.count_words(F.array_join("block_texts", " ")))
    return derived.items(spark, sf).select(
        "item_id", "reading_minutes", F.when(F.col("has_full_text"), extracted).alias("extracted_minutes")
    )


_FEED_TEXT = duck.strip_tags("coalesce(content, summary, '')")


@query("c8_feed_word_count", f"""{_BASE} SELECT item_id, n AS feed_words, n >= 300 AS substantial,
  NOT has_full_text AND n < 300 AS excerpt FROM (SELECT item_id, has_full_text, {duck.words("t")} AS n
  FROM (SELECT item_id, has_full_text, {_FEED_TEXT} AS t FROM items_base))""")
def c8_feed_word_count(spark, sf):
    out = derived.items(spark, sf).select(
        "item_id", "has_full_text", text.feed_word_count(F.col("content"), F.col("summary")).alias("feed_words")
    )
    return out.select(
        "item_id", "feed_words", (F.col("feed_words") >= 300).alias("substantial"),
        (~F.col("has_full_text") & (F.col("feed_words") < 300)).alias("excerpt"),
    )


@query("c9_dedupe_key", f"""{_BASE} SELECT item_id, CASE WHEN trim(guid) <> '' THEN 'guid:' || guid
  WHEN trim(link) <> '' THEN 'link:' || link
  ELSE 'fallback:' || feed_id || ':' || title || ':' || CAST(epoch(published_at) AS BIGINT) END AS dedupe_key FROM items_base""")
def c9_dedupe_key(spark, sf):
    c = F.col
    return derived.items(spark, sf).select(
        "item_id", urls.dedupe_key(c("guid"), c("link"), c("feed_id"), c("title"), c("published_at")).alias("dedupe_key")
    )


@query("c10_source_key", f"""{_BASE} SELECT item_id,
  coalesce(CASE WHEN item_id % 2 = 0 THEN feed_id END, {duck.host("upper(link)")}, lower(author), 'unknown') AS source_key
  FROM items_base""")
def c10_source_key(spark, sf):
    feed = F.when(F.col("item_id") % 2 == 0, F.col("feed_id"))
    return derived.items(spark, sf).select(
        "item_id", urls.source_key(feed, F.upper("link"), F.col("author")).alias("source_key")
    )


@query("c11_publisher_key", f"""WITH {duck.FEEDS} SELECT feed_id,
  coalesce(regexp_replace({duck.host("coalesce(site_url, url)")}, '^www\\.', ''), 'unknown-publisher-' || feed_id) AS publisher_key,
  'unknown-publisher-' || feed_id AS orphan_key FROM feeds""")
def c11_publisher_key(spark, sf):
    c = F.col
    none = F.lit(None).cast("string")
    return derived.feeds(spark, sf).select(
        "feed_id", urls.publisher_key(c("site_url"), c("url"), c("feed_id")).alias("publisher_key"),
        urls.publisher_key(none, none, c("feed_id")).alias("orphan_key"),
    )


@query("c12_normalize_title", f"{_BASE} SELECT item_id, {duck.normalize_title('title')} AS title_key FROM items_base")
def c12_normalize_title(spark, sf):
    return derived.items(spark, sf).select("item_id", text.normalize_title(F.col("title")).alias("title_key"))


@query("c13_title_tokens", f"""{_BASE} SELECT item_id, array_to_string(list_sort(t), ' ') AS tokens, len(t) AS n_tokens
  FROM (SELECT item_id, {duck.tokens("title")} AS t FROM items_base)""")
def c13_title_tokens(spark, sf):
    out = derived.items(spark, sf).select("item_id", text.title_tokens(F.col("title")).alias("t"))
    return out.select("item_id", F.array_join(F.sort_array("t"), " ").alias("tokens"), F.size("t").alias("n_tokens"))


@query("c14_title_similarity", f"""{_BASE} SELECT item_id, CASE WHEN s >= 3 THEN round(s / (len(a) + len(b) - s), 6) ELSE 0.0 END AS similarity
  FROM (SELECT item_id, a, b, len(list_intersect(a, b)) AS s FROM (
    SELECT item_id, {duck.tokens("title")} AS a, {duck.tokens("coalesce(summary, '')")} AS b FROM items_base))""")
def c14_title_similarity(spark, sf):
    out = derived.items(spark, sf).select(
        "item_id", text.title_tokens(F.col("title")).alias("a"),
        text.title_tokens(F.coalesce("summary", F.lit(""))).alias("b"),
    )
    return out.select("item_id", F.round(text.title_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("c15_canonical_link", f"{_BASE} SELECT item_id, {duck.canonical('link')} AS canonical_link FROM items_base")
def c15_canonical_link(spark, sf):
    return derived.items(spark, sf).select("item_id", urls.canonical_link(F.col("link")).alias("canonical_link"))


@query("c15_canonical_page_url", f"SELECT page_id, {duck.canonical('url')} AS canonical_link FROM pages")
def c15_canonical_page_url(spark, sf):
    return derived.table(spark, sf, "pages").select("page_id", urls.canonical_link(F.col("url")).alias("canonical_link"))


@query("c17_content_hash", f"""{_BASE} SELECT item_id, sha256(title || chr(10) || coalesce(content, '')) AS content_hash,
  sha256(title || chr(10) || array_to_string(block_texts, chr(10))) AS blocks_hash FROM items_base""")
def c17_content_hash(spark, sf):
    content = F.sha2(F.concat("title", F.lit("\n"), F.coalesce("content", F.lit(""))), 256)
    blocks = F.sha2(F.concat("title", F.lit("\n"), F.array_join("block_texts", "\n")), 256)
    return derived.items(spark, sf).select("item_id", content.alias("content_hash"), blocks.alias("blocks_hash"))


_DATE_SHAPES = [
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "", ""),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "+02:00", "2"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", ".250Z", "0"),
    ("E, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", " GMT", "0"),
    ("E, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", " -0530", "-5.5"),
    ("E, dd MMM yyyy HH:mm", "%a, %d %b %Y %H:%M", " EST", "-5"),
    ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S", " +0100", "1"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "", "0"),
    ("yyyy", "%Y", "", None),
    ("dd/MM/yyyy", "%d/%m/%Y", "", None),
]
_DATE_EXPECT = " ".join(
    f"WHEN {i} THEN " + ("NULL" if hours is None else duck.stamp(f"published_at - to_minutes(CAST({hours or 0} * 60 AS INTEGER))"))
    for i, (_, _, _, hours) in enumerate(_DATE_SHAPES)
)


@query("c19_parse_feed_date", f"{_BASE} SELECT item_id, CASE item_id % 10 {_DATE_EXPECT} END AS parsed FROM items_base")
def c19_parse_feed_date(spark, sf):
    shape = F.lit(None).cast("string")
    for i, (pattern, _, suffix, _) in enumerate(_DATE_SHAPES):
        rendered = F.concat(F.lit(" "), F.date_format("published_at", pattern), F.lit(suffix + "\n"))
        shape = F.when(F.col("item_id") % 10 == i, rendered).otherwise(shape)
    return derived.items(spark, sf).select("item_id", derived.stamp(dates.parse_feed_date(shape)).alias("parsed"))


@query("c20_favicon", f"""WITH {duck.FEEDS} SELECT feed_id, coalesce(CASE WHEN regexp_matches(icon_url, '^[a-z]+:') THEN icon_url END,
  'https://' || {duck.host("coalesce(site_url, url)")} || '/favicon.ico') AS favicon FROM feeds""")
def c20_favicon(spark, sf):
    return derived.feeds(spark, sf).select(
        "feed_id", urls.favicon(F.col("icon_url"), F.col("site_url"), F.col("url")).alias("favicon")
    )


@query("c21_normalize_address", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '')
  WHEN 2 THEN NULL WHEN 3 THEN 'https://' || rtrim(regexp_replace(url, '^https?://', ''), '/') END AS address FROM pages""")
def c21_normalize_address(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    typed = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  "), "url", F.lit("\n")))
        .when(F.col("page_id") % 5 == 1, bare)
        .when(F.col("page_id") % 5 == 2, F.concat(bare, F.lit(" x")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("feed://"), bare))
        .otherwise(F.lit("localhost"))
    )
    return derived.table(spark, sf, "pages").select("page_id", urls.normalize_address(typed).alias("address"))


_UUID_SQL = "'00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')"


@query("c22_click_target", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'all' WHEN 1 THEN 'feed' WHEN 2 THEN 'article' WHEN 5 THEN 'article' END AS kind,
  CASE WHEN event_id % 6 IN (1, 2, 5) THEN {_UUID_SQL} END AS target FROM events""")
def c22_click_target(spark, sf):
    ident = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    n = F.col("event_id") % 6
    link = (
        F.when(n == 0, F.lit("rssreader://all"))
        .when(n == 1, F.concat(F.lit("rssreader://feed/"), ident))
        .when(n == 2, F.concat(F.lit("RSSReader://articles/"), F.upper(ident)))
        .when(n == 3, F.concat(F.lit("https://example.com/"), ident))
        .when(n == 4, F.lit("rssreader://feed/not-an-id"))
        .otherwise(F.concat(F.lit("rssreader://"), ident))
    )
    hit = urls.click_target(link, ["rssreader"])
    return derived.table(spark, sf, "events").select("event_id", hit["kind"].alias("kind"), hit["id"].alias("target"))


_VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_DOT = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))"
_LEN = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_PAIRED = f"""paired AS (SELECT e.vec_id, {_VEC.replace("embedding", "e.embedding")} AS a, {_VEC.replace("embedding", "f.embedding")} AS b
  FROM embeddings e JOIN embeddings f ON f.vec_id = CASE WHEN e.vec_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings) ELSE e.vec_id + 1 END)"""


def _paired(spark, sf):
    """Each vector with its successor, the last with the first."""
    e = derived.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    ends = e.agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).withColumn("_one", F.lit(1))
    before = F.when(F.col("vec_id") == F.col("first"), F.col("last")).otherwise(F.col("vec_id") - 1)
    after = e.withColumn("_one", F.lit(1)).join(ends, "_one").select(before.alias("vec_id"), F.col("a").alias("b"))
    return e.join(after, "vec_id")


@query("c23_cosine", f"WITH {_PAIRED} SELECT vec_id, round({_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}), 6) AS similarity FROM paired")
def c23_cosine(spark, sf):
    return _paired(spark, sf).select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("c24_unit_vector", f"""WITH v AS (SELECT vec_id, {_VEC} AS a FROM embeddings)
  SELECT vec_id, unnest(range(1, len(a) + 1)) AS dim, round(unnest(list_transform(a, lambda x: 3 * x / {_LEN.format('list_transform(a, lambda y: 3 * y)')})), 6) AS x FROM v""")
def c24_unit_vector(spark, sf):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    out = derived.table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.unit(tripled)).alias("dim", "x"))
    return out.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


@query("c25_blend_vectors", f"""WITH {_PAIRED} SELECT vec_id, unnest(range(1, len(a) + 1)) AS dim,
  round(unnest(list_transform(list_zip(a, b), lambda z: z[1] * 0.4 + z[2] * 0.6)), 6) AS x FROM paired""")
def c25_blend_vectors(spark, sf):
    out = _paired(spark, sf).select("vec_id", F.posexplode(vectors.blend(F.col("a"), F.col("b"))).alias("dim", "x"))
    return out.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


def _terms_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({expr}, {duck.lit(fixed.WHITESPACE + '+')}), lambda w: w <> ''))"


@query("c26_term_similarity", f"""{_BASE} SELECT item_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN
  round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity
  FROM (SELECT item_id, {_terms_sql("title")} AS a, {_terms_sql("body_text")} AS b FROM items_base)""")
def c26_term_similarity(spark, sf):
    return derived.items(spark, sf).select(
        "item_id", F.round(vectors.term_similarity(F.col("title"), F.col("body_text")), 6).alias("similarity")
    )


@query("c27_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents")
def c27_fold(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("digest"))


_TRIM = f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$"


@query("c32_leading_sentences", f"""SELECT doc_id, CASE WHEN len(p) > 0 THEN p[1] || '.' || CASE WHEN len(p) > 1 THEN ' ' || p[2] || '.' ELSE '' END
  ELSE 'No title' END AS summary FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'),
  lambda s: {duck.sub("s", _TRIM, "")}), lambda s: length(s) > 30) AS p FROM documents)""")
def c32_leading_sentences(spark, sf):
    return derived.table(spark, sf, "documents").select(
        "doc_id", text.leading_sentences(F.lit("No title"), F.col("text")).alias("summary")
    )


@query("c34_numbered_blocks", f"""{_BASE} SELECT item_id, md5(t) AS digest, length(t) AS chars FROM (SELECT item_id,
  left(array_to_string(list_transform(block_texts, lambda b, i: '[BLOCK ' || (i - 1) || '] ' || b), chr(10)), 4000) AS t
  FROM items_base WHERE has_full_text)""")
def c34_numbered_blocks(spark, sf):
    t = text.numbered_blocks(F.col("block_texts"))
    out = derived.items(spark, sf).filter("has_full_text")
    return out.select("item_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


_COLLECTED = duck.squash(
    "replace(replace(replace(replace(replace("
    + duck.sub("html", fixed.TAG, " ")
    + ", '&nbsp;', ' '), '&#39;', ''''), '&apos;', ''''), '&quot;', '\"'), '&amp;', '&')"
)


@query("c36_clean_collected", f"SELECT page_id, md5({_COLLECTED}) AS digest FROM pages")
def c36_clean_collected(spark, sf):
    return derived.table(spark, sf, "pages").select("page_id", F.md5(text.clean_collected(F.col("html"))).alias("digest"))


@query("c18_stable_id", """SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' ||
  CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9'
       WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable_id
  FROM (SELECT page_id, sha256(url) AS h FROM pages)""")
def c18_stable_id(spark, sf):
    from newsloom.sources.corpus import stable_id

    return derived.table(spark, sf, "pages").select("page_id", stable_id(F.col("url")).alias("stable_id"))


@query("c39_language_profile", """WITH words AS (
  SELECT d.doc_id, d.lang, unnest(list_filter(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')) AS w,
    l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
  totals AS (SELECT lang, count(*) AS n FROM words WHERE labelled GROUP BY lang),
  profile AS (SELECT words.lang, w, count(*) / any_value(totals.n) AS weight FROM words JOIN totals USING (lang) WHERE labelled GROUP BY words.lang, w),
  counts AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w),
  votes AS (SELECT doc_id, profile.lang, round(sum(n * weight), 9) AS s FROM counts JOIN profile USING (w) GROUP BY doc_id, profile.lang),
  best AS (SELECT doc_id, lang FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
  SELECT d.doc_id, coalesce(best.lang, 'und') AS detected FROM documents d LEFT JOIN best USING (doc_id)""")
def c39_language_profile(spark, sf):
    from newsloom.operators.language import detect_language, language_profile

    docs = derived.table(spark, sf, "documents")
    labelled = docs.join(derived.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    profile = language_profile(labelled, "text", "lang")
    return detect_language(docs, "doc_id", "text", profile)


@query("c40_gate_decision", f"""WITH {_PAIRED}, g AS (SELECT vec_id, round({_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}), 6) AS c FROM paired)
  SELECT vec_id, CASE WHEN c IS NULL OR c + 0.1 < 0.2 THEN 'rejectedCentroidSimilarity'
    WHEN vec_id % 7 = 0 THEN 'rejectedEventSignatureMismatch'
    WHEN vec_id % 3 = 0 AND c < 0.985 THEN 'rejectedActionMismatch'
    WHEN c < 0.145 THEN 'rejectedRepresentativeSimilarity'
    WHEN c - 0.02 < 0.145 THEN 'rejectedRecentMemberSupport' ELSE 'accepted' END AS decision FROM g""")
def c40_gate_decision(spark, sf):
    c = F.round(vectors.cosine(F.col("a"), F.col("b")), 6)
    base = _paired(spark, sf).select("vec_id", c.alias("c"))
    actions = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("approve"))).otherwise(F.array(F.lit("reject")))
    signature = F.when(F.col("vec_id") % 7 == 0, False)
    decision = vectors.gate_decision(
        F.col("c") + 0.1, F.col("c"), F.col("c") - 0.02, actions, F.array(F.lit("reject")), 0.2, signature
    )
    return base.select("vec_id", decision.alias("decision"))


@query("c41_could_join", f"""WITH {_PAIRED}, g AS (SELECT vec_id, round({_DOT} / ({_LEN.format('a')} * {_LEN.format('b')}), 6) AS c FROM paired)
  SELECT vec_id, coalesce(c + 0.1 >= 0.2 AND c >= 0.2 - 0.055 AND c - 0.02 >= 0.2 - 0.055, false) AS possible FROM g""")
def c41_could_join(spark, sf):
    base = _paired(spark, sf).select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("c"))
    return base.select("vec_id", vectors.could_join(F.col("c") + 0.1, F.col("c"), F.col("c") - 0.02, 0.2).alias("possible"))


@query("u4_token_set_algebra", f"""{_BASE}, t AS (SELECT item_id, {duck.tokens("title")} AS a, {duck.tokens("coalesce(snippet_src, '')")} AS b FROM (
  SELECT item_id, title, summary AS snippet_src FROM items_base))
  SELECT item_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_either,
    len(list_intersect(a, b)) = 0 AS disjoint FROM t""")
def u4_token_set_algebra(spark, sf):
    a, b = F.col("a"), F.col("b")
    out = derived.items(spark, sf).select(
        "item_id", text.title_tokens(F.col("title")).alias("a"), text.title_tokens(F.coalesce("summary", F.lit(""))).alias("b")
    )
    return out.select(
        "item_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_union(a, b)).alias("n_either"),
        (~F.arrays_overlap(a, b)).alias("disjoint"),
    )


# --- rule columns -----------------------------------------------------------------------------


@query("f6_promotional_noise", f"{_BASE} SELECT item_id, {duck.promotional('title', 'link')} AS noise FROM items_base")
def f6_promotional_noise(spark, sf):
    return derived.items(spark, sf).select("item_id", rules.is_promotional(F.col("title"), F.col("link")).alias("noise"))


@query("c16_promotional_path", f"""{_BASE} SELECT item_id, coalesce(regexp_matches({duck.path("link")},
  {duck.alternation(fixed.PROMOTIONAL_PATHS)}), false) AS promotional FROM items_base""")
def c16_promotional_path(spark, sf):
    hit = F.coalesce(urls.path(F.col("link")).rlike(rules.any_of(fixed.PROMOTIONAL_PATHS)), F.lit(False))
    return derived.items(spark, sf).select("item_id", hit.alias("promotional"))


@query("f7_clickbait", f"{_BASE} SELECT item_id, {duck.clickbait('title')} AS clickbait FROM items_base")
def f7_clickbait(spark, sf):
    return derived.items(spark, sf).select("item_id", rules.is_clickbait(F.col("title")).alias("clickbait"))
