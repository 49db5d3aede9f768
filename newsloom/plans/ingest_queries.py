"""Queries of feed ingest, subscriptions, discovery and article extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import extract, merge
from newsloom.plans import derived, duck
from newsloom.plans.registry import query
from newsloom.sources import feeds

_BASE = f"WITH {duck.ITEMS_BASE}"
# A payload holds at most this many consecutive documents of one source, however large the source is.
_PER_PAYLOAD = 200


def _escaped(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tag(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name.split(' ')[0]}>")), F.lit(""))


def payloads(spark, sf) -> DataFrame:
    """Feed documents in four dialects, made of the document texts."""
    n, num = F.col("doc_id"), F.col("doc_id").cast("string")
    kind = derived.source_number() % 4
    published = F.timestamp_seconds(F.lit(derived.BASE_SECONDS) + (n * 37 % 720) * 3600)
    mail_date = F.date_format(published, "E, dd MMM yyyy HH:mm:ss 'GMT'")
    iso_date = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.array_join(F.slice(F.split(F.substring_index("text", "\n", 1), " ", -1), 1, 12), " ")
    link = F.concat(F.lit("https://"), "source", F.lit(".example.com/a?id="), num, F.lit("&x=1"))
    author = F.concat(F.lit("Author "), (n % 50).cast("string"))
    enclosure = F.when(n % 2 == 0, F.concat(F.lit('<enclosure url="https://img.example.com/'), num, F.lit('.png" type="image/png"/>'))).otherwise("")
    rss = F.concat(
        F.lit("<item>"), _tag("title", _escaped(title)), _tag("link", _escaped(link)),
        _tag('guid isPermaLink="false"', F.concat(F.lit("g"), num)), _tag("pubDate", mail_date),
        _tag("description", _escaped(F.col("text"))), _tag("author", author), enclosure, F.lit("</item>"),
    )
    spaced = F.concat(
        F.lit("<item>"), _tag("title", _escaped(title)), _tag("link", _escaped(link)), _tag("dc:date", iso_date),
        F.lit('<content:encoded><![CDATA[<p><img class="x" src="https://i.example.com/'), num, F.lit('.gif"/>'), F.col("text"),
        F.lit("</p>]]></content:encoded>"), _tag("dc:creator", author), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), _tag('title type="html"', _escaped(title)), _tag("id", F.concat(F.lit("urn:"), num)),
        F.lit('<link rel="self" href="https://self.example.com/"/><link href="'), _escaped(link), F.lit('"/>'),
        F.when(n % 2 == 0, F.concat(F.lit('<link rel="enclosure" type="image/jpeg" href="https://img.example.com/'), num, F.lit('.jpg"/>'))).otherwise(""),
        F.when(n % 3 == 0, _tag("published", F.date_format(published - F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ssXXX"))).otherwise(""),
        _tag("updated", iso_date), _tag("summary", _escaped(F.col("text"))), _tag("author", _tag("name", author)), F.lit("</entry>"),
    )
    rows = derived.table(spark, sf, "documents").select(
        "source", F.floor(n / _PER_PAYLOAD).alias("part"), n, kind.alias("kind"),
        F.when(kind == 1, atom).when(kind == 3, spaced).otherwise(rss).alias("xml"),
    )
    grouped = rows.groupBy("source", "part", "kind").agg(F.sort_array(F.collect_list(F.struct("doc_id", "xml"))).alias("xs"))
    inner = F.array_join(F.transform("xs", lambda x: x["xml"]), "\n")
    name = F.concat(F.lit("Feed "), "source")
    head = F.concat(_tag("title", name), _tag("link", F.concat(F.lit("https://"), "source", F.lit(".example.com"))), F.lit("<description>News</description>"))
    prolog = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!-- feed -->\n')
    body = (
        F.when(F.col("kind") == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), _tag("title", name),
               F.lit('<link href="https://'), "source", F.lit('.example.com"/><subtitle>News</subtitle><icon>https://i.example.com/f.ico</icon>'), inner, F.lit("</feed>")))
        .when(F.col("kind") == 2, F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel>'), head, F.lit("</channel>"), inner, F.lit("</rdf:RDF>")))
        .otherwise(F.concat(F.lit('<rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel>'), head, inner, F.lit("</channel></rss>")))
    )
    return grouped.select(
        F.concat_ws("-", "source", F.col("part").cast("string")).alias("feed_id"), "part",
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("fetched_at"), F.concat(prolog, body).alias("body"),
    )


_D = f"""d AS (SELECT *, CAST(substr(source, 4) AS INTEGER) % 4 AS kind, doc_id // {_PER_PAYLOAD} AS part, {duck._PUBLISHED} AS ts,
  regexp_replace({duck._WORDS}, '^\\s+|\\s+$', '', 'g') AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
  numbered AS (SELECT *, source || '-' || part AS feed_id, row_number() OVER (PARTITION BY source, part ORDER BY doc_id) - 1 AS position FROM d)"""
_LINK = "'https://' || source || '.example.com/a?id=' || doc_id || '&x=1'"


def _item_columns(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "feed_id", "position", "guid", "title", "link", "author", F.md5("summary").alias("summary_digest"),
        F.md5("content").alias("content_digest"), "image_url", derived.stamp("published_at").alias("published_at"), *more,
    )


@query("s1_feed_ingest", f"""WITH {_D} SELECT feed_id, any_value('Feed ' || source) AS title, any_value('https://' || source || '.example.com') AS site_url, 'News' AS description,
  CASE WHEN any_value(kind) = 1 THEN 'https://i.example.com/f.ico' END AS icon_url, count(*) AS n_items, {duck.stamp("max(CASE WHEN kind = 1 AND doc_id % 3 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END)")} AS newest_at
  FROM numbered GROUP BY feed_id""")
def s1_feed_ingest(spark, sf):
    parsed = feeds.parse(payloads(spark, sf))
    counts = feeds.item_rows(parsed).groupBy("feed_id").agg(F.count("*").alias("n_items"), F.max("published_at").alias("newest_at"))
    return feeds.feed_rows(parsed).drop("fetched_at").join(counts, "feed_id", "left").withColumn("newest_at", derived.stamp("newest_at"))


@query("s1a_rss_items", f"""WITH {_D} SELECT feed_id, position, CASE WHEN kind <> 3 THEN 'g' || doc_id END AS guid, coalesce(nullif(title, ''), 'Untitled Article') AS title, {_LINK} AS link,
  'Author ' || (doc_id % 50) AS author, CASE WHEN kind <> 3 THEN md5(nullif(body, '')) END AS summary_digest,
  CASE WHEN kind = 3 THEN md5('<p><img class="x" src="https://i.example.com/' || doc_id || '.gif"/>' || text || '</p>') END AS content_digest,
  CASE WHEN kind = 3 THEN 'https://i.example.com/' || doc_id || '.gif' WHEN doc_id % 2 = 0 THEN 'https://img.example.com/' || doc_id || '.png' END AS image_url,
  {duck.stamp("ts")} AS published_at FROM numbered WHERE kind <> 1""")
def s1a_rss_items(spark, sf):
    return _item_columns(feeds.rss_items(feeds.parse(payloads(spark, sf))))


@query("s1b_atom_items", f"""WITH {_D} SELECT feed_id, position, 'urn:' || doc_id AS guid, coalesce(nullif(title, ''), 'Untitled Article') AS title, {_LINK} AS link, 'Author ' || (doc_id % 50) AS author,
  md5(nullif(body, '')) AS summary_digest, CAST(NULL AS VARCHAR) AS content_digest, CASE WHEN doc_id % 2 = 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END AS image_url,
  {duck.stamp("CASE WHEN doc_id % 3 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END")} AS published_at FROM numbered WHERE kind = 1""")
def s1b_atom_items(spark, sf):
    return _item_columns(feeds.atom_items(feeds.parse(payloads(spark, sf))))


@query("s1c_first_image", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://i.example.com/' || page_id || '.png' END AS image_url FROM pages""")
def s1c_first_image(spark, sf):
    n = F.col("page_id")
    html = F.when(n % 3 == 0, F.concat("html", F.lit("<IMG alt='a' SRC='https://i.example.com/"), n.cast("string"), F.lit(".png'><img src=\"two.png\">"))).otherwise(F.col("html"))
    return derived.table(spark, sf, "pages").select("page_id", urls.first_image(html).alias("image_url"))


@query("s1_quarantine", f"""WITH {_D} SELECT feed_id, CASE (any_value(CAST(substr(source, 4) AS INTEGER)) + any_value(part)) % 5 WHEN 1 THEN 'invalidXML' WHEN 2 THEN 'emptyData' WHEN 3 THEN 'unsupportedFormat' ELSE 'invalidXML' END AS reason
  FROM numbered WHERE (CAST(substr(source, 4) AS INTEGER) + part) % 5 <> 0 GROUP BY feed_id""")
def s1_quarantine(spark, sf):
    """Broken payloads are set aside with their reason; the whole ones beside them still load."""
    n = (F.substring(F.substring_index("feed_id", "-", 1), 4, 10).cast("int") + F.col("part")) % 5
    broken = (
        F.when(n == 1, F.substring(F.col("body"), 1, 300))
        .when(n == 2, F.lit(""))
        .when(n == 3, F.lit("<!DOCTYPE html>\n<html><body><p>Not a feed</p></body></html>"))
        .when(n == 4, F.replace("body", F.lit("</title>"), F.lit("</titel>")))
        .otherwise(F.col("body"))
    )
    return feeds.quarantine(feeds.parse(payloads(spark, sf).withColumn("body", broken))).select("feed_id", "reason")


# --- subscriptions and discovery ----------------------------------------------------------------


def _opml(spark, sf) -> DataFrame:
    """One OPML document per 50 documents: a folder, a folder eight levels below it, and top-level feeds."""
    n, num = F.col("doc_id"), F.col("doc_id").cast("string")
    outline = F.concat(
        F.lit('<outline type="rss" text="Feed '), num, F.lit('" '),
        F.when(n % 4 == 0, F.lit("xmlURL")).otherwise(F.lit("xmlUrl")), F.lit('="https://'), "source", F.lit(".example.com/"),
        (n % 700).cast("string"), F.lit('" htmlUrl="https://'), "source", F.lit('.example.com"'),
        F.when(n % 5 == 0, F.lit(' category="Inline"')).otherwise(""), F.lit("/>"),
    )
    rows = derived.table(spark, sf, "documents").select(F.floor(n / 50).alias("id"), n, outline.alias("xml"))
    parts = [
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(n % 3 == k, F.struct("doc_id", "xml")))), lambda x: x["xml"]), "").alias(f"p{k}")
        for k in range(3)
    ]
    grouped = rows.groupBy("id").agg(*parts)
    label = F.col("id").cast("string")
    body = F.concat(
        F.lit('<?xml version="1.0"?><opml version="2.0"><head><title>s</title></head><body><outline text="Folder '), label, F.lit('">'),
        "p0", F.lit('<outline text="Level">' * 7 + '<outline title="Sub '), label, F.lit('" type="folder">'), "p1", F.lit("</outline>" * 9), "p2", F.lit("</body></opml>"),
    )
    return grouped.select(F.col("id").alias("doc_id"), body.alias("body"))


_OUTLINES = """outlines AS (SELECT doc_id // 50 AS id, doc_id % 3 AS grp, doc_id, 'Feed ' || doc_id AS title, 'https://' || source || '.example.com/' || (doc_id % 700) AS xml_url,
  'https://' || source || '.example.com' AS html_url, CASE WHEN doc_id % 5 = 0 THEN 'Inline' WHEN doc_id % 3 = 0 THEN 'Folder ' || (doc_id // 50)
    WHEN doc_id % 3 = 1 THEN 'Sub ' || (doc_id // 50) END AS category FROM documents)"""


@query("s2_opml_outlines", f"WITH {_OUTLINES} SELECT id AS doc_id, title, xml_url, html_url, category FROM outlines")
def s2_opml_outlines(spark, sf):
    return feeds.subscriptions(_opml(spark, sf)).drop("position")


@query("s2_opml_import", f"""WITH {_OUTLINES}, {duck.FEEDS}, known AS (SELECT replace(url, '/rss', '/' || n) AS url FROM feeds, range(0, 700, 7) t(n))
  SELECT title, xml_url, category FROM outlines WHERE xml_url NOT IN (SELECT url FROM known) QUALIFY row_number() OVER (PARTITION BY xml_url ORDER BY id, grp, doc_id) = 1""")
def s2_opml_import(spark, sf):
    known = derived.feeds(spark, sf).select(F.explode(F.sequence(F.lit(0), F.lit(699), F.lit(7))).alias("n"), "url").select(
        F.concat(F.regexp_replace("url", "/rss$", "/"), F.col("n").cast("string")).alias("url")
    )
    return merge.new_subscriptions(feeds.subscriptions(_opml(spark, sf)), known).select("title", "xml_url", "category")


@query("s3_export_groups", f"""WITH {duck.FEEDS} SELECT coalesce(category, '') AS folder, title, url, site_url,
  row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY title, feed_id) AS position FROM feeds""")
def s3_export_groups(spark, sf):
    return feeds.export_groups(derived.feeds(spark, sf)).select("folder", "title", "url", "site_url", "position")


def _pages_with_links(spark, sf) -> DataFrame:
    """The pages, each announcing a feed in another way."""
    n, num = F.col("page_id"), F.col("page_id").cast("string")
    href = F.when(n % 4 == 0, F.lit("/feed.xml")).when(n % 4 == 1, F.concat(F.lit("https://f.example.org/"), num)).otherwise(F.lit("../x/./feed.xml"))
    tag = F.concat(
        F.lit("<link rel='alternate' type='application/"), F.when(n % 4 == 3, F.lit("json")).otherwise(F.lit("rss+xml")), F.lit("'"),
        F.when(n % 5 != 0, F.concat(F.lit(' title="News '), (n % 50).cast("string"), F.lit('"'))).otherwise(""), F.lit(' href="'), href, F.lit('"/>'),
    )
    own = F.concat(F.lit('<rss version="2.0"><channel><title>Own '), num, F.lit("</title></channel></rss>"))
    html = F.when(n % 10 == 9, own).otherwise(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), tag)))
    return derived.table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


_SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_FOUND = f"""found AS (SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'Own ' || page_id WHEN page_id % 5 <> 0 THEN 'News ' || (page_id % 50) ELSE 'RSS Feed' END AS title,
  CASE WHEN page_id % 10 = 9 THEN url WHEN page_id % 4 = 0 THEN {_SITE} || '/feed.xml' WHEN page_id % 4 = 1 THEN 'https://f.example.org/' || page_id
    ELSE {_SITE} || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') || 'x/feed.xml' END AS url
  FROM pages WHERE page_id % 4 <> 3 OR page_id % 10 = 9)"""


@query("s4_feed_discovery", f"WITH {_FOUND} SELECT page_id, title, url FROM found")
def s4_feed_discovery(spark, sf):
    return feeds.discover_feeds(_pages_with_links(spark, sf))


@query("u3_distinct_discoveries", f"WITH {_FOUND} SELECT DISTINCT title, url FROM found")
def u3_distinct_discoveries(spark, sf):
    return feeds.distinct_discoveries(feeds.discover_feeds(_pages_with_links(spark, sf)))


# --- extraction -------------------------------------------------------------------------------


@query("x1_without_comments", "SELECT page_id, md5(regexp_replace(html, '<!--(.|\\n)*?-->', '', 'g')) AS digest FROM pages")
def x1_without_comments(spark, sf):
    return derived.table(spark, sf, "pages").select("page_id", F.md5(extract.without_comments(F.col("html"))).alias("digest"))


@query("x4_boilerplate_attributes", """SELECT page_id, tag, regexp_matches(lower(coalesce(regexp_extract(tag, '(?i)(?:class|id)\\s*=\\s*["'']([^"'']*)["'']', 1), '')),
  '(^|[^\\p{L}\\p{N}])(((ad|ads|nav)([^\\p{L}\\p{N}]|$))|(support|donat|patreon|promo|sponsor|advert|banner|newsletter|subscri|share|sharing|social|comment|related|recommend|author|byline|breadcrumb|cookie|consent|modal|popup|toolbar|menu|sidebar|itembox|footer|navbox|navbar|navigation))') AS boilerplate
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][^>]*>')) AS tag FROM pages)""")
def x4_boilerplate_attributes(spark, sf):
    tags = derived.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[a-z][^>]*>"), 0)).alias("tag"))
    return tags.select("page_id", "tag", extract.is_boilerplate(F.col("tag")).alias("boilerplate"))


_KINDS = ["paragraph", "paragraph", "paragraph", "quote", "listItem", "heading", "paragraph"]
_KIND_SQL = "['" + "','".join(_KINDS) + "'][CAST((doc_id + i * i) % 7 AS INTEGER) + 1]"
_GAP_SQL = "CASE WHEN (doc_id * 7 + i * i * 131) % 9 = 0 THEN 9000 WHEN (doc_id * 7 + i * i * 131) % 4 = 0 THEN 2500 ELSE 40 END"


def _line_blocks(spark, sf, with_summary: bool = False, with_words: bool = True) -> DataFrame:
    """Documents as scanned pages: a block per line, with kinds and gaps by rule."""
    n = F.col("doc_id")
    lines = F.filter(F.transform(F.split("text", "\n", -1), text.squash), lambda s: s != "")
    kinds = F.array(*[F.lit(k) for k in _KINDS])

    def block(line: Column, i: Column) -> Column:
        step = n * 7 + i * i * 131
        return F.struct(
            F.get(kinds, ((n + i * i) % 7).cast("int")).alias("kind"), line.alias("text"),
            F.when(step % 9 == 0, 9000).when(step % 4 == 0, 2500).otherwise(40).alias("gap"),
            *[text.count_squashed(line).alias("words")] * with_words,
        )

    third = F.concat(F.get(lines, F.lit(2)), F.lit(" and more words to be long enough"))
    summary = F.when(n % 2 == 0, third) if with_summary else F.lit(None).cast("string")
    return derived.table(spark, sf, "documents").select("doc_id", F.transform(lines, block).alias("blocks"), summary.alias("summary"))


_RUNS = f"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, ls FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {duck.squash("s")}), lambda s: s <> '') AS ls FROM documents)),
  blk AS (SELECT doc_id, i, line, {_KIND_SQL} AS kind, {_GAP_SQL} AS gap, {duck.words("line")} AS words, ls FROM lines),
  marked AS (SELECT *, sum(CASE WHEN i = 0 OR gap > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS run FROM blk),
  rn AS (SELECT doc_id, run, min(i) + 1 AS first, max(i) + 1 AS last, arg_min(gap, i) AS gap, coalesce(sum(words) FILTER (WHERE kind IN ('paragraph', 'quote')), 0) AS prose, sum(words) AS total FROM marked GROUP BY doc_id, run)"""


@query("w9_block_runs", f"WITH {_RUNS} SELECT doc_id, run, first, last, gap, prose, total FROM rn")
def w9_block_runs(spark, sf):
    out = _line_blocks(spark, sf).select("doc_id", F.posexplode(extract.runs(F.col("blocks"))).alias("run", "r"))
    return out.select("doc_id", "run", "r.*")


_SPAN = f"""{_RUNS}, best AS (SELECT doc_id, run AS best FROM rn QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prose DESC, run) = 1),
  near AS (SELECT rn.*, best, gap <= 8000 AND prose >= 40 AND prose >= 0.6 * total AS fits, lead(gap) OVER (PARTITION BY doc_id ORDER BY run) AS next_gap FROM rn JOIN best USING (doc_id)),
  edge AS (SELECT doc_id, coalesce(max(run) FILTER (WHERE run < best AND NOT (next_gap <= 8000 AND fits)) + 1, 0) AS lo, coalesce(min(run) FILTER (WHERE run > best AND NOT fits) - 1, max(run)) AS hi FROM near GROUP BY doc_id),
  span AS (SELECT e.doc_id, min(first) AS first, max(last) AS last FROM edge e JOIN rn ON rn.doc_id = e.doc_id AND run BETWEEN lo AND hi GROUP BY e.doc_id)"""


@query("w10_best_span", f"WITH {_SPAN} SELECT doc_id, first, last FROM span")
def w10_best_span(spark, sf):
    staged = text.settle(_line_blocks(spark, sf), runs=extract.runs(F.col("blocks")))
    out = text.settle(staged, s=extract.best_span(F.col("runs")))
    return out.filter("s is not null").select("doc_id", "s.first", "s.last")


_ANCHOR_SQL = f"lower({duck.strip_tags(chr(39) + chr(39) + ' || ls[3] || ' + chr(39) + ' and more words to be long enough' + chr(39))})"
_ARTICLE = f"""{_SPAN}, anch AS (SELECT doc_id, left(any_value({_ANCHOR_SQL}), 40) AS a FROM blk WHERE doc_id % 2 = 0 AND len(ls) >= 3 GROUP BY doc_id),
  hit AS (SELECT m.doc_id, min(m.i) + 1 AS first, arg_min(m.run, m.i) AS run FROM marked m JOIN anch ON anch.doc_id = m.doc_id WHERE starts_with(lower(m.line), anch.a) GROUP BY m.doc_id),
  chosen AS (SELECT s.doc_id, coalesce(h.first, s.first) AS first, coalesce(r.last, s.last) AS last FROM span s LEFT JOIN hit h ON h.doc_id = s.doc_id LEFT JOIN rn r ON r.doc_id = h.doc_id AND r.run = h.run),
  art AS (SELECT b.*, max(CASE WHEN kind <> 'heading' AND words >= 5 THEN i END) OVER (PARTITION BY b.doc_id) AS keep FROM blk b JOIN chosen c ON c.doc_id = b.doc_id AND b.i + 1 BETWEEN c.first AND c.last)"""


@query("x6_anchored_article", f"""WITH {_ARTICLE} SELECT doc_id, count(*) AS n_blocks, sum(words) AS word_count, md5(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS digest,
  sum(words) >= 20 AS accepted FROM art WHERE i <= keep GROUP BY doc_id""")
def x6_anchored_article(spark, sf):
    """Anchor, region growth, trimming and acceptance (steps X5 to X8) over every document."""
    spans = extract.article_spans(_line_blocks(spark, sf, with_summary=True))
    return spans.filter(F.size("article") > 0).select(
        "doc_id", F.size("article").alias("n_blocks"), "word_count",
        F.md5(F.array_join(F.transform("article", lambda b: b["text"]), "\n\n")).alias("digest"), "accepted",
    )


def _pages_with_meta(spark, sf) -> DataFrame:
    """The pages with lead image and AMP tags of several shapes."""
    n, num = F.col("page_id"), F.col("page_id").cast("string")
    meta = (
        F.when(n % 3 == 0, F.concat(F.lit('<meta property="og:image" content="/img/'), num, F.lit('.jpg?a=1&amp;b=2">')))
        .when(n % 3 == 1, F.concat(F.lit("<META content='https://c.example.org/"), num, F.lit(".png' name='twitter:image'>")))
        .otherwise("")
    )
    amp = F.when(n % 2 == 0, F.concat(F.lit('<link rel="amphtml" href="//amp.example.org/'), num, F.lit('">'))).otherwise("")
    return derived.table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta, amp)).alias("html"))


@query("x9_lead_image", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_SITE} || '/img/' || page_id || '.jpg?a=1&b=2' WHEN 1 THEN 'https://c.example.org/' || page_id || '.png' END AS lead_image FROM pages""")
def x9_lead_image(spark, sf):
    return _pages_with_meta(spark, sf).select("page_id", extract.lead_image(F.col("html"), F.col("url")).alias("lead_image"))


@query("x11_amp_links", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?:)', 1) || '//amp.example.org/' || page_id END AS amp_url FROM pages""")
def x11_amp_links(spark, sf):
    return _pages_with_meta(spark, sf).select("page_id", extract.amp_link(F.col("html"), F.col("url")).alias("amp_url"))


def _json_pages(spark, sf) -> DataFrame:
    """Every document as a page that hides its text in JSON-LD, page state or a form field."""
    n = F.col("doc_id")
    quoted = F.to_json(F.struct(F.col("text").alias("articleBody")))
    inner = F.substring(quoted, 2, 100_000_000)
    inner = inner.substr(F.lit(1), F.length(inner) - 1)
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"description": "short one", '), inner, F.lit("}]}</script>"))
    state = F.concat(F.lit('<script id="__NEXT_DATA__">{"props": {"body": '), F.substring(inner, 15, 100_000_000), F.lit("}}</script>"))
    loose = F.concat(F.lit("<script>var a = {"), inner, F.lit("};</script>"))
    html = F.when(n % 4 == 0, ld).when(n % 4 == 1, state).when(n % 4 == 2, loose).otherwise(F.lit("<p>short</p>"))
    return derived.table(spark, sf, "documents").select(n, F.concat(F.lit("<html>"), html, F.lit("</html>")).alias("html"))


_EMB = duck.strip_tags(duck.decode(duck.decode("text")))
_EMB_ONCE = duck.strip_tags(duck.decode("text"))


@query("x10_embedded_bodies", f"""SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (0, 1) THEN CASE WHEN {duck.words("t2")} >= 20 THEN t2 ELSE CASE WHEN doc_id % 4 = 0 THEN nullif(t1, '') END END
    WHEN doc_id % 4 = 2 THEN nullif(t1, '') END) AS digest FROM (SELECT doc_id, {_EMB} AS t2, {_EMB_ONCE} AS t1 FROM documents)""")
def x10_embedded_bodies(spark, sf):
    return extract.embedded_bodies(_json_pages(spark, sf)).select("doc_id", F.md5("embedded").alias("digest"))


_ITEM_END = " and one more item of the list"


def _made_pages(spark, sf) -> DataFrame:
    """Documents as web pages: a block per line, kinds and gaps as in the line blocks, beside what is to be left out.

    Before every third line there is a sponsored copy of it, which is never read, and one that is a link
    as a whole, which is read and dropped. A gap is text in a plain element.
    """
    n = F.col("doc_id")
    made = _line_blocks(spark, sf, with_words=False)

    def shown(b: Column, i: Column) -> Column:
        kind, line = b["kind"], _escaped(b["text"])
        filler = F.when(b["gap"] > 40, F.concat(F.lit("<div>"), F.repeat(F.lit("z"), b["gap"]), F.lit("</div>"))).otherwise("")
        aside = F.when(i % 3 == 0, F.concat(F.lit('<div class="sponsored"><p>'), line, F.lit('</p></div><p><a href="/x">'), line, F.lit("</a></p>"))).otherwise("")
        body = (
            F.when(kind == "quote", F.concat(F.lit("<blockquote>"), line, F.lit("</blockquote>")))
            .when(kind == "listItem", F.concat(F.lit("<ul><li>"), line, F.lit(f"{_ITEM_END}</li></ul>")))
            .when(kind == "heading", F.concat(F.lit("<h2>"), line, F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>")))
        )
        return F.concat(aside, filler, body)

    html = F.concat(F.lit("<html><head><title>t</title></head><body>"), F.array_join(F.transform("blocks", shown), "\n"), F.lit("</body></html>"))
    url = F.when(n % 50 == 3, F.concat(F.lit("ftp://e.example.com/"), n.cast("string"))).otherwise(F.concat(F.lit("https://e.example.com/"), n.cast("string")))
    return made.select(n.alias("page_id"), url.alias("url"), F.when(n % 50 != 4, html).alias("html"))


_MADE = _SPAN.replace("blk AS (SELECT doc_id, i, line,", f"shown AS (SELECT doc_id, i, ls, line || CASE WHEN {_KIND_SQL} = 'listItem' THEN '{_ITEM_END}' ELSE '' END AS line, line AS own FROM lines), blk AS (SELECT doc_id, i, line, own,").replace("AS words, ls FROM lines)", "AS words, ls FROM shown)")
_ESCAPED = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"


@query("x2_scanned_blocks", f"""WITH {_MADE}, every AS (SELECT doc_id, 2 * i + 1 AS place, kind, {_ESCAPED.format("line")} AS raw, '' AS linked, CASE gap WHEN 9000 THEN 2 WHEN 2500 THEN 1 ELSE 0 END AS apart FROM blk WHERE doc_id % 50 <> 4
    UNION ALL SELECT doc_id, 2 * i, 'paragraph', {_ESCAPED.format("own")}, {_ESCAPED.format("own")}, 0 FROM blk WHERE i % 3 = 0 AND doc_id % 50 <> 4)
  SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS position, kind, md5(raw) AS raw, md5(linked) AS linked, apart FROM every""")
def x2_scanned_blocks(spark, sf):
    """Blocks as the scanner finds them; gaps by which of the two region limits they exceed."""
    scanned = _made_pages(spark, sf).select("page_id", F.posexplode(extract.scan_blocks("html")).alias("position", "b"))
    apart = F.when(F.col("b.gap") > extract.MERGE_GAP, 2).when(F.col("b.gap") > extract.REGION_GAP, 1).otherwise(0)
    return scanned.select("page_id", "position", "b.kind", F.md5("b.raw").alias("raw"), F.md5("b.linked").alias("linked"), apart.alias("apart"))


@query("x3_kept_blocks", f"""WITH {_MADE} SELECT doc_id AS page_id, i AS position, kind, md5(line) AS text, words FROM blk WHERE doc_id % 50 <> 4""")
def x3_kept_blocks(spark, sf):
    out = _made_pages(spark, sf).select("page_id", extract.scan_blocks("html").alias("scanned"))
    kept = out.select("page_id", F.posexplode(extract.block_array(F.col("scanned"))).alias("position", "b"))
    return kept.select("page_id", "position", "b.kind", F.md5("b.text").alias("text"), "b.words")


_EXTRACTED = f"""{_MADE}, art AS (SELECT b.*, max(CASE WHEN kind <> 'heading' AND words >= 5 THEN i END) OVER (PARTITION BY b.doc_id) AS keep FROM blk b JOIN span c ON c.doc_id = b.doc_id AND b.i + 1 BETWEEN c.first AND c.last),
  body AS (SELECT doc_id, sum(words)::BIGINT AS words, md5(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS digest FROM art WHERE i <= keep GROUP BY doc_id),
  judged AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 50 = 3 THEN 'invalidURL' WHEN doc_id % 50 = 4 THEN 'fetchFailed' WHEN words >= 20 THEN 'extracted' ELSE 'noReadableBody' END AS status, digest, words FROM documents LEFT JOIN body USING (doc_id))"""


@query("s5_extract_articles", f"""WITH {_EXTRACTED} SELECT page_id, status, CASE WHEN status = 'extracted' THEN digest END AS text, CASE WHEN status = 'extracted' THEN words END AS word_count FROM judged""")
def s5_extract_articles(spark, sf):
    """Articles out of pages made of the documents, from tags to trimmed text."""
    done = extract.extract_articles(_made_pages(spark, sf))
    return done.select("page_id", "status", F.md5("text").alias("text"), F.col("word_count").cast("bigint").alias("word_count"))


@query("x11_amp_articles", f"""WITH {_EXTRACTED} SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 50 <> 4 AND words >= 20 THEN 'extracted' ELSE 'noReadableBody' END AS status,
    CASE WHEN doc_id % 2 = 0 AND doc_id % 50 <> 4 AND words >= 20 THEN digest END AS text FROM documents LEFT JOIN body USING (doc_id)""")
def x11_amp_articles(spark, sf):
    """Pages with a teaser only; every other one names an AMP page, which has the document."""
    made = _made_pages(spark, sf)
    num = F.col("page_id").cast("string")
    amp = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="amphtml" href="https://amp.example.org/a?id='), num, F.lit('&amp;v=1">'))).otherwise("")
    pages = made.select("page_id", F.concat(F.lit("https://e.example.com/"), num).alias("url"), F.concat(F.lit("<html><head>"), amp, F.lit("</head><body><p>Only a teaser here.</p></body></html>")).alias("html"))
    there = extract.extract_articles(made.withColumn("url", F.concat(F.lit("https://amp.example.org/a?id="), num, F.lit("&v=1"))))
    done = extract.with_amp_bodies(extract.extract_articles(pages), pages, there)
    return done.select("page_id", "status", F.md5("text").alias("text"))


@query("s5_crawled_articles")
def s5_crawled_articles(spark, sf):
    """The same over the crawled pages as they are."""
    done = extract.extract_articles(derived.table(spark, sf, "pages"))
    return done.select("page_id", "url", "status", "text", "word_count", "reading_minutes", "lead_image")


@query("x12_extraction_status", f"""WITH {_EXTRACTED} SELECT status, count(*) AS n, sum(CASE WHEN status = 'extracted' THEN words END)::BIGINT AS words FROM judged GROUP BY status""")
def x12_extraction_status(spark, sf):
    done = extract.extract_articles(_made_pages(spark, sf))
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum("word_count").cast("bigint").alias("words"))


# --- work list ----------------------------------------------------------------------------------

_WORK = f"""w AS (SELECT *, {duck.words("et")} AS extracted_words, {duck.words("ft")} AS feed_words, {duck.words("ct")} AS content_words FROM (SELECT *,
    {duck.squash("array_to_string(block_texts, ' ')")} AS et, {duck.strip_tags("coalesce(content, summary, '')")} AS ft, {duck.strip_tags("coalesce(content, '')")} AS ct FROM items_base)),
  queue AS (SELECT * FROM w WHERE coalesce(extracted_words, 0) < 120 AND feed_words < 300 AND link IS NOT NULL AND (extraction_attempted_at IS NULL OR {duck.NOW} - extraction_attempted_at >= INTERVAL 24 HOUR)),
  preview AS (SELECT * FROM w WHERE NOT has_full_text AND content_words < 120 AND link IS NOT NULL AND (extraction_attempted_at IS NULL OR {duck.NOW} - extraction_attempted_at >= INTERVAL 24 HOUR))"""


def _work_items(spark, sf) -> DataFrame:
    from newsloom.operators.story_views import body_words

    joined = F.array_join("block_texts", " ")
    return (
        derived.items(spark, sf)
        .withColumn("extracted_words", text.count_words(joined))
        .withColumn("feed_words", text.feed_word_count(F.col("content"), F.col("summary")))
        .withColumn("body_words", body_words(joined, F.col("content")))
    )


@query("s6_extraction_queue", f"{_BASE}, {_WORK} SELECT item_id, link FROM queue")
def s6_extraction_queue(spark, sf):
    return extract.work_list(_work_items(spark, sf), derived.now()).select("item_id", "link")


@query("s6_preview_requests", f"""{_BASE}, {_WORK} SELECT link AS url, count(*) AS n_items, md5(arg_min(coalesce(summary, content), struct_pack(p := published_at, i := item_id))) AS summary_digest FROM preview GROUP BY link""")
def s6_preview_requests(spark, sf):
    wanted = extract.work_list(_work_items(spark, sf), derived.now(), preview=True)
    return extract.fetch_requests(wanted).select("url", "n_items", F.md5("summary").alias("summary_digest"))


@query("s7_extraction_write_back", f"""{_BASE}, res AS (SELECT DISTINCT link, regexp_extract(link, '/a/(\\d+)', 1) <> '' AND coalesce(TRY_CAST(regexp_extract(link, '/a/(\\d+)', 1) AS BIGINT) % 2 = 0, false) AS ok FROM items_base WHERE link IS NOT NULL)
  SELECT item_id, CASE WHEN ok IS NOT NULL THEN {duck.stamp(duck.NOW)} ELSE {duck.stamp("extraction_attempted_at")} END AS attempted_at,
    CASE WHEN ok THEN 'done' ELSE array_to_string(block_texts[1:1], '') END AS first_block, coalesce(image_url, CASE WHEN ok THEN 'https://lead.example.com/x.png' END) AS image_url
  FROM items_base LEFT JOIN res USING (link)""")
def s7_extraction_write_back(spark, sf):
    items = derived.items(spark, sf).drop("reading_minutes").withColumn("reading_minutes", F.lit(1))
    number = F.regexp_extract("url", r"/a/(\d+)", 1)
    ok = (number != "") & (number.try_cast("bigint") % 2 == 0)
    results = items.filter("link is not null").select(F.col("link").alias("url")).distinct().select(
        "url", F.when(ok, "extracted").otherwise("noReadableBody").alias("status"), F.array(F.lit("done")).alias("block_texts"),
        F.lit(4).alias("reading_minutes"), F.lit("https://lead.example.com/x.png").alias("lead_image"),
    )
    done = extract.write_back(items, results, derived.now())
    return done.select(
        "item_id", derived.stamp("extraction_attempted_at").alias("attempted_at"),
        F.array_join(F.slice("block_texts", 1, 1), "").alias("first_block"), "image_url",
    )
