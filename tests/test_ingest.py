import re
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.operators import chunks, extract, merge
from newsloom.plans import stream_queries
from newsloom.sources import corpus, feeds
from newsloom.streaming import refresh

FETCHED = datetime(2024, 2, 1)
RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:dc="d" xmlns:media="m"><channel>
<title> My Feed </title><link>https://e.com</link><description>About</description>
<item><title>A &amp; B</title><link>https://e.com/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>
<description><![CDATA[<p>Hi &amp; <img src="i.png"></p>]]></description><dc:creator>Z</dc:creator></item>
<item><title>Two</title><content:encoded><![CDATA[<b>c</b>]]></content:encoded><media:thumbnail url="t.jpg"/><dc:date>2024-01-02T00:00:00Z</dc:date></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title type="html">At</title><link rel="self" href="s"/><link href="https://a.com"/>
<entry><title>E1</title><id>id1</id><link href="https://a.com/1"/><updated>2024-01-03T00:00:00Z</updated><summary>Sum&nbsp;x</summary><author><name>N</name></author></entry></feed>"""
MINIMAL = "<rss><channel><item><title>only</title></item></channel></rss>"


def payloads(spark, *rows):
    return spark.createDataFrame(rows, "feed_id string, body string").withColumn("fetched_at", F.lit(FETCHED))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_feed_dialects(spark):
    parsed = feeds.parse(payloads(spark, ("rss", RSS), ("atom", ATOM), ("min", MINIMAL)))
    items = {(r.feed_id, r.position): r for r in feeds.item_rows(parsed).collect()}
    first, second = items[("rss", 0)], items[("rss", 1)]
    assert (first.title, first.guid, first.author, first.image_url) == ("A & B", "g1", "Z", "i.png")
    assert first.summary == '<p>Hi &amp; <img src="i.png"></p>' and first.published_at == datetime(2024, 1, 1, 10)
    assert (second.content, second.image_url, second.published_at) == ("<b>c</b>", "t.jpg", datetime(2024, 1, 2))
    atom = items[("atom", 0)]
    assert (atom.author, atom.link, atom.guid) == ("N", "https://a.com/1", "id1") and atom.summary.startswith("Sum")
    assert items[("min", 0)].published_at == FETCHED and items[("min", 0)].link is None
    meta = {r.feed_id: r for r in feeds.feed_rows(parsed).collect()}
    assert meta["rss"].title == "My Feed" and meta["min"].title == "Untitled Feed" and meta["atom"].site_url == "https://a.com"


def test_failures_stay_apart(spark):
    parsed = feeds.parse(payloads(spark, ("ok", RSS), ("html", "<html><body>x</body></html>"), ("cut", RSS[:200]), ("none", "")))
    assert {r.feed_id: r.reason for r in feeds.quarantine(parsed).collect()} == {
        "html": "unsupportedFormat", "cut": "invalidXML", "none": "emptyData",
    }
    assert feeds.item_rows(parsed).count() == 2


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RSS)
    read = feeds.read_payload_files(spark, str(tmp_path))
    assert feeds.item_rows(feeds.parse(read)).count() == 2 and read.first().feed_id == "one"


def test_subscriptions_and_discovery(spark):
    opml = (
        '<opml><body><outline text="Tech"><outline type="rss" text="F1" xmlUrl="u1"/></outline>'
        '<outline text="Top" xmlURL="u3"/></body></opml>'
    )
    found = feeds.subscriptions(spark.createDataFrame([(1, opml)], "doc_id int, body string")).collect()
    assert {(r.title, r.xml_url, r.category) for r in found} == {("F1", "u1", "Tech"), ("Top", "u3", None)}
    page = '<link rel="alternate" type="application/rss+xml" title="My RSS Feed" href="../feed.xml"/>'
    pages = spark.createDataFrame([(1, "https://ex.com/a/b?x=1", page)], "page_id int, url string, html string")
    assert feeds.discover_feeds(pages).first() == (1, "My RSS Feed", "https://ex.com/feed.xml")


def test_merge_knows_guid_link_and_time(spark):
    schema = "item_id int, feed_id string, guid string, link string, title string, published_at timestamp, is_vip boolean"
    stored = spark.createDataFrame([(0, "f", "g1", "l1", "t1", FETCHED, False)], schema)
    incoming = spark.createDataFrame(
        [(1, "f", " g1 ", "x", "a", FETCHED, False), (2, "f", "new", "l1", "b", FETCHED, False), (3, "f", None, None, "t1", FETCHED, False),
         (4, "f", " ", "", "fresh", FETCHED, False), (5, "other", "g1", "l1", "t1", FETCHED, False),
         (6, "f", "n", "n", "Black Friday deals", FETCHED, False), (7, "f", "v", "v", "Black Friday deals", FETCHED, True)], schema)
    judged = {r.item_id: r.reason for r in merge.merge_reasons(incoming, stored).collect()}
    assert judged == {1: "dup_guid", 2: "dup_link", 3: "dup_fallback", 4: "inserted", 5: "inserted", 6: "noise", 7: "inserted"}


def test_repeated_batches_leave_the_same_tables(spark, tmp_path):
    run = refresh.refresh_batch(str(tmp_path))
    long = RSS.replace("<title>Two</title>", "<title>A headline that is long enough to be sent</title>")
    batches = [payloads(spark, ("rss", RSS), ("bad", "<html></html>")), payloads(spark, ("rss", long), ("atom", ATOM))]

    def tables():
        read = lambda df: sorted(map(str, df.collect()))
        kept = [read(refresh.stored_items(spark, str(tmp_path)).drop("batch"))]
        return kept + [read(refresh.newest(spark, f"{tmp_path}/{name}")) for name in ("snapshot", "unread")] + [read(spark.read.parquet(f"{tmp_path}/alerts"))]

    for number, batch in enumerate(batches):
        run(batch, number)
        once = tables()
        for gone in ("unread", "identities")[number:]:  # as if the batch had died before this write
            (tmp_path / gone / f"batch={number}").rename(tmp_path / f"lost-{gone}-{number}")
            run(batch, number)
            assert tables() == once
    items = refresh.stored_items(spark, str(tmp_path)).collect()
    assert sorted(r.title for r in items)[:2] == ["A & B", "A headline that is long enough to be sent"]
    assert all(r.discovered_at.replace(tzinfo=None) == FETCHED.replace(tzinfo=None) for r in items)
    assert spark.read.parquet(f"{tmp_path}/quarantine").first().reason == "unsupportedFormat"
    counts = {r.feed_id: r.unread for r in refresh.newest(spark, f"{tmp_path}/unread").collect()}
    assert sum(counts.values()) == len(items)
    states = {r.feed_id: r.refresh_error for r in refresh.newest(spark, f"{tmp_path}/state").collect()}
    assert states == {"rss": None, "atom": None, "bad": "unsupportedFormat"}


def test_fetches_merge_one_after_the_other(spark):
    """Against a plain loop over the fetches of each feed, with all three identities."""
    import random

    draw = random.Random(6)
    rows = []
    for i in range(160):
        some = lambda name, n: None if draw.random() < 0.2 else f" {name}{draw.randint(0, n)}"
        title = "Black Friday deals" if i % 17 == 0 else f"t{draw.randint(0, 30)}"
        rows.append((f"i{i:03d}", f"f{i % 3}", some("g", 25), title, some("l", 25), FETCHED, datetime(2024, 2, 1 + draw.randint(0, 5)), i % 34 == 0))
    names = ["item_id", "feed_id", "guid", "title", "link", "published_at", "discovered_at", "is_vip"]
    table = spark.createDataFrame(rows, "item_id string, feed_id string, guid string, title string, link string, published_at timestamp, discovered_at timestamp, is_vip boolean")
    stored = table.filter("item_id < 'i010'").withColumn("item_id", F.concat("item_id", F.lit("s")))
    found = {r.item_id: r.reason for r in merge.merge_in_order(table.filter("item_id >= 'i010'"), merge.identities(stored)).collect()}
    keys = lambda r: [(r["feed_id"], k, (r[n] or "").strip()) for k, n in enumerate(("guid", "link"))] + [(r["feed_id"], 2, r["title"])]
    known, want = set(), {}
    fetches = {}
    for row in (dict(zip(names, r, strict=True)) for r in rows):
        if row["item_id"] < "i010":
            known |= {k for k in keys(row) if k[2]}
        else:
            fetches.setdefault(row["discovered_at"], []).append(row)
    for _, items in sorted(fetches.items()):
        fresh = set()
        for row in items:
            hit = [k[1] for k in keys(row) if k[2] and k in known]
            noise = "Friday" in row["title"] and not row["is_vip"]
            want[row["item_id"]] = merge.REASONS[min(hit)] if hit else "noise" if noise else "inserted"
            if not hit and not noise:
                fresh |= {k for k in keys(row) if k[2]}
        known |= fresh
    assert found == want and set(want.values()) == {"inserted", "noise", *merge.REASONS}


def test_compaction_retention_and_sweep(spark, tmp_path, monkeypatch):
    """Removed items are gone from every table, come back as new ones, and folders do not pile up."""
    monkeypatch.setattr(refresh, "COMPACT", 1)
    vip = spark.createDataFrame([("rss",)], "feed_id string")
    noisy = RSS.replace("<title>Two</title>", "<title>Black Friday deals</title>")
    at = lambda day: spark.createDataFrame([("rss", datetime(2024, 3, day), noisy)], "feed_id string, fetched_at timestamp, body string")
    folder = str(tmp_path)
    refresh.refresh_batch(folder, vip)(at(1), 0)
    items = refresh.stored_items(spark, folder)
    assert items.count() == 2 and items.filter("is_vip").count() == 2
    old = items.orderBy("published_at").limit(1)
    refresh.record_events(old.select("item_id", "feed_id", F.lit(True).alias("set_read"), F.lit(datetime(2024, 3, 1)).alias("event_at"), F.lit("e").alias("event_id")), folder)
    read = old.first().item_id
    refresh.refresh_batch(folder)(at(20), 1)  # trusted no more: the sweep takes the promotional one, retention the read one if it is old
    gone = {r.item_id: r.why for r in spark.read.parquet(f"{folder}/removed/batch=1").collect()}
    left = {r.item_id for r in refresh.stored_items(spark, folder).collect()}
    assert "promotional" in gone.values() and not left & set(gone) and len(left) + len(gone) == 2
    refresh.refresh_batch(folder)(at(21), 2)
    again = refresh.stored_items(spark, folder).collect()
    assert not {r.item_id for r in again} & set(gone) and all(r.title != "Black Friday deals" for r in again)
    assert read not in gone or any(not r.is_read for r in again)
    unread = {r.feed_id: r.unread for r in refresh.newest(spark, f"{folder}/unread").collect()}
    assert unread == {"rss": sum(not r.is_read for r in again)}
    assert sorted(p.name for p in (tmp_path / "items").iterdir()) == ["batch=2"] and sorted(p.name for p in (tmp_path / "items-base").iterdir()) == ["upto=1", "upto=2"]


def test_blank_metadata_leaves_what_is_known(spark):
    before = spark.createDataFrame([("rss", "Known", "s", "d", "i", "u", "e", None)], "feed_id string, title string, site_url string, description string, icon_url string, url string, etag string, last_modified string")
    fetch = payloads(spark, ("rss", MINIMAL), ("new", MINIMAL)).withColumns({"status": F.lit(200), "etag": F.lit(None).cast("string"), "last_modified": F.lit("m"), "final_url": F.lit("u2")})
    found = {r.feed_id: r for r in refresh.merged_metadata(fetch, feeds.parse(fetch), before).collect()}
    assert found["rss"] == ("rss", "Known", "s", "d", "i", "u2", "e", "m") and found["new"].title is None


def test_refresh_keeps_state_readers_and_ledger(spark, tmp_path):
    readers = spark.createDataFrame([("r1", "rss"), ("r2", "rss"), ("r2", "none")], "reader_id string, feed_id string")
    run = refresh.refresh_batch(str(tmp_path), readers=readers)
    noisy = RSS.replace("<title>Two</title>", "<title>Black Friday deals</title>")
    schema = refresh.PAYLOAD_SCHEMA
    run(spark.createDataFrame([("rss", FETCHED, noisy, 200, "e1", None), ("down", FETCHED, None, 503, "x", None)], schema), 0)
    run(spark.createDataFrame([("rss", datetime(2024, 2, 2), None, 304, "e2", None)], schema), 1)
    state = {r.feed_id: (r.etag, r.last_success is not None, r.refresh_error, r.failures) for r in refresh.newest(spark, f"{tmp_path}/state").collect()}
    assert state == {"rss": ("e1", True, None, 0), "down": (None, False, "http 503", 1)}
    assert {(r.reader_id, r.unread) for r in refresh.newest(spark, f"{tmp_path}/unread").collect()} == {("r1", 1), ("r2", 1)}
    assert {r.reader_id for r in refresh.newest(spark, f"{tmp_path}/snapshot").collect()} == {"r1", "r2"}
    assert [(r.feed_id, r.n) for r in spark.read.parquet(f"{tmp_path}/ledger").filter("n > 0").collect()] == [("rss", 1)]
    assert [(r.feed_id, r.if_none_match) for r in refresh.validators(spark, str(tmp_path)).filter("if_none_match is not null").collect()] == [("rss", "e1")]


def test_alerts_are_the_first_of_the_feed(spark):
    rows = [(f"{9 - i}", "f", i, f"A plain headline number {i} of today", True) for i in range(9)]
    items = spark.createDataFrame(rows, "item_id string, feed_id string, position int, title string, is_starred boolean")
    items = items.withColumns({"is_vip": F.lit(True), "is_read": F.lit(False), "has_full_text": F.lit(False), "published_at": F.lit(FETCHED), "reading_minutes": F.lit(1), "snippet": F.lit("s"), "link": F.lit("https://e.com/x"), "summary": F.lit("s"), "content": F.lit("c"), "image_url": F.lit(None).cast("string"), "author": F.lit(None).cast("string")})
    assert sorted(r.position for r in refresh.qualifying_alerts(items).collect()) == [0, 1, 2, 3, 4]


def test_deep_outlines(spark):
    opml = "<opml><body>" + "".join(f'<outline text="L{i}">' for i in range(30)) + '<outline text="F" xmlUrl="u"/>' + "</outline>" * 30 + "</body></opml>"
    found = feeds.subscriptions(spark.createDataFrame([(1, opml), (2, "<opml><body>"), (3, None)], "doc_id int, body string")).collect()
    assert [(r.doc_id, r.title, r.xml_url, r.category) for r in found] == [(1, "F", "u", "L29")]


def test_cadence():
    assert refresh.cadence(None) == {"processingTime": "15 minutes"} and refresh.cadence(0) == {"availableNow": True}
    assert refresh.cadence(1) == {"processingTime": "5 minutes"} and refresh.cadence(500) == {"processingTime": "60 minutes"}


WORDY = " ".join(f"word{i}" for i in range(60)) + "."


def test_extraction(spark):
    page = (
        '<html><body><nav><ul><li>Menu entry that is long enough</li></ul></nav><div class="ad box"><p>Buy this now please</p></div>'
        f'<article><h2>Heading</h2><p>{WORDY}<p>Second paragraph &amp; more words here.</p><p><a href="#">See also this link list</a></p>'
        "<pre>\n  code  block kept as is, really\n</pre><li>short</li><h3>Trailing heading</h3></article></body></html>"
    )
    rows = [(1, "https://e.com/a", page), (2, "https://e.com/b", "<p>too short</p>"), (3, "ftp://e.com", page), (4, "https://e.com/d", None)]
    done = {r.page_id: r for r in extract.extract_articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [b.kind for b in done[1].blocks] == ["heading", "paragraph", "paragraph", "code"]
    assert done[1].blocks[2].text == "Second paragraph & more words here." and done[1].blocks[3].text == "  code  block kept as is, really"
    assert [done[i].status for i in (2, 3, 4)] == ["noReadableBody", "invalidURL", "fetchFailed"]


def test_regions_apart(spark):
    gap = "<div>" + "x" * 2500 + "</div>"
    page = f"<p>{WORDY}</p>{gap}<p>tiny footer with few words only</p>"
    frame = spark.createDataFrame([(1, "https://e.com", page)], "page_id int, url string, html string")
    assert extract.extract_articles(frame).first().text == WORDY


@pytest.mark.parametrize(
    "page",
    [
        '<script type="application/ld+json">{"@graph": [{"description": "no", "articleBody": "%s"}]}</script><p>x</p>' % WORDY,
        '<input type="hidden" name="Description" value="&lt;p&gt;%s&lt;/p&gt;">' % WORDY,
        '<script>var s = {"articleBody" : "%s"};</script>' % WORDY,
    ],
)
def test_embedded_bodies(spark, page):
    frame = spark.createDataFrame([(1, "https://e.com", page)], "page_id int, url string, html string")
    assert extract.extract_articles(frame).first().text == WORDY


def test_dates(spark):
    good = ["2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 04:04:05 +0100", "2024-01-02 03:04:05"]
    for shape in good:
        assert value(spark, dates.parse_feed_date(F.lit(shape))) == datetime(2024, 1, 2, 3, 4, 5), shape
    assert value(spark, dates.parse_feed_date(F.lit("2024"))) is None


def test_links(spark):
    ident = "0F8FAD5B-D9CB-469F-A165-70867728950E"
    target = lambda link: value(spark, urls.click_target(F.lit(link), ["rssreader"]))
    assert target("rssreader://all").kind == "all"
    assert target(f"rssreader://feed/{ident}") == ("feed", ident.lower())
    assert target(f"rssreader://article/{ident}") == ("article", ident.lower())
    assert target("https://example.com") is None
    none = F.lit(None).cast("string")
    assert value(spark, urls.favicon(F.lit("https://c.com/i.png"), none, none)) == "https://c.com/i.png"
    assert value(spark, urls.favicon(none, F.lit("https://s.com/x"), none)) == "https://s.com/favicon.ico"
    assert value(spark, urls.favicon(none, none, F.lit("https://f.com/rss"))) == "https://f.com/favicon.ico"


def test_entities_decode_once(spark):
    assert value(spark, text.decode_entities(F.lit("&amp;lt; &#x41;&#66; &nope; &#xD800;"))) == "&lt; AB &nope; &#xD800;"


def test_chunks(spark):
    long = "One sentence here. " * 30 + "x" * 900
    rows = chunks.chunk_rows(spark.createDataFrame([(1, long)], "id int, t string"), "t", 350).orderBy("chunk_no").collect()
    assert all(0 < len(r.chunk) <= 350 for r in rows)
    assert "".join(r.chunk for r in rows).replace(" ", "") == long.replace(" ", "")


def test_strict_corpus(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"articleID":"a","goldStoryID":"g","predictedClusterID":"p"}\n\n')
    assert corpus.read_corpus_strict(spark, str(tmp_path)).first() == ("a", "g", "p", "und")
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(ValueError, match="invalid JSON"):
        corpus.read_corpus_strict(spark, str(tmp_path))


def test_values_of_a_batch_are_python_objects_a_few_at_a_time():
    import weakref

    import pyarrow as pa

    from newsloom.functions import batches

    class Words(list):
        pass

    ids, most = [], 0

    def split(value):
        nonlocal most
        out = None if value is None else Words(value.split())
        if out is not None:
            ids.append(weakref.ref(out))
        most = max(most, sum(r() is not None for r in ids[-1_000:]))
        return out

    given = [None, "", *[f"a{i} b" for i in range(500)]]
    got = batches.each(pa.array(given, pa.string()), split, pa.list_(pa.string()))
    assert got.to_pylist() == [None if v is None else v.split() for v in given]
    assert most <= 2 * batches.AT_ONCE
    assert batches.each(pa.array([], pa.string()), split, pa.list_(pa.string())).to_pylist() == []


def test_large_profile_joins_its_frequent_words_where_the_texts_are(spark, monkeypatch):
    from newsloom.operators import language

    rows = [(1, "the cat the dog", "en"), (2, "le chat le chien", "fr"), (3, "the rare wordone", "en"), (4, "le mot unique", "fr"), (5, None, "en"), (6, "the le chat wordone", None), (7, "zzz", "fr"), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "id int, t string, lang string")
    profile = language.language_profile(docs.filter("id < 5"), "t", "lang")
    answer = lambda df: sorted((str(r.id), r.detected) for r in df.collect())
    small = answer(language.detect_language(docs, "id", "t", profile))
    monkeypatch.setattr(language, "MAP_SIDE_ROWS", 4)
    found = language.detect_language(docs, "id", "t", profile)
    assert answer(found) == small
    assert dict(small) == {"1": "en", "2": "fr", "3": "en", "4": "fr", "5": "und", "6": "en", "7": "und", "None": "und"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_an_arrival_is_one_micro_batch_however_many_tasks_write_it(spark, tmp_path):
    from newsloom.plans import stream_queries

    source = str(tmp_path / "corpus")
    for _ in range(2):
        stream_queries._arrive(spark.range(0, 100, 1, 12), source)
    assert len(list((tmp_path / "corpus").glob("*.parquet"))) <= 2 * stream_queries.FILES_PER_TRIGGER
    assert spark.read.parquet(source).count() == 200


def test_later_fetches_are_made_of_the_first(spark, monkeypatch, tmp_path):
    """Payloads are built from the documents once; what comes again and later is what the first fetch has written."""
    made = [(f"src7-{k}", k, datetime(2024, 2, 1), f"<title>Feed src7</title> {k} ") for k in range(3)]
    rows = spark.createDataFrame(made, "feed_id string, part bigint, fetched_at timestamp, body string").withColumn("body", F.concat("body", F.expr("uuid()")))
    monkeypatch.setattr(stream_queries, "payloads", lambda spark, sf: rows)
    monkeypatch.setattr(stream_queries, "run_dir", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(refresh, "start_refresh", lambda stream, folder: SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(refresh, "stored_items", lambda spark, folder: spark.createDataFrame([], "item_id string, feed_id string, position int"))
    monkeypatch.setattr(refresh, "record_events", lambda events, folder: None)
    stream_queries._refreshed(spark, "")
    found = spark.read.schema(refresh.PAYLOAD_SCHEMA).parquet(str(tmp_path / "payloads")).collect()
    assert len(found) == 3 + 6 + 3 and {r.status for r in found} == {200}
    for k in range(3):
        own, tag = [r for r in found if r.feed_id == f"src7-{k}"], f"e-src7-{k}"
        assert len({r.body[-36:] for r in own}) == 1
        assert sorted(r.etag or "" for r in own) == sorted([tag, tag, "", f"{tag}-2" if k % 2 == 0 else ""])


def test_a_page_is_searched_once_and_goes_no_further(spark):
    """A page is far longer than its text: one pattern goes over it per question, and steps after the scan do not carry it."""
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for column in (extract.lead_image(F.col("html"), F.col("url")), extract.amp_link(F.col("html"), F.col("url"))):
        plan = pages.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert len(re.findall(r"regexp_extract(?:_all)?\(html#", plan)) == 1
    plan = extract.embedded_bodies(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract(?:_all)?\(html#", plan)) <= 3
    assert "html" not in extract.page_blocks(pages).columns


def test_openings_in_any_case_are_found(spark):
    """The cheap search before a pattern misses nothing that the pattern finds."""
    body = " ".join(f"word{k}" for k in range(30))
    rows = [
        (1, f'<SCRIPT Type="application/LD+json">{{"articleBody": "{body} one"}}</SCRIPT><p>x</p>'),
        (2, f'<p>x</p><sCript>var a = {{"ARTICLEBODY" : "{body} two"}}</sCript>'),
        (3, f'<InPut name="description" value="&lt;p&gt;{body} three&lt;/p&gt;">'),
        (4, f'<!-- <p>{body} gone</p> --><p>{body} four</p><META name="og:image" content="/i.png"><LINK href="/amp" rel="amphtml">'),
        (5, f'<p>{body} five</p><META content="/k.png" property="twitter:image"><link rel="amphtml" href="/amp5">'),
        (6, None),
    ]
    pages = spark.createDataFrame([(i, f"https://e.example.com/{i}", h) for i, h in rows], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in extract.extract_articles(pages).collect()}
    ends = {i: (r["text"] or "").split(" ")[-1] for i, r in found.items()}
    assert ends == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: ""} and found[6]["status"] == "fetchFailed"
    assert found[4]["text"].count("word0") == 1
    assert [found[i]["lead_image"] for i in (3, 4, 5)] == [None, "https://e.example.com/i.png", "https://e.example.com/k.png"]
    links = {r[0]: r[1] for r in pages.select("page_id", extract.amp_link(F.col("html"), F.col("url"))).collect()}
    assert (links[3], links[4], links[5], links[6]) == (None, "https://e.example.com/amp", "https://e.example.com/amp5", None)
