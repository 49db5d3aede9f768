from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import curate, library, related
from newsloom.functions import rules
from newsloom.session import durable

NOW = datetime(2024, 5, 1, 12)
SCHEMA = (
    "reader_id int, item_id int, feed_id string, title string, link string, author string, image_url string, snippet string, "
    "reading_minutes int, has_full_text boolean, published_at timestamp, is_read boolean, is_starred boolean, is_vip boolean"
)
WORDS = "alpha bravo cobra delta eagle falcon gamma harbor island jungle kettle lemon magnet nickel orbit planet quartz river".split()


def item(n, hours=1.0, title=None, feed="f1", link="auto", read=False, starred=False, vip=False):
    title = title or f"{WORDS[n % 18]}{n} {WORDS[(n * 7) % 18]}{n}x {WORDS[(n * 5) % 18]}{n}y"
    link = f"https://e.com/{n}" if link == "auto" else link
    return (1, n, feed, title, link, None, None, None, None, False, NOW - timedelta(hours=hours), read, starred, vip)


def now():
    return F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def chosen(spark, rows, **kwargs):
    return {r.item_id for r in curate.curated(spark.createDataFrame(rows, SCHEMA), now()).collect()}


def test_noise_dropped_unless_starred(spark):
    title = "[Sponsored] The best offer of a long week"
    assert chosen(spark, [item(1, title=title), item(2), item(3, title=title, starred=True)]) == {2, 3}


def test_same_story_under_two_tracking_links_is_kept_once(spark):
    a = item(1, 1, "One title for both of them", "f1", "https://e.com/a?utm_source=x")
    b = item(2, 2, "Another title for this one", "f2", "https://e.com/a?utm_source=y")
    assert chosen(spark, [a, b]) == {1}


def test_stale_read_item_is_dropped(spark):
    assert chosen(spark, [item(1, 72, read=True), item(2, 2)]) == {2}


def test_duplicate_title_from_another_outlet_keeps_the_newer(spark):
    title = "Minister presents sweeping budget reform before parliament today"
    rows = [item(1, 5, title + " again", "f1"), item(2, 1, title, "f2"), item(3, 1.5)]
    assert chosen(spark, rows) == {2, 3}
    frame = spark.createDataFrame(rows, SCHEMA)
    picks = curate.curated_picks(frame, now())
    counts = {r.item_id: r.coverage_count for r in curate.coverage(frame, now(), picks).collect()}
    assert counts == {2: 2, 3: 1}


def test_large_library_keeps_between_25_and_75(spark):
    rows = [item(i, 0.1 * i, feed=f"f{i % 10}", read=i > 300) for i in range(976)]
    assert 25 <= len(chosen(spark, rows)) <= 80


def test_firehose_leaves_room_for_small_feeds(spark):
    rows = [item(i, i / 60, feed="big") for i in range(200)]
    rows += [item(300 + i, 2, feed="small1") for i in range(5)] + [item(400 + i, 2, feed="small2") for i in range(5)]
    kept = chosen(spark, rows)
    assert any(300 <= n < 305 for n in kept) and any(400 <= n < 405 for n in kept)


@pytest.mark.parametrize("block", [1, 3, 500])
def test_rounds_do_not_change_the_pick(spark, block):
    rows = [
        item(i, (i * 37 % 400) / 3, feed=f"f{(i * i) % 4}", vip=i % 9 == 0, read=i % 4 == 0, starred=i % 31 == 0,
             title=" ".join(WORDS[(i * k) % 9] for k in (1, 2, 3, 5)) if i % 3 else None,
             link=f"https://e.com/{i % 60}?utm_medium={i}")
        for i in range(120)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    picks = [r.item_id for r in curate.curated_picks(frame, now(), block).orderBy("position").collect()]
    assert picks == by_hand(frame)


def by_hand(frame):
    """Plain sequential pick over collected rows."""
    pool = curate.candidates(frame, now()).orderBy(*curate.best_first()).collect()
    limits = curate.budgets(curate.scored(frame, now())).first()
    kept = []

    def likeness(a, b):
        shared = len(set(a) & set(b))
        return shared / len(set(a) | set(b)) if shared >= 3 else 0

    for row in pool:
        if len(kept) == limits.budget:
            break
        full = sum(k.source_key == row.source_key for k in kept) >= limits.source_cap * (2 if row.is_vip else 1)
        if full or any(k.link_key == row.link_key or k.title_key == row.title_key for k in kept):
            continue
        near = [
            k for k in kept
            if len(row.tokens) >= 3 and abs((k.published_at - row.published_at).total_seconds()) <= 172800
            and likeness(row.tokens, k.tokens) >= 0.3
        ]
        if any(k.source_key != row.source_key and min(len(k.tokens), len(row.tokens)) >= 4 and likeness(k.tokens, row.tokens) >= 0.65 for k in near):
            continue
        if not row.is_vip and len(near) >= limits.topic_cap:
            continue
        kept.append(row)
    return [k.item_id for k in kept]


def test_alert_rules(spark):
    cases = [
        (item(1, title="A calm and thorough report on harbours"), True), (item(2, title="[Sponsored] A long enough headline"), False),
        (item(3, title="Sponsorlu içerik: yeni ürünler burada"), False), (item(4, title="You won't believe what the mayor did"), False),
        (item(5, title="Short title"), False), (item(6, title="Short title", starred=True), True),
    ]
    frame = spark.createDataFrame([c for c, _ in cases], SCHEMA)
    found = {r.item_id: r.ok for r in frame.select("item_id", rules.may_alert().alias("ok")).collect()}
    assert found == {c[1]: want for c, want in cases}


def test_filter_matrix(spark):
    rows = [item(1, feed="a"), item(2, feed="a", read=True), item(3, feed="b", read=True, starred=True, vip=True)]
    frame = spark.createDataFrame(rows, SCHEMA)

    def ids(**kwargs):
        return {r.item_id for r in frame.filter(library.config_predicate(library.FilterConfig(**kwargs), now())).collect()}

    assert ids() == {1, 2, 3}
    assert ids(include_unread=True) == {1}
    assert ids(include_unread=True, include_starred=True) == {1, 3}
    assert ids(excluded_feeds=["a"]) == {3}
    assert ids(only_vip_feeds=True) == {3}
    with_images = frame.withColumn("image_url", F.when(F.col("item_id") == 1, "https://e/x.png").when(F.col("item_id") == 2, "   "))
    media = library.config_predicate(library.FilterConfig(only_with_media=True), now())
    assert {r.item_id for r in with_images.filter(media).collect()} == {1}


def test_retention_matrix(spark):
    day = 24
    rows = [item(1, 40 * day, read=True), item(2, 10 * day, read=True), item(3, 40 * day, read=True, starred=True), item(4, 40 * day), item(5, 365 * day, read=True)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.item_id for r in library.retain(frame, 30, 180, now()).collect()} == {2, 3, 4}
    assert library.retain(frame, 0, 0, now()).count() == 5
    report = library.pruning_report(frame, 30, 180, now()).first()
    assert (report.read_pruned, report.unread_pruned, report.total_pruned) == (2, 0, 2)


def test_snapshot_is_written_only_when_changed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    path = str(tmp_path / "snapshot")
    assert library.write_snapshot(rows, path)
    assert not library.write_snapshot(rows, path)
    assert not library.write_snapshot(rows.limit(0), path)
    assert library.write_snapshot(rows.withColumn("t", F.lit("c")), path)


def test_a_large_reader_is_met_in_parts_and_cut_before_it_moves(spark, monkeypatch):
    rows = [item(i, (i * 37 % 400) / 30, feed=f"f{(i * i) % 4}", title=" ".join(WORDS[(i * k) % 9] for k in (1, 2, 3, 5)) if i % 3 else None) for i in range(90)]
    rows = [*rows, (2, *item(900, 1)[1:]), (None, *item(901, 1)[1:])]
    frame = spark.createDataFrame(rows, SCHEMA)
    run = curate.prepared(frame, now())

    def found():
        picks = curate.curated_picks(frame, now(), 60, run=run)
        covered = curate.coverage(frame, now(), picks, run=run)
        near = related.related_to_picks(curate.of_run(run), picks)
        return [sorted(map(tuple, df.collect())) for df in (picks.select("reader_id", "item_id", "position"), covered, near)]

    whole = found()
    monkeypatch.setattr(curate, "JOINED_ROWS", 20)
    assert found() == whole and len(whole[0]) > 10
    with_settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_settings}
    try:
        for k, v in with_settings.items():
            spark.conf.set(k, v)
        limits = curate.budgets(run)
        joined = curate.with_reader(curate.of_run(run).filter("reader_id = 1"), limits, limits)
        assert joined.select(F.spark_partition_id()).distinct().count() > 1
        cut = []
        monkeypatch.setattr(curate, "durable", lambda df: cut.append(df) or durable(df))
        curate.curated_picks(frame, now(), run=run)
        best = cut[1]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in best[best.index(", Final") : best.index(", Partial")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
