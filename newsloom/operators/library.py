"""Library views: scopes, filters, search, sections, counts, retention, snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, rules, text
from newsloom.operators.ranking import rank_all, top_k

NEWEST_FIRST = ["published_at", "discovered_at"]


def newest_first() -> list[Column]:
    return [F.col("published_at").desc(), F.col("item_id")]


def scope(name: str, now: Column, zone: str = "UTC", feed_id: str | None = None) -> Column:
    """Predicate of a library scope; ``curated`` is a join, see the curation operators."""
    scopes = {
        "all": F.lit(True),
        "today": F.col("published_at") >= dates.start_of_day(now, zone),
        "unread": ~F.col("is_read"),
        "starred": F.col("is_starred"),
        "one_feed": F.col("feed_id") == F.lit(feed_id),
    }
    return scopes[name]


@dataclass(frozen=True)
class FilterConfig:
    """Reader's filter; unread and starred widen each other, the rest narrow."""

    include_unread: bool = False
    include_starred: bool = False
    only_today: bool = False
    only_with_media: bool = False
    only_vip_feeds: bool = False
    excluded_feeds: list[str] = field(default_factory=list)


def config_predicate(config: FilterConfig, now: Column, zone: str = "UTC") -> Column:
    keep = F.lit(True)
    if config.excluded_feeds:
        keep &= F.col("feed_id").isNull() | ~F.col("feed_id").isin(config.excluded_feeds)
    if config.include_unread or config.include_starred:
        wanted = F.lit(False)
        if config.include_unread:
            wanted |= ~F.col("is_read")
        if config.include_starred:
            wanted |= F.col("is_starred")
        keep &= wanted
    if config.only_today:
        start, end = dates.start_of_day(now, zone), dates.start_of_day(now, zone, -1)
        keep &= (F.col("published_at") >= start) & (F.col("published_at") < end)
    if config.only_with_media:
        keep &= F.coalesce(text.squash(F.col("image_url")) != "", F.lit(False))
    if config.only_vip_feeds:
        keep &= F.col("is_vip")
    return keep


def with_vip(items: DataFrame, vip_feeds: DataFrame) -> DataFrame:
    """Flag items of feeds their reader trusts."""
    marks = vip_feeds.select("reader_id", "feed_id", F.lit(True).alias("is_vip"))
    return items.drop("is_vip").join(marks, ["reader_id", "feed_id"], "left").withColumn(
        "is_vip", F.coalesce("is_vip", F.lit(False))
    )


def only_vip(items: DataFrame, vip_feeds: DataFrame) -> DataFrame:
    return items.join(vip_feeds, ["reader_id", "feed_id"], "left_semi")


def exclude_feeds(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop items of feeds in a (reader_id, feed_id) table, for exclusion lists of any size."""
    return items.join(excluded, ["reader_id", "feed_id"], "left_anti")


def search(items: DataFrame, feeds: DataFrame, needle: str, hide_read: bool = False) -> DataFrame:
    """Case-insensitive substring over the item's texts and its feed's title."""
    titles = feeds.select("feed_id", F.col("title").alias("_feed_title"))
    wanted = needle.strip().lower()
    fields = ["title", "translated_title", "author", "snippet", "summary", "_feed_title"]
    hit = F.lit(False)
    for name in fields:
        hit |= F.coalesce(F.lower(name).contains(wanted), F.lit(False))
    rows = items.filter(~F.col("is_read")) if hide_read else items
    return rows.join(titles, "feed_id", "left").filter(hit).drop("_feed_title")


def recent_window(published_at: Column, now: Column, zone: str = "UTC") -> Column:
    """Published between local midnight yesterday and now, both included."""
    return published_at.between(dates.start_of_day(now, zone, 1), now)


def section(published_at: Column, now: Column, zone: str = "UTC") -> Column:
    return (
        F.when(published_at >= dates.start_of_day(now, zone), "today")
        .when(published_at >= dates.start_of_day(now, zone, 1), "yesterday")
        .when(published_at >= dates.start_of_day(now, zone, 7), "thisWeek")
        .otherwise("older")
    )


def timeline(items: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Rows (reader_id, section, position, item_id), newest first within a section.

    Rows, not arrays: one section may hold most of a library.
    """
    narrow = items.select(
        "reader_id", "item_id", "published_at", section(F.col("published_at"), now, zone).alias("section")
    )
    return rank_all(narrow, ["reader_id", "section"], newest_first(), "position").select(
        "reader_id", "section", "position", "item_id"
    )


def unread_counts(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Unread items per feed, per folder and in total, in one pass.

    Counts are taken per feed before the folder join, so the join is small whatever the items are.
    """
    per_feed = items.groupBy("reader_id", "feed_id").agg(F.count_if(~F.col("is_read")).alias("n"))
    folders = feeds.select("feed_id", F.coalesce(F.trim("category"), F.lit("")).alias("folder"))
    joined = per_feed.join(folders, "feed_id", "left")
    levels = F.when(F.grouping("folder") == 1, "reader").when(F.grouping("feed_id") == 1, "folder").otherwise("feed")
    return (
        joined.groupingSets([["reader_id", "folder", "feed_id"], ["reader_id", "folder"], ["reader_id"]], "reader_id", "folder", "feed_id")
        .agg(F.sum("n").alias("unread"), levels.alias("level"))
        .select("reader_id", "level", "folder", "feed_id", "unread")
    )


def library_counts(items: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Per reader: unread, unread of today, starred."""
    unread = ~F.col("is_read")
    return items.groupBy("reader_id").agg(
        F.count_if(unread).alias("unread"),
        F.count_if(unread & scope("today", now, zone)).alias("unread_today"),
        F.count_if("is_starred").alias("starred"),
    )


def folder_sizes(feeds: DataFrame) -> DataFrame:
    """Feeds per folder; the empty name holds the uncategorised ones."""
    return feeds.groupBy(F.coalesce(F.trim("category"), F.lit("")).alias("folder")).agg(F.count("*").alias("n_feeds"))


def feed_freshness(items: DataFrame) -> DataFrame:
    return items.groupBy("feed_id").agg(F.max("published_at").alias("newest_at"))


def retain(items: DataFrame, read_days: int, unread_days: int, now: Column) -> DataFrame:
    """Items that retention keeps."""
    return items.filter(~(rules.expired("read", read_days, now) | rules.expired("unread", unread_days, now)))


def pruning_report(items: DataFrame, read_days: int, unread_days: int, now: Column) -> DataFrame:
    """How many items retention removes."""
    counts = items.agg(
        F.count_if(rules.expired("read", read_days, now)).alias("read_pruned"),
        F.count_if(rules.expired("unread", unread_days, now)).alias("unread_pruned"),
    )
    return counts.withColumn("total_pruned", F.col("read_pruned") + F.col("unread_pruned"))


def promotional_history(items: DataFrame, vip_feeds: DataFrame) -> DataFrame:
    """Stored items the promotional sweep removes: not starred, not of a trusted feed."""
    noise = ~F.col("is_starred") & rules.is_promotional(F.col("title"), F.col("link"))
    return items.filter(noise).join(vip_feeds, ["reader_id", "feed_id"], "left_anti")


def cleanup_delta(ledger: DataFrame, last_reported_at: Column, now: Column) -> DataFrame:
    """Lifetime total and, when a week has passed, what was cleaned since the last report."""
    week = F.make_dt_interval(F.lit(7))
    due = (last_reported_at.isNull()) | (now - last_reported_at >= week)
    fresh = last_reported_at.isNull() | (F.col("cleaned_at") > last_reported_at)
    sums = ledger.agg(
        F.sum("n").alias("lifetime"), F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("delta")
    )
    return sums.select("lifetime", F.when(due & (F.col("delta") > 0), F.col("delta")).alias("reported"))


def top_lists(items: DataFrame, size: int) -> DataFrame:
    """Newest ``size`` items per reader."""
    return top_k(items, ["reader_id"], newest_first(), size)


def snapshot(items: DataFrame, feeds: DataFrame, size: int = 10) -> DataFrame:
    """Newest items per reader as small display rows."""
    order = [F.col("published_at").desc(), F.col("discovered_at").desc(), F.col("item_id")]
    titles = feeds.select("feed_id", F.col("title").alias("feed_title"))
    best = top_k(items, ["reader_id"], order, size)
    return best.join(titles, "feed_id", "left").select(
        "reader_id", "rank", "item_id", "title", F.coalesce("feed_title", F.lit("Feed")).alias("feed_title"),
        "published_at", text.snippet(F.col("summary"), F.col("content"), 180).alias("summary"), "is_read",
    )


def write_snapshot(rows: DataFrame, path: str) -> bool:
    """Replace the snapshot at ``path`` when it is non-empty and differs; true when written.

    A snapshot has ten rows per reader; content is compared by a distributed checksum.
    """
    from newsloom.session import durable

    spark = rows.sparkSession
    fresh = durable(rows)
    if fresh.isEmpty():
        return False

    def fingerprint(df: DataFrame):
        hashed = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
        return df.agg(F.count("*"), F.sum(hashed)).first()

    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop_path) and fingerprint(spark.read.parquet(path)) == fingerprint(fresh):
        return False
    fresh.write.mode("overwrite").parquet(path)
    return True
