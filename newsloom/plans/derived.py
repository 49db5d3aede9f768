"""Domain tables derived from the given test tables, once for Spark and once as oracle SQL.

``documents`` has no dates, links or flags, so they come from arithmetic on ``doc_id`` that both
engines repeat exactly. Nothing is dropped: every document is an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text

NOW_TEXT = "2024-01-31 00:00:00"
BASE_SECONDS = 1704067200  # 2024-01-01 UTC


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; the columns a query does not name are pruned away again."""
    doc = F.col("doc_id")
    id_text = doc.cast("string")
    first_line = F.substring_index("text", "\n", 1)
    words = F.array_join(F.slice(F.split(first_line, " ", -1), 1, 12), " ")
    title = (
        F.when(doc % 23 == 0, F.concat(F.lit("[Sponsored] "), words))
        .when(doc % 29 == 0, F.concat(F.lit("You won't believe "), words))
        .when(doc % 31 == 0, F.substring(words, 1, 10))
        .otherwise(words)
    )
    link_id = F.when((doc % 9 == 0) & (doc >= 40), doc - 40).otherwise(doc).cast("string")
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
    link = (
        F.when(doc % 41 == 0, F.concat(site, F.lit("/sponsored/"), id_text))
        .when(doc % 37 == 0, F.lit(None))
        .otherwise(F.concat(site, F.lit("/a/"), link_id, F.lit("?utm_source=x&id="), link_id, F.lit("#top")))
    )
    published = F.timestamp_seconds(F.lit(BASE_SECONDS) + (doc * 37 % 720) * 3600)
    lines = F.filter(F.split("text", "\n", -1), lambda s: s != "")
    base = table(spark, sf_dir, "documents").select(
        doc.alias("item_id"),
        (doc % 8).alias("reader_id"),
        F.col("source").alias("feed_id"),
        F.when(doc % 35 == 0, F.lit("  ")).when(doc % 5 != 0, F.concat(F.lit("g"), id_text)).alias("guid"),
        title.alias("title"),
        F.when(doc % 19 == 0, F.concat(F.lit("Translated "), words)).alias("translated_title"),
        link.alias("link"),
        F.when(doc % 13 != 0, F.concat(F.lit("Author "), (doc % 50).cast("string"))).alias("author"),
        F.when(doc % 10 != 0, F.concat(F.lit("<p>"), first_line, F.lit("</p>Read&nbsp;on &amp; more&hellip;"))).alias(
            "summary"
        ),
        F.when(
            doc % 7 != 0, F.concat(F.lit("<div><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>"))
        ).alias("content"),
        F.when(doc % 4 == 0, F.concat(F.lit("https://img.example.com/"), id_text, F.lit(".jpg")))
        .when(doc % 4 == 1, F.lit("   "))
        .alias("image_url"),
        published.alias("published_at"),
        (published + F.make_dt_interval(mins=(doc % 50).cast("int"))).alias("discovered_at"),
        (doc % 3 == 0).alias("is_read"),
        (doc % 17 == 0).alias("is_starred"),
        (doc % 6 == 0).alias("has_full_text"),
        F.when(doc % 6 == 0, lines).alias("block_texts"),
        F.when(doc % 11 == 0, now() - F.expr("interval 3 hours"))
        .when(doc % 11 == 1, now() - F.expr("interval 30 hours"))
        .alias("extraction_attempted_at"),
        F.col("lang").alias("language"),
        F.col("text").alias("body_text"),
        ((source_number() + doc % 8) % 6 == 0).alias("is_vip"),
    )
    return base.withColumn("snippet", text.snippet(F.col("summary"), F.col("content"))).withColumn(
        "reading_minutes", text.reading_minutes(F.col("content"))
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document source."""
    n = source_number()
    s = F.col("source")
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            s.alias("feed_id"),
            F.concat(F.lit("Feed "), s).alias("title"),
            F.concat(F.lit("https://"), s, F.lit(".example.com/rss")).alias("url"),
            F.when(n % 3 != 0, F.concat(F.lit("https://www."), s, F.lit(".example.com/"))).alias("site_url"),
            F.when(n % 4 == 0, "Tech").when(n % 4 == 1, " World ").when(n % 4 == 2, "").alias("category"),
            F.when(n % 5 == 0, F.concat(F.lit("https://cdn.example.com/"), s, F.lit(".png")))
            .when(n % 5 == 1, F.lit("icon.png"))
            .alias("icon_url"),
            (n % 10 != 9).alias("enabled"),
        )
    )


def vip_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds each reader trusts."""
    return (
        table(spark, sf_dir, "documents")
        .select((F.col("doc_id") % 8).alias("reader_id"), F.col("source").alias("feed_id"), source_number().alias("n"))
        .distinct()
        .filter((F.col("n") + F.col("reader_id")) % 6 == 0)
        .select("reader_id", "feed_id")
    )
