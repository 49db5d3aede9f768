"""Corpus files: validation, stable ids, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.dates import parse_feed_date
from newsloom.functions.text import clean_collected, fold, squash
from newsloom.functions.urls import host
from newsloom.operators.ranking import keep_first, top_k


def stable_id(identity: Column) -> Column:
    """Name-based id: first half of SHA-256 with version 8 and the RFC variant set."""
    h = F.sha2(identity, 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("8"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def annotation_queue(
    corpus: DataFrame,
    labels: DataFrame,
    publisher: str | None = None,
    language: str | None = None,
    unlabelled_only: bool = False,
    needle: str = "",
) -> DataFrame:
    """Rows an annotator asks for: by publisher, language, missing label and text."""
    rows = corpus
    if publisher:
        rows = rows.filter(F.col("publisher_key") == publisher)
    if language:
        rows = rows.filter(F.col("language") == language)
    wanted = needle.strip().lower()
    if wanted:
        searched = [c for c in ["title", "summary", "publisher_key", "url"] if c in corpus.columns]
        rows = rows.filter(F.lower(F.concat_ws(" ", *searched)).contains(wanted))
    return rows.join(labels.select("id"), "id", "left_anti") if unlabelled_only else rows


REQUIRED = ["articleID", "goldStoryID", "predictedClusterID"]


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and problems of JSON-lines evaluation files.

    A record needs an object with three non-blank text fields; the language may be missing but not
    blank. Line numbers do not exist in a distributed read, so a problem names the file and the raw
    record, a duplicate id the number of extra records.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.filter(F.trim("value") != "").withColumn("doc", F.try_parse_json("value"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT<")), F.lit(False))

    def text_field(name: str) -> Column:
        raw = F.try_variant_get("doc", f"$.{name}", "variant")
        is_text = F.schema_of_variant(raw) == "STRING"
        trimmed = F.regexp_replace(F.try_variant_get("doc", f"$.{name}", "string"), f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")
        return F.when(is_text & (trimmed != ""), trimmed)

    language_raw = F.try_variant_get("doc", "$.language", "variant")
    parsed = lines.select(
        "value", "file",
        F.col("doc").isNull().alias("bad_json"),
        (F.col("doc").isNotNull() & ~is_object).alias("not_object"),
        *[text_field(name).alias(name) for name in REQUIRED],
        F.when(language_raw.isNull(), F.lit("und")).otherwise(F.lower(text_field("language"))).alias("language"),
    )
    checked = ~F.col("bad_json") & ~F.col("not_object")
    complete = F.lit(True)
    for name in REQUIRED:
        complete &= F.col(name).isNotNull()
    reasons = F.filter(
        F.array(
            F.when(F.col("bad_json"), "invalid JSON"),
            F.when(F.col("not_object"), "expected a JSON object"),
            *[F.when(checked & F.col(name).isNull(), f"missing or empty {name}") for name in REQUIRED],
            F.when(checked & complete & F.col("language").isNull(), "blank language"),
        ),
        F.isnotnull,
    )
    problems = parsed.select("file", F.col("value").alias("record"), F.explode(reasons).alias("reason"))
    repeated = (
        parsed.filter(F.col("articleID").isNotNull())
        .groupBy("articleID")
        .agg(F.count("*").alias("n"), F.min("file").alias("file"))
        .filter("n > 1")
        .select(
            "file", F.col("articleID").alias("record"),
            F.concat(F.lit("duplicate articleID, extra records: "), (F.col("n") - 1).cast("string")).alias("reason"),
        )
    )
    records = parsed.filter(checked & complete & F.col("language").isNotNull()).select(
        F.col("articleID").alias("article_id"), F.col("goldStoryID").alias("gold_story_id"),
        F.col("predictedClusterID").alias("predicted_cluster_id"), "language",
    )
    return records, problems.unionByName(repeated)


def read_corpus_strict(spark: SparkSession, path: str) -> DataFrame:
    """Records of clean files only; any problem or an empty input fails the whole load."""
    records, problems = read_corpus(spark, path)
    first = [f"{r.reason}: {r.record}" for r in problems.take(20)]
    if first:
        raise ValueError("input validation failed:\n- " + "\n- ".join(first))
    if records.isEmpty():
        raise ValueError("input contains no article records")
    return records


def predictions(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Evaluator rows: every labelled record, unassigned ones as singletons of their own."""
    joined = records.select("id", "gold_story_id").join(
        assignments.select("id", "story_id", F.col("language").alias("_language")), "id", "left"
    )
    ident = F.lower(F.col("id").cast("string"))
    return joined.select(
        ident.alias("article_id"), "gold_story_id",
        F.coalesce("story_id", F.concat(F.lit("unassigned-"), ident)).alias("predicted_cluster_id"),
        F.coalesce("_language", F.lit("und")).alias("language"),
    )


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines under the field names ``read_corpus`` expects."""
    rows.select(
        F.col("article_id").alias("articleID"), F.col("gold_story_id").alias("goldStoryID"),
        F.col("predicted_cluster_id").alias("predictedClusterID"), "language",
    ).write.json(path)


def collect_items(parsed: DataFrame, cutoff: Column, per_feed: int | None = 100) -> DataFrame:
    """Corpus rows of parsed feed items: titled, dated, recent; the first ``per_feed`` of each feed, or all.

    ``parsed``: feed_id, feed_url, position, title, summary, link, guid, source_url, date_text,
    language.
    """
    c = F.col
    title = clean_collected(c("title"))
    summary = clean_collected(c("summary"))
    link = F.coalesce(F.nullif(c("link"), F.lit("")), c("guid"), F.lit(""))
    publisher = F.coalesce(host(c("source_url")), host(c("feed_url")), F.lit("unknown.publisher"))
    rows = parsed.select(
        "feed_id", "position", title.alias("title"), F.nullif(F.substring(summary, 1, 4000), F.lit("")).alias("summary"),
        publisher.alias("publisher_key"), parse_feed_date(c("date_text")).alias("published_at"), link.alias("url"), "language",
    ).filter((F.col("title") != "") & (F.col("published_at") >= cutoff))
    first = rows if per_feed is None else top_k(rows, ["feed_id"], [F.col("position")], per_feed).drop("rank")
    identity = F.concat_ws("|", "publisher_key", F.when(F.col("url") == "", F.col("title")).otherwise(F.col("url")))
    return first.withColumn("id", stable_id(identity))


def distinct_stories(corpus: DataFrame) -> DataFrame:
    """Newest row per publisher and folded title."""
    keyed = corpus.withColumn("_title", squash(fold(F.col("title"))))
    return keep_first(keyed, ["publisher_key", "_title"], [F.col("published_at").desc(), F.col("id")]).drop("_title")


def balanced_sample(corpus: DataFrame, limit: int = 500, per_publisher: int = 30) -> DataFrame:
    """Round-robin over publishers in name order, ``limit`` rows in all, ranked newest first."""
    newest = [F.col("published_at").desc(), F.col("id")]
    rounds = top_k(corpus, ["publisher_key"], newest, per_publisher, "round")
    chosen = rounds.orderBy("round", "publisher_key").limit(limit)
    # At most ``limit`` rows are left, so one unpartitioned window is fine.
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*newest)))


def label_progress(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled and provisional rows of a corpus."""
    marked = corpus.join(labels.select("id", F.lit(True).alias("_labelled")), "id", "left")
    return marked.agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce("_labelled", F.lit(False))).alias("labelled"),
        F.count_if("provisional").alias("provisional"),
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("story").agg(F.count("*").alias("n"))


def collection_stats(fetched: DataFrame, unique: DataFrame, emitted: DataFrame) -> DataFrame:
    """Feeds that answered, unique and emitted rows of a collection run."""
    sides = [
        fetched.agg(F.count("*").alias("n_feeds"), F.count_if(F.col("error").isNull()).alias("ok_feeds")),
        unique.agg(F.count("*").alias("unique_items")),
        emitted.agg(F.count("*").alias("emitted_items")),
    ]
    out = sides[0].withColumn("_one", F.lit(1))
    for side in sides[1:]:
        out = out.join(side.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
