"""Views over assigned stories: groups, categories, metrics, read-time windows.

Memberships are rows (story_id, item_id), never arrays: a story may hold a large share of all items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.ranking import rank_all

MIN_ITEMS = 2
MIN_PUBLISHERS = 2


def groups(assignments: DataFrame) -> DataFrame:
    """Per story: items, distinct publishers, newest item.

    Publishers are made distinct first, so no task sees all rows of a large story.
    """
    per_publisher = assignments.groupBy("story_id", "publisher_key").agg(
        F.count("*").alias("n"), F.max("published_at").alias("newest_at")
    )
    return per_publisher.groupBy("story_id").agg(
        F.sum("n").alias("n_items"), F.count("publisher_key").alias("publisher_count"),
        F.max("newest_at").alias("newest_at"),
    )


def useful(story_groups: DataFrame) -> DataFrame:
    """Stories with independent coverage."""
    return story_groups.filter(
        (F.col("n_items") >= MIN_ITEMS) & (F.col("publisher_count") >= MIN_PUBLISHERS)
    )


def members(assignments: DataFrame, story_groups: DataFrame) -> DataFrame:
    """Members of the given stories with their position, newest first."""
    kept = assignments.join(story_groups.select("story_id"), "story_id", "left_semi")
    order = [F.col("published_at").desc(), F.col("item_id")]
    return rank_all(kept.select("story_id", "item_id", "published_at"), ["story_id"], order, "position")


def ordered_groups(story_groups: DataFrame) -> DataFrame:
    """Stories ranked by their newest item."""
    return rank_all(story_groups, [], [F.col("newest_at").desc(), F.col("story_id")], "rank")


def unassigned(recent: DataFrame, story_members: DataFrame) -> DataFrame:
    """Recent items outside every shown story."""
    return recent.join(story_members.select("item_id"), "item_id", "left_anti")


def _topic_rows(topics: DataFrame, story_members: DataFrame, unassigned_items: DataFrame) -> DataFrame:
    """(key, label, story_id or null, item_id) per topic mention of shown items."""
    in_story = topics.join(story_members.select("item_id", "story_id"), "item_id")
    alone = topics.join(unassigned_items.select("item_id"), "item_id").withColumn(
        "story_id", F.lit(None).cast(story_members.schema["story_id"].dataType)
    )
    rows = in_story.unionByName(alone)
    return rows.select(
        text.label_key(F.col("topic")).alias("key"), text.label_text(F.col("topic")).alias("label"), "story_id", "item_id"
    ).filter("key is not null")


def categories(topics: DataFrame, story_members: DataFrame, unassigned_items: DataFrame) -> DataFrame:
    """Daily categories (key, title, stories, items); the title is the most frequent spelling.

    ``topics`` has one row per (item_id, topic).
    """
    rows = _topic_rows(topics, story_members, unassigned_items)
    spelled = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    titles = spelled.groupBy("key").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("title"))
    linked = category_members(topics, story_members, unassigned_items)
    sizes = linked.groupBy("key").agg(
        F.count("story_id").alias("n_stories"), F.count("item_id").alias("n_items")
    )
    return titles.join(sizes, "key")


def category_members(topics: DataFrame, story_members: DataFrame, unassigned_items: DataFrame) -> DataFrame:
    """Rows (key, story_id, null) and (key, null, item_id) a category leads to."""
    rows = _topic_rows(topics, story_members, unassigned_items)
    item = F.when(F.col("story_id").isNull(), F.col("item_id")).alias("item_id")
    return rows.select("key", "story_id", item).distinct()


def rewindow_members(story_members: DataFrame, in_window: Column) -> DataFrame:
    """Members still recent when the stories are read."""
    return story_members.filter(in_window)


def rewindow_groups(story_groups: DataFrame, recent_members: DataFrame) -> DataFrame:
    """Stories with a recent member; the publisher count cannot exceed the members left."""
    left = recent_members.groupBy("story_id").agg(F.count("*").alias("n_left"))
    return story_groups.join(left, "story_id").select(
        "story_id", F.col("n_left").alias("n_items"), F.least("publisher_count", "n_left").alias("publisher_count")
    )


def rewindow_categories(linked: DataFrame, recent_groups: DataFrame, recent_items: DataFrame) -> DataFrame:
    """Category links that still lead somewhere; categories without any vanish."""
    stories = linked.filter("story_id is not null").join(recent_groups.select("story_id"), "story_id", "left_semi")
    items = linked.filter("item_id is not null").join(recent_items.select("item_id"), "item_id", "left_semi")
    return stories.unionByName(items, allowMissingColumns=True)


def readiness_metrics(assignments: DataFrame, min_body_words: int = 120) -> DataFrame:
    """Counts of one clustering run by readiness, body and digest."""
    state = F.col("readiness")
    ready = state == "ready"
    return assignments.agg(
        F.count("*").alias("analyzed"),
        F.count_if(ready & F.col("story_id").isNotNull()).alias("ready"),
        F.count_if(F.col("body_words") >= min_body_words).alias("with_body"),
        F.count_if("has_digest").alias("enriched"),
        F.count_if(state == "translationNotInstalled").alias("waiting_for_translation"),
        F.count_if(state == "unsupportedLanguage").alias("unsupported_language"),
        F.count_if(~state.isin("ready", "translationNotInstalled", "unsupportedLanguage")).alias("other_failures"),
    )


def readiness(words: Column, language: Column, pivot: str, translatable: Column) -> Column:
    """Whether a text can be compared: long enough, known language, pivot or translatable."""
    return (
        F.when(words < 8, "insufficientText")
        .when(language.isNull(), "unsupportedLanguage")
        .when((language == pivot) | translatable, "ready")
        .otherwise("translationNotInstalled")
    )


def coverage_windows(assignments: DataFrame, length: int = 72 * 3600, slide: int = 3600) -> DataFrame:
    """Distinct publishers per story in a sliding window of ``length`` seconds, exact.

    A publisher's step h opens the windows that start in the ``length`` before it, less those its
    previous step has opened: one +1 and one -1 per step. The running sum of a story's events is its number
    of publishers, and only the windows of the result are written out.
    """
    reach = length // slide
    step = F.floor(F.unix_seconds("published_at") / slide)
    steps = assignments.select("story_id", "publisher_key", step.alias("h")).distinct()
    before = F.lag("h").over(Window.partitionBy("story_id", "publisher_key").orderBy("h"))
    opened = F.greatest(F.coalesce(before + 1, F.col("h") - (reach - 1)), F.col("h") - (reach - 1))
    change = F.array(F.struct(opened.alias("at"), F.lit(1).alias("n")), F.struct((F.col("h") + 1).alias("at"), F.lit(-1).alias("n")))
    events = steps.select("story_id", change.alias("c")).select("story_id", F.inline("c")).groupBy("story_id", "at").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("story_id").orderBy("at")
    spans = events.select("story_id", "at", F.sum("n").over(order).alias("publisher_count"), F.lead("at").over(order).alias("until"))
    starts = F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("w")
    return spans.filter("publisher_count > 0").select("story_id", starts, "publisher_count").select(
        "story_id", F.timestamp_seconds(F.col("w") * slide).alias("window_start"), "publisher_count"
    )


# --- text that goes into clustering -------------------------------------------------------------


def analysis_text(title: Column, summary: Column, body: Column) -> Column:
    """Non-blank parts joined by blank lines, at most 12 000 characters."""
    trimmed = F.transform(F.array(title, summary, body), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.substring(F.array_join(F.filter(trimmed, lambda p: p != ""), "\n\n"), 1, 12_000)


def analysis_context(
    title: Column, summary: Column, body: Column, digest: Column, key_points: Column, same_language: Column
) -> Column:
    """Body, else summary, else title; a digest in the same language may follow a shortened body."""
    def clean(part: Column) -> Column:
        return F.nullif(F.regexp_replace(part, r"^\s+|\s+$", ""), F.lit(""))

    source = F.coalesce(clean(body), clean(summary), title)
    notes = F.filter(F.transform(F.concat(F.array(digest), F.coalesce(key_points, F.expr("array()"))), clean), F.isnotnull)
    joined = F.array_join(notes, "\n")
    head = F.substring(source, 1, 3_400)
    room = F.least(F.lit(600), F.greatest(F.lit(0), 4_000 - F.length(head) - 2))
    extended = F.concat(head, F.lit("\n\n"), joined.substr(F.lit(1), room))
    usable = (joined != "") & F.coalesce(same_language, F.lit(False))
    return F.when(usable, extended).otherwise(F.substring(source, 1, 4_000))


def preferred_body(extracted: Column, content: Column) -> Column:
    """The extracted text when long, else long feed content, else whatever there is."""
    def clean(part: Column) -> Column:
        return F.nullif(F.regexp_replace(part, r"^\s+|\s+$", ""), F.lit(""))

    plain = text.strip_tags(content)
    return text.bind(
        F.struct(extracted.alias("e"), plain.alias("c")),
        lambda s: F.coalesce(
            F.when(text.count_words(s["e"]) >= 120, clean(s["e"])),
            F.when(text.count_squashed(s["c"]) >= 120, clean(s["c"])),
            clean(s["e"]),
            clean(s["c"]),
        ),
    )


def body_words(extracted: Column, content: Column) -> Column:
    """Words of the preferred body: extracted when 120 and more, else content, else what exists."""
    own = text.count_words(extracted)
    feed = text.count_words(text.strip_tags(F.coalesce(content, F.lit(""))))
    return F.when(own >= 120, own).when(feed >= 120, feed).otherwise(F.coalesce(own, feed))
