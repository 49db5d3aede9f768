"""Evaluation of story groupings against labels, in closed form: pair counts come from group sizes,
so nothing is ever paired up. Input rows: article_id, gold_story_id, predicted_cluster_id, language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def pairs(n: Column) -> Column:
    """n choose 2, wide enough for groups of billions."""
    wide = n.cast("decimal(19,0)")
    return ((wide * (wide - 1)) / 2).cast(_WIDE)


def contingency(predictions: DataFrame) -> DataFrame:
    """Articles per (gold, predicted, language); everything below starts from this small table."""
    return predictions.groupBy("gold_story_id", "predicted_cluster_id", "language").agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def quality(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; null where undefined, F1 zero when either of them is."""
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(
        (precision == 0) | (recall == 0), F.lit(0.0)
    )
    return {"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6)}


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: true and false positive pairs, false negative pairs, group counts."""
    sizes = table.groupingSets(
        [["gold_story_id", "predicted_cluster_id"], ["predicted_cluster_id"], ["gold_story_id"]],
        "gold_story_id", "predicted_cluster_id",
    ).agg(F.sum("n").alias("size"), F.grouping_id().alias("level"))
    both, predicted, gold = F.col("level") == 0, F.col("level") == 2, F.col("level") == 1

    def total(level: Column) -> Column:
        return F.coalesce(F.sum(F.when(level, pairs(F.col("size")))), F.lit(0).cast(_WIDE))

    sums = sizes.agg(
        total(both).alias("tp"), total(predicted).alias("predicted_pairs"), total(gold).alias("gold_pairs"),
        F.count_if(predicted).alias("predicted_clusters"), F.count_if(gold).alias("gold_stories"),
        F.coalesce(F.sum(F.when(gold, F.col("size"))), F.lit(0)).alias("articles"),
    )
    return sums.withColumn("fp", F.col("predicted_pairs") - F.col("tp")).withColumn(
        "fn", F.col("gold_pairs") - F.col("tp")
    )


def pairwise_quality(counts: DataFrame) -> DataFrame:
    q = quality(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("tp", "fp", "fn", *[c.alias(name) for name, c in q.items()])


def _language_pairs(table: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Article pairs per unordered language pair within groups of ``keys``.

    The groups' counts per language meet each other, so no group is gathered and no article is paired.
    """
    same = [*keys, "_one"]
    sizes = table.groupBy(*keys, F.lit(1).alias("_one"), F.coalesce("language", F.lit("")).alias("language")).agg(F.sum("n").alias("n"))
    other = sizes.select(*same, F.col("language").alias("language_b"), F.col("n").alias("n_b"))
    both = sizes.join(other, same).filter("language <= language_b")
    cross = (F.col("n").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")).cast(_WIDE)
    n = F.when(F.col("language") == F.col("language_b"), pairs(F.col("n"))).otherwise(cross)
    return both.groupBy(F.concat_ws("|", "language", "language_b").alias("language_pair")).agg(
        F.sum(n).cast(_WIDE).alias("n")
    ).withColumn("kind", F.lit(kind))


def per_language_pair(table: DataFrame) -> DataFrame:
    """Confusion per language pair, without comparing articles."""
    parts = [
        _language_pairs(table, ["gold_story_id", "predicted_cluster_id"], "both"),
        _language_pairs(table, ["predicted_cluster_id"], "predicted"),
        _language_pairs(table, ["gold_story_id"], "gold"),
        _language_pairs(table, [], "all"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast(_WIDE)

    sums = rows.groupBy("language_pair").agg(
        of("all").alias("article_pairs"), of("both").alias("tp"),
        (of("predicted") - of("both")).alias("fp"), (of("gold") - of("both")).alias("fn"),
    ).filter(F.col("article_pairs") > 0)
    q = quality(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumn("scored_pairs", F.col("tp") + F.col("fp") + F.col("fn")).select(
        "*", *[c.alias(name) for name, c in q.items()]
    )


def clusters(table: DataFrame) -> DataFrame:
    """Per predicted cluster: articles, gold stories in it, articles outside the majority story."""
    by_pair = table.groupBy("predicted_cluster_id", "gold_story_id").agg(F.sum("n").alias("n"))
    return (
        by_pair.groupBy("predicted_cluster_id")
        .agg(F.sum("n").alias("articles"), F.count("*").alias("gold_stories"), F.max("n").alias("majority"))
        .withColumn("outside", F.col("articles") - F.col("majority"))
    )


def contaminated_clusters(table: DataFrame) -> DataFrame:
    """Clusters that mix gold stories, with the share of articles outside the majority."""
    return clusters(table).filter(F.col("gold_stories") > 1).select(
        "predicted_cluster_id", "articles", "gold_stories",
        F.round(F.col("outside") / F.col("articles"), 6).alias("contamination_rate"),
    )


def contaminating_stories(table: DataFrame) -> DataFrame:
    """Rows (cluster, gold story) of the contaminated clusters; rows, since a cluster may mix many."""
    mixed = contaminated_clusters(table).select("predicted_cluster_id")
    return table.select("predicted_cluster_id", "gold_story_id").distinct().join(mixed, "predicted_cluster_id", "left_semi")


def split_stories(table: DataFrame) -> DataFrame:
    """Gold stories spread over several clusters."""
    by_pair = table.select("gold_story_id", "predicted_cluster_id").distinct()
    return by_pair.groupBy("gold_story_id").agg(F.count("*").alias("clusters")).filter(F.col("clusters") > 1)


def report(predictions: DataFrame) -> DataFrame:
    """The one-row evaluation report; its lists are the tables of the functions above."""
    table = contingency(predictions)
    counts = pair_counts(table)
    mixed = clusters(table).agg(
        F.count_if(F.col("gold_stories") > 1).alias("contaminated_clusters"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("contaminated_articles"),
    )
    split = split_stories(table).agg(F.count("*").alias("split_stories"))
    q = quality(F.col("tp"), F.col("fp"), F.col("fn"))
    one = F.lit(1).alias("_one")
    # Three one-row tables, joined on a constant.
    joined = counts.select("*", one).join(mixed.select("*", one), "_one").join(split.select("*", one), "_one")
    c = F.col
    return joined.select(
        "articles", "tp", "fp", "fn", "predicted_pairs", "gold_pairs", "predicted_clusters", "gold_stories",
        *[col.alias(name) for name, col in q.items()],
        "contaminated_clusters",
        F.round(_ratio(c("contaminated_clusters"), c("predicted_clusters")), 6).alias("false_merge_rate"),
        F.round(_ratio(c("fp"), c("predicted_pairs")), 6).alias("false_positive_pair_rate"),
        "split_stories",
        F.round(_ratio(c("split_stories"), c("gold_stories")), 6).alias("false_split_rate"),
        "contaminated_articles",
        F.round(_ratio(c("contaminated_articles"), c("articles")), 6).alias("contamination_rate"),
    )


def narrow(df: DataFrame) -> DataFrame:
    """Pair counts back to ``bigint`` where they are known to fit."""
    return df.select(*[F.col(n).cast("bigint").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])
