"""Event-time windows shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.story_views import coverage_windows


def weekly_cleanup(ledger: DataFrame) -> DataFrame:
    """Promotional items cleaned per week; ``ledger``: cleaned_at, n."""
    week = F.window("cleaned_at", "7 days").alias("week")
    return ledger.groupBy(week).agg(F.sum("n").alias("cleaned")).select(F.col("week.start").alias("week_start"), "cleaned")


def start_coverage(assignments: DataFrame, folder: str) -> StreamingQuery:
    """Keep the hours in which a publisher covered a story, from a stream of assignments.

    A batch writes its distinct (story, publisher, hour) rows to a folder of its own, which it
    overwrites when it is done again. Nothing is too late: an old hour is one more row.
    """

    def keep(rows: DataFrame, batch_id: int) -> None:
        hours = rows.select("story_id", "publisher_key", F.date_trunc("hour", "published_at").alias("published_at")).distinct()
        hours.write.mode("overwrite").parquet(f"{folder}/hours/batch={batch_id}")

    return assignments.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).start()


def streamed_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """All coverage windows of what has been taken in so far, as the batch operator gives them."""
    return coverage_windows(spark.read.parquet(f"{folder}/hours"))
