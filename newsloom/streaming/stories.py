"""Story assignment on a stream, in event time: items wait until the watermark has passed them.

Every micro-batch is an ordinary job over three tables of the folder: the items that wait, the last states
of the stories that are open, and the clock. What the watermark has passed is folded in order of time,
in shards of what is similar (``newsloom.operators.stories``), so no corpus goes through one task. An
item that comes after the watermark cannot be replayed and goes to the table ``late``. Each table has one
folder per batch, made from earlier folders only: a batch that is repeated gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators import stories
from newsloom.session import durable
from newsloom.streaming.refresh import newest

_CLOCK = "batch_id bigint, mark bigint, seen bigint"
_COLUMNS = ["corpus_id", "item_id", "published_at", "publisher_key", "headline", "body", "combined", "actions", "signature"]


def _fold(spark: SparkSession, folder: str, batch_id: int, ready: DataFrame, mark: int, seen: int, threshold: float, window_seconds: int) -> int:
    """Assign ``ready`` after the stories open so far; returns how many items have been placed in all."""
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
    opened = newest(spark, f"{folder}/open", batch_id)
    items = durable(stories.in_order(ready, seen))
    found = stories.states(items, threshold, window_seconds, opened)
    write(stories.assigned(items, found, window_seconds).join(items.select("item_id", "corpus_id"), "item_id"), "assigned")
    last = found.filter((F.col("until") == stories.LAST) & (F.col("at_us") >= mark - window_seconds * 1_000_000))
    write(last, "open")
    return seen + items.count()


def assign_batch(folder: str, threshold: float, window_seconds: int, lateness_seconds: int = 0) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch of items (columns as in the batch operator).

    The watermark is the newest time seen so far less ``lateness_seconds``, over all corpora. Items before
    the last watermark are late, items before the new one are folded, the others wait. Rows without a time
    or a vector are late, too.
    """

    def run(arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        clock = newest(spark, f"{folder}/clock", batch_id)
        before = clock.first() if clock is not None else None
        if "signature" not in arrived.columns:
            arrived = arrived.withColumn("signature", F.lit(None).cast("array<double>"))
        rows = durable(arrived.select(*_COLUMNS).withColumn("_us", F.unix_micros("published_at")))
        newest_us = rows.agg(F.max("_us")).first()[0]
        mark, seen = (before.mark, before.seen) if before else (None, 0)
        if newest_us is not None:
            mark = max(newest_us - lateness_seconds * 1_000_000, mark if mark is not None else newest_us - lateness_seconds * 1_000_000)
        unusable = F.col("_us").isNull() | F.col("combined").isNull()
        late = unusable if before is None or before.mark is None else unusable | (F.col("_us") < before.mark)
        write(rows.filter(late).drop("_us"), "late")
        waiting = newest(spark, f"{folder}/waiting", batch_id)
        pending = rows.filter(~late)
        pending = pending if waiting is None else pending.unionByName(waiting)
        passed = F.coalesce(F.col("_us") < F.lit(mark).cast("bigint"), F.lit(False))
        write(pending.filter(~passed), "waiting")
        seen = _fold(spark, folder, batch_id, pending.filter(passed).drop("_us"), mark or 0, seen, threshold, window_seconds)
        write(spark.createDataFrame([(batch_id, mark, seen)], _CLOCK), "clock")

    return run


def start_assigning(items: DataFrame, folder: str, threshold: float, window_seconds: int, lateness_seconds: int = 0) -> StreamingQuery:
    """Run the assignment over a stream of items until all that is there has been taken in."""
    work = assign_batch(folder, threshold, window_seconds, lateness_seconds)
    return items.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).start()


def close(spark: SparkSession, folder: str, threshold: float, window_seconds: int) -> None:
    """Fold what still waits: nothing more will come. Done again, it changes nothing."""
    waiting = newest(spark, f"{folder}/waiting")
    if waiting is None or waiting.isEmpty():
        return
    clock = newest(spark, f"{folder}/clock").first()
    number = clock.batch_id + 1
    seen = _fold(spark, folder, number, waiting.drop("_us"), clock.mark, clock.seen, threshold, window_seconds)
    spark.createDataFrame([(number, clock.mark, seen)], _CLOCK).write.mode("overwrite").parquet(f"{folder}/clock/batch={number}")
    waiting.limit(0).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")


def streamed_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus_id, item_id, story_id, similarity, publisher_count, late) of all items placed or late so far."""
    columns = ["corpus_id", "item_id", "story_id", "similarity", "publisher_count"]
    done = spark.read.parquet(f"{folder}/assigned").select(*columns, F.lit(False).alias("late"))
    missed = spark.read.parquet(f"{folder}/late").select("corpus_id", "item_id")
    absent = [F.lit(None).cast("string").alias("story_id"), F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("publisher_count")]
    return done.unionByName(missed.select("corpus_id", "item_id", *absent, F.lit(True).alias("late")))
