"""Orders within a group that hold when one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import durable


#: Up to this many rows per group Spark cuts a group down in every task before it is shuffled.
CUT_BY_SPARK = 1_000
PARTS = 32
#: Rows per group and slice up to which their offsets are broadcast.
MAP_SIDE_ROWS = 200_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    ``row_number() <= k`` lets Spark keep only ``k`` rows per group in every task before the
    shuffle, so a hot group never travels whole. A larger ``k`` is first taken in parts of each group.
    """
    if k > CUT_BY_SPARK:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        inner = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= k).drop("_part", "_n")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every group."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def rank_all(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``row_number`` of every row within its group, every group spread over many tasks.

    ``order`` must be unique within a group. The rows are held while the ranges are sampled, so their plan
    runs once; they move range-partitioned by group and order, so a hot group becomes many consecutive
    slices, and are numbered where they then lie. What turns these numbers into ranks is one row per group
    and slice, broadcast while they fit ``MAP_SIDE_ROWS``; only for more groups the rows move again.
    The slices are checkpointed because a recomputed range partitioning may cut elsewhere.
    """
    held = df.withColumn("_all", F.lit(0)).persist()
    by = keys or ["_all"]
    sort = [*[F.col(k) for k in by], *order]
    slices = held.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = durable(slices.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held.unpersist()
    groups = rows.groupBy("_slice", *by).agg(F.min("_at").alias("_begin"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_begin") + 1
    bases = durable(groups.select(F.col("_slice").alias("_in"), *[F.col(k).alias(f"_k_{k}") for k in by], base.alias("_base")))
    bases = F.broadcast(bases) if bases.limit(MAP_SIDE_ROWS + 1).count() <= MAP_SIDE_ROWS else bases
    same = F.col("_slice") == F.col("_in")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(bases, same).withColumn(out, F.col("_at") + F.col("_base")).select(*df.columns, out)
