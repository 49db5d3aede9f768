"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows partition p sends to shard j is drawn first: row p of the matrix is hypergeometric in what the
shards still lack after the rows before it. A partition then deals its rows by a random permutation, rows are
exchanged, and every shard permutes what it got. All permutations of the rows are equally likely, and the
sizes are those that were asked for, not about those.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.session import run_dir

#: Partitions whose rows of the matrix are drawn together, and rows of a shard that one task orders.
GROUP, BLOCK = 64, 10_000


def hypergeometric(random: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` out of ``good + bad`` are good, by inversion around the most likely value.

    Probabilities follow from the ratio of neighbours, twelve standard deviations and 64 values to each
    side; what lies beyond is less likely than 1e-30. Numbers of any size will do.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (good + 1) * (drawn + 1) // (total + 2)))
    spread = sqrt(drawn * (good / total) * (bad / total) * max(0, total - drawn) / max(1, total - 1))
    reach = int(12 * spread) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    fall = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    mass = np.concatenate([fall[::-1], [1.0], rise])
    reached = np.cumsum(mass)
    at = int(np.searchsorted(reached, random.random() * reached[-1], "right"))
    return mode - len(fall) + min(at, len(mass) - 1)


def deal(random: np.random.Generator, lacking: list[int], rows: int) -> list[int]:
    """How many of ``rows`` uniformly chosen places lie in each shard; ``lacking`` are the free places."""
    out, rest = [], sum(lacking)
    for free in lacking:
        rest -= free
        out.append(hypergeometric(random, free, rest, rows))
        rows -= out[-1]
    return out


def matrix(counts: Iterable[int], lacking: list[int], *seed: int) -> list[list[int]]:
    """One row of counts per partition; row sums are ``counts``, column sums at most ``lacking``."""
    random, lacking, out = np.random.default_rng(seed), list(lacking), []
    for rows in counts:
        out.append(deal(random, lacking, rows))
        lacking = [a - b for a, b in zip(lacking, out[-1], strict=True)]
    return out


def sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _dealt(numbered: DataFrame, counts: dict[int, int], shards: int, seed: int) -> DataFrame:
    """Adds ``_shard``. ``counts``: rows of each partition; rows carry (``_part``, ``_at``).

    The driver draws for groups of ``GROUP`` partitions; a task draws the rows of the matrix of the group
    it is in. All draws follow from the seed, so a task that is run again deals the same way.
    """
    parts = sorted(counts)
    places = {p: divmod(k, GROUP) for k, p in enumerate(parts)}
    grouped = [[counts[p] for p in parts[k : k + GROUP]] for k in range(0, len(parts), GROUP)]
    totals = matrix([sum(g) for g in grouped], sizes(sum(counts.values()), shards), seed, 0)
    shared = numbered.sparkSession.sparkContext.broadcast((places, grouped, totals))
    schema = T.StructType([*numbered.schema, T.StructField("_shard", T.IntegerType())])
    part_at, place_at = numbered.columns.index("_part"), numbered.columns.index("_at")

    def run(batches):
        places, grouped, totals = shared.value
        drawn: dict[int, list[list[int]]] = {}
        current, labels = None, None
        for batch in batches:
            part, place = batch.column(part_at).to_numpy(), batch.column(place_at).to_numpy()
            out = np.zeros(len(part), np.int32)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True):
                p = int(part[start])
                if p != current:
                    g, k = places[p]
                    if g not in drawn:
                        drawn = {g: matrix(grouped[g], totals[g], seed, 1, g)}
                    labels = np.repeat(np.arange(shards, dtype=np.int32), drawn[g][k])
                    np.random.default_rng([seed, 2, p]).shuffle(labels)
                    current = p
                out[start:stop] = labels[place[start:stop]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return numbered.mapInArrow(run, schema)


def shuffled(docs: DataFrame, shards: int, seed: int = 1, block: int = BLOCK, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard): a uniform random order.

    Shards differ by one row at most. Every row counts, whatever it holds: null ids, empty texts and
    repeated rows are dealt like any other; an empty table gives an empty one. Columns that have the name
    of a new one are replaced. Which order comes out depends on the seed and on how the rows lie in their
    partitions.

    Rows are written once with the partition and place they had, so that these stay the same when a
    lost task is repeated. They are exchanged once, to (shard, block): a row's random key gives both its
    block and its order there, and a shard has so many blocks that none gets much over ``block`` rows.
    The driver holds one count per partition of the input, and per block of all shards nothing.
    """
    spark = docs.sparkSession
    taken = {shard.lower(), slot.lower(), "_part", "_at", "_shard", "_block", "_key", "_before"}
    given = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])
    place = F.monotonically_increasing_id()
    folder = run_dir(spark, "shuffled")
    given.withColumn("_part", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    counts = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // (shards * block)))
    key = F.xxhash64(F.lit(seed), "_part", "_at")
    in_block = F.floor(F.shiftrightunsigned(key, 11) / float(1 << 53) * blocks)
    keyed = lambda rows: _dealt(rows, counts, shards, seed).withColumn("_key", key).withColumn("_block", in_block)
    filled = keyed(numbered.select("_part", "_at")).groupBy("_shard", "_block").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = filled.select("_shard", "_block", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"))
    ordered = Window.partitionBy("_shard", "_block").orderBy("_key", "_part", "_at")
    placed = keyed(numbered).withColumn("_rank", F.row_number().over(ordered)).join(before, ["_shard", "_block"])
    return placed.select(*given.columns, F.col("_shard").alias(shard), (F.col("_before") + F.col("_rank") - 1).cast("long").alias(slot))
