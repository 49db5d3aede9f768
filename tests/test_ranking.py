"""Ranks of every row against a plain sort, over many slices and a hot group."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import ranking
from newsloom.operators.ranking import rank_all


def _plain(rows, keys, order):
    seen, out = {}, {}
    for row in sorted(rows, key=order):
        seen[keys(row)] = seen.get(keys(row), 0) + 1
        out[row[2]] = seen[keys(row)]
    return out


@pytest.mark.parametrize("bound", [ranking.MAP_SIDE_ROWS, 10])
def test_ranks_across_slices(spark, monkeypatch, bound):
    """A group with most of the rows, many small ones, null keys, ties of the first order column."""
    monkeypatch.setattr(ranking, "MAP_SIDE_ROWS", bound)
    names = ["hot", "hot", "hot", "hot", None, "x", "y"]
    rows = [(names[(i * i) % 7] if i % 5 else f"g{i % 400}", (i * 37) % 11, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "name string, score int, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        order = [F.col("score").desc(), F.col("id")]
        found = {r["id"]: r["rank"] for r in rank_all(df, ["name"], order).collect()}
        assert found == _plain(rows, lambda r: r[0], lambda r: (-r[1], r[2]))
        found = {r["id"]: r["n"] for r in rank_all(df, [], order, "n").collect()}
        assert found == _plain(rows, lambda r: 0, lambda r: (-r[1], r[2]))
        two = rank_all(df, ["name", "score"], [F.col("id")])
        assert two.columns == ["name", "score", "id", "rank"]
        assert {r["id"]: r["rank"] for r in two.collect()} == _plain(rows, lambda r: r[:2], lambda r: r[2])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nothing_to_rank(spark):
    assert rank_all(spark.createDataFrame([], "name string, id long"), ["name"], [F.col("id")]).collect() == []
