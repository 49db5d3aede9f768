"""Embedding near-duplicates: random projections decoded to E8 lattice points, neighbouring cells probed, cosine verified.

A table projects unit vectors onto two blocks of eight random directions, scaled by ``SCALE``; the pair of
nearest E8 points is the vector's own cell. It also visits the cells of the ``PROBES`` nearest
neighbours among the 240 smallest lattice vectors of each block. Two vectors meet where one visits the
other's own cell. At cosine 0.95 they meet in one table with probability 0.62 and miss all ``TABLES`` with
probability below 1e-4; unrelated vectors meet in a table with probability 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.words import constants, mix
from newsloom.operators.similarity import components
from newsloom.session import durable

TABLES, PROBES, SCALE = 10, 4, 2.0
#: Vectors of one cell that meet in one step; a larger cell is cut into tiles of about this size.
TILE = 1_000
_AT_ONCE = 1 << 20


def _smallest() -> np.ndarray:
    """The 240 smallest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for at in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[list(at)] = signs
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_AROUND = _smallest()


def nearest(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: the better of the nearest in D8 and in D8 shifted by one half."""

    def even(y: np.ndarray) -> np.ndarray:
        rounded = np.rint(y)
        rest = y - rounded
        odd = np.flatnonzero(rounded.sum(1).astype(np.int64) & 1)
        worst = np.abs(rest[odd]).argmax(1)
        rounded[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        return rounded

    whole, half = even(points), even(points - 0.5) + 0.5
    return np.where((((points - whole) ** 2).sum(1) <= ((points - half) ** 2).sum(1))[:, None], whole, half)


def _directions(size: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([size, table])
    blocks = 2 * 8
    basis = np.linalg.qr(random.standard_normal((max(size, blocks), blocks)))[0][:size]
    return basis * np.sqrt(size / 8) * SCALE, random.random(blocks) * 2


def cells(units: np.ndarray, table: int) -> np.ndarray:
    """Cell hashes of unit vectors in a table, (rows, (PROBES + 1) ** 2); the own cell comes first."""
    directions, shift = _directions(units.shape[1], table)
    lifted = units @ directions + shift
    turns = constants(8, 31)
    halves = []
    for block in (0, 1):
        points = lifted[:, 8 * block : 8 * block + 8]
        own = nearest(points)
        gain = (points - own) @ _AROUND.T
        best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        visited = np.concatenate([own[:, None, :], own[:, None, :] + _AROUND[best]], axis=1)
        halves.append(mix(((2 * visited).astype(np.int64).view(np.uint64) * turns).sum(2, dtype=np.uint64) + np.uint64(block)))
    both = mix(halves[0][:, :, None] * np.uint64(3) + halves[1][:, None, :] + np.uint64(table << 32 | units.shape[1]))
    return both.reshape(len(units), -1)


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows padded with zeros to the longest, their lengths) of a list column."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(float)
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True) if out.size else 1
    return out / np.linalg.norm(out, axis=1, keepdims=True), lengths


def _visits(classes: DataFrame) -> DataFrame:
    """(cell, rep, own) for every cell that a vector visits in any table."""
    schema = T.StructType([T.StructField("cell", T.LongType()), classes.schema["rep"], T.StructField("own", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.slice(start, 1_000)
                units, lengths = _matrix(part.column(1))
                for size in np.unique(lengths):
                    rows = np.flatnonzero(lengths == size)
                    for table in range(TABLES):
                        visited = cells(units[rows, :size], table)
                        width = visited.shape[1]
                        own = np.zeros(visited.shape, bool)
                        own[:, 0] = True
                        ids = part.column(0).take(pa.array(np.repeat(rows, width)))
                        yield pa.RecordBatch.from_arrays([pa.array(visited.ravel().view(np.int64)), ids, pa.array(own.ravel())], names=["cell", "rep", "own"])

    return classes.select("rep", "vector").mapInArrow(run, schema)


def _counted(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class _Hits:
    """Links of one batch of complete tiles, each in the one place where it counts."""

    def __init__(self, batch: pa.Table, threshold: float):
        column = batch.column("vector").combine_chunks()
        self.units, self.sizes = _matrix(column)
        self.rep = batch.column("rep").to_numpy()
        self.own = batch.column("own").to_numpy(zero_copy_only=False)
        self.cell = batch.column("cell").to_numpy()
        self.copies = batch.column("copies").to_numpy()
        self.low, self.high, self.side = (batch.column(c).to_numpy() for c in ("low", "high", "side"))
        self.threshold = threshold

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs to compare, about ``_AT_ONCE`` at a time."""
        new = np.append(True, (self.cell[1:] != self.cell[:-1]) | (self.low[1:] != self.low[:-1]) | (self.high[1:] != self.high[:-1]))
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(self.cell)))
        cost = count.astype(np.int64) ** 2 // 2
        group = np.cumsum(cost) // _AT_ONCE
        for g in np.unique(group):
            here = np.flatnonzero(group == g)
            step = np.repeat(count[here], count[here]) - 1 - _counted(count[here])
            left = np.repeat(np.repeat(begin[here], count[here]) + _counted(count[here]), step)
            right = left + 1 + _counted(step)
            apart = (self.low[left] == self.high[left]) | (self.side[left] != self.side[right])
            keep = (self.own[left] | self.own[right]) & apart & (self.rep[left] != self.rep[right]) & (self.sizes[left] == self.sizes[right])
            yield left[keep], right[keep]

    def _visited(self, rows: np.ndarray, table: int) -> np.ndarray:
        size = int(self.sizes[rows[0]])
        return cells(self.units[rows, :size], table)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for left, right in self.pairs():
            cosine = np.einsum("ij,ij->i", self.units[left], self.units[right])
            hit = cosine >= self.threshold
            left, right = left[hit], right[hit]
            swap = self.rep[left] > self.rep[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            for size in np.unique(self.sizes[left]):
                same = self.sizes[left] == size
                yield self._once(left[same], right[same])

    def _once(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that count here: in the first table where they meet, there in the smaller's own cell if the other visits it."""
        taken_l, taken_r = [], []
        rows, back = np.unique(np.concatenate([left, right]), return_inverse=True)
        at_l, at_r = back[: len(left)], back[len(left) :]
        for table in range(TABLES):
            if not len(left):
                break
            used, place = np.unique(np.concatenate([at_l, at_r]), return_inverse=True)
            visited = self._visited(rows[used], table)
            x, y = visited[place[: len(left)]], visited[place[len(left) :]]
            in_left = (y == x[:, :1]).any(1)
            in_right = (x == y[:, :1]).any(1)
            where = np.where(in_left, x[:, 0], y[:, 0]).view(np.int64)
            meets = in_left | in_right
            here = meets & (where == self.cell[left])
            taken_l.append(left[here])
            taken_r.append(right[here])
            left, right, at_l, at_r = left[~meets], right[~meets], at_l[~meets], at_r[~meets]
        return (np.concatenate(taken_l), np.concatenate(taken_r)) if taken_l else (left, right)


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, label): linked vectors counted, and a smaller linked vector of the same batch."""
    names = ["cell", "low", "high", "side", "rep", "own", "copies", "vector"]
    schema = T.StructType([tiles.schema["rep"], T.StructField("n", T.LongType()), T.StructField("label", tiles.schema["rep"].dataType)])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        hits = _Hits(table, threshold)
        for left, right in hits.found():
            if not len(left):
                continue
            rep = np.concatenate([hits.rep[left], hits.rep[right]])
            ids, at = np.unique(rep, return_inverse=True)
            a, b = at[: len(left)], at[len(left) :]
            n = np.bincount(a, hits.copies[right], len(ids)) + np.bincount(b, hits.copies[left], len(ids))
            label = np.arange(len(ids))
            while True:
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                label = label[label]
                if (before == label).all():
                    break
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(ids[label])], names=["rep", "n", "label"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 2 * TILE:
                continue
            keys = [held.column(c).to_numpy() for c in names[:3]]
            last = [k[-1] for k in keys]
            open_rows = np.flatnonzero((keys[0] == last[0]) & (keys[1] == last[1]) & (keys[2] == last[2]))
            yield from work(held.slice(0, int(open_rows[0])))
            held = held.slice(int(open_rows[0]))
        if held is not None:
            yield from work(held)

    return tiles.select(*names).mapInArrow(run, schema)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", ident: str = "vec_id", tile: int = TILE) -> DataFrame:
    """(ident, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors link at cosine >= ``threshold`` in double precision. Null, empty, zero and non-finite
    vectors link with nothing, nor do vectors of different lengths; rows without id take no part (null
    component, kept). Equal vectors are one class that counts with its number of rows.

    Only cells where an owner has company are looked at; large ones are cut into tiles that meet two by
    two. A link counts in one place alone, so no pair is written: a step gives out each
    vector's count and one smaller linked vector. Rows with one id are counted as they come.
    """
    given = vectors.select(vectors[ident].alias("id"), vectors[vector].alias("vector"))
    fit = given.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    classes = durable(fit.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    visits = durable(_visits(classes))
    busy = visits.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("owned")).filter("n > 1 AND owned")
    tiles = visits.join(busy.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "cell")
    side = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    tiles = tiles.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("cell", "rep", "own", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    dealt = tiles.join(classes, "rep").repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    links = durable(_links(dealt, threshold))
    edges = links.filter("label <> rep").select(F.col("rep").alias("a"), F.col("label").alias("b")).distinct()
    groups = components(edges).select(F.col("node").alias("rep"), "component")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    known = known.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("_group"))
    fits = usable(F.col("vector")) & F.col("id").isNotNull()
    joined = given.withColumn("vector", F.when(fits, F.col("vector"))).join(known, "vector", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_group", "id"))
    return joined.select(F.col("id").alias(ident), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
