"""Exact cosine joins over metric cells, spanning forests of similarity graphs, and their components.

A row of the right side lives in one cell, that of its nearest pivot. Every cell keeps the least and the
largest angle of its rows to every pivot, so by the triangle inequality a row of the left side needs those
cells only whose ranges, widened by the threshold's angle, hold all its own angles. Both are exact: a
bound only leaves out pairs that cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import vectors
from newsloom.operators.ranking import top_k
from newsloom.session import durable, release

#: Right rows of a cell that a task holds, left rows that one task compares with them, and pivots at most.
BLOCK, RUN, PIVOTS = 20_000, 200_000, 128
#: Similarities computed at once, and the slack of angles and rounded similarities.
_AT_ONCE, _SLACK, _ROUNDED = 1_000_000, 1e-6, 2e-6
_FOREVER = (1 << 63) - 1


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Unit vectors as rows, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(len(sizes), width).copy()
    else:
        out = np.zeros((len(sizes), width))
        starts = np.cumsum(sizes) - sizes
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


@dataclass
class Cells:
    """Pivots, the ranges of angles of every cell to every pivot, and in how many parts a cell is held and met."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: list[int]
    runs: list[int]

    def angles(self, column: pa.ListArray) -> np.ndarray:
        rows = _matrix(column, self.pivots.shape[1])
        pivots = np.pad(self.pivots, ((0, 0), (0, rows.shape[1] - self.pivots.shape[1])))
        return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _side(df: DataFrame, keys: list[str], ident: str, at: str, start: Column, until: Column) -> DataFrame:
    """Rows as the join takes them; a vector without direction meets nothing."""
    length = vectors.norm(F.col("vector"))
    usable = F.col("vector").isNotNull() & (length > 0) & (length < float("inf"))
    for k in keys:
        usable &= F.col(k).isNotNull()
    group = [F.xxhash64(F.lit(n), *keys, F.size("vector")).alias(f"_k{n}") for n in (1, 2)]
    return df.filter(F.coalesce(usable, F.lit(False))).select(
        *group, F.col(ident).alias("id"), F.unix_micros(at).alias("at"), start.cast("bigint").alias("start"),
        until.cast("bigint").alias("until"), F.col("vector").cast("array<double>").alias("vector"),
    )


def _pivots(right: DataFrame, n: int) -> np.ndarray:
    """``n`` distinct vectors, those of the smallest hashes, so that the choice depends on the rows only."""
    mark = F.xxhash64("vector")
    marks = [r.h for r in right.select(mark.alias("h")).distinct().orderBy("h").limit(n).collect()]
    rows = right.withColumn("h", mark).filter(F.col("h").isin(marks)).groupBy("h").agg(F.first("vector").alias("v"))
    found = [r.v for r in rows.orderBy("h").collect()]
    return _matrix(pa.array(found, pa.list_(pa.float64())))


def _homed(right: DataFrame, cells: Cells | None) -> DataFrame:
    """Adds ``cell``, that of the nearest pivot."""
    if cells is None:
        return right.withColumn("cell", F.lit(0))
    schema = T.StructType([*right.schema, T.StructField("cell", T.IntegerType())])
    shared = right.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            home = shared.value.angles(batch.column(batch.num_columns - 1)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=schema.names)

    return right.mapInArrow(run, schema)


def _ranges(homed: DataFrame, cells: Cells) -> None:
    """Fills in the cells' ranges: a task sends one row per cell and pivot, whatever it has read."""
    schema = "cell int, pivot int, low double, high double"
    at, last = homed.columns.index("vector"), len(homed.columns) - 1
    shared = homed.sparkSession.sparkContext.broadcast(cells)
    n = len(cells.pivots)

    def run(batches):
        low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for batch in batches:
            angles, home = shared.value.angles(batch.column(at)), batch.column(last).to_numpy()
            np.minimum.at(low, home, angles)
            np.maximum.at(high, home, angles)
        cell, pivot = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(pivot, pa.int32()), pa.array(low[cell, pivot]), pa.array(high[cell, pivot])], names=["cell", "pivot", "low", "high"])

    for r in homed.mapInArrow(run, schema).groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        cells.low[r.cell, r.pivot], cells.high[r.cell, r.pivot] = r.low, r.high


def _most(rows: DataFrame, n: int, limit: int) -> list[int]:
    """Per cell: into how many parts of ``limit`` rows its largest group is to be cut."""
    sizes = rows.groupBy("_k1", "_k2", "cell").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n"))
    most = {r.cell: r.n for r in sizes.collect()}
    return [max(1, -(-most.get(c, 0) // limit)) for c in range(n)]


def _routed(left: DataFrame, cells: Cells | None, which: str) -> DataFrame:
    """Left rows once for every cell that may hold a match; ``reach`` is the angle a match is within.

    ``which``: ``home`` gives the row's own cell only, ``others`` all but that one, ``all`` both.
    """
    if cells is None:
        return left.withColumn("cell", F.lit(0))
    schema = T.StructType([*left.schema, T.StructField("cell", T.IntegerType())])
    at, reach_at = left.columns.index("vector"), left.columns.index("reach")
    shared = left.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                angles = own.angles(part.column(at))
                home = angles.argmin(1)
                if which == "home":
                    row, cell = np.arange(len(home)), home
                else:
                    reach = part.column(reach_at).to_numpy()[:, None] + _SLACK
                    needed = np.ones(angles.shape, bool)
                    for pivot in range(angles.shape[1]):
                        angle = angles[:, pivot, None]
                        needed &= (own.low[None, :, pivot] - reach <= angle) & (angle <= own.high[None, :, pivot] + reach)
                    if which == "others":
                        needed[np.arange(len(home)), home] = False
                    row, cell = np.nonzero(needed)
                copies = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(cell, pa.int32())], names=schema.names)

    return left.mapInArrow(run, schema)


def _dealt(left: DataFrame, right: DataFrame, cells: Cells | None) -> DataFrame:
    """Both sides by group of the join, the right rows of a group first.

    A cell with more than a block of right rows is held in parts, which all its left rows pass; if more than
    ``RUN`` left rows of a group come to a cell, they come in several runs.
    """
    many = lambda counts: F.element_at(F.array(*[F.lit(c) for c in counts]), F.col("cell") + 1)
    parts, runs = many(cells.parts), many(cells.runs)
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.withColumn("run", dealt(runs)).withColumn("part", each(parts))
    right = right.withColumn("part", dealt(parts)).withColumn("run", each(runs))
    group = [F.xxhash64(F.lit(n), "_k1", "_k2", "cell", "part", "run").alias(f"_g{n}") for n in (1, 2)]
    absent = lambda df: F.lit(None).cast(df.schema["id"].dataType)
    rest = ["at", "start", "until", "vector"]
    rows = right.select(*group, F.lit(0).alias("side"), absent(left).alias("left_id"), F.col("id").alias("right_id"), *rest).unionByName(
        left.select(*group, F.lit(1).alias("side"), F.col("id").alias("left_id"), absent(right).alias("right_id"), *rest)
    )
    return rows.repartition("_g1").sortWithinPartitions("_g1", "_g2", "side")


def _groups(batches) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(new group?, side, rows) in order."""
    current = None
    for batch in batches:
        one, two, side = (batch.column(k).to_numpy() for k in range(3))
        if not len(one):
            continue
        begin = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (side[1:] != side[:-1])))
        for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(one)], strict=True):
            fresh, current = (one[start], two[start]) != current, (one[start], two[start])
            yield fresh, int(side[start]), batch.slice(start, stop - start)


class _Held:
    """The right rows of a group, in order of their ids."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        order = pa.compute.sort_indices(table.column("right_id")) if len(table) else pa.array([], pa.uint64())
        table = table.take(order)
        column = lambda name: table.column(name).combine_chunks()
        self.ids = column("right_id")
        self.at, self.start, self.until = (column(c).to_numpy() for c in ("at", "start", "until"))
        self.units = _matrix(column("vector"))
        self.root = np.arange(len(self.ids))

    def similar(self, left: pa.RecordBatch, span: int | None) -> np.ndarray:
        """Similarities of left rows (order: ``start``) and all right rows; NaN where they may not meet."""
        s = _matrix(left.column("vector")) @ self.units.T
        at, order = left.column("at").to_numpy()[:, None], left.column("start").to_numpy()[:, None]
        s[(self.start[None, :] > order) | (self.until[None, :] < order)] = np.nan
        if span is not None:
            s[at - self.at[None, :] > span] = np.nan
        return s

    def unite(self, linked: np.ndarray) -> None:
        """Make the right rows that a row of ``linked`` marks one tree; roots stay the first of their tree.

        A link costs no more than its mark: rows whose links are one tree already are seen at once, and one of the
        others takes the roots of its own links only.
        """
        low = np.where(linked, self.root, len(self.root)).min(1, initial=len(self.root))
        high = np.where(linked, self.root, -1).max(1, initial=-1)
        for row in np.flatnonzero(low < high).tolist():
            trees = np.unique(self.root[linked[row]])
            if len(trees) > 1:
                into = np.arange(len(self.root))
                into[trees] = trees[0]
                self.root = into[self.root]


def _nearest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most similar of every row by rounded similarity and order of columns."""
    rounded = np.where(np.isnan(s), -np.inf, np.round(s, 6))
    if rounded.shape[1] > k:
        least = np.partition(rounded, -k, axis=1)[:, -k]
        i, j = np.nonzero((rounded >= least[:, None]) & np.isfinite(rounded))
    else:
        i, j = np.nonzero(np.isfinite(rounded))
    order = np.lexsort((j, -rounded[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _multiplied(dealt: DataFrame, span: int | None, threshold: float | None, nearest: int | None) -> DataFrame:
    """(left_id, right_id, similarity): one group after the other, left rows streaming past the held right ones."""
    schema = T.StructType([dealt.schema["left_id"], dealt.schema["right_id"], T.StructField("similarity", T.DoubleType())])

    def run(batches):
        parts, held = [], None
        for fresh, side, rows in _groups(batches):
            if fresh:
                parts, held = [], None
            if side == 0:
                parts.append(rows)
                continue
            if held is None and not parts:
                continue
            if held is None:
                held, parts = _Held(parts), []
            step = max(1, _AT_ONCE // len(held.ids))
            for start in range(0, rows.num_rows, step):
                left = rows.slice(start, step)
                s = held.similar(left, span)
                if threshold is not None:
                    s[s < threshold] = np.nan
                i, j = np.nonzero(~np.isnan(s)) if nearest is None else _nearest(s, nearest)
                yield pa.RecordBatch.from_arrays([left.column("left_id").take(pa.array(i)), held.ids.take(pa.array(j)), pa.array(s[i, j])], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _forest(dealt: DataFrame, span: int | None, threshold: float) -> DataFrame:
    """(a, b): edges that span every group's graph, at most one per left row and one per right row."""
    schema = T.StructType([T.StructField(n, dealt.schema[c].dataType) for n, c in (("a", "left_id"), ("b", "right_id"))])

    def run(batches):
        parts, held = [], None

        def ends(rows):
            return pa.RecordBatch.from_arrays(list(rows), names=["a", "b"])

        def trees():
            other = np.flatnonzero(held.root != np.arange(len(held.root)))
            return ends((held.ids.take(pa.array(other)), held.ids.take(pa.array(held.root[other]))))

        for fresh, side, rows in _groups(batches):
            if fresh:
                if held is not None:
                    yield trees()
                parts, held = [], None
            if side == 0:
                parts.append(rows)
                continue
            if held is None and not parts:
                continue
            if held is None:
                held, parts = _Held(parts), []
            step = max(1, _AT_ONCE // len(held.ids))
            for start in range(0, rows.num_rows, step):
                left = rows.slice(start, step)
                linked = held.similar(left, span) >= threshold
                row = np.flatnonzero(linked.any(1))
                linked = linked[row]
                first = linked.argmax(1)
                held.unite(linked)
                yield ends((left.column("left_id").take(pa.array(row)), held.ids.take(pa.array(first))))
        if held is not None:
            yield trees()

    return dealt.mapInArrow(run, schema).filter("a <> b")


def _planned(right: DataFrame, block: int, pivots: int) -> tuple[DataFrame, Cells]:
    """The right side with its cells: one cell while a block holds it, else about one per quarter of a block.

    Rows only meet within a group, so the largest group decides: more cells would cost copies of left rows for
    cells of a few right rows each.
    """
    right = durable(right)
    largest = right.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = min(pivots, -(-4 * largest // block))
    if n <= 4:
        homed = right.withColumn("cell", F.lit(0))
        return homed, Cells(np.zeros((1, 0)), np.zeros((1, 1)), np.zeros((1, 1)), _most(homed, 1, block), [1])
    found = _pivots(right, n)
    n = len(found)
    cells = Cells(found, np.full((n, n), np.inf), np.full((n, n), -np.inf), [], [1] * n)
    homed = _homed(right, cells)
    _ranges(homed, cells)
    cells.parts = _most(homed, n, block)
    return homed, cells


def cosine_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    threshold: float | None = None,
    nearest: int | None = None,
    span_seconds: int | None = None,
    block: int = BLOCK,
    pivots: int = PIVOTS,
    forest: bool = False,
) -> DataFrame:
    """Pairs (left_id, right_id, similarity) within equal ``keys``; with ``forest`` edges (a, b) that span their graph.

    ``left``: keys, left_id, vector, left_at; ``right``: keys, right_id, vector, right_at. Only pairs with
    ``right_at <= left_at``, at most ``span_seconds`` apart, count. If there are columns ``left_order`` and
    ``right_start``, ``right_until``, a pair counts instead when the order lies between these. Rows with a
    null key or a null, zero or infinite vector meet nothing, nor do vectors of unequal length.

    With ``threshold`` all pairs that reach it; with ``nearest`` the best of each left row of every part of a
    cell (the caller keeps the best overall): a left row first meets its own cell, and then those that may hold
    something nearer than its k-th there. A task holds at most ``block`` right rows; only a group's part that
    more than ``RUN`` left rows come to is held more than once.
    """
    span = None if span_seconds is None else span_seconds * 1_000_000
    order = F.col("left_order") if "left_order" in left.columns else F.unix_micros("left_at")
    start = F.col("right_start") if "right_start" in right.columns else F.unix_micros("right_at")
    until = F.col("right_until") if "right_until" in right.columns else F.lit(_FOREVER)
    homed, cells = _planned(_side(right, keys, "right_id", "right_at", start, until), block, pivots)
    one_cell = not cells.pivots.shape[1]
    rows = _side(left, keys, "left_id", "left_at", order, F.lit(_FOREVER))

    def met(rows: DataFrame, reach: Column, which: str) -> DataFrame:
        routed = _routed(rows.withColumn("reach", reach), None if one_cell else cells, which)
        cells.runs = _most(routed.drop("vector") if one_cell else routed, len(cells.parts), RUN)
        dealt = _dealt(routed, homed, cells)
        return _forest(dealt, span, threshold) if forest else _multiplied(dealt, span, threshold, nearest)

    if nearest is None or one_cell:
        reach = F.lit(float(np.arccos(np.clip(threshold, -1, 1)))) if threshold is not None else F.lit(float(np.pi))
        found = met(rows, reach, "all")
    else:
        near = durable(met(rows, F.lit(0.0), "home"))
        kth = top_k(near, ["left_id"], [F.col("similarity").desc(), F.col("right_id")], nearest).groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("_n"), F.min("similarity").alias("_least"))
        bounded = rows.join(kth.filter(F.col("_n") == nearest), "id", "left")
        farthest = F.when(F.col("_least").isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_least") - _ROUNDED)))).otherwise(float(np.pi))
        found = near.unionByName(met(bounded.select(*rows.columns, farthest.alias("_reach")), F.col("_reach"), "others"))
    return found


def in_window(items: DataFrame, stories: DataFrame, window_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Key both sides by time buckets so that everything within the window meets.

    Items (left_at) look back: each goes to its own bucket and the one before; stories (right_at)
    stay in theirs, so a pair meets in one bucket only. The exact window is checked per pair.
    """
    bucket = lambda at: F.floor(F.unix_seconds(at) / window_seconds)
    left = items.withColumn("bucket", F.explode(F.array(bucket("left_at"), bucket("left_at") - 1)))
    return left, stories.withColumn("bucket", bucket("right_at"))


def story_candidates(
    items: DataFrame, stories: DataFrame, window_seconds: int, threshold: float, block: int = BLOCK
) -> DataFrame:
    """Items with the stories updated within the window before them and similar enough."""
    left, right = in_window(items, stories, window_seconds)
    return cosine_join(
        left, right, ["corpus_id", "bucket"], threshold=threshold, span_seconds=window_seconds, block=block
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for an undirected edge table (a, b); a component is its smallest node.

    Every round each node takes the smallest label among itself and its neighbours and then the
    label of that label, so long chains shrink fast. Labels are checkpointed each round, and those of the
    round before deleted.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = held = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, F.col("node") == F.col("a"), "left").select(
            "node", "component", F.least("component", "offer").alias("next")
        )
        parents = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        moved = durable(
            lower.join(parents, "next", "left").select("node", "component", F.least("next", F.coalesce("jump", "next")).alias("next"))
        )
        release(held)
        changed = not moved.filter("next != component").isEmpty()
        labels, held = moved.select("node", F.col("next").alias("component")), moved
        if not changed:
            release(both)
            return labels


def nearest_stories(items: DataFrame, stories: DataFrame, window_seconds: int, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar open stories of every item, ranked; each cell offers its own best."""
    left, right = in_window(items, stories, window_seconds)
    pairs = cosine_join(left, right, ["corpus_id", "bucket"], nearest=k, span_seconds=window_seconds, block=block)
    order = [F.round("similarity", 6).desc(), F.col("right_id")]
    return top_k(pairs, ["left_id"], order, k)


def story_graph(points: DataFrame, ident: str, window_seconds: int | None, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, component): points linked when similar and within the window (None: whenever); loners stay alone.

    Every task gives out edges that span its own graph, so a dense story costs an edge per row, not per
    pair. Without a window equal vectors of a corpus are one point of the join.
    """
    if window_seconds is None:
        nodes = points.select("corpus_id", F.col(ident).alias("node"), F.col("vector").cast("array<double>").alias("vector"))
        firsts = durable(nodes.filter("vector is not null").groupBy("corpus_id", "vector").agg(F.min("node").alias("first")))
        left = firsts.select("corpus_id", F.col("first").alias("left_id"), "vector", F.timestamp_seconds(F.lit(0)).alias("left_at"))
        right = left.withColumnsRenamed({"left_id": "right_id", "left_at": "right_at"})
        linked = components(cosine_join(left, right, ["corpus_id"], threshold=threshold, block=block, forest=True))
        length = vectors.norm(F.col("vector"))
        usable = F.col("vector").isNotNull() & (length > 0) & (length < float("inf"))
        held = nodes.join(firsts, ["corpus_id", "vector"], "left").select("node", F.when(usable, F.col("first")).alias("first"))
        named = held.join(linked.withColumnRenamed("node", "first"), "first", "left")
        return named.select("node", F.coalesce("component", "first", "node").alias("component"))
    left = points.select("corpus_id", F.col(ident).alias("left_id"), "vector", F.col("at").alias("left_at"))
    right = points.select("corpus_id", F.col(ident).alias("right_id"), "vector", F.col("at").alias("right_at"))
    left, right = in_window(left, right, window_seconds)
    linked = components(cosine_join(left, right, ["corpus_id", "bucket"], threshold=threshold, span_seconds=window_seconds, block=block, forest=True))
    alone = points.select(F.col(ident).alias("node")).join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(alone.withColumn("component", F.col("node")))
