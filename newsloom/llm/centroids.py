"""Centroid clustering of whole-numbered vectors over subvector dictionaries.

Vectors are cut into blocks of ``WIDTH`` components. A chunk of vectors keeps, for every block, its distinct
subvectors and one code per vector, which loses nothing. In a round the squared distances of these
distinct subvectors to all centroids are computed once, and a vector's distance is the sum over its codes.
Everything is whole numbers, so the result does not depend on how rows lie in chunks or partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import durable

DIM, WIDTH, SCALE = 64, 2, 256
#: Vectors of a chunk, and vectors whose distances are held at once.
CHUNK, SLICE = 1 << 16, 1 << 12
#: Whole numbers below this keep squared distances of 64 components within 63 bits.
LIMIT = 1 << 27


def quantised(vectors: DataFrame, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors of ``dim`` components, none null, infinite, not a number or beyond ``LIMIT``."""
    x = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bound = F.lit(float(LIMIT) / scale)
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound))
    usable = F.col(vector).isNotNull() & (F.size(vector) == dim) & F.coalesce(whole, F.lit(False))
    return vectors.select("id", F.when(usable, F.col(vector)).alias(vector)).filter(F.col(vector).isNotNull()).select("id", x.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; of equal ids those of the smaller components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = kept.filter(F.col("id").isNotNull()).select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k)
    return [r.v for r in chosen.collect()]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, code of every row), a column at a time."""
    code = np.zeros(len(rows), np.int64)
    for column in rows.T:
        values, here = np.unique(column, return_inverse=True)
        _, first, code = np.unique(code * len(values) + here, return_index=True, return_inverse=True)
    return rows[first], code


def encoded(kept: DataFrame, dim: int = DIM, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Chunks (ids, dictionaries, codes): distinct subvectors of every block as 8-byte numbers, codes of 2 or 4 bytes."""
    binaries = T.ArrayType(T.BinaryType())
    schema = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("dictionaries", binaries), T.StructField("codes", binaries)])
    code_type = np.uint16 if chunk <= 1 << 16 else np.uint32

    def run(batches):
        held, rows = [], 0

        def done(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch.column(1)
            table = v.flatten().to_numpy().reshape(len(v), dim)
            blocks = [_distinct(table[:, a : a + width]) for a in range(0, dim, width)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), batch.column(0))
            dictionaries = [np.ascontiguousarray(d, np.int64).tobytes() for d, _ in blocks]
            codes = [c.astype(code_type).tobytes() for _, c in blocks]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.list_(pa.binary())) for x in (dictionaries, codes))], names=schema.names)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == chunk:
                    yield done(pa.concat_batches(held))
                    held, rows = [], 0
        if rows:
            yield done(pa.concat_batches(held))

    return kept.mapInArrow(run, schema)


class Chunk:
    """A chunk read back: dictionaries as tables, codes as indexes into them."""

    def __init__(self, ids: pa.Array, dictionaries: list[bytes], codes: list[bytes], dim: int, width: int):
        self.ids, self.rows = ids, len(ids)
        widths = [min(width, dim - a) for a in range(0, dim, width)]
        self.dictionaries = [np.frombuffer(d, np.int64).reshape(-1, w) for d, w in zip(dictionaries, widths, strict=True)]
        kind = np.uint16 if len(codes[0]) == 2 * self.rows else np.uint32
        self.codes = [np.frombuffer(c, kind) for c in codes]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every vector; of equally near centroids the first."""
        partial, at = [], 0
        for d in self.dictionaries:
            block = centroids[:, at : at + d.shape[1]]
            partial.append(sum((d[:, None, k] - block[None, :, k]) ** 2 for k in range(d.shape[1])))
            at += d.shape[1]
        cluster, distance = np.empty(self.rows, np.int64), np.empty(self.rows, np.int64)
        for start in range(0, self.rows, SLICE):
            here = slice(start, start + SLICE)
            total = partial[0][self.codes[0][here]]
            for table, codes in zip(partial[1:], self.codes[1:], strict=True):
                total += table[codes[here]]
            cluster[here] = total.argmin(1)
            distance[here] = total[np.arange(len(total)), cluster[here]]
        return cluster, distance

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of the members of each cluster, from how often each subvector occurs in it."""
        out = []
        for d, codes in zip(self.dictionaries, self.codes, strict=True):
            often = np.bincount(cluster * len(d) + codes, minlength=k * len(d)).reshape(k, len(d))
            out.append(often @ d)
        return np.concatenate(out, axis=1)


def _chunks(batches, dim: int, width: int):
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column(0).slice(row, 1).flatten()
            yield Chunk(ids, batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), dim, width)


def _next(chunks: DataFrame, centroids: list[list[int]], dim: int, width: int) -> list[list[int]]:
    """Centroids moved to the floor of their members' mean; a task adds up all its chunks first."""
    shared = chunks.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("cluster", "dim", "n", "total")])

    def run(batches):
        now = shared.value
        k = len(now)
        total, count, largest = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0

        def rows():
            some = np.repeat(np.arange(k), dim)
            columns = [some, np.tile(np.arange(dim), k), np.repeat(count, dim), total.ravel()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.names)

        for chunk in _chunks(batches, dim, width):
            cluster, _ = chunk.nearest(now)
            added = chunk.sums(cluster, k)
            size = int(np.abs(added).max())
            if largest + size >= 1 << 62:  # before a sum leaves 63 bits
                yield rows()
                total, count, largest = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
            total = total + added
            count = count + np.bincount(cluster, minlength=k)
            largest += size
        if count.any():
            yield rows()

    added = chunks.mapInArrow(run, schema).groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in added.filter("n > 0").collect():
        out[r.cluster][r.dim] = int(r.total) // int(r.n)
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, vector: str = "embedding", ident: str = "vec_id", dim: int = DIM, scale: int = SCALE, width: int = WIDTH, chunk: int = CHUNK) -> tuple[DataFrame, list[list[int]]]:
    """((ident, cluster, distance), final centroids): ``rounds`` of moving ``k`` centroids, then one more assignment.

    Kept are the vectors of exactly ``dim`` components without null, NaN or infinite ones; a component beyond
    ``LIMIT / scale`` also leaves a vector out, since its squared distance has no 64-bit value. Rows without
    id are clustered but never start a centroid. Fewer than ``k`` kept rows give as many centroids; none
    gives no rows. Rows of one id are vectors of their own; equal vectors get one cluster. Ties go to the
    smaller number. Only the centroids (k x dim numbers) are on the driver or broadcast.
    """
    kept = quantised(vectors.select(vectors[f"`{ident}`"].alias("id"), vectors[f"`{vector}`"].alias("_vector")), "_vector", dim, scale)
    chunks = durable(encoded(kept, dim, width, chunk))
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _next(chunks, centroids, dim, width)
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for one in _chunks(batches, dim, width):
            if not len(shared.value):
                return
            cluster, distance = one.nearest(shared.value)
            yield pa.RecordBatch.from_arrays([one.ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=schema.names)

    return chunks.mapInArrow(run, schema).withColumnRenamed("id", ident), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (null beyond 63 bits) and ``centroid_sha256``; k rows are joined."""
    assigned = durable(assigned)
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    rows = [(c, fits(d), whole, digest(c)) for c, d in sums.items()]
    each = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster")
