"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A signature is ``SYMBOLS`` MinHash values of 16 bits, cut into ``CHUNKS`` chunks of one long each. Two
sets of similarity s differ in Bin(SYMBOLS, 1 - s) symbols, so a radius r exists that such pairs keep
with all but ``MISS`` probability. If chunk i allows a_i errors and the sum of (a_i + 1) is above r, two
signatures within r agree in some chunk up to a_i symbols (pigeonhole), hence on one of the keys that
leave out a_i symbols of that chunk. Signatures that meet on a key are compared: those within the radius
belong to one family, and links are confirmed on the full sets inside a family.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.containment import small as bounded
from newsloom.llm.words import blocks, constants, hashed_words, mix, shingle_sets, utf8
from newsloom.operators.similarity import components
from newsloom.session import durable

CHUNKS, PER_CHUNK = 12, 4
SYMBOLS = CHUNKS * PER_CHUNK
MISS = 1e-5
#: Classes whose sets, or signatures, are compared with each other in one step.
TILE, SIGNATURES = 512, 4096
#: Bytes of sets that a step holds, but for one set alone; shingles, and comparisons of signatures, at a time.
TILE_BYTES = 1 << 26
_SLICE = 4096
_PARTS = [f"_s{i}" for i in range(CHUNKS)]
_LANE = 0xFFFF


def radius(similarity: float) -> int:
    """Smallest number of differing symbols that pairs of this similarity exceed with probability below ``MISS``."""
    p = 1 - similarity
    above = lambda r: sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(r + 1, SYMBOLS + 1))
    return next(r for r in range(SYMBOLS + 1) if above(r) <= MISS)


def errors(r: int) -> list[int]:
    """Errors allowed in each chunk, as even as may be, so that the sum of (errors + 1) is r + 1."""
    spare = r + 1 - CHUNKS
    if spare < 0:
        return [0] * (r + 1)
    return [spare // CHUNKS + (i < spare % CHUNKS) for i in range(CHUNKS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(r: int) -> Column:
    """The row's keys: its chunks, each with every choice of allowed errors left out."""
    out = []
    for i, missing in enumerate(errors(r)):
        if missing >= PER_CHUNK:
            raise ValueError("the similarity is too low for signatures of this length")
        for kept in combinations(range(PER_CHUNK), PER_CHUNK - missing):
            mask = sum(_LANE << 16 * k for k in kept)
            out.append(F.xxhash64(F.lit(i), F.lit(_signed(mask)), F.col(_PARTS[i]).bitwiseAND(F.lit(_signed(mask)))))
    return F.array(*out)


def _block_sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    values, offsets = utf8(column)
    for a, b in blocks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        hashes, rows, _ = hashed_words(values[offsets[a] : offsets[b]], at)
        yield shingle_sets(hashes, rows, b - a, size)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, two digests of the set, the chunks) from (id, text)."""
    fields = ["n_shingles", "_da", "_db", *_PARTS]
    schema = T.StructType([docs.schema["id"]] + [T.StructField(f, T.LongType()) for f in fields])
    turns, salt = constants(SYMBOLS, 7), np.uint64(0xA24BAED4963EE407)

    def run(batches):
        for batch in batches:
            rows: list[np.ndarray] = []
            for sets in _block_sets(batch.column(1), size):
                counts = np.array([len(s) for s in sets])
                out = np.zeros((len(sets), len(fields)), np.int64)
                out[:, 0] = counts
                full = np.flatnonzero(counts)
                if len(full):
                    flat = np.concatenate(sets)
                    first = (np.cumsum(counts) - counts)[full]
                    out[full, 1] = np.add.reduceat(mix(flat), first).view(np.int64)
                    out[full, 2] = np.add.reduceat(mix(flat ^ salt), first).view(np.int64)
                    for k in range(SYMBOLS):
                        least = mix(np.minimum.reduceat(flat * turns[k], first)) & np.uint64(_LANE)
                        out[full, 3 + k // PER_CHUNK] |= (least << np.uint64(16 * (k % PER_CHUNK))).view(np.int64)
                rows.append(out)
            table = np.concatenate(rows) if rows else np.zeros((0, len(fields)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["id", *fields])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted shingle hashes, 8 bytes each."""
    schema = T.StructType([docs.schema["id"], T.StructField("set", T.BinaryType())])

    def run(batches):
        for batch in batches:
            packed = [s.tobytes() for sets in _block_sets(batch.column(1), size) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, schema)


def _links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one of its component among these; links have 100 * shared >= percent * all.

    Shared shingles of all pairs are one product of the 0/1 matrix of sets by shingles, taken a slice
    of shingles at a time. If there are two sides, only pairs across count.
    """
    sizes = np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), sizes), counts[column] > 1
    row, column = row[common], (np.cumsum(counts > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _SLICE):
        here = slice(*np.searchsorted(column, [start, start + _SLICE]))
        part = np.zeros((len(sets), _SLICE), np.float32)
        part[row[here], column[here] - start] = 1
        shared += part @ part.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if len(set(sides.tolist())) > 1:
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(1)
        if (low == label).all():
            return label
        label = low[low]


def _differing(x: Column, y: Column) -> Column:
    """Number of unequal symbols of two chunks: a symbol's bits are folded onto its lowest one."""
    bits = x.bitwiseXOR(y)
    for width in (8, 4, 2, 1):
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, width))
    return F.bit_count(bits.bitwiseAND(F.lit(0x0001000100010001)))


def _near(rows: list[np.ndarray], sides: np.ndarray, r: int) -> np.ndarray:
    """For each signature the first one of its component among these; links differ in at most ``r`` symbols.

    The first of a row's values says whether the row is still open; two closed rows are in one family anyhow.
    """
    table = np.stack(rows)
    label, signs = np.arange(len(table)), table[:, 1:]
    open_ = np.flatnonzero(table[:, 0])
    step = max(1, (_SLICE * 256) // (len(table) * SYMBOLS))
    pairs = []
    for start in range(0, len(open_), step):
        part = open_[start : start + step]
        near = (signs[part, None, :] != signs[None, :, :]).sum(2) <= r
        if len(set(sides.tolist())) > 1:
            near &= sides[part, None] != sides[None, :]
        one, other = np.nonzero(near)
        pairs.append(np.stack([part[one], other]))
    one, other = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    while True:
        low = label.copy()
        np.minimum.at(low, one, label[other])
        np.minimum.at(low, other, label[one])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tile_links(dealt: DataFrame, compare: Callable[[list[np.ndarray], np.ndarray], np.ndarray], kind_of: type) -> DataFrame:
    """(a, b): links that span the components of each pair of tiles; ``dealt`` is in order of the pairs.

    ``compare`` gets the rows' values (``set`` as an array of ``kind_of``) and sides.
    """
    kind = dealt.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):
        held, current = [], None

        def done():
            rep = pa.chunked_array([x for x, _, _ in held]).combine_chunks()
            sets = [np.frombuffer(s.as_buffer(), kind_of) for _, column, _ in held for s in column]
            side = np.concatenate([side for _, _, side in held])
            label = compare(sets, side)
            # Each side is a star around its own first, so that a tile gives the same edges whichever tile it is compared with.
            tree, first, own = np.unique(2 * label + side, return_index=True, return_inverse=True)
            star = first[own]
            other = np.flatnonzero(star != np.arange(len(sets)))
            across = np.flatnonzero(tree[1:] // 2 == tree[:-1] // 2)
            a, b = np.append(other, first[across]), np.append(star[other], first[across + 1])
            return pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            low, high, side = (batch.column(c).to_numpy() for c in ("low", "high", "side"))
            begin = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(low)], strict=True):
                if held and (low[start], high[start]) != current:
                    yield done()
                    held = []
                current = (low[start], high[start])
                part = batch.slice(start, stop - start)
                held.append((part.column("rep"), part.column("set"), side[start:stop]))
        if held:
            yield done()

    return dealt.select("low", "high", "side", "rep", "set").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked when 100 * shared >= percent * all of their distinct ``size``-word shingles;
    a shorter text is one shingle, a text without words has none and is linked with nothing. A
    component is named after its smallest id. Rows with the same id are one document. A row
    without id takes no part: its component_id is null and it is kept.

    Equal sets become one class first, so exact copies cost one row each. Classes that meet on a key and whose
    signatures are within the radius are a family (directly or through others): every class is compared
    with the first of its key, and where some are not within the radius of that one, these with all of
    the key, in blocks. Full sets are compared inside families only. A family is one tile, or several of at
    most about ``TILE`` classes and ``TILE_BYTES``; two tiles are compared if some key occurs in both. A
    comparison counts shared shingles of all its pairs at once and gives out only links that span its
    components, so no pair is written. Nothing is capped; only classes of a family have their texts read again.
    """
    given = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    rows = durable(sketches(given, size))
    part = rows.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "_da", "_db"]
    classes = durable(part.groupBy(*same).agg(F.min("id").alias("rep"), *[F.max(s).alias(s) for s in _PARTS]))
    r = radius(percent / 100)
    keyed = classes.select("rep", F.explode(_keys(r)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter("n > 1")
    shared = durable(keyed.join(met, "key"))
    families = components(_met_within(shared, classes, r))
    weights = classes.select("rep", "n_shingles")
    placed = shared.join(families.select(F.col("node").alias("rep"), "component"), "rep").join(weights, "rep")
    tiles = _tiles(placed)
    sets = _sets(given.join(bounded(tiles.select(F.col("rep").alias("id")).distinct()), "id", "left_semi"), size)
    present = placed.join(tiles, "rep").select("component", "key", "tile").distinct()
    meeting = present.alias("x").join(present.alias("y"), ["component", "key"]).filter("x.tile <= y.tile").select(F.col("x.tile").alias("low"), F.col("y.tile").alias("high")).distinct()
    both = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    sides = meeting.select("low", "high", F.posexplode(both).alias("side", "tile"))
    dealt = sides.join(tiles, "tile").join(sets.withColumnRenamed("id", "rep"), "rep")
    links = _tile_links(_in_order(dealt), lambda values, sides: _links(values, sides, percent), np.uint64)
    return _result(rows, classes, components(links), ident)


def _in_order(dealt: DataFrame) -> DataFrame:
    return dealt.select("low", "high", "side", "rep", "set").repartition("low", "high").sortWithinPartitions("low", "high", "rep")


def _met_within(shared: DataFrame, classes: DataFrame, r: int) -> DataFrame:
    """(a, b): spanning links between classes that share a key and differ in at most ``r`` symbols.

    ``shared``: (key, rep, n, first). A class and the first of a key are compared once, however many keys
    they share. A key where all are within the radius of its first is done.
    """
    pairs = shared.filter("rep <> first").select("rep", "first").distinct()
    mine = classes.select("rep", *_PARTS)
    theirs = classes.select(F.col("rep").alias("first"), *[F.col(p).alias(f"{p}f") for p in _PARTS])
    apart = sum((_differing(F.col(p), F.col(f"{p}f")) for p in _PARTS[1:]), _differing(F.col(_PARTS[0]), F.col(f"{_PARTS[0]}f")))
    judged = durable(pairs.join(mine, "rep").join(theirs, "first").select("rep", "first", (apart <= r).alias("near")))
    links = judged.filter("near").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    # Keys of two are settled by that one comparison; the first of a key needs none with itself.
    more = shared.filter("n > 2").join(judged, ["rep", "first"], "left").withColumn("open", ~F.coalesce("near", F.lit(True)))
    unsettled = more.filter("open").select("key").distinct()
    parts = F.ceil(F.col("n") / SIGNATURES).cast("long")
    mine_of = F.pmod(F.xxhash64("rep"), parts)
    rows = more.join(unsettled, "key").select("key", "rep", "open", mine_of.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") > F.col("other"), 1).otherwise(0)
    dealt = rows.select("rep", "open", F.xxhash64("key", low).alias("low"), F.xxhash64("key", high).alias("high"), side.alias("side"))
    signed = dealt.join(_signatures(classes), "rep").withColumn("set", F.concat(F.when(F.col("open"), F.lit(b"\x01\x00")).otherwise(F.lit(b"\x00\x00")), "signature"))
    return links.unionByName(_tile_links(_in_order(signed), lambda values, sides: _near(values, sides, r), np.uint16)).distinct()


def _signatures(classes: DataFrame) -> DataFrame:
    """(rep, signature): the chunks as bytes, end to end."""
    bytes_of = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return classes.select("rep", F.concat(*[bytes_of(p) for p in _PARTS]).alias("signature"))


def _tiles(placed: DataFrame) -> DataFrame:
    """(rep, tile) from (key, rep, n, component, n_shingles): families, the large ones in parts.

    A class of a large family belongs to its most common key. A key with many such classes has tiles of
    its own; the other keys of the family share tiles, each key whole in one of them. Parts are made by
    number of classes and by bytes of their sets, whichever needs more of them.
    """
    one = placed.groupBy("rep").agg(F.max(F.struct("n", "key")).getField("key").alias("home"), F.max("component").alias("component"), F.max("n_shingles").alias("weight"))
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("weight") * 8 / TILE_BYTES)).alias("parts")
    families = one.groupBy("component").agg(parts)
    crowds = one.groupBy("component", "home").agg(parts, F.count("*").alias("crowd"), (F.sum("weight") * 8).alias("bytes"))
    crowds = crowds.select("component", "home", F.col("parts").alias("own"), ((F.col("crowd") * 2 >= TILE) | (F.col("bytes") * 2 >= TILE_BYTES)).alias("crowded"))
    found = one.join(families, "component").join(crowds, ["component", "home"])
    own = F.xxhash64("component", "home", F.pmod(F.xxhash64("rep"), "own"))
    common = F.xxhash64("component", F.pmod(F.xxhash64("home"), "parts"))
    tile = F.when(F.col("parts") == 1, F.xxhash64("component")).when(F.col("crowded"), own).otherwise(common)
    return durable(found.select("rep", tile.alias("tile")))


def _result(rows: DataFrame, classes: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    same = ["n_shingles", "_da", "_db"]
    groups = classes.select(*same, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select(*same, F.coalesce("component", "rep").alias("_group"))
    joined = rows.select("id", *same).join(groups, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_group", "id"))
    return joined.select(F.col("id").alias(ident), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
