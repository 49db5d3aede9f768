"""Short known texts found inside long ones: MinHash bands by size class, then exact containment. Column functions only.

Both sides become 64-bit hashes of word shingles. A hash belongs to the bin named by its top ``bits`` bits
and a row's sketch is the smallest hash of each bin (one permutation, one band per bin). A shingle that
two rows share is the smallest of its bin in both with probability (1 - exp(-load)) / load, where load
is the number of shingles per bin; each shared shingle is one more trial. Known texts are parted by
size, and every class sets the load that its smallest text needs (``CLASSES``).

A hash is the smallest of its bin for ``bits`` bits exactly if ``bits`` is above the number of top bits it
shares with the next smaller hash, so one sketch row with that level serves texts of every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import durable

#: (least shingles of the class, bins per shingle as a power of two). At a similarity of 0.8 the bins
#: miss a text with probability below 3e-6 from 16 shingles on, 3e-7 from 4 on, and 0.001 from 1 on.
CLASSES = ((16, 0), (4, 6), (1, 10))
#: Rows up to which the known side is broadcast (24 bytes each); above, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; fewer words are one run; null without words.

    A known text of fewer words is thus found only in a text of exactly these words, not inside a longer one.
    """
    runs = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(runs, lambda i: F.xxhash64(F.slice(words, i, size))))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once: the one-element generator keeps later expressions from repeating them."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_made")).select("*", "_made.*").drop("_made")


def shingled(docs: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """(id, shingles) of the rows that have an id and words."""
    given = docs.select(docs[ident].alias("id"), docs[text].alias("text")).filter(F.col("id").isNotNull())
    split = settled(given, words=words(F.col("text"))).select("id", "words")
    return settled(split, shingles=shingle_hashes(F.col("words"), size)).select("id", "shingles").filter(F.col("shingles").isNotNull())


def known_texts(items: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """(item, shingles, n, least, fine): distinct shingles of the known texts and their size class.

    Equal rows are one; different texts of one id are known texts of their own.
    """
    rows = shingled(items, ident, text, size).select("id", F.array_distinct("shingles").alias("shingles")).distinct()
    n = F.size("shingles")
    least, fine = F.lit(None).cast("int"), F.lit(None).cast("int")
    for low, bits in reversed(CLASSES):
        least, fine = F.when(n >= low, F.lit(low)).otherwise(least), F.when(n >= low, F.lit(bits)).otherwise(fine)
    return rows.select(F.col("id").alias("item"), "shingles", n.alias("n"), least.alias("least"), fine.alias("fine"))


def _level(this: Column, before: Column) -> Column:
    """Bits from which on ``this`` is the smallest of its bin, ``before`` being the next smaller hash."""
    return F.lit(65) - F.length(F.bin(this.bitwiseXOR(before)))


def _known_sketch(known: DataFrame) -> DataFrame:
    """(item, least, hash, level): every shingle with the bits from which it is in the sketch."""
    ordered = settled(known.select("item", "least", "shingles"), ordered=F.sort_array("shingles")).select("item", "least", "ordered")
    each = ordered.select("item", "least", "ordered", F.posexplode("ordered").alias("at", "hash"))
    before = F.when(F.col("at") > 0, F.element_at("ordered", F.greatest(F.col("at"), F.lit(1))))
    return each.select("item", "least", "hash", F.coalesce(_level(F.col("hash"), before), F.lit(0)).alias("level"))


def _sketch(parts: DataFrame) -> DataFrame:
    """(id, least, part, hash, bits): the smallest hash of each bin of every part."""
    bits = F.least(F.lit(62), F.ceil(F.log2(F.size("shingles"))).cast("int") + F.col("fine"))
    ordered = settled(parts.select("id", "least", "part", bits.alias("bits"), "shingles"), ordered=F.sort_array("shingles"), shift=F.lit(64) - F.col("bits"))
    bin_of = lambda x: F.call_function("shiftright", x, F.col("shift"))
    new = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("ordered", i - 1)))
    least = F.when(F.col("bits") == 0, F.slice("ordered", 1, 1)).otherwise(F.filter("ordered", new))
    return ordered.select("id", "least", "part", "bits", F.explode(least).alias("hash"))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def whole(shingles: Column, longest: int) -> Column:
    """Every row as one part."""
    return F.array(shingles)


def windows(shingles: Column, longest: int) -> Column:
    """Overlapping parts: a known text of up to ``longest`` shingles lies whole in one of them."""
    step = max(1, longest)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(shingles) - step) / step).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.slice(shingles, i * step + 1, 2 * step))


def _parts(rows: DataFrame, classes: list, cut) -> DataFrame:
    """(id, least, fine, part, shingles): the parts of every row for each size class, in one pass."""

    def of_class(c) -> Column:
        least, fine = F.lit(c["least"]).alias("least"), F.lit(c["fine"]).alias("fine")
        longest = 1 << (c["longest"] - 1).bit_length()
        return F.transform(cut(F.col("shingles"), longest), lambda s, i: F.struct(least, fine, i.alias("part"), s.alias("shingles")))

    return rows.select("id", F.inline(F.concat(*map(of_class, classes))))


def contained(docs: DataFrame, items: DataFrame, cut=whole, size: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id", item_text: str = "text", item_ident: str = "item_id") -> DataFrame:
    """(id, item, n_shared, n_shingles, n_parts): known texts of which a part of a document holds ``percent`` of the shingles.

    ``cut`` parts the documents (``whole`` or ``windows``); n_shared is the largest number of shared
    distinct shingles in one part, n_parts the number of parts that reach the share. Rows with null ids,
    without text or without words match nothing; rows with one id count as parts of one document.
    Candidates come from the sketches alone and are confirmed on all shingles of the part. The
    documents are not shuffled while the known side or the candidates fit the row bound.
    """
    known = durable(known_texts(items, item_ident, item_text, size))
    rows = shingled(docs, ident, text, size)
    classes = known.groupBy("least", "fine").agg(F.max("n").alias("longest")).orderBy("least").collect()
    if not classes:
        classes = [{"least": 1, "fine": 0, "longest": 1}]
    hits = _sketch(_parts(rows, classes, cut)).join(small(_known_sketch(known)), ["least", "hash"]).filter("bits >= level")
    candidates = durable(hits.select("id", "least", "part", "item").distinct())
    wanted = docs.join(small(candidates.select(F.col("id").alias(ident)).distinct()), ident, "left_semi")
    again = _parts(shingled(wanted, ident, text, size), classes, cut).drop("fine")
    exact = known.select("item", "least", F.col("shingles").alias("_known"), "n")
    pairs = again.join(small(candidates), ["id", "least", "part"]).join(small(exact), ["item", "least"])
    shared = settled(pairs, n_shared=F.size(F.array_intersect("_known", "shingles")))
    matched = shared.filter(F.col("n_shared") * 100 >= F.col("n") * percent)
    return matched.groupBy("id", "item").agg(F.max("n_shared").alias("n_shared"), F.max("n").alias("n_shingles"), F.countDistinct("least", "part").alias("n_parts"))


def without(docs: DataFrame, ids: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column); rows without id stay."""
    return docs.join(small(ids.distinct()), ident, "left_anti").select(*docs.columns)
