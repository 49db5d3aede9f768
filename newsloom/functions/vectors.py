"""Vector columns (arrays of doubles) and the story gate over similarity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(left: Column, right: Column) -> Column:
    """Null on different or zero length and on zero vectors."""
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    length = norm(left) * norm(right)
    return F.when(usable & (length > 0), _dot(left, right) / length)


def unit(vector: Column) -> Column:
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x / length))


def blend(headline: Column, body: Column) -> Column:
    """0.4 headline + 0.6 body over unit vectors; the headline alone when there is no body."""
    return F.coalesce(F.zip_with(headline, body, lambda h, b: h * 0.4 + b * 0.6), headline)


def running_mean(existing: Column, following: Column, count: Column) -> Column:
    """Equal-weight mean of ``count`` earlier vectors and one more."""
    mean = F.zip_with(existing, following, lambda e, n: (e * count + n) / (count + 1))
    return F.when((F.size(existing) == F.size(following)) & (count > 0), mean).otherwise(following)


def term_similarity(left: Column, right: Column) -> Column:
    """Jaccard of white-space tokens, null when a side has none."""
    def terms(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, fixed.WHITESPACE + "+", -1), lambda w: w != ""))

    a, b = terms(left), terms(right)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared))


def gate_decision(
    centroid: Column,
    representative: Column,
    recent_mean: Column,
    actions: Column,
    representative_actions: Column,
    threshold: float,
    signature_ok: Column | None = None,
) -> Column:
    """Why an item may or may not join a story; the first failing check names the reason."""
    signature_ok = F.lit(None).cast("boolean") if signature_ok is None else signature_ok
    clash = (
        (F.size(actions) > 0) & (F.size(representative_actions) > 0) & ~F.arrays_overlap(actions, representative_actions)
    )
    floor = threshold - fixed.COHESION_SLACK

    def below(value: Column, limit: float) -> Column:
        return value.isNull() | (value < limit)

    return (
        F.when(below(centroid, threshold), "rejectedCentroidSimilarity")
        .when(~F.coalesce(signature_ok, F.lit(True)), "rejectedEventSignatureMismatch")
        .when(clash & below(representative, fixed.ACTION_OVERRIDE), "rejectedActionMismatch")
        .when(below(representative, floor), "rejectedRepresentativeSimilarity")
        .when(below(recent_mean, floor), "rejectedRecentMemberSupport")
        .otherwise("accepted")
    )


def could_join(centroid: Column, representative: Column, recent_mean: Column, threshold: float) -> Column:
    """Cheap pre-check before any expensive evidence is asked for."""
    floor = threshold - fixed.COHESION_SLACK
    passes = (centroid >= threshold) & (representative >= floor) & (recent_mean >= floor)
    return F.coalesce(passes, F.lit(False))
