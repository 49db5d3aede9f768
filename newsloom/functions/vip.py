"""Trusted-feed lists as one text: upper-case ids, sorted, comma-joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.urls import UUID


def encode_vip(ids: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(ids, F.upper)), ",")


def decode_vip(encoded: Column) -> Column:
    """Array of the valid ids."""
    return F.array_distinct(F.filter(F.transform(F.split(encoded, ",", -1), F.upper), lambda x: x.rlike(UUID)))
