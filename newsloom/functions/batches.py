"""Python functions of one value as column functions that hold few Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Values of a batch that are Python objects at once.
AT_ONCE = 64


def _slices(values: pa.Array) -> Iterator[pa.Array]:
    for start in range(0, len(values), AT_ONCE):
        yield values.slice(start, AT_ONCE)


def each(values: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """``function`` of every value; results go to Arrow after ``AT_ONCE`` of them, whatever the batch's length."""
    parts = [pa.array([function(v) for v in part.to_pylist()], kind) for part in _slices(values)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
