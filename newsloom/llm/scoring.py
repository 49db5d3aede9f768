"""Adding computed columns to rows in Arrow batches, a block of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.words import blocks, utf8


def with_columns(docs: DataFrame, added: list[T.StructField], shared: object, score: Callable[[object, np.ndarray, np.ndarray], list], text: str = "text") -> DataFrame:
    """``docs`` with the columns ``added``, computed from the bytes of ``text``.

    ``score(shared, values, offsets)`` gets a block of rows and returns one sequence per added
    column. ``shared`` travels as one broadcast; it is a fitted model of fixed size. Rows stay where
    they are; columns that have the name of an added one are replaced.
    """
    names = {f.name.lower() for f in added}
    read = [c for c in docs.columns if c.lower() not in names or c == text]
    kept = [c for c in read if c.lower() not in names]
    source = docs.select(*[docs[f"`{c}`"] for c in read])
    schema = T.StructType([source.schema[c] for c in kept] + added)
    at, columns_at, fields = read.index(text), [read.index(c) for c in kept], [f.name for f in schema]
    types = [{T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}[f.dataType] for f in added]
    model = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            values, offsets = utf8(batch.column(at))
            parts = [score(model.value, values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
            new = [pa.array(np.concatenate([np.asarray(p[k]) for p in parts]) if parts else [], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in columns_at] + new, names=fields)

    return source.mapInArrow(run, schema)
