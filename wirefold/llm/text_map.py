"""Arrow functions over a text column that leave every other column as it is."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wirefold.llm.common import pick_places
from wirefold.llm.lengths import SLICE_BYTES, slices
from wirefold.llm.words import utf8


def append_columns(docs: DataFrame, make: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField],
                   text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """docs with columns computed by `make` from slices of the text column, one array per field.

    Columns are handled by place, so names that clash do no harm; the new columns come last.
    """
    where = pick_places(docs, text)[text]
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    added = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]

    def run(batches):
        for batch in batches:
            _, offs = utf8(batch.column(where))
            for a, b in slices(offs, most):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(where))],
                                                 [*part.schema.names, *[f.name for f in added]])

    return flat.mapInArrow(run, T.StructType([*flat.schema.fields, *added])).toDF(
        *docs.columns, *[f.name for f in fields])
