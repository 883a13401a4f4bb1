"""Embedding columns as whole numbers: floor(scale * entry) of every vector that can take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import pick

CELLS = "vec_id long, dim int, cells array<double>"


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in a row, null as NaN, and where each list starts (one more entry than lists)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0), np.zeros(1, np.int64)
    offs = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offs


def taking_part(flat: np.ndarray, offs: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whether a vector is there, has a member, and has only finite members."""
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    return ~null & (bad[offs[1:]] == bad[offs[:-1]]) & (offs[1:] > offs[:-1])


def floored(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim and cells (floor of scale times each entry, as whole doubles) of the rows that take part.

    A scale that is a power of two makes the product exact. Rows are left out whose vector is null, empty, or holds an
    entry that is null, NaN or infinite, before or after scaling. A null vec_id stays.
    """
    def run(batches):
        for batch in batches:
            flat, offs = lists(batch["embedding"])
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale) + 0.0
            keep = np.flatnonzero(taking_part(flat, offs, batch["embedding"].is_null().to_numpy(zero_copy_only=False)))
            size = (offs[1:] - offs[:-1])[keep]
            ends = np.cumsum(size)
            at = np.repeat(offs[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(keep)), pa.array(size, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat[at]))],
                ["vec_id", "dim", "cells"])

    v = pick(vectors, vec_id="vec_id", embedding="embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.mapInArrow(run, CELLS)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
