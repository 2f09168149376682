"""What operators on vectors share: which rows take part, matrices of Arrow columns, unit vectors, bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whether an array is there, not empty and finite; and whether it has a direction.
FINITE = "({v} IS NOT NULL AND size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')))"
NONZERO = "exists({v}, x -> x <> 0)"


def dimensions(df: DataFrame, column: str = "v") -> list[int]:
    """The numbers of dimensions that occur, ascending; a few, as vectors of one model have one."""
    return sorted(r["d"] for r in df.select(F.size(column).alias("d")).distinct().collect())


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind: type = np.float64) -> np.ndarray:
    """The rows of an array column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sample(df: DataFrame, n: int, column: str = "v") -> np.ndarray:
    """At most ``n`` rows of a vector column, the same ones whatever the partitions: those of least hash."""
    rows = df.select(column).orderBy(F.xxhash64(column), column).limit(n).toArrow()
    return matrix(rows[column], len(rows[column][0])) if len(rows) else np.zeros((0, 1))
