"""Shared checks of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not null, and not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def complete(vector: Column) -> Column:
    """All components finite and not null; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vector_digest(vector: Column) -> Column:
    """The same for equal vectors only (up to hash collisions of 128 bits); zero has one sign."""
    shown = F.transform(vector, lambda x: (x + F.lit(0.0)).cast("string"))
    return F.unhex(F.md5(F.array_join(shown, ",").cast("binary")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def balanced(rows: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, times a power of two; directions stay as they are, to the bit."""
    exponent = np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1]
    extreme = np.abs(exponent) > 300
    return np.where(extreme[:, None], np.ldexp(rows, -exponent[:, None]), rows) if extreme.any() else rows
