"""Integer vectors out of float arrays, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums below this are whole numbers in float64 too, so products may go through BLAS.
EXACT = 2**52


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component; an empty vector is usable."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def floored(vector: Column, scale: int, length: int) -> Column:
    """Every component times ``scale``, rounded down; zeros behind the end up to ``length`` components."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(F.size(vector) >= length, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(vector))))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of arrays of ``length`` longs as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), length)


def exact(rows: np.ndarray, safe: bool) -> np.ndarray:
    """As float64 where sums stay below EXACT (``safe``), else as Python integers, which never overflow."""
    return rows.astype(np.float64) if safe else rows.astype(object)
