"""Vectors as rows and as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length in double precision."""
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
