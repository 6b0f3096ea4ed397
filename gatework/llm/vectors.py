"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(vectors: DataFrame, vector_col: str) -> Column:
    """The vector with floating-point components: float stays float, all else becomes double."""
    kind = dict(vectors.dtypes)[vector_col]
    return F.col(f"`{vector_col}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector_col}`").cast("array<double>")


def finite(v: Column) -> Column:
    """Whether there is a vector and no component of it is null, NaN or infinite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd, F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists of `dim` components, none null, as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
