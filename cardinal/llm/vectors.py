"""Reading vector columns in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """True for vectors that are not null, not empty, and hold only finite numbers."""
    ok = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & ok, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)
