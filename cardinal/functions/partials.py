"""Adding per-partition partial results (one row per partition).

Kernels that emit one partial row per partition (sums of gradients, of
p x p matrices, ...) are added in two steps, always the same way: rows are
dealt to about sqrt(partitions) tasks that add theirs in numpy, and the driver adds
those few sums.  A partial that is null or NaN makes the sum NaN: a kernel
that went wrong in one partition shows in the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _add(rows, arrays: dict[str, int], scalars: Sequence[str]) -> dict[str, np.ndarray | float]:
    out: dict = {a: np.zeros(n) for a, n in arrays.items()} | dict.fromkeys(scalars, 0.0)
    for r in rows:
        for a in arrays:
            out[a] = out[a] + np.asarray(r[a], dtype=float)  # a null element becomes NaN
        for c in scalars:
            v = r[c]
            out[c] += math.nan if v is None else float(v)
    return out


def sum_partials(part: DataFrame, partitions: int, arrays: dict[str, int],
                 scalars: Sequence[str]) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Sum of every array column (``name -> length``) and scalar column over the partial rows."""
    names = [*arrays, *scalars]

    def kernel(batches):
        total = None
        for pdf in batches:
            rows = pdf.to_dict("records")
            total = _add(([] if total is None else [total]) + rows, arrays, scalars)
        if total is not None:
            yield pd.DataFrame({n: [total[n].tolist() if n in arrays else total[n]] for n in names})

    schema = ", ".join([*[f"{a} array<double>" for a in arrays], *[f"{c} double" for c in scalars]])
    slots = max(1, math.isqrt(max(1, partitions)))
    few = part.select(*names).repartition(slots).mapInPandas(kernel, schema).collect()  # slots rows
    total = _add(few, arrays, scalars)
    return {a: total[a] for a in arrays}, {c: total[c] for c in scalars}
