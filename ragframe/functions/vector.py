"""Vector expressions.

Spark has no vector type with arithmetic, so two implementations exist:

* ``*_expr`` — native higher-order functions (``zip_with`` + ``aggregate``); no
  Python, good for small dimensions;
* :func:`cosine_distance_batch` — a numpy kernel used inside ``mapInPandas``
  (Arrow batches), for large dimensions.

Both accumulate in double and return NaN for a zero vector (cosine undefined),
never raising on division by zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot_expr(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm_expr(a) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine_distance_expr(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - cos(a, b): 0 identical direction, 1 orthogonal, 2 opposite; NaN when a
    norm is zero; NULL when a vector is NULL."""
    na = _c(norm_a) if norm_a is not None else norm_expr(a)
    nb = _c(norm_b) if norm_b is not None else norm_expr(b)
    denom = na * nb
    return (F.when(denom == 0, F.lit(float("nan")))
            .otherwise(F.lit(1.0) - dot_expr(a, b) / F.when(denom == 0, F.lit(1.0)).otherwise(denom)))


def stack(series) -> np.ndarray:
    """pandas Series of equal-length arrays -> 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def cosine_distance_batch(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Row-wise cosine distance of two (n, d) matrices, float64, NaN on zero norm."""
    dot = np.einsum("ij,ij->i", q, e)
    denom = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", e, e))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - dot / denom
    out[denom == 0] = np.nan
    return out
