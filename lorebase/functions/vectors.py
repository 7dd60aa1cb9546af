"""Vector distance as a column, and unit rows for the k-NN search."""

import numpy as np
from pyspark.sql import Column, functions as F

# Distances are compared at this many decimals, so that equal vectors tie
# whatever order the products were summed in.
DISTANCE_DECIMALS = 12


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a, b) -> Column:
    """``1 - cos(a, b)``; NaN when a vector is all zeros, NULL when one is NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    distance = 1 - F.try_divide(_dot(a, b), norms)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(distance, F.lit(float("nan"))))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; an all-zero row becomes NaN."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms[:, None]
