"""Distances as column expressions over ARRAY<FLOAT> and as numpy kernels. Smaller is nearer, always."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, added from the first component to the last."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def ip(a: Column, b: Column) -> Column:
    """Inner-product distance, 1 - <a, b>."""
    return F.lit(1.0) - dot(a, b)


METRICS = {"l2": l2, "ip": ip}


def pairwise(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks by matrix product; for ranking candidates only, its rounding differs from l2()."""
    q, b = queries.astype(np.float64), base.astype(np.float64)
    product = q @ b.T
    if metric == "ip":
        return 1.0 - product
    return np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * product, 0.0)


def one_to_many(query: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    q, b = query.astype(np.float64), base.astype(np.float64)
    return 1.0 - b @ q if metric == "ip" else ((b - q) ** 2).sum(1)


def in_order(query: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """The same, added from the first component to the last: equal to l2() and ip() to the last bit. One query, or one a row."""
    total = np.zeros(len(base))
    for x, column in zip(query.astype(np.float64).T, base.astype(np.float64).T):
        total += x * column if metric == "ip" else (x - column) ** 2
    return 1.0 - total if metric == "ip" else total
