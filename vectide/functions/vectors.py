"""Column expressions on vectors, plus the numpy kernels used inside tile tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Squared distances below this are recomputed from coordinate differences:
# 2 - 2 * cosine loses them to rounding, and copies must be exactly 0 apart.
_NEAR = 1e-6
# rows of a block whose distances to 2,048 others stay in a core's cache
_STRIP = 128


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def unit(vector: Column, name: Column) -> Column:
    """L2-normalised vector; a zero or non-finite norm fails naming the row."""
    length = norm(vector)
    usable = (length > 0) & (length < float("inf")) & ~F.isnan(length)
    message = F.concat(
        F.lit("Embedding row(s) with zero or non-finite norm, e.g. "),
        name.cast("string"),
        F.lit("."),
    )
    return F.when(
        usable, F.transform(as_doubles(vector), lambda x: x / length)
    ).otherwise(F.raise_error(message).cast("array<double>"))


def clip_similarity(cosine: Column) -> Column:
    return F.greatest(F.least(cosine, F.lit(1.0)), F.lit(0.0))


def chord(cosine: Column) -> Column:
    """Euclidean distance of unit vectors from their cosine."""
    return F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * cosine, F.lit(0.0)))


def gaussian_kernel(cosine: Column, sigma: Column) -> Column:
    return F.exp(-(F.lit(1.0) - cosine) / (sigma * sigma))


# --- numpy side, on the two blocks of one tile ---------------------------------


def squared_strips(
    a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """First row and squared distances to `b` of one strip of `a` after another.

    A strip is worked on in place while it is in the cache, in `out` if given; else the next one
    overwrites it.
    """
    held = np.empty((min(_STRIP, len(a)), len(b))) if out is None else out
    for at in range(0, len(a), _STRIP):
        part = a[at : at + _STRIP]
        first = 0 if out is None else at
        d2 = np.matmul(part, b.T, out=held[first : first + len(part)])
        d2 *= -2.0
        d2 += 2.0
        np.maximum(d2, 0.0, out=d2)
        if d2.size and d2.min() < _NEAR:
            rows, cols = np.nonzero(d2 < _NEAR)
            for start in range(0, len(rows), 65536):
                r, c = rows[start : start + 65536], cols[start : start + 65536]
                diff = part[r] - b[c]
                d2[r, c] = np.einsum("ij,ij->i", diff, diff)
        yield at, d2


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of unit rows, exact where rows nearly coincide."""
    out = np.empty((len(a), len(b)))
    for _ in squared_strips(a, b, out):
        pass
    return out


def gaussian_distances(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-d^2 / 2 sigma^2) of unit rows."""
    out = np.empty((len(a), len(b)))
    for _, d2 in squared_strips(a, b, out):
        d2 *= -0.5 / sigma**2
        np.exp(d2, out=d2)
    return out
