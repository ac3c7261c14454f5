"""Vector distances as Spark column expressions (V1-V5).

Every element is widened to DOUBLE before it is multiplied and the sums fold
left in element order, so the value is fixed by the data and not by the
partitioning.  Vectors of unequal length give NULL (never a silent pad).

The numpy twins at the bottom use the same operation order, so the block
kernel re-scores candidates to exactly the value these expressions return.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(x: Column) -> Column:
    return x.cast("double")


def _fold(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def sq_norm(a) -> Column:
    return _fold(F.transform(_col(a), lambda x: _d(x) * _d(x)))


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def _same_len(a: Column, b: Column, expr: Column) -> Column:
    return F.when(F.size(a) == F.size(b), expr)


def l2(a, b) -> Column:
    """V1: Euclidean distance."""
    a, b = _col(a), _col(b)
    sq = _fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))
    return _same_len(a, b, F.sqrt(sq))


def neg_ip(a, b) -> Column:
    """V2: negative inner product; 0 - s so that an empty sum is +0.0."""
    a, b = _col(a), _col(b)
    return _same_len(a, b, F.lit(0.0) - dot(a, b))


def cosine(a, b) -> Column:
    """V3: 1 - cos; defined as 1.0 when either vector has zero norm."""
    a, b = _col(a), _col(b)
    na, nb = sq_norm(a), sq_norm(b)
    val = (F.when((na == 0) | (nb == 0), F.lit(1.0))
           .otherwise(F.lit(1.0) - dot(a, b) / (F.sqrt(na) * F.sqrt(nb))))
    return _same_len(a, b, val)


def cosine_from_parts(dotp, na, nb) -> Column:
    """V3 from a dot product and two precomputed squared norms (lets a join
    compute each norm once per row instead of once per pair)."""
    return (F.when((na == 0) | (nb == 0), F.lit(1.0))
            .otherwise(F.lit(1.0) - dotp / (F.sqrt(na) * F.sqrt(nb))))


_BUILDERS = {"l2": l2, "ip": neg_ip, "cosine": cosine}


def check_metric(metric: str) -> str:
    if metric not in _BUILDERS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    return metric


def distance(metric: str, a, b) -> Column:
    """V4: metric dispatch.  Unknown names raise."""
    return _BUILDERS[check_metric(metric)](a, b)


def divide_by(v: Column, n: Column) -> Column:
    """v / n element-wise in double, stored as FLOAT.  The divisor is
    evaluated once per row (repeated into an array), not once per element
    as a reference inside a transform lambda would be."""
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, d: (_d(x) / d).cast("float"))


def normalize(v, tiny: float = 1e-12) -> Column:
    """V5: v / ||v|| in double, stored back as FLOAT; tiny norms left alone."""
    v = _col(v)
    n = norm(v)
    return F.when(n < F.lit(tiny), v).otherwise(divide_by(v, n))


# --- numpy twins (same fold order as the expressions above) -----------------

def np_exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise exact distance between matching rows of a and b (float64).

    Loops over dimensions and vectorises over rows, which reproduces the
    left fold of ``aggregate`` bit for bit.
    """
    a = np.asarray(a, np.float64)
    b = np.asarray(b, np.float64)
    n, dim = a.shape
    if metric == "l2":
        acc = np.zeros(n)
        for j in range(dim):
            d = a[:, j] - b[:, j]
            acc = acc + d * d
        return np.sqrt(acc)
    dotp = np.zeros(n)
    for j in range(dim):
        dotp = dotp + a[:, j] * b[:, j]
    if metric == "ip":
        return 0.0 - dotp
    na = np.zeros(n)
    nb = np.zeros(n)
    for j in range(dim):
        na = na + a[:, j] * a[:, j]
        nb = nb + b[:, j] * b[:, j]
    zero = (na == 0) | (nb == 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        val = 1.0 - dotp / (np.sqrt(na) * np.sqrt(nb))
    return np.where(zero, 1.0, val)


def np_normalize(x: np.ndarray, tiny: float = 1e-12) -> np.ndarray:
    """Row-wise V5 in numpy, bit-equal to ``normalize``: the squared norm is
    a left fold in double, each element is divided in double and rounded to
    float32; rows with a norm below ``tiny`` are left alone."""
    x64 = np.asarray(x, np.float64)
    acc = np.zeros(x64.shape[0])
    for j in range(x64.shape[1]):
        acc = acc + x64[:, j] * x64[:, j]
    n = np.sqrt(acc)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (x64 / n[:, None]).astype(np.float32)
    small = n < tiny
    if small.any():
        out[small] = np.asarray(x, np.float32)[small]
    return out


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 rows divided by a power of two so that the largest element is
    in [0.5, 1), that power as float64).  The product of two such rows can
    neither overflow nor lose more than rounding."""
    top = np.abs(x).max(axis=1, initial=0.0).astype(np.float64)
    power = np.ldexp(1.0, np.frexp(top)[1])
    return (x / power[:, None]).astype(np.float32), power


def np_bounds(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q x B) matrices that enclose the distances of finite rows: a fast
    float32 product of scaled rows, less and plus its worst error.  For l2
    they enclose the squared distance (same order, cheaper).

    The rows are float32 data, so the product of scaled rows is off by at
    most dim * 2^-24 * |q| |x| for any summation order; the norms are float64.
    The allowance is four times that.  Everything else is float64, which
    neither overflows nor vanishes for float32 data.
    """
    dim = q.shape[1]
    qs, qp = _scaled(np.asarray(q, np.float64))
    xs, xp = _scaled(np.asarray(x, np.float64))
    qn = np.sqrt(np.einsum("ij,ij->i", qs, qs, dtype=np.float64))
    xn = np.sqrt(np.einsum("ij,ij->i", xs, xs, dtype=np.float64))
    g = (qs @ xs.T).astype(np.float64)
    unit = 4.0 * max(dim, 1) * 2.0 ** -24
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - g / (qn[:, None] * xn[None, :])
        zero = (qn == 0)[:, None] | (xn == 0)[None, :]
        d = np.where(zero, 1.0, d)
        eps = np.where(zero, 0.0, 2.0 * unit)
        return d - eps, d + eps
    size = (qn * qp)[:, None] * (xn * xp)[None, :]
    g *= qp[:, None]
    g *= xp[None, :]
    if metric == "ip":
        eps = unit * size + 1e-300
        return -g - eps, eps - g
    both = ((qn * qp) ** 2)[:, None] + ((xn * xp) ** 2)[None, :]
    d = both - 2.0 * g
    eps = 2.0 * unit * size + 1e-13 * both + 1e-300
    return d - eps, d + eps


def searchable(v) -> Column:
    """True for vectors that take part in a search: not NULL, and every
    element a finite number (NULL, NaN and infinite elements have no place
    in a stored vector).  The same rule holds in every form of search."""
    v = _col(v)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
