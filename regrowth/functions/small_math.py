"""Tiny numeric helpers on already aggregated rows (a k x k system, one tail probability)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F, types as T

register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(gram: pd.Series, rhs: pd.Series) -> pd.Series:
    """Least-squares coefficients from one small cross-product matrix per row; ``gram`` is row-major.

    Redundant columns share their effect (minimum norm), constant ones get 0.
    """
    out = []
    for g, b in zip(gram, rhs):
        b = np.asarray(b, float)
        m = np.asarray(g, float).reshape(len(b), len(b))
        if not (np.isfinite(m).all() and np.isfinite(b).all()):
            out.append(None)
            continue
        scale = np.sqrt(np.clip(np.diag(m), 0, None))
        scale[scale == 0] = 1.0
        out.append((np.linalg.lstsq(m / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale).tolist())
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) by Gauss-Legendre integration of the density after t = sqrt(df) tan(a)."""
    x, w = np.polynomial.legendre.leggauss(200)

    def one(tv, nu):
        if not (np.isfinite(tv) and nu > 0):
            return None
        lo, hi = math.atan(abs(tv) / math.sqrt(nu)), math.pi / 2
        a = 0.5 * (hi - lo) * x + 0.5 * (hi + lo)
        const = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
        return float(2 * const * 0.5 * (hi - lo) * np.sum(w * np.cos(a) ** (nu - 1)))

    return pd.Series([one(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution: a finite sum for each parity of df."""

    def one(xv, k):
        if not np.isfinite(xv) or k < 1:
            return None
        half = xv / 2
        if k % 2 == 0:
            term, total = 1.0, 1.0
            for j in range(1, k // 2):
                term *= half / j
                total += term
            return math.exp(-half) * total
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        for j in range(1, (k + 1) // 2):
            total += term
            term *= half / (j + 0.5)
        return total

    return pd.Series([one(float(a), int(b)) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def inverse_form(matrix: pd.Series, vector: pd.Series) -> pd.Series:
    """b' V^-1 b for one small covariance per row."""
    out = []
    for v, b in zip(matrix, vector):
        b = np.asarray(b, float)
        v = np.asarray(v, float).reshape(len(b), len(b))
        try:
            out.append(float(b @ np.linalg.solve(v, b)))
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out, dtype="float64")
