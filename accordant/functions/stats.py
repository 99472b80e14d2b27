"""Estimators as column expressions over arrays; arrays hold one value per source, so their size is bounded."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAD_SCALE = 1.4826


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it: conditional branches and lambdas share nothing else."""
    return F.get(F.transform(F.array(value), use), 0)


def array_median(values: Column) -> Column:
    """Middle of an array, the mean of the two middle values for even sizes; null if empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)

    return once(F.array_sort(values), middle)


def mad(values: Column) -> Column:
    """Median absolute deviation, scaled to a normal sd; null for fewer than two values."""
    spread = once(array_median(values), lambda middle: array_median(F.transform(values, lambda x: F.abs(x - middle))))
    return F.when(F.size(values) > 1, MAD_SCALE * spread)


def hodges_lehmann(values: Column) -> Column:
    """Median of the values and all pairwise means; the mean for up to two values."""
    n = F.size(values)
    pairs = F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 1, n - i), lambda y: (x + y) / 2)))
    return F.when(n <= 2, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(n.cast("double"), F.lit(0.0))).otherwise(array_median(pairs))


#: Coefficients of the Lanczos approximation (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for x > 0."""
    total = LANCZOS[0] + sum(c / (x + k) for k, c in enumerate(LANCZOS[1:]))
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * np.log(t) - t + np.log(total)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 60) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    t, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inner = (t > 0) & (t < 1)
    t = np.where(inner, t, 0.5)
    c, d = np.ones_like(t), 1 / (1 - (a + b) * t / (a + 1))
    h = d
    for m in range(1, steps + 1):
        for k in (m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * t / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h = h * d * c
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(t) + b * np.log(1 - t))
    out = front * h / a
    return np.where(inner, np.where(swap, 1 - out, out), np.where(x <= 0, 0.0, 1.0))


def harrell_davis(x: list[np.ndarray], w: list[np.ndarray], probs: tuple[float, ...]) -> np.ndarray:
    """Weighted quantiles of each list of values with Kish's effective size, one column a probability; NaN for fewer than two values."""
    n = np.array([len(v) for v in x], "i8")
    shape = len(n), max(1, n.max(initial=0))  # as wide as the most sources of an entity
    there = np.arange(shape[1]) < n[:, None]
    values, weights = np.full(shape, np.inf), np.zeros(shape)
    values[there], weights[there] = (np.concatenate([np.zeros(0), *v]) for v in (x, w))
    order = np.argsort(values, axis=1, kind="stable")
    values, weights = (np.take_along_axis(v, order, 1) for v in (values, weights))
    running = np.cumsum(weights, 1)
    total, square = running[:, -1:], (weights**2).sum(1, keepdims=True)
    size = total**2 / np.where(square > 0, square, 1)
    edge = np.where(np.arange(shape[1]) >= n[:, None] - 1, 1.0, running / np.where(total > 0, total, 1))
    out = np.full((len(n), len(probs)), np.nan)
    for k, p in enumerate(probs):
        cdf = beta_cdf(edge, (size + 1) * p, (size + 1) * (1 - p))
        step = np.diff(cdf, axis=1, prepend=0.0)
        out[:, k] = np.where(n > 1, (np.where(there, values, 0.0) * step).sum(1), np.nan)
    return out


@F.pandas_udf(T.StructType([T.StructField("floor", T.DoubleType()), T.StructField("ceiling", T.DoubleType())]))
def weighted_bounds(x: pd.Series, w: pd.Series) -> pd.DataFrame:
    """5 and 95 % Harrell-Davis quantiles of arrays of values and weights, whole Arrow batches at a time.

    As nested column functions the continued fraction takes 16 s for 2,000 entities of four sources, here well under a second.
    """
    found = pd.DataFrame(harrell_davis(x.tolist(), w.tolist(), (0.05, 0.95)), columns=["floor", "ceiling"])
    return found.astype(object).where(found.notna(), None)
