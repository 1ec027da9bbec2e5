"""Elementwise functions on numbers, and on arrays of them: names to column expressions.

Special functions that Spark lacks run in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.store import ship


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fmod(x: Column, y: Column) -> Column:
    """Remainder with the dividend's sign."""
    return x % y


def remainder(x: Column, y: Column) -> Column:
    """Remainder with the divisor's sign."""
    return x - y * F.floor(x / y)


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "neg": lambda x: -x, "sign": F.signum, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x: F.bround(x, 0), "trunc": trunc, "frac": lambda x: x - trunc(x), "exp": F.exp, "expm1": F.expm1, "log": F.log, "log1p": F.log1p,
    "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "rsqrt": lambda x: 1 / F.sqrt(x), "reciprocal": lambda x: 1 / x, "square": lambda x: x * x,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "relu": lambda x: F.greatest(x, F.lit(0.0)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin,
    "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "isnan": F.isnan, "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")), "logical_not": lambda x: x == 0, "bitwise_not": F.bitwise_not,
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y, "pow": F.pow, "atan2": F.atan2,
    "fmod": fmod, "remainder": remainder, "min": F.least, "max": F.greatest, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y,
    "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y,
    "logical_and": lambda x, y: (x != 0) & (y != 0), "logical_or": lambda x, y: (x != 0) | (y != 0), "logical_xor": lambda x, y: (x != 0) != (y != 0),
    "bitwise_and": lambda x, y: x.bitwiseAND(y), "bitwise_or": lambda x, y: x.bitwiseOR(y), "bitwise_xor": lambda x, y: x.bitwiseXOR(y),
}


def lerp(a: Column, b: Column, w) -> Column:
    return a + (b - a) * w


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(x - y) <= atol + rtol * F.abs(y)


def all_close(x: Column, y: Column, **kw) -> Column:
    """Aggregate: whether all rows are close."""
    return F.bool_and(is_close(x, y, **kw))


def over_array(f: Callable[[Column], Column], a: Column) -> Column:
    return F.transform(a, f)


def over_arrays(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.zip_with(a, b, f)


# Special functions of whole arrays.


def _digamma(x: np.ndarray) -> np.ndarray:
    """Reflection below a half, recurrence up to ten, then the asymptotic series."""
    x = np.asarray(x, float)
    pole = (x <= 0) & (x == np.floor(x))
    low = x < 0.5
    y = np.where(low, 1 - x, x)
    out = np.zeros_like(y)
    for _ in range(10):
        small = y < 10
        out -= np.where(small, 1 / y, 0.0)
        y = np.where(small, y + 1, y)
    inv = 1 / (y * y)
    out += np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    with np.errstate(all="ignore"):
        out = np.where(low, out - np.pi / np.tan(np.pi * x), out)
    return np.where(pole, np.nan, out)


def _erfinv(y: np.ndarray) -> np.ndarray:
    """A closed first guess and four steps of Newton's method."""
    y = np.asarray(y, float)
    a = 0.147
    with np.errstate(all="ignore"):
        u = np.log1p(-y * y)
        x = np.copysign(np.sqrt(np.sqrt((2 / (np.pi * a) + u / 2) ** 2 - u / a) - (2 / (np.pi * a) + u / 2)), y)
        for _ in range(4):
            x = x - (_each(math.erf, x) - y) / (2 / math.sqrt(math.pi) * np.exp(-x * x))
    return np.where(np.abs(y) > 1, np.nan, np.where(np.abs(y) == 1, np.copysign(np.inf, y), x))


def _polygamma(n: int, x: np.ndarray) -> np.ndarray:
    """Derivatives of digamma by recurrence and the asymptotic series."""
    if n == 0:
        return _digamma(x)
    y, fact = np.asarray(x, float), math.factorial(n)
    out = np.zeros_like(y)
    for _ in range(64):
        small = y < 20
        if not small.any():
            break
        out += np.where(small, fact / y ** (n + 1), 0.0)
        y = np.where(small, y + 1, y)
    out += math.factorial(n - 1) / y**n + fact / (2 * y ** (n + 1))
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):
        out += b * math.factorial(2 * k + n - 1) / (math.factorial(2 * k) * y ** (2 * k + n))
    return (-1) ** (n + 1) * out


def _each(f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    """The C library's function on each distinct number of a batch."""
    distinct, back = np.unique(x, return_inverse=True)
    return np.array([f(v) if math.isfinite(v) else math.nan if v != v else f(math.copysign(30.0, v)) if f is not math.lgamma else math.inf for v in distinct.tolist()])[back].reshape(x.shape)


def _lgamma(v: float) -> float:
    return math.inf if v <= 0 and v == math.floor(v) else math.lgamma(v)


def _special(f: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float, na_value=np.nan)
        return pd.Series(np.where(np.isnan(v), np.nan, f(np.where(np.isnan(v), 0.25, v)))).where(x.notna())

    return apply


SPECIAL = {"erf": lambda x: _each(math.erf, x), "erfc": lambda x: _each(math.erfc, x), "erfinv": _erfinv, "lgamma": lambda x: _each(_lgamma, x), "digamma": _digamma}


def special(name: str, x: Column, order: int = 1) -> Column:
    """erf, erfc, erfinv, lgamma, digamma, or polygamma of an order."""
    ship(SparkSession.active())
    f = SPECIAL[name] if name != "polygamma" else lambda v: _polygamma(order, v)
    return _special(f)(x.cast("double"))


# Losses as aggregates.

LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda p, t: F.avg((p - t) * (p - t)),
    "l1": lambda p, t: F.avg(F.abs(p - t)),
    "kl_div": lambda log_p, t: F.avg(F.when(t > 0, t * (F.log(t) - log_p)).otherwise(0.0)),
    "nll": lambda log_p, t: -F.avg(F.element_at(log_p, t.cast("int") + 1)),
}


def cosine_embedding_loss(a: Column, b: Column, y: Column, margin: float = 0.0) -> Column:
    from graphloom.functions.vector import cosine

    c = cosine(a, b)
    return F.avg(F.when(y == 1, 1 - c).otherwise(F.greatest(F.lit(0.0), c - margin)))
