"""Truth values as column expressions: every rule is one projection inside codegen.

A truth value is a pair of columns (strength, confidence); rules return such a
pair, both clamped to [0, 1].
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence at which confidence is a half, bounds of precision, most confidence of a fold.
LOOKAHEAD = 10.0
EPSILON = 1e-4
SIMILARITY_EPSILON = 1e-6
BATCH_EPSILON = 1e-7
MOST = 0.99


class TV(NamedTuple):
    s: Column
    c: Column

    @classmethod
    def of(cls, s, c) -> TV:
        return cls(_col(s), _col(c))

    def struct(self) -> Column:
        return F.struct(self.s.alias("s"), self.c.alias("c"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def make(s: Column, c: Column) -> TV:
    return TV(clamp(s), clamp(c))


#: Constants: unknown, true, false.
DEFAULT, TRUE, FALSE = (0.5, 0.0), (1.0, 0.9), (0.0, 0.9)


def deduction(a: TV, b: TV, epsilon: float = 0.0) -> TV:
    return make(a.s * b.s, a.c * b.c * (a.s + b.s) / (1 + a.s * b.s + epsilon))


def induction(positive, total) -> TV:
    p, n = _col(positive), _col(total)
    return TV(F.when(n > 0, clamp(p / n)).otherwise(0.5), F.when(n > 0, F.least(n / (n + 1), F.lit(MOST))).otherwise(0.0))


def abduction(b: TV, ab: TV) -> TV:
    return make(b.s * ab.s, 0.8 * b.c * ab.c * ab.s / (1 + b.s))


def revision(a: TV, b: TV) -> TV:
    total = a.c + b.c
    some = total >= EPSILON
    s = F.when(some, (a.s * a.c + b.s * b.c) / total).otherwise(0.5)
    c = F.when(some, F.least(a.c * b.c / (total - a.c * b.c + EPSILON), F.lit(MOST))).otherwise(0.0)
    return make(s, c)


def revised(a_s, a_c, b_s, b_c):
    """Revision of numbers or arrays, by the same rule as the columns'."""
    total, both = a_c + b_c, a_c * b_c
    some = total >= EPSILON
    s = np.where(some, (a_s * a_c + b_s * b_c) / np.where(some, total, 1.0), 0.5)
    c = np.where(some, np.minimum(both / np.where(some, total - both + EPSILON, 1.0), MOST), 0.0)
    return np.clip(s, 0, 1), np.clip(c, 0, 1)


def conjunction(a: TV, b: TV) -> TV:
    return make(a.s * b.s, a.c * b.c)


def disjunction(a: TV, b: TV) -> TV:
    return make(a.s + b.s - a.s * b.s, (a.c + b.c) / 2)


def negation(a: TV) -> TV:
    return make(1 - a.s, a.c)


def similarity(a: TV, b: TV) -> Column:
    """One less the distance of two values over the square root of two."""
    return 1 - F.sqrt((a.s - b.s) * (a.s - b.s) + (a.c - b.c) * (a.c - b.c)) / F.sqrt(F.lit(2.0))


def implication(a: TV, b: TV) -> TV:
    return make(1 - a.s + a.s * b.s, F.least(a.c, b.c))


def indefinite(positive, negative) -> TV:
    p, n = _col(positive), _col(negative)
    total = p + n
    return TV(F.when(total > 0, clamp(p / total)).otherwise(0.5), F.when(total > 0, total / (total + LOOKAHEAD)).otherwise(0.0))


def extensional_similarity(a: TV, b: TV) -> TV:
    both = a.s * b.s
    return make(both / (a.s + b.s - both + SIMILARITY_EPSILON), F.least(a.c, b.c))


# Batch rules: their confidences differ from those above.


def batch_and(a: TV, b: TV) -> TV:
    return deduction(a, b, BATCH_EPSILON)


def batch_or(a: TV, b: TV) -> TV:
    both = a.c * b.c
    return make(a.s + b.s - a.s * b.s, both / (a.c + b.c - both + BATCH_EPSILON))


def batch_implies(a: TV, b: TV) -> TV:
    return make(1 - a.s + a.s * b.s, a.c * b.c / (1 + F.abs(a.s - b.s) + BATCH_EPSILON))


def batch_equivalent(a: TV, b: TV) -> TV:
    return make(1 - F.abs(a.s - b.s), a.c * b.c / (1 + F.abs(a.s - b.s) + BATCH_EPSILON))


def batch_xor(a: TV, b: TV) -> TV:
    return make(F.abs(a.s + b.s - 2 * a.s * b.s), F.least(a.c, b.c))


def batch_default(a: TV, b: TV) -> TV:
    return make(a.s * b.s, F.least(a.c, b.c))


batch_not = negation
batch_deduction = batch_and
BATCH = {"AND": batch_and, "OR": batch_or, "IMPLIES": batch_implies, "EQUIVALENT": batch_equivalent, "XOR": batch_xor, "NOT": batch_default}


def batch(op: str, a: TV, b: TV | None = None) -> TV:
    """A batch rule by name; one operand only for NOT."""
    if b is None:
        if op != "NOT":
            raise ValueError(f"{op} takes two operands")
        return batch_not(a)
    return BATCH.get(op, batch_default)(a, b)


def revision_fold(values: Column) -> Column:
    """Left fold of an array of (s, c) structs by revision."""

    def step(a: Column, x: Column) -> Column:
        return revision(TV(a["s"], a["c"]), TV(x["s"], x["c"])).struct()

    first = F.get(values, F.lit(0))
    start = F.struct(first["s"].cast("double").alias("s"), first["c"].cast("double").alias("c"))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
