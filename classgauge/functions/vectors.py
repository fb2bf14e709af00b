"""Expressions over arrays of class scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row.

    Spark copies a column's expression to where the column is used, also into
    lambdas and pushed-down filters, and would then evaluate it there each time.
    A lambda argument is bound to its value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(scores: Column) -> Column:
    """Index of the largest entry; the first one on ties."""
    return let(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def linear(hidden: Column, weights: Column, bias: Column) -> Column:
    """``W h + b`` with W an array of rows: one score per class."""
    return F.zip_with(F.transform(weights, lambda row: dot(hidden, row)), bias, lambda z, b: z + b)


def softmax(logits: Column) -> Column:
    """Softmax shifted by the largest logit."""

    def powers(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    return let(let(logits, powers), shares)


def rounded(values: Column, digits: int) -> Column:
    return F.transform(values, lambda v: F.round(v, digits))


ERFC_TERMS = 80


def _erf_near(t: Column) -> Column:
    """erf by its series with positive terms, 2 t e^(-t^2) / sqrt(pi) times the sum of (2 t^2)^n / (3 * 5 * .. * (2n + 1)): for t up to 2."""
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, n: Column) -> Column:
        return let(s["term"] * (2.0 * t * t / (2.0 * n + 1.0)), lambda term: F.struct(term.alias("term"), (s["total"] + term).alias("total")))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERFC_TERMS)), state, step, lambda s: s["total"])
    return 2.0 / math.sqrt(math.pi) * t * F.exp(-t * t) * total


def _erfc_far(t: Column) -> Column:
    """erfc by its continued fraction e^(-t^2) / sqrt(pi) / (t + (1/2) / (t + (2/2) / (t + ..))), from the inside: for t from 2."""
    down = F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1))
    return F.exp(-t * t) / math.sqrt(math.pi) / F.aggregate(down, t, lambda s, n: t + (n / 2.0) / s)


def erfc(t: Column) -> Column:
    """The complementary error function for t >= 0, which Spark lacks, without leaving the JVM."""
    return let(t.cast("double"), lambda x: F.when(x < 2.0, 1.0 - _erf_near(x)).otherwise(_erfc_far(x)))


def chi2_tail_1df(stat: Column | str) -> Column:
    """Upper tail of the chi-square law with one degree of freedom."""
    return erfc(F.sqrt((F.col(stat) if isinstance(stat, str) else stat) / 2.0))
