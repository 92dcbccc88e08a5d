"""Arithmetic on natural logarithms, with a sentinel for the logarithm of zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the logarithm that stands for zero.
LOG_ZERO = -1073741824.0
#: Two logarithms closer than this are equal (fixed value).
CLOSE = 1e-10


def _zero() -> Column:
    return F.lit(LOG_ZERO)


def log(x: Column) -> Column:
    """ln x; zero gives the sentinel, a negative number an error."""
    return F.when(x == 0, _zero()).when(x > 0, F.ln(x)).otherwise(F.raise_error(F.lit("logarithm of a negative number")))


def exp(a: Column) -> Column:
    return F.when(a <= LOG_ZERO, F.lit(0.0)).otherwise(F.exp(a))


def add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)"""
    return F.when(a <= LOG_ZERO, b).when(b <= LOG_ZERO, a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def sub(a: Column, b: Column) -> Column:
    """ln(e^a - e^b); equal operands give zero's logarithm, a smaller a an error."""
    return F.when(b <= LOG_ZERO, a).when(F.abs(a - b) <= CLOSE, _zero()).when(a > b, a + F.log1p(-F.exp(b - a))).otherwise(F.raise_error(F.lit("difference below zero")))


def mul(a: Column, b: Column) -> Column:
    return F.when((a <= LOG_ZERO) | (b <= LOG_ZERO), _zero()).otherwise(a + b)


def div(a: Column, b: Column) -> Column:
    return F.when(a <= LOG_ZERO, _zero()).when(b <= LOG_ZERO, F.raise_error(F.lit("division by zero"))).otherwise(a - b)


def power(a: Column, n: Column) -> Column:
    return F.when(a <= LOG_ZERO, _zero()).otherwise(a * n)


def increment(a: Column) -> Column:
    """ln(e^a + 1)"""
    return add(a, F.lit(0.0))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; close logarithms are equal."""
    return F.when(F.abs(a - b) <= CLOSE, 0).when(a > b, 1).otherwise(-1)
