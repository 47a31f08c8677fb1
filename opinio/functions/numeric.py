"""Numeric expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floating aggregates are rounded to 9 decimals so that engines summing in a
# different order still return the same double (the oracle rounds alike).
FLOAT_DIGITS = 9


def fround(c: Column) -> Column:
    return F.round(c, FLOAT_DIGITS)


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator (ANSI-safe)."""
    return F.try_divide(num, den)


def power2(n: Column) -> Column:
    """PostgreSQL ``2^n`` is exponentiation (in Spark ``^`` is XOR)."""
    return F.pow(F.lit(2.0), n)
