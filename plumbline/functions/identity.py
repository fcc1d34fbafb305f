"""Identifier checks as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the first six digits of an IMO number (fixed values of the numbering scheme).
IMO_WEIGHTS = (7, 6, 5, 4, 3, 2)


def imo_digit_sum(imo: Column) -> Column:
    """Weighted sum of the first six of seven digits, by integer arithmetic."""
    n = imo.cast("long")
    terms = [F.pmod(F.floor(n / F.lit(10 ** (6 - k))), F.lit(10)) * w for k, w in enumerate(IMO_WEIGHTS)]
    return reduce(lambda a, b: a + b, terms)


def imo_is_valid(imo: Column) -> Column:
    """True for seven digits whose last one is the last digit of the weighted sum; false for everything else and null."""
    n = imo.cast("long")
    ok = n.between(1_000_000, 9_999_999) & (F.pmod(imo_digit_sum(imo), F.lit(10)) == F.pmod(n, F.lit(10)))
    return F.coalesce(ok, F.lit(False))
