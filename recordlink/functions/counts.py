"""Counts of pairs that stay exact for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enough digits for the pairs of 10^18 records.
PAIRS = "decimal(38,0)"


def _wide(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def pairs_of(n: str | Column) -> Column:
    """Number of pairs in a group of ``n``: the even factor is halved first."""
    n = F.col(n) if isinstance(n, str) else n
    # a sum of counts is a decimal itself
    n = n.cast("bigint")
    half = F.when(n % 2 == 0, _wide(F.shiftright(n, 1)) * _wide(n - 1))
    return half.otherwise(_wide(n) * _wide(F.shiftright(n - 1, 1))).cast(PAIRS)


def product(left: str, right: str) -> Column:
    """Pairs between two groups."""
    return (_wide(F.col(left)) * _wide(F.col(right))).cast(PAIRS)
