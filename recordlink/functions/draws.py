"""Random draws that depend on a row's id and a seed only.

``rand()`` and ``monotonically_increasing_id()`` give new values when a lost
partition is computed again; a hash of the id does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Column | str, seed: int, purpose: str = "order") -> Column:
    """A repeatable random sort key; different purposes give unrelated keys."""
    return F.xxhash64(F.lit(purpose), F.lit(seed), key)


def hash_uniform(key: Column | str, seed: int, purpose: str = "uniform") -> Column:
    """A repeatable uniform draw from [0, 1)."""
    return F.shiftrightunsigned(hash_order(key, seed, purpose), 11) * F.lit(2.0**-53)
