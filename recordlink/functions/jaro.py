"""Jaro-Winkler similarity, which Spark does not have, as an Arrow UDF.

Each Arrow batch is worked as a whole: strings become rows of a character matrix,
and one pass over the character positions matches all pairs of the batch at once.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send this module's code with the UDF: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the published algorithm.
PREFIX_SCALE = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7

# Pairs are worked in runs of similar length, so one long text pads few others.
CELLS_PER_RUN = 1 << 18


def _characters(strings: np.ndarray, width: int) -> np.ndarray:
    padded = np.array(strings, dtype=f"U{width}")
    return padded.view(np.uint32).reshape(len(strings), width)


def _similarity(left: np.ndarray, right: np.ndarray, len_l: np.ndarray, len_r: np.ndarray):
    width = max(int(len_l.max()), int(len_r.max()), 1)
    a, b = _characters(left, width), _characters(right, width)
    place = np.arange(width)
    reach = np.maximum(np.maximum(len_l, len_r) // 2 - 1, 0)[:, None]
    open_b = place < len_r[:, None]
    hit_a = np.zeros_like(open_b)
    for i in range(width):
        fits = open_b & (b == a[:, i : i + 1]) & (np.abs(place - i) <= reach)
        fits &= (i < len_l)[:, None]
        rows = np.flatnonzero(fits.any(axis=1))
        hit_a[rows, i] = True
        open_b[rows, fits[rows].argmax(axis=1)] = False
    hit_b = ~open_b & (place < len_r[:, None])

    hits = hit_a.sum(axis=1)
    packed_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable"), axis=1)
    packed_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable"), axis=1)
    swaps = ((packed_a != packed_b) & (place < hits[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (hits / len_l + hits / len_r + (hits - swaps) / hits) / 3
    jaro = np.where(hits == 0, 0.0, jaro)

    head = min(PREFIX_LENGTH, width)
    equal = (a[:, :head] == b[:, :head]) & (place[:head] < np.minimum(len_l, len_r)[:, None])
    prefix = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_SCALE * (1 - jaro), jaro)


def similarity_of_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    a, b = left.to_numpy(dtype=object), right.to_numpy(dtype=object)
    len_l = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    len_r = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    longest = np.maximum(len_l, len_r)
    order = np.argsort(longest, kind="stable")
    out = np.zeros(len(a))
    start = 0
    while start < len(order):
        run = order[start : start + 4096]
        room = max(1, CELLS_PER_RUN // max(1, int(longest[run[-1]])))
        run = run[:room]
        out[run] = _similarity(a[run], b[run], len_l[run], len_r[run])
        start += len(run)
    return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity in [0, 1]; an empty string is unlike everything (0)."""
    return pd.Series(similarity_of_batch(left, right))
