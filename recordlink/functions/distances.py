"""Distances between two values, and the registry that names them.

A distance has two steps. ``prepare`` normalises one value and runs once per
record; ``measure`` compares two prepared values and runs once per pair. Both are
column expressions; all but Jaro-Winkler stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlink.functions.jaro import jaro_winkler_similarity

# Fixed value: the text that a missing value is compared as.
NULL_TEXT = "none"


def _as_is(value: Column) -> Column:
    return value


@dataclass(frozen=True)
class Distance:
    """A named distance.

    ``step`` is the least distance between two values that do not agree, if there
    is one. ``bound`` is the greatest distance possible; where that depends on the
    data, ``widest`` aggregates prepared values to it. Rules use these to tell which
    pairs they can never accept. ``within(a, b, limit)`` tests measure <= limit where
    that is cheaper than measuring, and ``cheap`` marks plain arithmetic. ``python``
    marks Python UDFs, which Spark allows neither inside lambdas nor in join conditions.
    """

    measure: Callable[[Column, Column], Column]
    prepare: Callable[[Column], Column] = _as_is
    step: float = 0.0
    bound: float | None = None
    widest: Callable[[Column], Column] | None = None
    within: Callable[[Column, Column, Column], Column] | None = None
    cheap: bool = False
    python: bool = False

    def between(self, left: Column, right: Column) -> Column:
        return self.measure(self.prepare(left), self.prepare(right))


def text(value: Column) -> Column:
    """Lowercase text; a missing value becomes the null text."""
    return F.coalesce(F.lower(value.cast("string")), F.lit(NULL_TEXT))


def number_text(value: Column) -> Column:
    """Text of a double without an exponent (``10000000.0``, not ``1.0E7``)."""
    plain = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value)
    return F.when((size < 1e16) & ((size >= 1e-4) | (size == 0)), plain).otherwise(
        value.cast("string")
    )


def fold_nan(value: Column, data_type: T.DataType) -> Column:
    """NaN as null. Spark holds NaN = NaN to be true, unlike other engines."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two texts."""
    return F.levenshtein(left, right)


def equality(left: Column, right: Column) -> Column:
    """0 if equal, 1 if not; a missing value differs from everything."""
    return F.when(left == right, 0).otherwise(1)


def euclidean_distance(left: Column, right: Column) -> Column:
    """Length of the difference of two arrays of numbers."""
    squares = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def euclidean_of_length(n: int) -> Callable[[Column, Column], Column]:
    """Euclidean distance of arrays of known length, without lambdas."""

    def measure(left: Column, right: Column) -> Column:
        total = F.lit(0.0)
        for i in range(n):
            gap = left[i] - right[i]
            total = total + gap * gap
        return F.sqrt(total)

    return measure


def time_difference(left: Column, right: Column) -> Column:
    """Absolute difference of two timestamps in seconds, with fractions."""
    return F.abs(F.timestamp_diff("MICROSECOND", left, right)) / 1e6


def jaro_winkler_distance(left: Column, right: Column) -> Column:
    return 1 - jaro_winkler_similarity(left, right)


def haversine_distance(left: Column, right: Column) -> Column:
    """Great-circle angle in radians between two [latitude, longitude] arrays."""
    lat_1, lat_2 = F.radians(left[0]), F.radians(right[0])
    half_lat = (lat_1 - lat_2) / 2
    half_lon = (F.radians(left[1]) - F.radians(right[1])) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(lat_1) * F.cos(lat_2) * F.pow(F.sin(half_lon), 2)
    return 2 * F.asin(F.sqrt(chord))


def pair_mean(left: Column, right: Column) -> Column:
    """Mean of two numbers."""
    return (left + right) / 2


def _within_edits(left: Column, right: Column, limit: Column) -> Column:
    # Spark stops early once the limit is passed; the Python wrapper takes no column
    return F.call_function("levenshtein", left, right, limit) >= 0


def _longest_text(value: Column) -> Column:
    return F.max(F.length(value))


def _widest_vector(value: Column) -> Column:
    squares = F.aggregate(value, F.lit(0.0), lambda total, x: total + x * x)
    return 2 * F.max(F.sqrt(squares))


def _time_range(value: Column) -> Column:
    return time_difference(F.min(value), F.max(value))


_REGISTRY: dict[str, Distance] = {
    "EQUALITY": Distance(equality, step=1.0, bound=1.0, cheap=True),
    "EDIT_DISTANCE": Distance(
        edit_distance, prepare=text, step=1.0, widest=_longest_text, within=_within_edits
    ),
    "EUCLIDEAN": Distance(euclidean_distance, widest=_widest_vector),
    "TIME_DELTA": Distance(time_difference, widest=_time_range, cheap=True),
    "JARO_WINKLER": Distance(jaro_winkler_distance, prepare=text, bound=1.0, python=True),
    "HAVERSINE": Distance(haversine_distance, bound=math.pi, cheap=True),
    "MEAN": Distance(pair_mean, cheap=True),
}


def distance(name: str) -> Distance:
    if name not in _REGISTRY:
        raise ValueError(f"unknown distance {name!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def register_distance(
    name: str,
    measure: Callable[[Column, Column], Column],
    *,
    prepare: Callable[[Column], Column] = _as_is,
    step: float = 0.0,
    bound: float | None = None,
    python: bool = False,
) -> None:
    """Add a distance, which has to be symmetric.

    A ``pandas_udf`` may be given as ``measure`` with ``python=True``.

    Leave ``step`` at 0 and ``bound`` at None unless they are certain: a rule skips
    pairs that they show to be unacceptable.
    """
    _REGISTRY[name] = Distance(measure, prepare, step, bound, python=python)
