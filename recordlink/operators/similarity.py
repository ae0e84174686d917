"""Distance vectors of pairs of records."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlink.config import RecordSpec
from recordlink.functions.distances import distance, fold_nan, number_text
from recordlink.operators.ordering import join_value_facts
from recordlink.operators.pairs import pair_values
from recordlink.session import checkpoint


def named(column: str) -> str:
    """Name of the distance of a comparison column."""
    return f"d_{column}"


def comparable_columns(df: DataFrame, spec: RecordSpec) -> dict[str, Column]:
    """Comparison values: NaN folded to null, numbers compared as text without exponent."""
    out = {}
    for column, name in spec.distances.items():
        data_type = df.schema[column].dataType
        value = fold_nan(F.col(f"`{column}`"), data_type)
        is_float = isinstance(data_type, (T.DoubleType, T.FloatType))
        as_text = is_float and name in ("EDIT_DISTANCE", "JARO_WINKLER")
        out[column] = number_text(value) if as_text else value
    return out


def comparable(df: DataFrame, spec: RecordSpec) -> DataFrame:
    return df.withColumns(comparable_columns(df, spec))


def distance_columns(
    spec: RecordSpec, left: Callable[[str], Column], right: Callable[[str], Column]
) -> dict[str, Column]:
    """Distance of each comparison column, given how to reach either side's value."""
    return {
        named(c): distance(name).between(left(c), right(c)).cast("double")
        for c, name in spec.distances.items()
    }


def measured_once(values: DataFrame, distances: Mapping[str, str]) -> DataFrame:
    """Add ``d_<column>`` for distances that run in Python: once per pair of different values.

    ``values`` has the structs ``l`` and ``r``, ``distances`` a name per column. Equal pairs of
    values are summed up to one before they are measured, and the result is joined back by
    value; pairs of values that many rows have are spread (``join_facts``).
    """
    sides = {
        f"_{side}_{i}": distance(name).prepare(F.col(side)[c])
        for side in "lr"
        for i, (c, name) in enumerate(distances.items())
    }
    values = checkpoint(values.withColumns(sides))
    for i, (c, name) in enumerate(distances.items()):
        pair = [f"_l_{i}", f"_r_{i}"]
        measure = distance(name).measure(*map(F.col, pair)).cast("double")
        counted = values.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"))
        measured = checkpoint(counted.withColumn(named(c), measure))
        values = join_value_facts(values, measured, pair, "_n")
    return values.drop(*sides)


def value_distances(values: DataFrame, spec: RecordSpec) -> DataFrame:
    """Add ``d_<column>`` for the structs ``l`` and ``r`` of ``pair_values``; drop both."""
    columns = distance_columns(spec, lambda c: F.col("l")[c], lambda c: F.col("r")[c])
    python = {c: d for c, d in spec.distances.items() if distance(d).python}
    if not python:
        return values.withColumns(columns).drop("l", "r")
    given = [F.col(f"`{c}`") for c in values.columns if c not in ("l", "r")]
    found = {named(c): F.col(f"`{named(c)}`") for c in python}
    return measured_once(values, python).select(*given, *[found.get(n, d).alias(n) for n, d in columns.items()])


def pair_distances(pairs: DataFrame, df: DataFrame, spec: RecordSpec) -> DataFrame:
    """The pair relation with one distance per comparison column."""
    values = pair_values(pairs, comparable(df, spec), spec.id_col, spec.columns)
    return value_distances(values, spec)


def distance_array(df: DataFrame, spec: RecordSpec, name: str = "dist") -> DataFrame:
    """The distances as one array, in the order of ``spec.columns``."""
    return df.withColumn(name, F.array(*[F.col(f"`{named(c)}`") for c in spec.columns]))


def literal_of(value: object, data_type: T.DataType) -> Column:
    """One driver-side value as a literal of the column's own type."""
    return F.lit(value).cast(data_type)


def distance_to_record(df: DataFrame, record: dict, spec: RecordSpec) -> DataFrame:
    """Distances of every record to one given record."""
    df = comparable(df, spec)
    types = {f.name: f.dataType for f in df.schema}
    columns = distance_columns(
        spec, lambda c: F.col(f"`{c}`"), lambda c: literal_of(record[c], types[c])
    )
    return df.select(spec.id_col, *[d.alias(n) for n, d in columns.items()])
