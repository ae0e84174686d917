"""Cleaning steps: each takes a DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlink.config import RecordSpec
from recordlink.functions.distances import fold_nan
from recordlink.functions.draws import hash_order, hash_uniform
from recordlink.operators.ordering import join_facts, number_rows
from recordlink.session import is_small

# Fixed value: the pattern of a Canadian postal code.
POSTAL_PATTERN = "^[A-Za-z][0-9][A-Za-z][0-9][A-Za-z][0-9]"

# Up to this many values are broadcast when they fill the gaps of a column.
FEW_DONORS = 10_000

# Columns a postal lookup brings, and the merged column.
LATITUDE, LONGITUDE, LAT_LONG, ACCURACY = "latitude", "longitude", "lat-long", "accuracy"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null, so that one rule covers all missing values."""
    return df.select(*[fold_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def postal_key(postal: Column) -> Column:
    """Lookup key ``a1a 1a1``; an empty code is looked up as ``0``."""
    code = F.lower(F.when(postal == "", "0").otherwise(postal))
    return F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 1 << 20))


def postal_is_valid(postal: Column) -> Column:
    return postal.rlike(POSTAL_PATTERN)


def add_geodata(
    df: DataFrame, geo: DataFrame, postal_col: str, key_col: str = "postal_key"
) -> DataFrame:
    """Left join of a postal lookup table with one row per ``key_col``."""
    repeated = geo.groupBy(key_col).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"lookup key {repeated[0][0]!r} occurs more than once")
    cleaned = F.when(F.col(postal_col) == "", "0").otherwise(F.col(postal_col))
    keyed = df.withColumn(postal_col, cleaned).withColumn(key_col, postal_key(F.col(postal_col)))
    if is_small(geo):
        return keyed.join(F.broadcast(geo), key_col, "left").drop(key_col)
    # a code that many records share must not send them all to one task, known or not
    return join_facts(keyed, geo, [key_col]).drop(key_col)


def fill_uniform(df: DataFrame, columns: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Fill nulls with uniform draws between each column's least and greatest value."""
    ends = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    filled = {}
    for i, c in enumerate(columns):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is None:
            continue
        draw = F.lit(float(low)) + hash_uniform(id_col, seed + i) * float(high - low)
        filled[c] = F.coalesce(F.col(c).cast("double"), draw)
    return df.withColumns(filled)


def fill_empirical(df: DataFrame, column: str, id_col: str, seed: int) -> DataFrame:
    """Fill nulls with values drawn from the column's own non-null values."""
    known = df.where(F.col(column).isNotNull())
    n_known = known.count()
    if n_known == 0:
        return df
    values = number_rows(known.select(F.col(id_col).alias("_donor"), F.col(column).alias("_value")),
                         ["_donor"], "_pick").drop("_donor")
    missing = df.where(F.col(column).isNull())
    if n_known <= FEW_DONORS:
        # few donors are hot keys
        values = F.broadcast(values)
    pick = F.pmod(hash_order(id_col, seed), F.lit(n_known))
    drawn = (
        missing.withColumn("_pick", pick)
        .join(values, "_pick", "left")
        .withColumn(column, F.col("_value"))
        .select(*df.columns)
    )
    return known.unionByName(drawn)


def merge_columns(
    df: DataFrame, columns: Sequence[str], merged: str, drop: bool = True
) -> DataFrame:
    """Several columns as one array column."""
    out = df.withColumn(merged, F.array(*[F.col(c) for c in columns]))
    return out.drop(*columns) if drop else out


def to_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as timestamps; a value that is no timestamp raises, naming the column."""

    def parse(name: str, data_type: T.DataType) -> Column:
        value = F.col(name)
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
            return value
        parsed = F.try_to_timestamp(value.cast("string"))
        problem = F.concat(F.lit(f"column {name} has no timestamp in: "), value.cast("string"))
        failed = value.isNotNull() & parsed.isNull()
        return F.when(failed, F.raise_error(problem).cast("timestamp")).otherwise(parsed)

    types = {f.name: f.dataType for f in df.schema}
    missing = [c for c in columns if c not in types]
    if missing:
        raise ValueError(f"columns {missing} cannot be turned into timestamps: not in the table")
    return df.withColumns({c: parse(c, types[c]) for c in columns})


def sentinel_to_null(df: DataFrame, column: str, sentinel: object = 0) -> DataFrame:
    """A stand-in for a missing key as null; else its holders would all be duplicates."""
    if isinstance(df.schema[column].dataType, T.StringType):
        # a text key such as '00000000' is the sentinel too
        is_sentinel = F.expr(f"try_cast(`{column}` AS DOUBLE)") == F.lit(sentinel).cast("double")
        return df.withColumn(column, F.when(F.coalesce(is_sentinel, F.lit(False)), None).otherwise(F.col(column)))
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def subset_columns(
    df: DataFrame, spec: RecordSpec, additional: Sequence[str] | None = None
) -> DataFrame:
    """Comparison columns and match key; with ``additional``, unique and sorted."""
    names = [*spec.columns, spec.match_col]
    if additional is not None:
        names = sorted({*names, *additional})
    return df.select(*[F.col(f"`{c}`") for c in names])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in each of ``columns``."""
    return df.dropna(how="any", subset=list(columns))


def preprocess(
    df: DataFrame,
    spec: RecordSpec,
    geo: DataFrame | None = None,
    geodata: bool = True,
    datetimes: bool = True,
) -> DataFrame:
    """All cleaning steps in order; steps whose result is there already are skipped."""
    df = nan_to_null(df)
    if geodata:
        if ACCURACY not in df.columns:
            if geo is None:
                raise ValueError(f"no column {ACCURACY!r} and no lookup table to take it from")
            df = add_geodata(df, geo, spec.postal_col)
        if LAT_LONG not in df.columns:
            df = fill_uniform(df, [LATITUDE, LONGITUDE], spec.id_col, spec.seed)
            df = merge_columns(df, [LATITUDE, LONGITUDE], LAT_LONG)
        df = df.withColumn(ACCURACY, F.coalesce(F.col(ACCURACY), F.lit(0)))
    if datetimes:
        df = to_datetime(df, spec.datetime_cols)
    return sentinel_to_null(df, spec.match_col)
