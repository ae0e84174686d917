"""What the training-data operators share: tables, written tables, text basics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# of UTF-8: letters and digits of ASCII, lower-cased, and all bytes beyond it; else a space
_WORD_BYTES = bytes(
    b if b >= 128 or chr(b) in "0123456789" + LOWER else b + 32 if chr(b) in UPPER else 32
    for b in range(256)
)


# what a worker process keeps from task to task
_KEPT: dict[str, object] = {}


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """What a step remembers in a worker process; what another step remembered goes."""
    if key not in _KEPT:
        release_worker()
        _KEPT[key] = make()
    return _KEPT[key]


def release_worker() -> None:
    """Called by steps that remember nothing, for Spark reuses workers from step to step."""
    _KEPT.clear()


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; extra columns of the input, whatever their names, are left out."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
