"""Row numbers, first-n and group facts without putting a group in one task.

A window without a partition key, or partitioned by a key that a third of the rows
share, sorts those rows in one task. Here rows are sorted over the whole cluster
and numbered from the sizes of the sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.session import BROADCAST_ROWS, checkpoint, is_small

# Up to this many rows Spark's own top-n is used: each task sends so many to one task.
SMALL_LIMIT = 100

# A group holding more than 1/HOT_PARTS of all rows is hot, so fewer than
# HOT_PARTS groups can be.
HOT_PARTS = 2000


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "row_no",
    start: int = 0,
    keep: Callable[[DataFrame], DataFrame] = checkpoint,
) -> DataFrame:
    """Number rows ``start, start + 1, ...`` in the given total order.

    ``keep`` holds what was sorted; rows that are many times the records may be ``stored``.
    """
    placed = keep(df.sort(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int")
    # one number per sorted partition
    sizes = dict(placed.groupBy(part).count().collect())
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.get(F.lit(starts).cast("array<bigint>"), part)
    return placed.withColumn(name, before + within + start).drop("_place")


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in the given total order, as documented row limits ask."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    return number_rows(df, order, "_row").where(F.col("_row") < n).drop("_row")


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def join_group_facts(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, how: str = "left"
) -> DataFrame:
    """Add to each row the columns of its group's single row in ``facts``.

    ``facts[size]`` is the number of rows of the group. Hot groups, fewer than
    ``HOT_PARTS`` by count, are joined by broadcast; the rest are shuffled. Missing
    keys match each other. ``rows`` are read twice.
    """
    facts = checkpoint(facts)
    added = [c for c in facts.columns if c not in keys]
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.where(F.col(size) > total / HOT_PARTS)
    cold = facts.where(F.col(size) <= total / HOT_PARTS)
    same = _same("rows", "facts", keys)
    pick = ["rows.*", *[F.col(f"facts.{c}") for c in added]]

    rows = rows.alias("rows")
    in_hot = rows.join(F.broadcast(hot.alias("facts")), same).select(*pick)
    others = rows.join(F.broadcast(hot.select(*keys).alias("facts")), same, "left_anti")
    in_cold = others.alias("rows").join(cold.alias("facts"), same, how).select(*pick)
    return in_hot.unionByName(in_cold)


def join_value_facts(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, width: int = 1
) -> DataFrame:
    """``join_group_facts`` for facts found among ``rows``; few facts are broadcast whole.

    ``facts`` are checkpointed, one row per key with ``width`` numbers or so; ``size`` is
    dropped.
    """
    if not is_small(facts, BROADCAST_ROWS // width):
        return join_group_facts(rows, facts, keys, size).drop(size)
    added = [c for c in facts.columns if c not in keys and c != size]
    same = _same("rows", "facts", keys)
    pick = ["rows.*", *[F.col(f"facts.{c}") for c in added]]
    return rows.alias("rows").join(F.broadcast(facts.alias("facts")), same, "left").select(*pick)


# Hot facts are broadcast up to so many bytes, beyond that they are salted.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``facts`` (one row per key) to rows of which any key may be hot.

    Hot keys are found among ``rows``, so a key without facts, or a missing one, is spread
    as well. Missing keys match each other. ``rows`` are read three times. Facts that are
    not hot are as many as the records, so they are merged: their bytes in a shuffle, by
    which Spark would choose a broadcast, are a fraction of what the driver would hold.
    """
    merged = facts.alias("facts").hint("merge")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot_keys = checkpoint(counts.where(F.col("_n") > max(total / HOT_PARTS, SMALL_LIMIT)).drop("_n"))
    added = [c for c in facts.columns if c not in keys]
    same = _same("rows", "facts", keys)
    pick = ["rows.*", *[F.col(f"facts.{c}") for c in added]]
    if not hot_keys.limit(1).count():
        return rows.alias("rows").join(merged, same, "left").select(*pick)
    # fewer than HOT_PARTS rows
    hot_facts = checkpoint(
        hot_keys.alias("rows").join(merged, same, "left").select(*pick)
    )
    size = hot_facts.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    in_hot = rows.alias("rows").join(F.broadcast(hot_keys.alias("facts")), same, "left_semi")
    in_cold = rows.alias("rows").join(F.broadcast(hot_keys.alias("facts")), same, "left_anti")
    cold = in_cold.alias("rows").join(merged, same, "left").select(*pick)
    if size <= BROADCAST_BYTES:
        hot = in_hot.alias("rows").join(F.broadcast(hot_facts.alias("facts")), same, "left").select(*pick)
    else:
        salted = in_hot.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
        copies = hot_facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        also = same & (F.col("rows._salt") == F.col("facts._salt"))
        hot = salted.alias("rows").join(copies.alias("facts"), also, "left").select(*pick).drop("_salt")
    return hot.unionByName(cold)
