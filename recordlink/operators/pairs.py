"""Pair relations: one row per pair, ``left_id`` and ``right_id``.

Nothing depends on the position of a row. A gold pair is two records that share a
match key nobody else has; a gold non-pair is two records whose keys are unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.config import RecordSpec
from recordlink.functions.counts import PAIRS, pairs_of, product
from recordlink.functions.draws import hash_order, hash_uniform
from recordlink.operators.ordering import first_rows, join_group_facts, number_rows

PAIR = ["left_id", "right_id"]


def key_counts(df: DataFrame, match_col: str) -> DataFrame:
    """Records per match key; records without a key are left out."""
    return df.where(F.col(match_col).isNotNull()).groupBy(match_col).agg(
        F.count(F.lit(1)).alias("n_records")
    )


def _key_ends(df: DataFrame, spec: RecordSpec) -> DataFrame:
    known = df.where(F.col(spec.match_col).isNotNull())
    return known.groupBy(spec.match_col).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(spec.id_col).alias("left_id"),
        F.max(spec.id_col).alias("right_id"),
    )


def strict_pairs(df: DataFrame, spec: RecordSpec) -> DataFrame:
    """Both records of every key that occurs exactly twice, by one aggregation."""
    return _key_ends(df, spec).where("n_records = 2").select(*PAIR)


def unique_key_ids(df: DataFrame, spec: RecordSpec) -> DataFrame:
    """Ids of the records whose key occurs once."""
    return _key_ends(df, spec).where("n_records = 1").select(F.col("left_id").alias(spec.id_col))


def strict_nonpairs(df: DataFrame, spec: RecordSpec, seed: int | None = None) -> DataFrame:
    """Records with a unique key, two by two, in id order or in a random order.

    Each record is in one pair at most; the last one of an odd number is left over.
    """
    order = [spec.id_col] if seed is None else [hash_order(spec.id_col, seed), spec.id_col]
    numbered = number_rows(unique_key_ids(df, spec), order)
    halves = numbered.groupBy(F.floor(F.col("row_no") / 2).alias("pair_no")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(spec.id_col).alias("left_id"),
        F.max(spec.id_col).alias("right_id"),
    )
    return halves.where("n_records = 2").select(*PAIR)


def neighbour_pairs(
    df: DataFrame,
    id_col: str,
    groups: Sequence[str] = (),
    partners: int = 1,
    seed: int | None = None,
) -> DataFrame:
    """Pair each record with the next ``partners`` records of its group.

    Groups of up to ``partners + 1`` records give all their pairs. A larger group
    gives ``partners`` pairs per record, so the result grows with the table and not
    with the square of a group: it samples the pairs of that group, in id order or,
    with a ``seed``, in random order. ``pair_runs`` holds all pairs of any group.
    Records are joined by row number, so a hot group is spread over all tasks.
    """
    order = [id_col] if seed is None else [hash_order(id_col, seed), id_col]
    known = df.select(*groups, id_col).dropna(subset=list(groups)) if groups else df.select(id_col)
    numbered = number_rows(known, [*groups, *order])
    ahead = F.sequence(F.col("row_no") + 1, F.col("row_no") + partners)
    left = numbered.select(
        F.explode(ahead).alias("row_no"),
        F.col(id_col).alias("_a"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
    )
    met = left.join(numbered.hint("merge"), "row_no")
    for i, g in enumerate(groups):
        met = met.where(F.col(g) == F.col(f"_g{i}"))
    return met.select(
        *groups,
        F.least("_a", id_col).alias("left_id"),
        F.greatest("_a", id_col).alias("right_id"),
    )


def pair_runs(df: DataFrame, id_col: str, groups: Sequence[str] = ()) -> DataFrame:
    """All pairs inside each group, one row per record instead of one per pair.

    In id order the pairs of a group are ab, ac, ad, bc, bd, cd. A record is the left
    side of the ``n_partners`` records after it, and those pairs are numbered from
    ``first_pair`` (0-based, per group). The relation is complete and as long as the
    table, however large a group is.
    """
    keyed = df.select(*groups, id_col)
    if groups:
        keyed = keyed.dropna(subset=list(groups))
    numbered = number_rows(keyed, [*groups, id_col])
    facts = numbered.groupBy(*groups).agg(
        F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    if groups:
        ranked = join_group_facts(numbered, facts, groups, "_size")
    else:
        only = facts.first()
        ranked = numbered.withColumns({"_first": F.lit(only["_first"]), "_size": F.lit(only["_size"])})
    ranked = ranked.withColumn("_rank", F.col("row_no") - F.col("_first"))
    return ranked.select(
        *groups,
        id_col,
        (F.col("_size") - F.col("_rank") - 1).alias("n_partners"),
        (product("_rank", "_size") - pairs_of(F.col("_rank") + 1)).cast(PAIRS).alias("first_pair"),
    )


def records_in(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Records whose id is listed."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def pair_members(pairs: DataFrame, id_col: str) -> DataFrame:
    """Ids of both sides, each with the left id of its pair as ``true_label``."""
    return pairs.select(
        F.explode(F.array("left_id", "right_id")).alias(id_col), F.col("left_id").alias("true_label")
    )


def records_outside(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Records in none of the pairs."""
    return df.join(pair_members(pairs, id_col), id_col, "left_anti")


def limit_pairs(pairs: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` of the pairs, by id or in a random order; too few pairs is an error."""
    found = pairs.count()
    if n > found:
        raise ValueError(f"asked for {n} pairs, but there are only {found}")
    order = PAIR if seed is None else [hash_order(F.struct(*PAIR), seed), *PAIR]
    return first_rows(pairs, order, n)


def shuffle_pairs(pairs: DataFrame, seed: int) -> DataFrame:
    """Pairs in a repeatable random order; a pair is one row, so it stays together."""
    return pairs.orderBy(hash_order(F.struct(*PAIR), seed), *PAIR)


def pair_ratio(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of the records that are in a pair, as one row."""
    parts = pairs.select(F.lit(2).alias("paired"), F.lit(0).alias("record")).unionByName(
        df.select(F.lit(0).alias("paired"), F.lit(1).alias("record"))
    )
    return parts.agg(F.try_divide(F.sum("paired"), F.sum("record")).alias("ratio"))


def pair_values(
    pairs: DataFrame, df: DataFrame, id_col: str, columns: Sequence[str]
) -> DataFrame:
    """Fetch both records of each pair as structs ``l`` and ``r``."""
    record = F.struct(*[F.col(f"`{c}`") for c in columns])
    left = df.select(F.col(id_col).alias("left_id"), record.alias("l"))
    right = df.select(F.col(id_col).alias("right_id"), record.alias("r"))
    return pairs.join(left, "left_id").join(right, "right_id")


def is_transposed(first: str, second: str) -> Column:
    """The two names are swapped between the sides; false where a name is missing."""
    left, right = F.col("l"), F.col("r")
    crossed = (F.lower(left[first]) == F.lower(right[second])) & (
        F.lower(left[second]) == F.lower(right[first])
    )
    return F.coalesce(crossed, F.lit(False))


def fix_transposition(values: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Give the left record of a transposed pair the right one's names, lowercased."""
    right = F.col("r")
    swapped = F.col("l")
    for name in names:
        swapped = swapped.withField(f"`{name}`", F.lower(right[name]))
    return values.withColumn("l", F.when(is_transposed(*names), swapped).otherwise(F.col("l")))


def transposed_pairs(values: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The transposed pairs with the names of both sides."""
    sides = [F.col(side)[n].alias(f"{side}_{n}") for side in "lr" for n in names]
    return values.where(is_transposed(*names)).select(*PAIR, *sides)


def records_with_gold(df: DataFrame, pairs: DataFrame, spec: RecordSpec) -> DataFrame:
    """Every record once, with ``true_label`` for gold records and transpositions fixed."""
    names = spec.transposed_pair
    members = pair_members(pairs, spec.id_col)
    if names is None:
        return df.join(members, spec.id_col, "left")
    swapped = transposed_pairs(pair_values(pairs, df, spec.id_col, names), names)
    fixes = swapped.select(
        F.col("left_id").alias(spec.id_col),
        *[F.lower(f"r_{n}").alias(f"_{n}") for n in names],
    )
    out = df.join(members, spec.id_col, "left").join(fixes, spec.id_col, "left")
    fixed = {n: F.coalesce(F.col(f"_{n}"), F.col(n)) for n in names}
    return out.withColumns(fixed).drop(*[f"_{n}" for n in names])


def working_set(gold_records: DataFrame, id_col: str, n: int, ratio: float) -> DataFrame:
    """The records of ``n`` gold pairs and the first others, so that pairs have share ``ratio``.

    The first gold labels are taken; fewer than ``n`` pairs are all taken. The others are
    ``2 * int(n / ratio - n)`` records.
    """
    n_others = 2 * int(n / ratio - n)
    gold = gold_records.where(F.col("true_label").isNotNull())
    chosen = first_rows(gold.select("true_label").distinct(), ["true_label"], n)
    others = first_rows(gold_records.where(F.col("true_label").isNull()), [id_col], n_others)
    columns = gold_records.columns
    taken = gold.join(chosen, "true_label", "left_semi").select(*[F.col(f"`{c}`") for c in columns])
    return taken.unionByName(others)


def training_labels(duplicates: DataFrame, others: DataFrame) -> DataFrame:
    """Duplicates labelled 1 and non-duplicates labelled 0, in one relation."""
    return duplicates.withColumn("label", F.lit(1)).unionByName(
        others.withColumn("label", F.lit(0))
    )


def train_test_split(pairs: DataFrame, test_size: float = 0.4, seed: int = 42) -> DataFrame:
    """Mark about ``test_size`` of the pairs as test pairs, by their ids alone."""
    return pairs.withColumn("is_test", hash_uniform(F.struct(*PAIR), seed) < test_size)
