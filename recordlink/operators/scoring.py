"""How many comparisons blocks cost, and how good blocks and predictions are.

Pairs are counted from group sizes: a group of n records has n (n - 1) / 2 pairs.
Nothing here lists pairs that were not predicted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.config import RecordSpec
from recordlink.functions.counts import PAIRS, pairs_of, product
from recordlink.operators.matching import duplicate_members, with_profile_facts
from recordlink.operators.ordering import join_facts
from recordlink.operators.similarity import comparable
from recordlink.session import checkpoint


def count_comparisons(records: DataFrame, block: str) -> DataFrame:
    """Pairs inside blocks, pairs in the whole table, and their ratio, as one row."""
    sizes = records.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    # records without a block meet nobody, but count in the whole table
    in_blocks = F.sum(F.when(F.col(block).isNotNull(), pairs_of("n")).otherwise(F.lit(0).cast(PAIRS)))
    found = sizes.agg(in_blocks.alias("block_pairs"), F.sum("n").alias("n"))
    return found.select(
        "block_pairs",
        pairs_of("n").alias("all_pairs"),
        F.try_divide(F.col("block_pairs").cast("double"), pairs_of("n").cast("double")).alias("ratio"),
    )


def block_pair_labels(records: DataFrame, spec: RecordSpec, block: str) -> DataFrame:
    """Per block: pairs known to be duplicates, known not to be, and unknown."""
    per_key = (
        records.where(F.col(block).isNotNull())
        .groupBy(block, spec.match_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    has_key = F.col(spec.match_col).isNotNull()
    sizes = per_key.groupBy(block).agg(
        F.sum("n").alias("n_all"),
        F.coalesce(F.sum(F.when(has_key, F.col("n"))), F.lit(0)).alias("n_known"),
        F.coalesce(F.sum(F.when(has_key, pairs_of("n"))), F.lit(0)).alias("duplicate_pairs"),
    )
    return sizes.select(
        block,
        "duplicate_pairs",
        (pairs_of("n_known") - F.col("duplicate_pairs")).alias("nonduplicate_pairs"),
        (pairs_of("n_all") - pairs_of("n_known")).alias("unknown_pairs"),
    )


def pair_label(left_key: Column, right_key: Column) -> Column:
    """1 duplicate, 0 not, -1 unknown because a match key is missing."""
    unknown = left_key.isNull() | right_key.isNull()
    return F.when(unknown, -1).when(left_key == right_key, 1).otherwise(0)


def _true_positives(
    records: DataFrame, profile_rows: DataFrame, pairs: DataFrame, spec: RecordSpec, block: str
) -> DataFrame:
    """Predicted pairs of records that share a match key, as one row."""
    columns = [block, *spec.columns]
    members = duplicate_members(pairs).select("profile_id").distinct()
    wanted = profile_rows.join(members.hint("merge"), "profile_id", "left_semi")
    facts = wanted.select(*[F.col(f"`{c}`") for c in columns], "profile_id", "copies")
    per_key = (
        comparable(records, spec)
        .where(F.col(spec.match_col).isNotNull())
        .groupBy(*[F.col(f"`{c}`") for c in columns], spec.match_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = checkpoint(
        join_facts(checkpoint(per_key), facts, columns)
        .where("profile_id IS NOT NULL")
        .select("profile_id", F.col(spec.match_col).alias("match"), "n")
    )
    n_keys = keys.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_keys"))

    def with_keys(found: DataFrame, side: str) -> DataFrame:
        of_side = n_keys.select(F.col("profile_id").alias(f"{side}_id"), F.col("n_keys").alias(f"{side}_keys"))
        return found.join(of_side.hint("merge"), f"{side}_id")

    # the profile with fewer keys looks its keys up in those of the other
    sized = with_keys(with_keys(pairs.where("left_id <> right_id").select("left_id", "right_id"), "left"), "right")
    fewer = F.col("left_keys") <= F.col("right_keys")
    turned = sized.select(
        F.when(fewer, F.col("left_id")).otherwise(F.col("right_id")).alias("few_id"),
        F.when(fewer, F.col("right_id")).otherwise(F.col("left_id")).alias("many_id"),
    )
    few = keys.select(F.col("profile_id").alias("few_id"), "match", F.col("n").alias("n_few"))
    many = keys.select(F.col("profile_id").alias("many_id"), "match", F.col("n").alias("n_many"))
    crossing = (
        turned.join(few.hint("merge"), "few_id")
        .join(many.hint("merge"), ["many_id", "match"])
        .select(product("n_few", "n_many").alias("tp"))
    )
    copies = (
        pairs.where("left_id = right_id")
        .select("left_id")
        .join(keys.withColumnRenamed("profile_id", "left_id").hint("merge"), "left_id")
        .select(pairs_of("n").alias("tp"))
    )
    return crossing.unionByName(copies).agg(F.coalesce(F.sum("tp"), F.lit(0)).cast(PAIRS).alias("tp"))


COUNTS = ("pos", "neg", "predicted", "tp")


def _confusion_sums(
    records: DataFrame, profile_rows: DataFrame, pairs: DataFrame, spec: RecordSpec, block: str
) -> DataFrame:
    """Parts of the counts of in-block pairs with known label; their sums are the counts."""
    zero = F.lit(0).cast(PAIRS)
    known = block_pair_labels(records, spec, block).select(
        F.col("duplicate_pairs").alias("pos"),
        F.col("nonduplicate_pairs").alias("neg"),
        zero.alias("predicted"),
        zero.alias("tp"),
    )
    predicted = pairs.select(
        zero.alias("pos"), zero.alias("neg"), F.col("n_known").alias("predicted"), zero.alias("tp")
    )
    hits = _true_positives(records, profile_rows, pairs, spec, block).select(
        zero.alias("pos"), zero.alias("neg"), zero.alias("predicted"), F.col("tp")
    )
    return known.unionByName(predicted).unionByName(hits)


def _scores_of_sums(parts: DataFrame, decimals: int) -> DataFrame:
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(PAIRS).alias(c) for c in COUNTS])
    counts = sums.select(
        "tp",
        (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("neg") - F.col("predicted") + F.col("tp")).alias("tn"),
        (F.col("pos") - F.col("tp")).alias("fn"),
    )
    return scores_of(counts, decimals)


def confusion_scores(
    records: DataFrame,
    profile_rows: DataFrame,
    pairs: DataFrame,
    spec: RecordSpec,
    block: str,
    decimals: int = 5,
) -> DataFrame:
    """Confusion matrix and scores over the in-block pairs whose label is known.

    One row; a score without a denominator is null. ``specificity`` is the share of
    non-duplicates that were predicted as such.
    """
    return _scores_of_sums(_confusion_sums(records, profile_rows, pairs, spec, block), decimals)


def _trained_sums(
    records: DataFrame,
    profile_rows: DataFrame,
    pairs: DataFrame,
    trained: DataFrame,
    spec: RecordSpec,
    block: str,
) -> DataFrame:
    """Counts of the pairs trained on, as one row; those that no score counts are left out."""
    asked = checkpoint(
        trained.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
        .where("left_id < right_id")
        .distinct()
    )
    ids = asked.select(F.explode(F.array("left_id", "right_id")).alias(spec.id_col)).distinct()
    known = records.where(F.col(block).isNotNull() & F.col(spec.match_col).isNotNull())
    wanted = known.join(ids.hint("merge"), spec.id_col, "left_semi")
    identity = profile_rows.select(block, *[F.col(f"`{c}`") for c in spec.columns], F.col("profile_id").alias("_profile"))
    members = checkpoint(
        with_profile_facts(checkpoint(wanted), identity, spec, block).select(
            F.col(spec.id_col).alias("_id"), F.col(block).alias("_block"), F.col(spec.match_col).alias("_key"), "_profile"
        )
    )

    def of_side(side: str) -> DataFrame:
        return members.select(*[F.col(c).alias(f"{side}{c}") for c in members.columns]).hint("merge")

    both = asked.join(of_side("left"), "left_id").join(of_side("right"), "right_id").where("left_block = right_block")
    # copies may put many pairs of records on one pair of profiles
    met = both.groupBy(
        F.least("left_profile", "right_profile").alias("left_id"),
        F.greatest("left_profile", "right_profile").alias("right_id"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("left_key") == F.col("right_key")).alias("pos"),
    )
    hit = pairs.select("left_id", "right_id", F.lit(True).alias("hit"))
    counted = met.join(hit.hint("merge"), ["left_id", "right_id"], "left")
    return counted.agg(
        F.sum("pos").alias("pos"),
        F.sum(F.col("n") - F.col("pos")).alias("neg"),
        F.sum(F.when(F.col("hit"), F.col("n"))).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("pos"))).alias("tp"),
    ).select(*[F.coalesce(c, F.lit(0)).cast(PAIRS).alias(c) for c in COUNTS])


def confusion_scores_held_out(
    records: DataFrame,
    profile_rows: DataFrame,
    pairs: DataFrame,
    trained: DataFrame,
    spec: RecordSpec,
    block: str,
    decimals: int = 5,
) -> DataFrame:
    """``confusion_scores`` without the pairs that the classifier was trained on.

    ``trained`` holds pairs of record ids, in any order and number. Only they are looked up
    among the predictions; the pairs held out are all the others, by their counts.
    """
    every = _confusion_sums(records, profile_rows, pairs, spec, block)
    seen = _trained_sums(records, profile_rows, pairs, trained, spec, block)
    return _scores_of_sums(every.unionByName(seen.select(*[(-F.col(c)).alias(c) for c in COUNTS])), decimals)


def scores_of(counts: DataFrame, decimals: int = 5) -> DataFrame:
    """Add precision, recall, specificity and accuracy to ``tp, fp, tn, fn``."""

    def share(part: str, whole: str) -> Column:
        return F.round(F.try_divide(F.expr(part).cast("double"), F.expr(whole).cast("double")), decimals)

    return counts.select(
        "tp",
        "fp",
        "tn",
        "fn",
        share("tp", "tp + fp").alias("precision"),
        share("tp", "tp + fn").alias("recall"),
        share("tn", "tn + fp").alias("specificity"),
        share("tp + tn", "tp + fp + tn + fn").alias("accuracy"),
    )


def confusion_of_predictions(labelled: DataFrame, decimals: int = 5) -> DataFrame:
    """Scores of a relation with ``label`` and ``prediction``; -1 labels are skipped."""

    def count(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0))

    counts = labelled.where(F.col("label") != -1).agg(
        count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn")
    )
    return scores_of(counts, decimals)


def gold_groups(labelled: DataFrame, cluster_col: str) -> DataFrame:
    """Per gold label, whether all its records are in one cluster."""
    return labelled.where(F.col("true_label").isNotNull()).groupBy("true_label").agg(
        (F.min(cluster_col) == F.max(cluster_col)).alias("together")
    )


def cluster_score(labelled: DataFrame, cluster_col: str) -> DataFrame:
    """Gold groups kept together, all gold groups, and their ratio, as one row."""
    return gold_groups(labelled, cluster_col).agg(
        F.coalesce(F.sum(F.when(F.col("together"), 1).otherwise(0)), F.lit(0)).alias("tally"),
        F.count(F.lit(1)).alias("n_gold"),
        F.try_divide(
            F.sum(F.when(F.col("together"), 1.0).otherwise(0.0)), F.count(F.lit(1))
        ).alias("score"),
    )


def cluster_false_negatives(labelled: DataFrame, cluster_col: str) -> DataFrame:
    """Records of the gold groups that were split over clusters."""
    split = gold_groups(labelled, cluster_col).where(~F.col("together"))
    return labelled.join(split.select("true_label"), "true_label", "left_semi")


def find_cluster(records: DataFrame, id_col: str, record_id: object, cluster_col: str) -> DataFrame:
    """All records in the cluster of the given record."""
    found = records.where(F.col(id_col) == F.lit(record_id)).select(cluster_col).limit(1)
    return records.join(F.broadcast(found), cluster_col, "left_semi")


def suggested_clusters(n_records: int, scale=math.log2) -> float:
    """N / scale(N): equal clusters of that number cost N * scale(N) comparisons or so."""
    return n_records / scale(n_records)
