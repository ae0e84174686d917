"""Clusters around hubs: who shares a bucket meets, and no pair is listed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlink.llm.common import written
from recordlink.operators.ordering import join_group_facts


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """``node`` and ``bucket`` of the buckets that hold several nodes, and their ``size``."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(join_group_facts(buckets, sizes, ["bucket"], "size", "inner"), "buckets")


def hub_clusters(shared: DataFrame) -> DataFrame:
    """``hub`` and ``node``: a hub with every node that shares a bucket it is hub of.

    ``shared`` is what ``shared_buckets`` returns. The hub of a bucket is the node that meets
    most others; it is a member of its own cluster. Any two nodes of a bucket share a cluster.
    """
    meets = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = shared.join(meets, "node")
    hubs = ranked.groupBy("bucket").agg(
        F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("_most"),
        F.max("size").alias("size"),
    )
    hubs = hubs.select("bucket", "size", (-F.col("_most.minus")).alias("hub"))
    return join_group_facts(shared.drop("size"), hubs, ["bucket"], "size").select("hub", "node").distinct()


def groups_of(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of rows of a partition that is sorted by ``keys``."""
    waiting: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        if len(waiting) == 1:
            return waiting[0]
        return {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}

    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        n = len(batch)
        if not n:
            continue
        differs = np.zeros(n - 1, dtype=bool)
        for k in keys:
            differs |= columns[k][1:] != columns[k][:-1]
        starts = [0, *(np.nonzero(differs)[0] + 1), n]
        for at, end in zip(starts, starts[1:]):
            part = {c: v[at:end] for c, v in columns.items()}
            if waiting and any(waiting[0][k][0] != part[k][0] for k in keys):
                yield whole()
                waiting = []
            waiting.append(part)
    if waiting:
        yield whole()
