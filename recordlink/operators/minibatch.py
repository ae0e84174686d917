"""Mini-batch k-means: centres moved by small batches, each one partial aggregation.

A pass over all rows per step is what k-means spends on large tables. Here each step reads
a batch, drawn by hash, and moves each centre to the mean of all rows it was given so far.
The driver holds the centres and sums per centre, which are as large as the model.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasMaxIter, HasPredictionCol, HasSeed
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlink.functions.draws import hash_order, hash_uniform
from recordlink.session import checkpoint


def squared_distance(vector: Column, other: Column) -> Column:
    gaps = F.zip_with(vector, other, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """``gap`` (squared) and ``centre`` number of the nearest centre; ties to the smaller number."""
    rated = F.transform(
        F.lit([[float(x) for x in c] for c in centres]),
        lambda c, i: F.struct(squared_distance(vector, c).alias("gap"), i.alias("centre")),
    )
    return F.array_min(rated)


def _spread_out(rows: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """``k`` of the rows, each drawn in proportion to its squared distance to those before."""
    chosen = [rows[draw.integers(len(rows))]]
    gaps = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gaps.sum() > 0:
        chosen.append(rows[draw.choice(len(rows), p=gaps / gaps.sum())])
        gaps = np.minimum(gaps, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


class CentreModel(Model, HasFeaturesCol, HasPredictionCol):
    """Gives each row the number of its nearest centre."""

    def __init__(self, centres: np.ndarray | None = None) -> None:
        super().__init__()
        self.centres = centres

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = nearest(vector_to_array(self.getFeaturesCol()), self.centres)
        return dataset.withColumn(self.getPredictionCol(), found["centre"])


class MiniBatchKMeans(Estimator, HasFeaturesCol, HasPredictionCol, HasMaxIter, HasSeed):
    """``k`` centres from ``maxIter`` batches of about ``batch_rows`` rows.

    The first centres are spread out over ``start_rows`` rows drawn by hash, a bounded
    sample; fewer different rows than ``k`` give as many centres. Without rows there is
    nothing to fit, which is an error.
    """

    k: Param[int] = Param(Params._dummy(), "k", "number of centres", TypeConverters.toInt)

    def __init__(
        self, k: int = 8, maxIter: int = 20, seed: int = 42, batch_rows: int = 10_000, start_rows: int = 5_000
    ) -> None:
        super().__init__()
        self._set(k=k, maxIter=maxIter, seed=seed)
        self.batch_rows, self.start_rows = batch_rows, start_rows

    def _fit(self, dataset: DataFrame) -> CentreModel:
        k, seed = self.getOrDefault("k"), self.getSeed()
        # numbers of written rows stay the same when a task runs again
        rows = checkpoint(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x")))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        first = rows.orderBy(hash_order("row", seed, "start"), "row").limit(max(self.start_rows, k)).collect()
        if not first:
            raise ValueError("no rows to cluster")
        centres = _spread_out(np.array([r["x"] for r in first]), k, np.random.default_rng(seed))
        counts = np.zeros(len(centres))
        share = min(1.0, self.batch_rows / rows.count())
        sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(centres.shape[1])]
        for step in range(self.getMaxIter()):
            batch = rows.where(hash_uniform("row", seed, f"batch {step}") < share)
            met = batch.groupBy(nearest(F.col("x"), centres)["centre"].alias("centre"))
            for found in met.agg(F.count(F.lit(1)).alias("n"), *sums).collect():
                c = found["centre"]
                total = centres[c] * counts[c] + np.array([found[f"s{i}"] for i in range(len(sums))])
                counts[c] += found["n"]
                centres[c] = total / counts[c]
        return self._copyValues(CentreModel(centres))
