"""Mini-batch k-means on planted clusters, and checks that reject a clustering of nothing."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from recordlink.operators.minibatch import CentreModel, MiniBatchKMeans
from recordlink.operators.clustering import ClusterModel, FeatureSteps
from recordlink.plans.queries import _clustering_checks, _squares

MIDDLES = [(0.0, 0.0), (20.0, 0.0), (0.0, 20.0), (20.0, 20.0)]


def planted(spark, n=400):
    draw = np.random.default_rng(4)
    rows = [(i, i % 4, [float(x) for x in draw.normal(MIDDLES[i % 4], 1.0)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, true int, x array<double>")
    return df.withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("batch_rows", [60, 10_000])
def test_planted_clusters_are_found(spark, batch_rows):
    df = planted(spark)
    model = MiniBatchKMeans(k=4, maxIter=10, seed=3, batch_rows=batch_rows).fit(df)
    found = model.transform(df)
    assert found.select("true", "prediction").distinct().count() == 4
    assert found.select("prediction").distinct().count() == 4
    want = _squares(df, "true", "x")
    assert _squares(found, "prediction", "x") == pytest.approx(want)
    again = MiniBatchKMeans(k=4, maxIter=10, seed=3, batch_rows=batch_rows).fit(df)
    assert np.array_equal(model.centres, again.centres)


def test_fewer_rows_than_centres(spark):
    df = planted(spark, 3).unionByName(planted(spark, 3))
    model = MiniBatchKMeans(k=8, maxIter=2).fit(df)
    assert len(model.centres) == 3
    with pytest.raises(ValueError, match="no rows"):
        MiniBatchKMeans(k=2).fit(df.limit(0))


def test_checks_reject_one_cluster_and_wrong_centres(spark):
    df = planted(spark)
    steps = FeatureSteps(None, None, None)

    def checked(centres):
        model = CentreModel(np.array(centres))
        model.set(model.featuresCol, "cluster_features")
        bound = 1.1 * _squares(df, "true", "x")
        return _clustering_checks(df, ClusterModel(steps, model, "x"), bound).first()

    good = checked(MIDDLES)
    assert (good["n_clusters"], good["nearest"], good["tight"]) == (4, 1, 1)
    constant = checked([(0.0, 0.0)])
    assert (constant["n_clusters"], constant["tight"]) == (1, 0)
    wrong = checked([(-100.0, 5.0), (100.0, 5.0), (5.0, -100.0), (5.0, 100.0)])
    assert (wrong["n_clusters"], wrong["tight"]) != (4, 1)
