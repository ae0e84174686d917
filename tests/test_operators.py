"""Worked cases, and what has to hold for random or fitted operators."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordlink.config import RecordSpec
from recordlink.functions import arrays
from recordlink.functions.distances import distance, number_text
from recordlink.functions.draws import hash_uniform
from recordlink.functions.jaro import similarity_of_batch
from recordlink.operators import (
    classify,
    cleaning,
    clustering,
    embedding,
    features,
    ordering,
    pairs,
    scoring,
    training,
)
from recordlink.plans.workflow import Deduplication
from recordlink.sources.files import load_records, save_records
from recordlink.sources.fixtures import PEOPLE


def one(spark, name, a, b, kind):
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    return df.select(distance(name).between(F.col("a"), F.col("b"))).first()[0]


# distances


def test_equality_on_nulls(spark):
    assert [one(spark, "EQUALITY", a, b, "double") for a, b in [(None, None), (None, 1.0), (1.0, 1.0)]] == [1, 1, 0]
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert cleaning.nan_to_null(df).first()[0] is None


def test_edit_on_nulls_and_unicode(spark):
    assert one(spark, "EDIT_DISTANCE", None, None, "string") == 0
    assert one(spark, "EDIT_DISTANCE", None, "none", "string") == 0
    assert one(spark, "EDIT_DISTANCE", "ANNE", "anna", "string") == 1
    assert one(spark, "EDIT_DISTANCE", "Élan", "elan", "string") == 1


def test_time_and_haversine(spark):
    start = dt.datetime(2024, 1, 1)
    end = start - dt.timedelta(seconds=1.5)
    assert one(spark, "TIME_DELTA", start, end, "timestamp_ntz") == 1.5
    quarter = one(spark, "HAVERSINE", [0.0, 0.0], [0.0, 90.0], "array<double>")
    assert math.isclose(quarter, math.pi / 2)
    assert one(spark, "EUCLIDEAN", [0.0, 3.0], [4.0, 0.0], "array<double>") == 5
    assert one(spark, "EUCLIDEAN", [0.0, None], [4.0, 0.0], "array<double>") is None


def jaro_winkler(a, b):
    import pandas as pd

    return float(similarity_of_batch(pd.Series([a]), pd.Series([b]))[0])


def test_jaro_winkler_cases():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert jaro_winkler("abcd", "axyz") == 0.5
    assert jaro_winkler("", "") == 0.0
    assert jaro_winkler("same", "same") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=80), st.text("abcé", max_size=80))
def test_jaro_winkler_follows_the_definition(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and j not in taken:
                taken.add(j)
                hits.append(c)
                break
    m = len(hits)
    if m == 0:
        wanted = 0.0
    else:
        moved = sum(x != b[j] for x, j in zip(hits, sorted(taken)))
        wanted = (m / len(a) + m / len(b) + (m - moved // 2) / m) / 3
        if wanted > 0.7:
            prefix = 0
            while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
                prefix += 1
            wanted += prefix * 0.1 * (1 - wanted)
    assert math.isclose(jaro_winkler(a, b), wanted, abs_tol=1e-12)


def test_number_text(spark):
    df = spark.createDataFrame([(1e7,), (0.5,), (12345678.25,), (1e-4,), (100.0,)], "x double")
    got = [r[0] for r in df.select(number_text(F.col("x"))).collect()]
    assert got == ["10000000.0", "0.5", "12345678.25", "0.0001", "100.0"]


def test_unknown_distance_and_missing_columns(people):
    with pytest.raises(ValueError, match="unknown distance"):
        distance("NOPE")
    with pytest.raises(ValueError, match="not in the table"):
        RecordSpec().validate(people)


# sources and cleaning


def test_files(spark, people, tmp_path):
    with pytest.raises(ValueError, match="neither"):
        load_records(spark, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match="encoding"):
        save_records(people, str(tmp_path / "x"), "json")
    path = save_records(people, str(tmp_path / "p.csv"), "csv")
    back = load_records(spark, path)
    assert back.count() == people.count()
    first = load_records(spark, path, nrows=3, order_by="rec_id").collect()
    assert [r["rec_id"] for r in first] == sorted(r[0] for r in people.select("rec_id").collect())[:3]


def test_first_rows_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_LIMIT", 5)
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("id"))
    got = ordering.first_rows(df, ["id"], 321)
    assert sorted(r[0] for r in got.collect()) == list(range(321))


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("id")).repartition(5)
    got = ordering.number_rows(df, [F.col("id").desc()], start=1).collect()
    assert all(r["row_no"] == 500 - r["id"] for r in got)


@pytest.mark.parametrize("hot_parts", [1, 3, 2000])
def test_join_group_facts(spark, monkeypatch, hot_parts):
    monkeypatch.setattr(ordering, "HOT_PARTS", hot_parts)
    rows = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("g"))
    facts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    wanted = {(r["g"], r["n"], r["least"]) for r in facts.where("n > 15").collect()}
    got = ordering.join_group_facts(rows, facts.where("n > 15"), ["g"], "n").collect()
    assert len(got) == 200
    assert {(r["g"], r["n"], r["least"]) for r in got if r["n"] is not None} == wanted


def test_fills_do_not_depend_on_partitions(spark, people):
    df = people.select("rec_id", F.when(F.col("rec_id") % 4 > 0, F.col("rec_id") * 1.5).alias("x"))
    for fill in (
        lambda d: cleaning.fill_uniform(d, ["x"], "rec_id", 1),
        lambda d: cleaning.fill_empirical(d, "x", "rec_id", 1),
    ):
        once, again = fill(df), fill(df.repartition(9))
        assert sorted(once.collect()) == sorted(again.collect())
        assert once.where("x IS NULL").count() == 0
        assert once.join(df, "rec_id").where("rec_id % 4 > 0").count() == df.where("x IS NOT NULL").count()


def test_hash_uniform_is_uniform(spark):
    got = spark.range(20000).select(hash_uniform("id", 3).alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.var_pop("u")
    ).first()
    assert 0 <= got[0] and got[1] < 1
    assert abs(got[2] - 0.5) < 0.01 and abs(got[3] - 1 / 12) < 0.005


def test_to_datetime_names_the_column(spark):
    bad = spark.createDataFrame([("2024-01-01",), ("soon",)], "day string")
    with pytest.raises(PySparkException, match="day has no timestamp in: soon"):
        cleaning.to_datetime(bad, ["day"]).collect()
    with pytest.raises(ValueError, match="hour"):
        cleaning.to_datetime(bad, ["hour"])


def test_geo_lookup_keeps_rows_and_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "K1A0B1"), (2, ""), (3, None)], "id int, postal string")
    geo = spark.createDataFrame([("k1a 0b1", "Ottawa")], "postal_key string, place_name string")
    got = {r["id"]: r["place_name"] for r in cleaning.add_geodata(df, geo, "postal").collect()}
    assert got == {1: "Ottawa", 2: None, 3: None}
    with pytest.raises(ValueError, match="more than once"):
        cleaning.add_geodata(df, geo.union(geo), "postal")


def test_large_lookup_is_joined_without_broadcast(spark, monkeypatch):
    from recordlink import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    codes = ["K1A0B1", "K1A0B1", "K1A0B1", "B2B2B2", "", None]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, postal string")
    geo = spark.createDataFrame(
        [("k1a 0b1", "Ottawa"), ("b2b 2b2", "Bedford")], "postal_key string, place_name string"
    )
    got = {r["id"]: r["place_name"] for r in cleaning.add_geodata(df, geo, "postal").collect()}
    assert got == {0: "Ottawa", 1: "Ottawa", 2: "Ottawa", 3: "Bedford", 4: None, 5: None}


def test_sentinels(spark):
    numbers = spark.createDataFrame([(0,), (7,), (None,)], "k bigint")
    assert [r[0] for r in cleaning.sentinel_to_null(numbers, "k").collect()] == [None, 7, None]
    texts = spark.createDataFrame([("00000000",), ("A7",), (None,)], "k string")
    assert [r[0] for r in cleaning.sentinel_to_null(texts, "k").collect()] == [None, "A7", None]


# pairs

IDS = RecordSpec(id_col="id", match_col="key", distances={"x": "EQUALITY"}, transposed_pair=("a", "b"))


def test_all_pairs_of_four(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    runs = sorted(pairs.pair_runs(df, "id").collect())
    names = [r["id"] for r in runs]
    listed = [
        (r["first_pair"] + n, r["id"] + names[i + 1 + n])
        for i, r in enumerate(runs)
        for n in range(r["n_partners"])
    ]
    assert [p for _, p in sorted(listed)] == ["ab", "ac", "ad", "bc", "bd", "cd"]
    met = pairs.neighbour_pairs(df, "id", partners=3).collect()
    assert sorted(r["left_id"] + r["right_id"] for r in met) == ["ab", "ac", "ad", "bc", "bd", "cd"]


def test_neighbours_of_a_hot_group_grow_with_the_table(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"))
    met = pairs.neighbour_pairs(df, "id", ["g"], partners=3, seed=1)
    assert met.count() == 667 * 3 - 6
    assert met.select("left_id", "right_id").distinct().count() == 667 * 3 - 6
    assert met.where("left_id >= right_id").count() == 0


def test_transposition(spark):
    df = spark.createDataFrame(
        [(1, "Ann", "Lee"), (2, "lee", "ann"), (3, None, "Lee"), (4, "lee", None)],
        "id int, a string, b string",
    )
    met = spark.createDataFrame([(1, 2), (3, 4)], "left_id int, right_id int")
    fixed = pairs.fix_transposition(pairs.pair_values(met, df, "id", ["a", "b"]), ("a", "b"))
    got = {r["left_id"]: (r["l"]["a"], r["l"]["b"]) for r in fixed.collect()}
    assert got == {1: ("lee", "ann"), 3: (None, "Lee")}


def test_too_few_pairs(people):
    with pytest.raises(ValueError, match="only 27"):
        pairs.limit_pairs(pairs.strict_pairs(people, PEOPLE), 28)


def test_working_set_size(spark):
    df = spark.range(50000).withColumn("true_label", F.when(F.col("id") < 2000, F.col("id") % 1000))
    got = pairs.working_set(df, "id", n=1000, ratio=0.05)
    assert got.count() == 40000
    assert got.where("true_label IS NOT NULL").count() == 2000


def test_split_is_stable(people):
    gold = pairs.strict_pairs(people, PEOPLE)
    once = pairs.train_test_split(gold, 0.4, 1)
    again = pairs.train_test_split(gold.repartition(6), 0.4, 1)
    assert sorted(once.collect()) == sorted(again.select(once.columns).collect())


# embeddings


def test_embedding_slots(spark):
    spec = RecordSpec(
        id_col="id", match_col="key", distances={"p": "EUCLIDEAN", "q": "EUCLIDEAN"}, transposed_pair=None
    )
    zero = spark.createDataFrame([(0, [0.0], [0.0])], "id int, p array<double>, q array<double>")
    basis = spark.createDataFrame(
        [(i, [float(2 * i - 1)], [float(2 * i)]) for i in range(1, 5)], zero.schema
    )
    rows = embedding.collect_basis(basis, spec, 4)
    assert embedding.embed(zero, spec, rows, 2).first()["embedding"] == [3, 4, 5, 6]
    assert embedding.embed(zero, spec, rows, 2, mean=False).first()["embedding"] == [6, 8, 10, 12]
    with pytest.raises(ValueError, match="does not divide"):
        embedding.embed(zero, spec, rows, 3)
    with pytest.raises(ValueError, match="must have 5"):
        embedding.collect_basis(basis, spec, 5)


def test_embedding_is_narrow(people):
    rows = embedding.collect_basis(embedding.choose_basis(people, PEOPLE, 4), PEOPLE, 4)
    plan = embedding.embed(people, PEOPLE, rows, 2)._jdf.queryExecution().executedPlan().toString()
    above_the_table = plan.split("InMemoryTableScan")[0]
    assert "Exchange" not in above_the_table and "Join" not in above_the_table


def test_vanishing_weights():
    assert embedding.tiled_weights([1, 2], 2, 2) == [1, 2, 1, 2]
    assert embedding.tiled_weights(None, 2, 2) == [1, 1, 1, 1]
    assert embedding.skew_factors([-2.0, 0.5], 2) == [4.0, 0.25]
    with pytest.raises(ValueError, match="vanish"):
        embedding.skew_factors([0.0, 0.0])


# models


def test_rule_equals_model(spark, people):
    labelled = training.gold_distances(people, PEOPLE)
    fitted = training.train(labelled, PEOPLE).classifier
    rows = labelled[0]
    by_model = fitted.predict(rows).select("left_id", "right_id", "prediction")
    by_rule = fitted.rule.predict(rows).select("left_id", "right_id", "prediction")
    assert sorted(by_model.collect()) == sorted(by_rule.collect())


def test_sample_sizes():
    assert classify.nonduplicates_for(1000, 0.05) == 19000
    assert classify.nonduplicates_for(100, 0.5) == 100
    with pytest.raises(ValueError):
        classify.nonduplicates_for(100, 0)


def test_other_estimators(people):
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC

    labelled = training.gold_distances(people, PEOPLE)
    margin = training.train(labelled, PEOPLE, LinearSVC(maxIter=10)).classifier
    assert set(margin.rule.weights) == set(PEOPLE.columns)
    tree = training.train(labelled, PEOPLE, DecisionTreeClassifier(), training=True)
    assert tree.test_scores().first()["accuracy"] > 0.8
    with pytest.raises(ValueError, match="linear"):
        tree.classifier.coefficients


def test_scores_without_predicted_duplicates(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (-1, 1)], "label int, prediction int")
    got = scoring.confusion_of_predictions(df).first()
    assert got["precision"] is None and got["recall"] == 0 and got["accuracy"] == 0.5


# clustering


def test_gram_and_moments(spark):
    x = np.random.default_rng(1).normal(3, 2, (200, 5))
    x[:, 4] = 7.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    assert np.allclose(features.feature_gram(df, "x"), x.T @ x)
    moments = features.Moments.of(df, "x")
    assert np.allclose(moments.deviations, x.std(axis=0))
    z = np.array([r[0] for r in df.select(moments.standardize(F.col("x"))).collect()])
    assert np.allclose(z, (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0)))


@pytest.mark.parametrize("standardized", [True, False])
def test_pooling_groups_the_weighted_features(spark, standardized):
    rng = np.random.default_rng(5)
    x = rng.normal(4, 1, (150, 8)) * rng.uniform(0.5, 3, 8)
    x[:, 6] = x[:, 1] * 1.01
    weights = rng.uniform(0.5, 1.5, 8).tolist()
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    steps = clustering.FeatureSteps.fit(df, "x", weights, 2, 4, standardized)
    y = (x - x.mean(0)) / x.std(0) if standardized else x
    y = y * np.array(weights) ** 2
    assert steps.groups == features.agglomerate_features(y.T @ y, 4)


def test_predictions_for_missing_distances(spark, people):
    fitted = training.train(training.gold_distances(people, PEOPLE), PEOPLE).classifier
    schema = "left_id int, right_id int, " + ", ".join(f"d_{c} double" for c in PEOPLE.columns)
    rows = [(1, 2, *[0.0] * 7), (3, 4, *[0.0] * 6, None)]
    got = fitted.predict(spark.createDataFrame(rows, schema)).orderBy("left_id").collect()
    assert [r["prediction"] for r in got] == [1, 0]
    assert got[1]["d_cdt"] is None and got[0]["d_cdt"] == 0.0


def test_agglomeration_is_average_linkage():
    x = np.random.default_rng(2).normal(size=(30, 9))
    x[:, 3] = x[:, 0] + 0.01
    x[:, 7] = x[:, 0] - 0.02
    apart = np.linalg.norm(x.T[:, None] - x.T[None, :], axis=2)
    groups = [[i] for i in range(9)]
    while len(groups) > 4:
        i, j = min(
            ((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))),
            key=lambda p: apart[np.ix_(groups[p[0]], groups[p[1]])].mean(),
        )
        groups[i] += groups.pop(j)
    got = features.agglomerate_features(x.T @ x, 4)
    assert sorted(map(sorted, got)) == sorted(map(sorted, groups))


def test_pool(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    assert df.select(arrays.pool(F.col("x"), [[0, 3], [1], [2]])).first()[0] == [2.5, 2.0, 3.0]


def test_bisecting_finds_separate_clusters_of_standardized_features(spark):
    rng = np.random.default_rng(3)
    centres = [0.0, 2.0, 10.0, 12.0]
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.05, 3)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    model = clustering.fit_clusters(df, "x", n_clusters=4, n_features=None)
    got = model.assign(df, "cluster").groupBy((F.col("id") % 4).alias("m")).agg(
        F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c")
    ).collect()
    assert all(r["n"] == 1 for r in got) and len({r["c"] for r in got}) == 4


def test_block_counts_agree(people):
    labels = scoring.block_pair_labels(people, PEOPLE, "cluster_id").agg(
        F.sum(F.expr("duplicate_pairs + nonduplicate_pairs + unknown_pairs"))
    ).first()[0]
    runs = pairs.pair_runs(people, "rec_id", ["cluster_id"]).agg(F.sum("n_partners")).first()[0]
    counted = scoring.count_comparisons(people, "cluster_id").first()
    assert labels == runs == counted["block_pairs"] == 791


# the whole


def test_workflow(spark, people, tmp_path):
    run = Deduplication(people.where("cdt IS NOT NULL").drop("cluster_id"), PEOPLE)
    with pytest.raises(ValueError, match="learn_weights first"):
        run.embed()
    with pytest.raises(ValueError, match="match first"):
        run.save(str(tmp_path / "none"))
    trained = run.learn_weights(training=True)
    assert trained.test_scores().first()["accuracy"] > 0.9
    run.embed(n=20, ratio=0.5, k=4, splits=2)
    assert run.embedded.count() == 80
    run.embed(k=4, splits=2)
    clustered = run.cluster(n_clusters=4, weight_exp=2, n_features=8)
    assert clustered.count() == run.records.count()
    assert run.cluster_score().first()["n_gold"] == 27
    assert run.find_cluster(12).where("rec_id = 12").count() == 1
    labelled = run.match(ratio=0.25)
    assert labelled.count() == run.records.count()
    scores = run.scores().first()
    assert scores["recall"] > 0.8 and scores["accuracy"] > 0.9
    path = run.save(str(tmp_path / "out.parquet"))
    assert spark.read.parquet(path).where("duplicate_label <> ''").count() > 0


def test_other_columns_per_step(people):
    run = Deduplication(people, PEOPLE)
    names = PEOPLE.on(["given_name", "surname"])
    run.learn_weights(spec=names)
    with pytest.raises(ValueError, match="birth_date"):
        run.embed(k=2, splits=2)
    assert len(run.embed(k=2, splits=2, spec=names).first()["embedding"]) == 4
    assert len(run.weights) == 4


def test_matching_any_blocked_table(people):
    from recordlink.plans.queries import RULE

    run = Deduplication.of_blocks(people, PEOPLE)
    run.match(rule=RULE)
    apart = run.scores().first()
    whole = Deduplication.of_blocks(people.withColumn("cluster_id", F.lit(0)), PEOPLE)
    whole.match(rule=RULE)
    together = whole.scores().first()
    assert apart["tp"] + apart["fn"] == together["tp"] + together["fn"]
    assert together["tp"] == apart["tp"] and together["tn"] > apart["tn"]
