"""Distances that run in Python are called once per pair of different values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordlink.config import RecordSpec
from recordlink.functions import distances as registry
from recordlink.operators import embedding, ordering, similarity
from recordlink.operators.pairs import pair_values

SCHEMA = "id bigint, key bigint, name string, code string"
SPEC = RecordSpec(
    id_col="id",
    match_col="key",
    distances={"name": "COUNTED", "code": "EQUALITY"},
    transposed_pair=None,
    datetime_cols=(),
    cluster_col="block",
    duplicate_col="labels",
)


@pytest.fixture
def calls(spark):
    """The number of pairs that the distance COUNTED has been called for."""
    counter = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def gap(left: pd.Series, right: pd.Series) -> pd.Series:
        counter.add(len(left))
        return (left.str.len() - right.str.len()).abs().astype(float)

    registry.register_distance("COUNTED", gap, prepare=registry.text, python=True)
    yield counter
    del registry._REGISTRY["COUNTED"]


def records(spark, n):
    names = ["a", "BB", "bb", None, "ccccc"]
    rows = [(i, i, "a" if i % 3 else names[i % 5], "xyz"[i % 2]) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def gap_of(a, b):
    return abs(len((a or "none").lower()) - len((b or "none").lower()))


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_of_values_are_measured_once(spark, calls, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ordering, "HOT_PARTS", 4)
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", 2)
    rows, df = records(spark, 90)
    by_id = {r[0]: r for r in rows}
    met = [(a, b) for a in range(90) for b in range(a + 1, min(a + 6, 90))]
    pairs = spark.createDataFrame(met, "left_id bigint, right_id bigint")
    values = pair_values(pairs, df, "id", SPEC.columns)
    found = similarity.value_distances(values, SPEC)
    assert sorted(found.columns) == ["d_code", "d_name", "left_id", "right_id"]
    got = {(r["left_id"], r["right_id"]): (r["d_name"], r["d_code"]) for r in found.collect()}
    want = {
        (a, b): (gap_of(by_id[a][2], by_id[b][2]), 0 if by_id[a][3] == by_id[b][3] else 1) for a, b in met
    }
    assert got == want
    texts = {((by_id[a][2] or "none").lower(), (by_id[b][2] or "none").lower()) for a, b in met}
    assert calls.value == len(texts)


@pytest.mark.parametrize("mean, hot", [(False, False), (True, False), (True, True)])
def test_embedding_measures_each_value_once(spark, calls, monkeypatch, mean, hot):
    if hot:
        monkeypatch.setattr(ordering, "HOT_PARTS", 4)
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", 2)
    rows, df = records(spark, 60)
    basis = df.where("id IN (0, 1, 6, 12)").orderBy("id").collect()
    got = {r["id"]: r["embedding"] for r in embedding.embed(df, SPEC, basis, 2, mean).collect()}
    want = {}
    for i, _, name, code in rows:
        vector = []
        for s in range(2):
            slot = basis[s::2]
            parts = [sum(gap_of(name, b["name"]) for b in slot), sum(code != b["code"] for b in slot)]
            vector += [p / len(slot) if mean else p for p in parts]
        want[i] = vector
    assert got == want
    values = {(r[2] or "none").lower() for r in rows}
    assert calls.value == len(values) * len({b["name"] for b in basis})
