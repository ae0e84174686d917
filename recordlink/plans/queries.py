"""One query per operator, over whole tables, each with plain SQL where SQL can say it.

Operators that draw at random or fit a model are checked by what must hold for any
draw: the query computes the check next to the result, the SQL states its outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.functions.distances import distance
from recordlink.operators import (
    classify,
    cleaning,
    clustering,
    embedding,
    features,
    groups,
    matching,
    minibatch,
    pairs,
    scoring,
    similarity,
    training,
)
from recordlink.plans import oracles as sql
from recordlink.plans.workflow import Deduplication
from recordlink.session import checkpoint, scratch_path, stored
from recordlink.sources.files import load_records, save_records
from recordlink.sources.fixtures import PEOPLE, geo, people, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEIGHTS = {
    "given_name": -0.5,
    "surname": -0.5,
    "birth_date": -1.0,
    "postal_code": -2.0,
    "active_ind": -1.0,
    "lat_long": -0.25,
    "cdt": -1e-7,
}
INTERCEPT = 3.125
RULE = classify.LinearRule(WEIGHTS, INTERCEPT)
BLOCK = "cluster_id"
# What the whole workflow has to reach, over all known pairs.
LEAST_PRECISION, LEAST_RECALL = 0.85, 0.7
ID = PEOPLE.id_col

PEOPLE_COLUMNS = [
    "rec_id", "match_id", "given_name", "surname", "birth_date", "postal_code", "active_ind",
    "cluster_id",
]
PEOPLE_SELECT = (
    ", ".join(PEOPLE_COLUMNS)
    + ", lat_long[1] AS latitude, lat_long[2] AS longitude"
    + ", strftime(cdt, '%Y-%m-%d %H:%M:%S') AS cdt"
)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return register


def plain(df: DataFrame, *more: str) -> DataFrame:
    """People with arrays and times as plain values."""
    return df.select(
        *PEOPLE_COLUMNS,
        F.col("lat_long")[0].alias("latitude"),
        F.col("lat_long")[1].alias("longitude"),
        F.date_format("cdt", "yyyy-MM-dd HH:mm:ss").alias("cdt"),
        *more,
    )


def flag(condition) -> object:
    return F.coalesce(condition, F.lit(False)).cast("int")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_records(spark, sf):
    return load_records(spark, f"{sf}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def limit_records(spark, sf):
    df = load_records(spark, f"{sf}/orders.parquet", nrows=500, order_by="o_orderkey")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {sql.PEOPLE} SELECT rec_id, match_id, surname, cluster_id FROM people")
def scan_csv(spark, sf):
    wanted = people(spark, sf).select("rec_id", "match_id", "surname", "cluster_id")
    path = scratch_path(spark, "people") + ".csv"
    save_records(wanted, path, "csv")
    return load_records(spark, path, schema=wanted.schema)


@query(f"WITH {sql.PEOPLE} SELECT {PEOPLE_SELECT} FROM people")
def save_roundtrip(spark, sf):
    path = save_records(people(spark, sf), scratch_path(spark, "people") + ".parquet")
    return plain(load_records(spark, path))


# ----------------------------------------------------------------------- cleaning


@query(
    f"""WITH {sql.PEOPLE}, {sql.GEO} SELECT rec_id, match_id,
    CASE WHEN postal_code = '' THEN '0' ELSE postal_code END AS postal_code,
    place_name, state_code, coalesce(accuracy, 0)::INTEGER AS accuracy,
    latitude, longitude, 1 AS in_range, strftime(cdt, '%Y-%m-%d') AS cdt
    FROM people LEFT JOIN geo ON lower(left(postal_code, 3)) || ' ' || lower(substr(postal_code, 4)) = postal_key"""
)
def preprocess(spark, sf):
    raw = (
        people(spark, sf)
        .withColumn("match_id", F.coalesce("match_id", F.lit(0)))
        .withColumn("cdt", F.date_format("cdt", "yyyy-MM-dd"))
        .select("rec_id", "match_id", "postal_code", "cdt")
    )
    lookup = geo(spark, sf)
    ends = lookup.agg(
        F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")
    ).first()
    lat, lon = F.col("lat-long")[0], F.col("lat-long")[1]
    known = F.col("place_name").isNotNull()
    return cleaning.preprocess(raw, PEOPLE, lookup).select(
        "rec_id",
        "match_id",
        "postal_code",
        "place_name",
        "state_code",
        F.col("accuracy").cast("int").alias("accuracy"),
        F.when(known, lat).alias("latitude"),
        F.when(known, lon).alias("longitude"),
        flag(lat.between(ends[0], ends[1]) & lon.between(ends[2], ends[3])).alias("in_range"),
        F.date_format("cdt", "yyyy-MM-dd").alias("cdt"),
    )


@query(
    f"""WITH {sql.PEOPLE}, {sql.GEO}
    SELECT rec_id, CASE WHEN postal_code = '' THEN '0' ELSE postal_code END AS postal_code,
           place_name, state_code, latitude, longitude, accuracy
    FROM people LEFT JOIN geo ON lower(left(postal_code, 3)) || ' ' || lower(substr(postal_code, 4)) = postal_key"""
)
def geo_lookup(spark, sf):
    found = cleaning.add_geodata(
        people(spark, sf).select("rec_id", "postal_code"), geo(spark, sf), "postal_code"
    )
    return found.select(
        "rec_id", "postal_code", "place_name", "state_code", "latitude", "longitude", "accuracy"
    )


@query(
    f"""WITH {sql.PEOPLE} SELECT rec_id, regexp_matches(postal_code,
    '^[A-Za-z][0-9][A-Za-z][0-9][A-Za-z][0-9]')::INTEGER AS valid FROM people"""
)
def postal_valid(spark, sf):
    return people(spark, sf).select(
        "rec_id", flag(cleaning.postal_is_valid(F.col("postal_code"))).alias("valid")
    )


def _events_with_gaps(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value")
    )


KEPT = """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS kept, 1 AS fits
FROM events"""


@query(KEPT)
def fill_uniform(spark, sf):
    gaps = _events_with_gaps(spark, sf)
    low, high = gaps.agg(F.min("value"), F.max("value")).first()
    return cleaning.fill_uniform(gaps, ["value"], "event_id", 7).select(
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("kept"),
        flag(F.col("value").between(low, high)).alias("fits"),
    )


@query(KEPT)
def fill_empirical(spark, sf):
    gaps = _events_with_gaps(spark, sf)
    seen = gaps.where("value IS NOT NULL").select("value").distinct().withColumn("seen", F.lit(1))
    return (
        cleaning.fill_empirical(gaps, "value", "event_id", 7)
        .join(seen, "value", "left")
        .select(
            "event_id",
            F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("kept"),
            F.coalesce("seen", F.lit(0)).alias("fits"),
        )
    )


@query(
    """SELECT c_custkey, 2 AS width, c_acctbal AS first, c_nationkey::DOUBLE AS second
    FROM customer"""
)
def merge_columns(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")
    )
    merged = cleaning.merge_columns(df, ["c_acctbal", "c_nationkey"], "both")
    return merged.select(
        "c_custkey",
        F.size("both").alias("width"),
        F.col("both")[0].alias("first"),
        F.col("both")[1].alias("second"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day,
    date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders"""
)
def to_datetime(spark, sf):
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
    return cleaning.to_datetime(text, ["day"]).select(
        "o_orderkey",
        F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"),
        F.unix_date(F.to_date("day")).alias("days"),
    )


@query(f"WITH {sql.PEOPLE} SELECT rec_id, match_id FROM people")
def sentinel_null(spark, sf):
    df = people(spark, sf).select("rec_id", F.coalesce("match_id", F.lit(0)).alias("match_id"))
    return cleaning.sentinel_to_null(df, "match_id")


@query(
    f"""WITH {sql.PEOPLE} SELECT active_ind, birth_date, cluster_id, given_name, match_id,
    postal_code, rec_id, surname FROM people"""
)
def subset_cols(spark, sf):
    spec = PEOPLE.on(["given_name", "surname", "birth_date", "postal_code", "active_ind"])
    return cleaning.subset_columns(people(spark, sf), spec, ["rec_id", "cluster_id", "surname"])


@query(
    f"""WITH {sql.PEOPLE} SELECT {PEOPLE_SELECT} FROM people
    WHERE birth_date IS NOT NULL AND cdt IS NOT NULL"""
)
def basis_eligible(spark, sf):
    return plain(cleaning.complete_rows(people(spark, sf), PEOPLE.columns))


# ------------------------------------------------------------------ pair relations


@query("SELECT o_custkey, count(*) AS n_records FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def key_counts(spark, sf):
    return pairs.key_counts(table(spark, sf, "orders"), "o_custkey")


@query(f"{sql.WITH_KEYS} SELECT left_id, right_id FROM gold")
def pairs_strict(spark, sf):
    return pairs.strict_pairs(people(spark, sf), PEOPLE)


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of pairs as bigint, which is wide enough for these tables."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query(
    """WITH ranked AS (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r,
             count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IS NOT NULL)
    SELECT o_custkey, o_orderkey, (n - r - 1)::BIGINT AS n_partners,
           (r * n - r * (r + 1) // 2)::BIGINT AS first_pair FROM ranked"""
)
def pairs_all(spark, sf):
    """All pairs of records that share a key, as runs; keys have up to 25 records."""
    return _whole(pairs.pair_runs(table(spark, sf, "orders"), "o_orderkey", ["o_custkey"]), "first_pair")


@query(
    f"""WITH {sql.PEOPLE}, ranked AS (
      SELECT rec_id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY rec_id) AS no
      FROM people WHERE match_id IS NOT NULL)
    SELECT a.match_id, a.rec_id AS left_id, b.rec_id AS right_id
    FROM ranked a JOIN ranked b ON a.match_id = b.match_id AND b.no BETWEEN a.no + 1 AND a.no + 4"""
)
def pairs_neighbours(spark, sf):
    """A sampling operator: each record with up to four after it."""
    return pairs.neighbour_pairs(people(spark, sf), ID, ["match_id"], partners=4)


@query(f"{sql.WITH_KEYS} SELECT left_id, right_id FROM nongold")
def nonpairs_strict(spark, sf):
    return pairs.strict_nonpairs(people(spark, sf), PEOPLE)


@query(
    f"""{sql.WITH_KEYS}, total AS (SELECT count(*) AS n FROM uniq)
    SELECT rec_id, (n - no - 1)::BIGINT AS n_partners, (no * n - no * (no + 1) // 2)::BIGINT AS first_pair
    FROM numbered, total"""
)
def nonpairs_all(spark, sf):
    """All pairs of records with unique keys, as runs."""
    unique = pairs.unique_key_ids(people(spark, sf), PEOPLE)
    return _whole(pairs.pair_runs(unique, ID), "first_pair")


@query(
    f"""{sql.WITH_KEYS} SELECT count(*) * 3 - 6 AS n_pairs, count(*) * 3 - 6 AS n_distinct,
    count(*) * 3 - 6 AS n_unique_keys, 1 AS drawn FROM uniq"""
)
def nonpairs_sampled(spark, sf):
    """A sampling operator: records with unique keys, each with three drawn by hash."""
    unique = pairs.unique_key_ids(people(spark, sf), PEOPLE)
    met = pairs.neighbour_pairs(unique, ID, partners=3, seed=5)
    ids = unique.select(F.col(ID).alias("left_id"))
    right = unique.select(F.col(ID).alias("right_id"))
    both = met.join(ids, "left_id", "left_semi").join(right, "right_id", "left_semi")
    n = both.agg(F.count(F.lit(1)).alias("n_unique_keys"))
    checks = met.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("left_id", "right_id").alias("n_distinct"),
        # neighbours by hash are far apart by id
        flag(F.avg(F.col("right_id") - F.col("left_id")) > 10).alias("drawn"),
    )
    return checks.crossJoin(n)


@query(
    f"""{sql.WITH_KEYS} SELECT {PEOPLE_SELECT} FROM people
    WHERE rec_id IN (SELECT rec_id FROM uniq)"""
)
def semi_join(spark, sf):
    df = people(spark, sf)
    return plain(pairs.records_in(df, pairs.unique_key_ids(df, PEOPLE), ID))


@query(
    f"""{sql.WITH_KEYS} SELECT {PEOPLE_SELECT} FROM people
    WHERE rec_id NOT IN (SELECT left_id FROM gold UNION ALL SELECT right_id FROM gold)"""
)
def non_pair_records(spark, sf):
    df = people(spark, sf)
    return plain(pairs.records_outside(df, pairs.strict_pairs(df, PEOPLE), ID))


@query(f"{sql.WITH_KEYS} SELECT left_id, right_id FROM gold ORDER BY left_id, right_id LIMIT 25")
def pairs_limit(spark, sf):
    return pairs.limit_pairs(pairs.strict_pairs(people(spark, sf), PEOPLE), 25)


@query(
    f"""{sql.WITH_KEYS} SELECT round(2.0 * (SELECT count(*) FROM gold)
    / (SELECT count(*) FROM people), 6)::DOUBLE AS ratio"""
)
def pair_ratio(spark, sf):
    df = people(spark, sf)
    found = pairs.pair_ratio(df, pairs.strict_pairs(df, PEOPLE))
    return found.select(F.round("ratio", 6).alias("ratio"))


GOLD_RECORDS = f"""{sql.WITH_KEYS}, crossed AS (
  SELECT a.rec_id, lower(b.given_name) AS given_name, lower(b.surname) AS surname
  FROM gold p {sql.PAIR_JOIN}
  WHERE lower(a.given_name) = lower(b.surname) AND lower(a.surname) = lower(b.given_name)
), members AS (
  SELECT left_id AS rec_id, left_id AS true_label FROM gold
  UNION ALL SELECT right_id, left_id FROM gold
), gold_records AS (
  SELECT p.rec_id, coalesce(c.given_name, p.given_name) AS given_name,
         coalesce(c.surname, p.surname) AS surname, m.true_label
  FROM people p LEFT JOIN members m ON m.rec_id = p.rec_id
  LEFT JOIN crossed c ON c.rec_id = p.rec_id
)"""


def _gold_records(spark, sf):
    df = people(spark, sf)
    gold = pairs.records_with_gold(df, pairs.strict_pairs(df, PEOPLE), PEOPLE)
    return gold.select("rec_id", "given_name", "surname", "true_label")


@query(f"{GOLD_RECORDS} SELECT * FROM gold_records")
def records_with_gold(spark, sf):
    return _gold_records(spark, sf)


@query(
    f"""{GOLD_RECORDS}, others AS (
      SELECT *, row_number() OVER (ORDER BY rec_id) AS no FROM gold_records WHERE true_label IS NULL)
    SELECT * FROM gold_records WHERE true_label IN (
      SELECT DISTINCT true_label FROM gold_records WHERE true_label IS NOT NULL ORDER BY 1 LIMIT 20)
    UNION ALL SELECT rec_id, given_name, surname, true_label FROM others
    WHERE no <= 2 * floor(20 / 0.2 - 20)"""
)
def working_set(spark, sf):
    return pairs.working_set(_gold_records(spark, sf), ID, n=20, ratio=0.2)


def _gold_values(spark, sf):
    df = people(spark, sf)
    return pairs.pair_values(pairs.strict_pairs(df, PEOPLE), df, ID, ["given_name", "surname"])


@query(
    f"""{sql.WITH_KEYS}, sides AS (
      SELECT p.*, a.given_name AS lg, a.surname AS ls, b.given_name AS rg, b.surname AS rs,
             coalesce(lower(a.given_name) = lower(b.surname)
                      AND lower(a.surname) = lower(b.given_name), false) AS crossed
      FROM gold p {sql.PAIR_JOIN})
    SELECT left_id, right_id, CASE WHEN crossed THEN lower(rg) ELSE lg END AS l_given_name,
           CASE WHEN crossed THEN lower(rs) ELSE ls END AS l_surname,
           rg AS r_given_name, rs AS r_surname FROM sides"""
)
def fix_transposition(spark, sf):
    fixed = pairs.fix_transposition(_gold_values(spark, sf), PEOPLE.transposed_pair)
    return fixed.select(
        "left_id",
        "right_id",
        *[F.col(s)[c].alias(f"{s}_{c}") for s in "lr" for c in ("given_name", "surname")],
    )


@query(
    f"""{sql.WITH_KEYS} SELECT left_id, right_id, a.given_name AS l_given_name,
           a.surname AS l_surname, b.given_name AS r_given_name, b.surname AS r_surname
    FROM gold p {sql.PAIR_JOIN}
    WHERE lower(a.given_name) = lower(b.surname) AND lower(a.surname) = lower(b.given_name)"""
)
def transposed_pairs(spark, sf):
    return pairs.transposed_pairs(_gold_values(spark, sf), PEOPLE.transposed_pair)


@query(f"{sql.WITH_KEYS} SELECT left_id, right_id FROM gold")
def shuffle_pairs(spark, sf):
    return pairs.shuffle_pairs(pairs.strict_pairs(people(spark, sf), PEOPLE), 3)


@query(
    f"""WITH {sql.PEOPLE}, ranked AS (
      SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS r, count(*) OVER () AS n FROM people)
    SELECT rec_id, (n - r - 1)::BIGINT AS n_partners,
           (r * n - r * (r + 1) // 2)::BIGINT AS first_pair FROM ranked"""
)
def all_pairs(spark, sf):
    return _whole(pairs.pair_runs(people(spark, sf), ID), "first_pair")


def _labelled_pairs(spark, sf):
    df = people(spark, sf)
    return pairs.training_labels(pairs.strict_pairs(df, PEOPLE), pairs.strict_nonpairs(df, PEOPLE))


@query(f"{sql.WITH_KEYS} SELECT left_id, right_id, label FROM labelled")
def training_labels(spark, sf):
    return _labelled_pairs(spark, sf)


@query(
    f"""{sql.WITH_KEYS} SELECT count(*) AS n_pairs, count(*) AS n_train_and_test,
    1 AS share_is_near FROM labelled"""
)
def train_test_split(spark, sf):
    split = pairs.train_test_split(_labelled_pairs(spark, sf), 0.4, 5)
    test = F.count(F.when(F.col("is_test"), 1))
    train = F.count(F.when(~F.col("is_test"), 1))
    return split.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (test + train).alias("n_train_and_test"),
        flag(F.abs(test / F.count(F.lit(1)) - 0.4) < 0.1).alias("share_is_near"),
    )


# ----------------------------------------------------------------------- distances


def _distance_query(column: str) -> Query:
    def build(spark, sf):
        df = people(spark, sf)
        spec = PEOPLE.on([column])
        both = _labelled_pairs(spark, sf).drop("label")
        found = similarity.pair_distances(both, df, spec)
        return found.select(
            "left_id", "right_id", F.round(similarity.named(column), 6).alias("distance")
        )

    return build


for _name, _column in {
    "dist_edit": "surname",
    "dist_equality": "postal_code",
    "dist_euclidean": "lat_long",
    "dist_time": "cdt",
}.items():
    QUERIES[_name] = _distance_query(_column)
    ORACLES[_name] = sql.one_distance(_column)


def _part_pairs(spark, sf, column: str, name: str) -> DataFrame:
    part = table(spark, sf, "part")
    met = pairs.neighbour_pairs(part, "p_partkey", partners=2)
    values = pairs.pair_values(met, part, "p_partkey", [column])
    measured = distance(name).between(F.col("l")[column], F.col("r")[column])
    return values.select("left_id", "right_id", F.round(measured, 6).alias("distance"))


@query(
    f"""WITH {sql.PARTS} SELECT left_id, right_id,
    round(1 - jaro_winkler_similarity(lower(ln), lower(rn)), 6) AS distance FROM met"""
)
def dist_jaro_winkler(spark, sf):
    part = table(spark, sf, "part")
    met = pairs.neighbour_pairs(part, "p_partkey", partners=2)
    values = pairs.pair_values(met, part, "p_partkey", ["p_name"])
    found = similarity.measured_once(values, {"p_name": "JARO_WINKLER"})
    return found.select("left_id", "right_id", F.round("d_p_name", 6).alias("distance"))


@query(
    f"""WITH {sql.PARTS} SELECT left_id, right_id, round((lp + rp) / 2, 6) AS distance FROM met"""
)
def pair_mean(spark, sf):
    return _part_pairs(spark, sf, "p_retailprice", "MEAN")


@query(
    f"""{sql.WITH_KEYS} SELECT p.left_id, p.right_id, round(2 * asin(sqrt(
      pow(sin(radians(a.lat_long[1] - b.lat_long[1]) / 2), 2)
      + cos(radians(a.lat_long[1])) * cos(radians(b.lat_long[1]))
      * pow(sin(radians(a.lat_long[2] - b.lat_long[2]) / 2), 2))), 6) AS distance
    FROM labelled p {sql.PAIR_JOIN}"""
)
def dist_haversine(spark, sf):
    values = pairs.pair_values(
        _labelled_pairs(spark, sf).drop("label"), people(spark, sf), ID, ["lat_long"]
    )
    angle = distance("HAVERSINE").between(F.col("l.lat_long"), F.col("r.lat_long"))
    return values.select("left_id", "right_id", F.round(angle, 6).alias("distance"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {similarity.named(c): F.round(similarity.named(c), 6) for c in PEOPLE.columns}
    )


@query(
    f"{sql.WITH_KEYS} SELECT p.left_id, p.right_id, p.label, {sql.rounded()} FROM labelled p {sql.PAIR_JOIN}"
)
def pair_distances(spark, sf):
    return _rounded(
        similarity.pair_distances(_labelled_pairs(spark, sf), people(spark, sf), PEOPLE)
    )


@query(
    f"""WITH {sql.PEOPLE}, one AS (SELECT * FROM people ORDER BY rec_id LIMIT 1)
    SELECT a.rec_id, {sql.rounded()} FROM people a CROSS JOIN one b"""
)
def distance_to_record(spark, sf):
    df = people(spark, sf)
    record = df.orderBy(ID).limit(1).first().asDict()
    return _rounded(similarity.distance_to_record(df, record, PEOPLE))


# ---------------------------------------------------------------------- embeddings

K, SPLITS = 4, 2


@query(
    f"""WITH {sql.PEOPLE} SELECT rec_id, given_name, surname FROM people
    WHERE birth_date IS NOT NULL AND cdt IS NOT NULL ORDER BY rec_id LIMIT 10"""
)
def basis(spark, sf):
    return embedding.choose_basis(people(spark, sf), PEOPLE, 10).select(
        "rec_id", "given_name", "surname"
    )


def _first_basis(df, spec=PEOPLE, k=K):
    return embedding.collect_basis(
        embedding.choose_basis(df, PEOPLE, k).select(ID, *spec.columns), spec, k
    )


def _long(df: DataFrame, column: str, id_col: str = ID) -> DataFrame:
    return df.select(id_col, F.posexplode(column).alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(sql.embedding(K, SPLITS, True, sql.DISTANCES))
def embed_mean(spark, sf):
    df = people(spark, sf)
    return _long(embedding.embed(df, PEOPLE, _first_basis(df), SPLITS), "embedding")


@query(sql.embedding(K, SPLITS, False, sql.DISTANCES))
def embed_sum(spark, sf):
    df = people(spark, sf)
    return _long(embedding.embed(df, PEOPLE, _first_basis(df), SPLITS, mean=False), "embedding")


@query(sql.embedding(3, 3, True, sql.DISTANCES))
def embed_given_basis(spark, sf):
    df = people(spark, sf)
    given = df.where("birth_date IS NOT NULL AND cdt IS NOT NULL").orderBy(ID).limit(3)
    rows = embedding.collect_basis(given, PEOPLE, 3)
    return _long(embedding.embed(df, PEOPLE, rows, 3), "embedding")


EMBED_WEIGHTS = [0.5, 1.0, 1.5, 0.25, 0.5, 1.25, 0.125]


@query(
    sql.embedding(
        K, SPLITS, True, sql.DISTANCES,
        f"power(([{', '.join(map(str, EMBED_WEIGHTS))}]::DOUBLE[])[col + 1], 2)",
    )
)
def embed_weighted(spark, sf):
    df = people(spark, sf)
    weights = embedding.tiled_weights(EMBED_WEIGHTS, len(PEOPLE.columns), SPLITS)
    found = embedding.embed(df, PEOPLE, _first_basis(df), SPLITS)
    return _long(
        found.withColumn("embedding", embedding.skew(F.col("embedding"), weights, 2)), "embedding"
    )


JW_COLUMNS = {
    c: f"(1 - jaro_winkler_similarity(lower(coalesce(a.{c}, 'none')), lower(coalesce(b.{c}, 'none'))))"
    for c in ("given_name", "surname")
}


@query(sql.embedding(K, SPLITS, True, JW_COLUMNS))
def embed_jw(spark, sf):
    from dataclasses import replace

    df = people(spark, sf)
    spec = replace(PEOPLE, distances=dict.fromkeys(JW_COLUMNS, "JARO_WINKLER"))
    return _long(embedding.embed(df, spec, _first_basis(df, spec), SPLITS), "embedding")


# --------------------------------------------------------------- supervised models


def _model_check(trained: training.Trained) -> DataFrame:
    weights = trained.classifier.coefficients
    return trained.test_scores().select(
        F.lit(trained.n_true).cast("bigint").alias("n_true"),
        F.lit(trained.n_false).cast("bigint").alias("n_false"),
        F.lit(len(weights)).alias("n_weights"),
        flag(F.col("precision") >= 0.8).alias("precise"),
        flag(F.col("recall") >= 0.8).alias("complete"),
    )


@query(
    f"""{sql.WITH_KEYS} SELECT (SELECT count(*) FROM gold) AS n_true,
    least((SELECT count(*) FROM gold), (SELECT count(*) FROM nongold)) AS n_false,
    7 AS n_weights, 1 AS precise, 1 AS complete"""
)
def train_pair_classifier(spark, sf):
    labelled = training.gold_distances(people(spark, sf), PEOPLE)
    return _model_check(training.train(labelled, PEOPLE, training=True))


@query(
    """WITH long AS (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos
      FROM embeddings), moments AS (
      SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY pos)
    SELECT vec_id, l.pos::INTEGER AS pos,
           round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value
    FROM long l JOIN moments USING (pos)"""
)
def standardize(spark, sf):
    df = _vectors(spark, sf)
    moments = features.Moments.of(df, "x")
    return _long(df.withColumn("x", moments.standardize(F.col("x"))), "x", "vec_id")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )


@query(
    f"""{sql.WITH_KEYS} SELECT p.left_id, p.right_id,
    (coalesce({sql.score(WEIGHTS, INTERCEPT)} > 0, false))::INTEGER AS prediction
    FROM labelled p {sql.PAIR_JOIN}"""
)
def score_fixed_model(spark, sf):
    found = similarity.pair_distances(_labelled_pairs(spark, sf), people(spark, sf), PEOPLE)
    return RULE.predict(found).select("left_id", "right_id", "prediction")


# ----------------------------------------------------------------------- clustering

LABELLED_VECTORS = """WITH labelled AS (SELECT vec_id, label AS true_label FROM embeddings)"""


def _cluster_check(df: DataFrame, id_col: str, cluster_col: str, k: int) -> DataFrame:
    return df.select(id_col, flag(F.col(cluster_col).between(0, k - 1)).alias("has_cluster"))


def _complete_people(spark, sf):
    """People without blocks, missing times drawn from the known ones."""
    return cleaning.fill_empirical(people(spark, sf).drop(BLOCK), "cdt", ID, 11)


@query(f"WITH {sql.PEOPLE} SELECT rec_id, 1 AS has_cluster FROM people")
def cluster_records(spark, sf):
    df = _complete_people(spark, sf)
    embedded = checkpoint(embedding.embed(df, PEOPLE, _first_basis(df), SPLITS))
    weights = embedding.tiled_weights(EMBED_WEIGHTS, len(PEOPLE.columns), SPLITS)
    model = clustering.fit_clusters(
        embedded, "embedding", n_clusters=8, weights=weights, weight_exp=2, n_features=6
    )
    return _cluster_check(model.assign(embedded, BLOCK), ID, BLOCK, 8)


@query("SELECT vec_id, 1 AS has_cluster FROM embeddings")
def cluster_kmeans(spark, sf):
    df = _vectors(spark, sf)
    model = clustering.fit_clusters(
        df, "x", n_clusters=10, n_features=16, estimator=KMeans(seed=1, maxIter=10)
    )
    return _cluster_check(model.assign(df, "cluster"), "vec_id", "cluster", 10)


def _squares(df: DataFrame, label: str, features: str):
    """Squared distances of all vectors to the mean of their cluster, summed up."""
    found = df.select(label, F.posexplode(features).alias("pos", "v")).groupBy(label, "pos")
    return found.agg((F.var_pop("v") * F.count("v")).alias("q")).agg(F.sum("q").alias("q")).first()["q"]


def _clustering_checks(df: DataFrame, model: clustering.ClusterModel, bound: float) -> DataFrame:
    """What a clustering has to be: every cluster used, nearly tight, own mean nearest."""
    features = model.steps.features(F.col(model.embedding))
    found = checkpoint(model.assign(df, "cluster").select("cluster", features.alias("f")))
    means = found.select("cluster", F.posexplode("f").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("m"))
    rows = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("m")).orderBy("cluster").collect()
    centres = [r["m"] for r in rows]
    own = F.get(F.lit([[float(x) for x in c] for c in centres]), F.array_position(F.lit([r["cluster"] for r in rows]), F.col("cluster")).cast("int") - 1)
    near = minibatch.squared_distance(F.col("f"), own) <= minibatch.nearest(F.col("f"), centres)["gap"] + 1e-9
    within = _squares(found, "cluster", "f")
    # a clustering need not have settled; nine of ten vectors have to lie nearest to their own mean
    return found.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.countDistinct("cluster").alias("n_clusters"),
        flag(F.avg(near.cast("double")) >= 0.9).alias("nearest"),
    ).withColumn("tight", flag(F.lit(within <= bound)))


CLUSTERED = "SELECT count(*) AS n_vectors, 10::BIGINT AS n_clusters, 1 AS nearest, 1 AS tight FROM embeddings"


@query(CLUSTERED)
def cluster_kmeans_checked(spark, sf):
    """K-means leaves less than nine tenths of the squares; one cluster for all leaves all."""
    df = _vectors(spark, sf)
    model = clustering.fit_clusters(df, "x", n_clusters=10, n_features=16, estimator=KMeans(seed=1, maxIter=20))
    every = model.steps.apply(df, "x").select(F.lit(0).alias("one"), model.steps.features(F.col("x")).alias("f"))
    return _clustering_checks(df, model, 0.9 * _squares(every, "one", "f"))


@query(CLUSTERED)
def cluster_minibatch(spark, sf):
    """Mini-batches leave at most 1.1 times the squares that k-means over all rows leaves."""
    df = checkpoint(_vectors(spark, sf))
    full, small = (
        clustering.fit_clusters(df, "x", n_clusters=10, n_features=16, estimator=estimator)
        for estimator in (KMeans(seed=1, maxIter=20), minibatch.MiniBatchKMeans(seed=1))
    )
    features = full.steps.features(F.col("x"))
    whole = _squares(full.assign(df, "cluster").select("cluster", features.alias("f")), "cluster", "f")
    return _clustering_checks(df, small, 1.1 * whole)


@query(
    """WITH long AS (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos
      FROM embeddings)
    SELECT a.pos::INTEGER AS i, b.pos::INTEGER AS j, round(sum(a.x * b.x), 4) AS value
    FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos"""
)
def feature_gram(spark, sf):
    rows = features.gram_rows(_vectors(spark, sf), "x")
    return rows.withColumn("value", F.round("value", 4))


GROUPS = [[0, 1, 2], [3], [10, 20, 30, 40], [63, 5]]


@query(
    "SELECT vec_id, pos, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT vec_id, {n} AS pos, ({' + '.join(f'embedding[{i + 1}]::DOUBLE' for i in g)}) / {len(g)} AS value FROM embeddings"
        for n, g in enumerate(GROUPS)
    )
    + ")"
)
def pool_features(spark, sf):
    pooled = features.pool_features(_vectors(spark, sf), "x", GROUPS, "pooled")
    return _long(pooled, "pooled", "vec_id")


@query(
    """SELECT pos::INTEGER AS feature, 1::BIGINT AS n_groups, 16::BIGINT AS all_groups
    FROM (SELECT unnest(generate_series(0, max(len(embedding)) - 1)) AS pos FROM embeddings)"""
)
def agglomerate(spark, sf):
    groups = features.agglomerate_features(features.feature_gram(_vectors(spark, sf), "x"), 16)
    rows = [(f, n) for n, g in enumerate(groups) for f in g]
    found = spark.createDataFrame(rows, "feature int, group_no int")
    return found.groupBy("feature").agg(
        F.countDistinct("group_no").alias("n_groups"), F.lit(len(groups)).cast("bigint").alias("all_groups")
    )


@query(
    f"""{sql.WITH_KEYS} SELECT left_id AS rec_id, left_id AS true_label FROM gold
    UNION ALL SELECT right_id, left_id FROM gold"""
)
def gold_labels(spark, sf):
    return pairs.pair_members(pairs.strict_pairs(people(spark, sf), PEOPLE), ID)


DECADES = f"""{sql.WITH_KEYS}, labelled_records AS (
  SELECT p.rec_id, g.left_id AS true_label, coalesce(substr(birth_date, 1, 3)::INTEGER, 0) AS cluster
  FROM people p LEFT JOIN gold g ON p.rec_id IN (g.left_id, g.right_id)
), together AS (
  SELECT true_label, min(cluster) = max(cluster) AS together FROM labelled_records
  WHERE true_label IS NOT NULL GROUP BY true_label
)"""


def _decades(spark, sf):
    df = people(spark, sf)
    members = pairs.pair_members(pairs.strict_pairs(df, PEOPLE), ID)
    decade = F.coalesce(F.substring("birth_date", 1, 3).cast("int"), F.lit(0))
    return df.select(ID, decade.alias("cluster")).join(members, ID, "left")


@query(
    f"""{DECADES} SELECT count(*) FILTER (WHERE together) AS tally, count(*) AS n_gold,
    round(count(*) FILTER (WHERE together) / count(*), 6) AS score FROM together"""
)
def cluster_score(spark, sf):
    return scoring.cluster_score(_decades(spark, sf), "cluster").withColumn(
        "score", F.round("score", 6)
    )


@query(
    f"""{DECADES} SELECT rec_id, true_label, cluster FROM labelled_records
    WHERE true_label IN (SELECT true_label FROM together WHERE NOT together)"""
)
def cluster_false_negatives(spark, sf):
    return scoring.cluster_false_negatives(_decades(spark, sf), "cluster").select(
        "rec_id", "true_label", "cluster"
    )


@query(
    f"""WITH {sql.PEOPLE} SELECT {PEOPLE_SELECT} FROM people
    WHERE cluster_id = (SELECT cluster_id FROM people WHERE rec_id = 12)"""
)
def find_cluster(spark, sf):
    return plain(scoring.find_cluster(people(spark, sf), ID, 12, BLOCK))


@query(
    """SELECT n AS n_clusters, (SELECT count(DISTINCT label) FROM embeddings) AS n_gold,
    1 AS score_fits FROM (VALUES (2), (4), (6)) t(n)"""
)
def elbow(spark, sf):
    df = table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("true_label")
    )
    found = clustering.elbow(df, "x", [2, 4, 6], n_features=16, estimator=KMeans(seed=1, maxIter=5))
    fits = (F.col("score") == F.col("tally") / F.col("n_gold")) & F.col("score").between(0, 1)
    return found.select("n_clusters", "n_gold", flag(fits).alias("score_fits"))


@query(f"WITH {sql.PEOPLE} SELECT count(*) AS n_records, round(count(*) / log2(count(*)), 6) AS clusters FROM people")
def suggested_clusters(spark, sf):
    n = people(spark, sf).count()
    return spark.createDataFrame(
        [(n, round(scoring.suggested_clusters(n), 6))], "n_records bigint, clusters double"
    )


# --------------------------------------------------------------- matching in blocks

MATCHES = sql.block_matches(WEIGHTS, INTERCEPT)


@query(
    f"""WITH {sql.PEOPLE}, ranked AS (
      SELECT cluster_id, rec_id, row_number() OVER (PARTITION BY cluster_id ORDER BY rec_id) - 1 AS r,
             count(*) OVER (PARTITION BY cluster_id) AS n FROM people)
    SELECT cluster_id, rec_id, (n - r - 1)::BIGINT AS n_partners,
           (r * n - r * (r + 1) // 2)::BIGINT AS first_pair FROM ranked"""
)
def block_pairs(spark, sf):
    return _whole(pairs.pair_runs(people(spark, sf), ID, [BLOCK]), "first_pair")


@query(
    f"""{MATCHES} SELECT cluster_id, count(*) FILTER (WHERE label = 1) AS duplicate_pairs,
    count(*) FILTER (WHERE label = 0) AS nonduplicate_pairs,
    count(*) FILTER (WHERE label = -1) AS unknown_pairs FROM block GROUP BY cluster_id"""
)
def block_pair_labels(spark, sf):
    found = scoring.block_pair_labels(people(spark, sf), PEOPLE, BLOCK)
    return _whole(found, "duplicate_pairs", "nonduplicate_pairs", "unknown_pairs")


def _profiles(spark, sf):
    return stored(matching.profiles(people(spark, sf), PEOPLE, BLOCK), "profiles")[0]


@query(
    f"""{MATCHES} SELECT left_id, right_id, cluster_id, 1::BIGINT AS n_pairs,
    {", ".join(f"d_{c}" for c in WEIGHTS)} FROM found"""
)
def block_pair_distances(spark, sf):
    found = matching.accepted_record_pairs(people(spark, sf), PEOPLE, RULE, BLOCK)
    return _rounded(found).withColumn("n_pairs", F.lit(1).cast("bigint"))


@query(
    f"""{MATCHES.replace("a.cluster_id = b.cluster_id AND ", "")}
    SELECT left_id, right_id, {", ".join(f"d_{c}" for c in WEIGHTS)} FROM found"""
)
def whole_table_pairs(spark, sf):
    """The whole table as one block: columns that nearly agree and cells of points stand in for it."""
    df = people(spark, sf).withColumn(BLOCK, F.lit(0))
    profile_rows, _ = stored(matching.profiles(df, PEOPLE, BLOCK), "profiles")
    found = matching.accepted_pairs(profile_rows, PEOPLE, RULE, BLOCK)
    return _rounded(found).drop("n_known", "n_pairs", BLOCK)


@query(
    f"""WITH {sql.PEOPLE}, sizes AS (SELECT count(*) AS n FROM people GROUP BY cluster_id)
    SELECT sum(n * (n - 1) // 2)::BIGINT AS block_pairs,
           (sum(n) * (sum(n) - 1) // 2)::BIGINT AS all_pairs,
           round(sum(n * (n - 1) // 2) / (sum(n) * (sum(n) - 1) // 2), 6)::DOUBLE AS ratio FROM sizes"""
)
def count_comparisons(spark, sf):
    found = scoring.count_comparisons(people(spark, sf), BLOCK)
    return _whole(found, "block_pairs", "all_pairs").withColumn("ratio", F.round("ratio", 6))


@query(
    f"""{MATCHES}, known AS (SELECT count(*) FILTER (WHERE label = 1) AS n FROM block)
    SELECT n AS n_true, ((n - 0.5 * n) // 0.5)::BIGINT AS n_false, 7 AS n_weights,
           1 AS precise, 1 AS complete FROM known"""
)
def train_block_classifier(spark, sf):
    labelled = training.block_distances(people(spark, sf), PEOPLE, BLOCK, ratio=0.5)
    return _model_check(training.train(labelled, PEOPLE, training=True))


@query(f"{MATCHES} SELECT pair_no, left_id, right_id, 1::BIGINT AS n_pairs FROM found")
def duplicate_pairs(spark, sf):
    found = matching.duplicate_pairs(_profiles(spark, sf), PEOPLE, RULE, BLOCK)
    return _whole(found.select("pair_no", "left_id", "right_id", "n_pairs"), "n_pairs")


@query(
    f"""{MATCHES}, members AS (
      SELECT left_id AS rec_id, pair_no FROM found UNION ALL SELECT right_id, pair_no FROM found
    ), labels AS (
      SELECT rec_id, string_agg(pair_no::VARCHAR || ' ', '' ORDER BY pair_no) AS label
      FROM members GROUP BY rec_id)
    SELECT p.rec_id, coalesce(l.label, '') AS duplicate_label
    FROM people p LEFT JOIN labels l ON l.rec_id = p.rec_id"""
)
def duplicate_labels(spark, sf):
    df, profile_rows = people(spark, sf), _profiles(spark, sf)
    found = matching.duplicate_pairs(profile_rows, PEOPLE, RULE, BLOCK)
    labelled = matching.duplicate_labels(df, profile_rows, found, PEOPLE, BLOCK)
    return labelled.select("rec_id", "duplicate_label")


@query(
    f"""{MATCHES}, counts AS (
      SELECT count(*) FILTER (WHERE label = 1 AND accepted) AS tp,
             count(*) FILTER (WHERE label = 0 AND accepted) AS fp,
             count(*) FILTER (WHERE label = 0 AND NOT accepted) AS tn,
             count(*) FILTER (WHERE label = 1 AND NOT accepted) AS fn FROM block)
    SELECT tp, fp, tn, fn, round(tp / (tp + fp), 5) AS "precision", round(tp / (tp + fn), 5) AS recall,
           round(tn / (tn + fp), 5) AS specificity,
           round((tp + tn) / (tp + fp + tn + fn), 5) AS accuracy FROM counts"""
)
def confusion_scores(spark, sf):
    df, profile_rows = people(spark, sf), _profiles(spark, sf)
    found = matching.duplicate_pairs(profile_rows, PEOPLE, RULE, BLOCK)
    found = scoring.confusion_scores(df, profile_rows, found, PEOPLE, BLOCK)
    return _whole(found, "tp", "fp", "tn", "fn")


@query(
    f"""{MATCHES}, numbered AS (
      SELECT rec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY rec_id) AS no
      FROM people
    ), trained AS (
      SELECT a.rec_id AS left_id, b.rec_id AS right_id FROM numbered a JOIN numbered b
        ON a.cluster_id = b.cluster_id AND b.no = a.no + 1
    ), counts AS (
      SELECT count(*) FILTER (WHERE label = 1 AND accepted) AS tp,
             count(*) FILTER (WHERE label = 0 AND accepted) AS fp,
             count(*) FILTER (WHERE label = 0 AND NOT accepted) AS tn,
             count(*) FILTER (WHERE label = 1 AND NOT accepted) AS fn
      FROM block ANTI JOIN trained USING (left_id, right_id))
    SELECT tp, fp, tn, fn, round(tp / (tp + fp), 5) AS "precision", round(tp / (tp + fn), 5) AS recall,
           round(tn / (tn + fp), 5) AS specificity,
           round((tp + tn) / (tp + fp + tn + fn), 5) AS accuracy FROM counts"""
)
def confusion_scores_held_out(spark, sf):
    """The scores of all other pairs, where each record and the next of its block were trained on."""
    df, profile_rows = people(spark, sf), _profiles(spark, sf)
    found = matching.duplicate_pairs(profile_rows, PEOPLE, RULE, BLOCK)
    trained = pairs.neighbour_pairs(df, ID, [BLOCK]).select(*pairs.PAIR)
    found = scoring.confusion_scores_held_out(df, profile_rows, found, trained, PEOPLE, BLOCK)
    return _whole(found, "tp", "fp", "tn", "fn")


@query(
    f"""{MATCHES.replace("WITH", "WITH RECURSIVE", 1)}, linked AS (
      SELECT left_id AS a, right_id AS b FROM found UNION ALL SELECT right_id, left_id FROM found
    ), reach AS (
      SELECT rec_id AS a, rec_id AS b FROM people
      UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
    SELECT a AS rec_id, min(b) AS group_id, count(*) AS n_records FROM reach GROUP BY a"""
)
def duplicate_groups(spark, sf):
    df, profile_rows = people(spark, sf), _profiles(spark, sf)
    found = matching.duplicate_pairs(profile_rows, PEOPLE, RULE, BLOCK)
    grouped = groups.duplicate_groups(df, profile_rows, found, PEOPLE, BLOCK)
    return grouped.select(ID, "group_id", "n_records")


@query()
def dedupe_end_to_end(spark, sf):
    run = Deduplication(checkpoint(_complete_people(spark, sf)), PEOPLE)
    run.learn_weights()
    run.embed(k=4, splits=2)
    run.cluster(n_clusters=8, weight_exp=2, n_features=8)
    run.match()
    return run.labelled.select(ID, PEOPLE.match_col, BLOCK, PEOPLE.duplicate_col)


@query(
    f"""{MATCHES}, members AS (
      SELECT left_id AS rec_id, pair_no FROM found UNION ALL SELECT right_id, pair_no FROM found
    ), labels AS (
      SELECT rec_id, string_agg(pair_no::VARCHAR || ' ', '' ORDER BY pair_no) AS label
      FROM members GROUP BY rec_id)
    SELECT p.rec_id, p.match_id, p.cluster_id, coalesce(l.label, '') AS duplicate_label
    FROM people p LEFT JOIN labels l ON l.rec_id = p.rec_id"""
)
def dedupe_given_rule(spark, sf):
    """The workflow from given blocks and a given rule to labels."""
    run = Deduplication.of_blocks(people(spark, sf), PEOPLE)
    run.match(rule=RULE)
    return run.labelled.select(ID, PEOPLE.match_col, BLOCK, PEOPLE.duplicate_col)


@query(
    f"""WITH {sql.PEOPLE} SELECT count(*) AS n_records, 1 AS in_range, 1 AS consistent, 1 AS precise,
    1 AS complete FROM people"""
)
def dedupe_end_to_end_checked(spark, sf):
    """What must hold for the labels of the whole workflow, whatever it learns."""
    run = Deduplication(checkpoint(_complete_people(spark, sf)), PEOPLE)
    run.learn_weights()
    run.embed(k=4, splits=2)
    run.cluster(n_clusters=8, weight_exp=2, n_features=8)
    labelled = checkpoint(run.match().select(ID, PEOPLE.match_col, BLOCK, "duplicate_numbers", PEOPLE.duplicate_col))
    numbers = F.col("duplicate_numbers")
    text = F.when(F.size(numbers) > 0, F.concat(F.array_join(numbers.cast("array<string>"), " "), F.lit(" ")))
    ordered = (F.array_sort(numbers) == numbers) & (F.coalesce(text, F.lit("")) == F.col(PEOPLE.duplicate_col))
    records = labelled.agg(
        F.count(F.lit(1)).alias("n_records"),
        flag(F.min(F.col(BLOCK).between(0, 7) & ordered)).alias("in_range"),
    )
    # every number is on the records of one pair, in one cluster
    groups = labelled.select(BLOCK, F.explode("duplicate_numbers").alias("no")).groupBy("no").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(BLOCK).alias("blocks")
    )
    consistent = groups.agg(flag(F.coalesce(F.min((F.col("n") >= 2) & (F.col("blocks") == 1)), F.lit(False))).alias("consistent"))
    known = labelled.where(F.col(PEOPLE.match_col).isNotNull()).groupBy(PEOPLE.match_col).count()
    all_known = known.agg(F.sum(F.expr("count * (count - 1) / 2")).alias("known"))
    scores = run.scores().crossJoin(all_known).select(
        flag(F.col("precision") >= LEAST_PRECISION).alias("precise"),
        flag(F.col("tp") / F.col("known") >= LEAST_RECALL).alias("complete"),
    )
    return records.crossJoin(consistent).crossJoin(scores)
