"""Record tables derived from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.config import RecordSpec

PEOPLE = RecordSpec(
    id_col="rec_id",
    match_col="match_id",
    distances={
        "given_name": "EDIT_DISTANCE",
        "surname": "EDIT_DISTANCE",
        "birth_date": "EDIT_DISTANCE",
        "postal_code": "EQUALITY",
        "active_ind": "EQUALITY",
        "lat_long": "EUCLIDEAN",
        "cdt": "TIME_DELTA",
    },
    transposed_pair=("given_name", "surname"),
    datetime_cols=("cdt",),
    postal_col="postal_code",
    cluster_col="cluster_id",
    duplicate_col="duplicate_label",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three records per customer, with the differences real duplicates have."""
    first_order = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("cdt")
    )
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(key % 4 == 0, F.lit(1)),
            F.when(key % 20 == 0, F.lit(2)),
        )
    )
    rows = (
        table(spark, sf_dir, "customer")
        .join(first_order, "c_custkey", "left")
        .withColumn("copy", F.explode(copies))
        .withColumn("seg", F.lower("c_mktsegment"))
        .withColumn("nm", F.concat(F.lit("sur"), F.expr("substr(c_name, 10)")))
    )
    second = F.col("copy") == 1
    transposed = second & (key % 8 == 0)
    inserted = F.concat(F.expr("left(nm, 4)"), F.lit("z"), F.expr("substr(nm, 5)"))
    day = F.format_string("%04d%02d%02d", 1950 + key % 50, 1 + key % 12, 1 + key % 28)
    postal = F.concat(
        F.lit("K"), (nation % 10).cast("string"),
        F.lit("A"), (nation % 7).cast("string"),
        F.lit("B"), (nation % 3).cast("string"),
    )
    return rows.select(
        (key * 3 + F.col("copy")).alias("rec_id"),
        F.when(key % 11 != 0, key).alias("match_id"),
        F.when(transposed, F.col("nm"))
        .when(F.col("copy") == 2, F.concat("seg", F.lit("x")))
        .otherwise(F.col("seg"))
        .alias("given_name"),
        F.when(transposed, F.col("seg")).when(second, inserted).otherwise(F.col("nm")).alias("surname"),
        F.when(~(second & (key % 13 == 0)), day).alias("birth_date"),
        F.when(key % 17 == 0, "").otherwise(postal).alias("postal_code"),
        F.array(40 + nation * F.lit(0.5), -120 + nation * F.lit(1.25)).alias("lat_long"),
        F.when(F.col("c_acctbal") < 0, "N").otherwise("Y").alias("active_ind"),
        "cdt",
        nation.alias("cluster_id"),
    )


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A postal lookup with one row per nation, a fifth of them missing."""
    nation = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(nation % 5 != 0).select(
        F.concat(
            F.lit("k"), (nation % 10).cast("string"),
            F.lit("a "), (nation % 7).cast("string"),
            F.lit("b"), (nation % 3).cast("string"),
        ).alias("postal_key"),
        F.col("n_name").alias("place_name"),
        F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("state_code"),
        (40 + nation * F.lit(0.5)).alias("latitude"),
        (-120 + nation * F.lit(1.25)).alias("longitude"),
        (1 + nation % 6).cast("int").alias("accuracy"),
    )
