"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recordlink-tests-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sql_rows(sf_dir: str, statement: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(statement)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def same_value(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def differences(df, sf_dir: str, statement: str) -> list[str]:
    names, expected = sql_rows(sf_dir, statement)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in expected]
    if len(got) != len(want):
        return [f"{len(got)} rows instead of {len(want)}"]

    def key(row):
        return tuple((v is None, round(v, 4) if isinstance(v, float) else v) if v is not None else (True, "") for v in row)

    got.sort(key=lambda r: str(key(r)))
    want.sort(key=lambda r: str(key(r)))
    bad = [f"{g} instead of {w}" for g, w in zip(got, want) if not all(map(same_value, g, w))]
    kinds = {(type(a), type(b)) for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and b is not None}
    return bad + [f"types {k}" for k in kinds if k[0] is not k[1]]


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:] or list(queries())
    spark = local_session()
    failed = []
    for name in wanted:
        begin = time.time()
        try:
            df = queries()[name](spark, sf)
            if name in oracle_sql():
                bad = differences(df, sf, oracle_sql()[name])
            else:
                bad = [] if df.count() else ["no rows"]
        except Exception as problem:  # report and go on
            bad = [str(problem)[:600]]
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - begin:.1f}s {bad[:2] if bad else ''}", flush=True)
        failed += [name] if bad else []
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
