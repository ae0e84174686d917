"""Plain SQL for the registered queries, to check them in another engine."""

from __future__ import annotations

PEOPLE = """people AS (
  WITH first_order AS (
    SELECT o_custkey, min(o_orderdate) AS cdt FROM orders GROUP BY o_custkey
  ), copies AS (
    SELECT c.*, f.cdt, k.copy, lower(c_mktsegment) AS seg, 'sur' || substr(c_name, 10) AS nm,
           (k.copy = 1 AND c_custkey % 8 = 0) AS transposed
    FROM customer c LEFT JOIN first_order f ON f.o_custkey = c.c_custkey
    JOIN (VALUES (0), (1), (2)) k(copy)
      ON k.copy = 0 OR (k.copy = 1 AND c_custkey % 4 = 0) OR (k.copy = 2 AND c_custkey % 20 = 0)
  )
  SELECT (c_custkey * 3 + copy)::BIGINT AS rec_id,
         CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END AS match_id,
         CASE WHEN transposed THEN nm WHEN copy = 2 THEN seg || 'x' ELSE seg END AS given_name,
         CASE WHEN transposed THEN seg WHEN copy = 1 THEN left(nm, 4) || 'z' || substr(nm, 5)
              ELSE nm END AS surname,
         CASE WHEN NOT (copy = 1 AND c_custkey % 13 = 0)
              THEN printf('%04d%02d%02d', 1950 + c_custkey % 50, 1 + c_custkey % 12,
                          1 + c_custkey % 28) END AS birth_date,
         CASE WHEN c_custkey % 17 = 0 THEN ''
              ELSE 'K' || (c_nationkey % 10) || 'A' || (c_nationkey % 7) || 'B' || (c_nationkey % 3)
              END AS postal_code,
         [40 + c_nationkey * 0.5::DOUBLE, -120 + c_nationkey * 1.25::DOUBLE] AS lat_long,
         CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'Y' END AS active_ind,
         cdt,
         c_nationkey AS cluster_id
  FROM copies
)"""

GEO = """geo AS (
  SELECT 'k' || (n_nationkey % 10) || 'a ' || (n_nationkey % 7) || 'b' || (n_nationkey % 3) AS postal_key,
         n_name AS place_name, 'S' || n_regionkey AS state_code,
         40 + n_nationkey * 0.5::DOUBLE AS latitude, -120 + n_nationkey * 1.25::DOUBLE AS longitude,
         (1 + n_nationkey % 6)::INTEGER AS accuracy
  FROM nation WHERE n_nationkey % 5 <> 0
)"""

KEYS = """keys AS (
  SELECT match_id, count(*) AS n, min(rec_id) AS l, max(rec_id) AS r
  FROM people WHERE match_id IS NOT NULL GROUP BY match_id
), gold AS (
  SELECT l AS left_id, r AS right_id FROM keys WHERE n = 2
), uniq AS (
  SELECT l AS rec_id FROM keys WHERE n = 1
), numbered AS (
  SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS no FROM uniq
), nongold AS (
  SELECT min(rec_id) AS left_id, max(rec_id) AS right_id FROM numbered
  GROUP BY no // 2 HAVING count(*) = 2
), labelled AS (
  SELECT left_id, right_id, 1 AS label FROM gold
  UNION ALL SELECT left_id, right_id, 0 FROM nongold
)"""

WITH_KEYS = f"WITH {PEOPLE}, {KEYS}"

PARTS = """parts AS (
  SELECT p_partkey, p_name, p_retailprice, row_number() OVER (ORDER BY p_partkey) AS no FROM part
), met AS (
  SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, a.p_name AS ln, b.p_name AS rn,
         a.p_retailprice AS lp, b.p_retailprice AS rp
  FROM parts a JOIN parts b ON b.no IN (a.no + 1, a.no + 2)
)"""


def edit(c: str, a: str = "a", b: str = "b") -> str:
    return (
        f"levenshtein(coalesce(lower({a}.{c}), 'none'), coalesce(lower({b}.{c}), 'none'))::DOUBLE"
    )


def equal(c: str, a: str = "a", b: str = "b") -> str:
    return f"(CASE WHEN {a}.{c} = {b}.{c} THEN 0 ELSE 1 END)::DOUBLE"


def euclid(a: str = "a", b: str = "b") -> str:
    return (
        f"sqrt(({a}.lat_long[1] - {b}.lat_long[1])^2 + ({a}.lat_long[2] - {b}.lat_long[2])^2)"
    )


def seconds(a: str = "a", b: str = "b") -> str:
    return f"(abs(epoch_us({a}.cdt) - epoch_us({b}.cdt)) / 1e6)::DOUBLE"


DISTANCES = {
    "given_name": edit("given_name"),
    "surname": edit("surname"),
    "birth_date": edit("birth_date"),
    "postal_code": equal("postal_code"),
    "active_ind": equal("active_ind"),
    "lat_long": euclid(),
    "cdt": seconds(),
}


def rounded() -> str:
    return ", ".join(f"round({sql}, 6) AS d_{c}" for c, sql in DISTANCES.items())


def score(weights: dict[str, float], intercept: float) -> str:
    """The linear rule's score of people ``a`` and ``b``."""
    return f"({intercept}::DOUBLE" + "".join(
        f" + ({w!r}::DOUBLE) * {DISTANCES[c]}" for c, w in weights.items()
    ) + ")"


PAIR_JOIN = "JOIN people a ON a.rec_id = p.left_id JOIN people b ON b.rec_id = p.right_id"


def one_distance(c: str) -> str:
    return (
        f"{WITH_KEYS} SELECT p.left_id, p.right_id, round({DISTANCES[c]}, 6) AS distance "
        f"FROM labelled p {PAIR_JOIN}"
    )


def embedding(k: int, splits: int, mean: bool, columns: dict[str, str], weights: str = "1") -> str:
    """Embedding of people by their first ``k`` complete records, in long form."""
    names = list(columns)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in DISTANCES)
    divisor = k // splits if mean else 1
    parts = " UNION ALL ".join(
        f"SELECT a.rec_id, (b.slot * {len(names)} + {i})::INTEGER AS pos, {i} AS col, {sql} AS d "
        "FROM people a, basis b"
        for i, sql in enumerate(columns.values())
    )
    return f"""WITH {PEOPLE}, basis AS (
      SELECT *, (row_number() OVER (ORDER BY rec_id) - 1) % {splits} AS slot
      FROM (SELECT * FROM people WHERE {complete} ORDER BY rec_id LIMIT {k})
    ), parts AS ({parts})
    SELECT rec_id, pos, round(sum(d) / {divisor} * {weights}, 6) AS value
    FROM parts GROUP BY rec_id, pos, col"""


def block_matches(weights: dict[str, float], intercept: float) -> str:
    """CTEs: every pair inside a nation, scored, and the accepted ones numbered."""
    return f"""WITH {PEOPLE}, block AS (
      SELECT a.rec_id AS left_id, b.rec_id AS right_id, a.cluster_id,
             CASE WHEN a.match_id IS NULL OR b.match_id IS NULL THEN -1
                  WHEN a.match_id = b.match_id THEN 1 ELSE 0 END AS label,
             {rounded()},
             coalesce({score(weights, intercept)} > 0, false) AS accepted
      FROM people a JOIN people b ON a.cluster_id = b.cluster_id AND a.rec_id < b.rec_id
    ), found AS (
      SELECT *, row_number() OVER (ORDER BY left_id, right_id) AS pair_no FROM block WHERE accepted
    )"""
