"""Importance resampling towards a target distribution: array-scored weights, then quickselect.

1. Features are the runs of 1 to 3 words of a text, each in one of ``BUCKETS`` buckets by
   its CRC-32. Every task counts its rows into one array; the arrays of all documents and of
   all target texts are summed over the cluster. What reaches the driver is ``BUCKETS``
   sums, whatever the corpus holds.
2. The gains, one integer a bucket, go to the tasks as one array. A document's weight is the
   sum of the gains at its features' buckets; its score adds Gumbel noise that is drawn
   from a hash of its id, so a task that runs again draws the same. The scores are written.
3. The k-th of the composite keys (score descending, doc_id, row) is found by distributed
   quickselect: random keys of the open interval are pivots, all its keys are counted
   exactly as below, at or between pivots, and the part that holds the k-th goes on. Keys
   are unique, so the interval shrinks in every round. A round takes one narrow scan.
4. Only the winners are sorted, over the cluster, and ranked.

Defined cases: a null or empty text, or one without words, has no features and weight 0;
a document with a null id has no score and is never drawn (nor counted among those drawn
from); rows that repeat an id are documents of their own, and among equal scores and ids the
order is that of the written rows; an empty target or corpus leaves counts of 0, which the
formula allows; if fewer than one document is due, none has a rank; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import LOWER, UPPER, only, table, words_of, written
from recordlink.operators.ordering import number_rows

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Random keys that cut the interval in one round.
PIVOTS = 64
# Words of a long text that are hashed at a time.
STRETCH = 100_000


def feature_buckets(words: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``LONGEST`` words, repeats included, stretch by stretch."""
    for at in range(0, len(words), STRETCH):
        end = min(at + STRETCH, len(words))
        part = words[at : end + LONGEST - 1]
        spaced = [b" " + w for w in part]
        hashes = list(map(crc32, part[: end - at]))
        found = hashes.copy()
        for more in range(1, LONGEST):
            # the hash of a run goes on from that of the run without its last word
            hashes = list(map(crc32, spaced[more:], hashes))
            found += hashes
        yield np.array(found, dtype=np.uint32) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all rows' ``text`` fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                for found in feature_buckets(words_of(text)):
                    total += np.bincount(found, minlength=BUCKETS)
        held = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    counted = only(texts, "text").mapInPandas(count, "bucket int, n long")
    sums = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, dtype=np.int64)
    total[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln)`` of how much likelier a bucket is in the target, both smoothed by one."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(doc_id: int, seed: int) -> int:
    """``floor(1000 * Gumbel noise)``, drawn from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                n = weight = 0
                for found in feature_buckets(words):
                    n += len(found)
                    weight += int(held.value[found].sum())
                own = None if doc_id is None else int(doc_id)
                rows.append((own, len(words), n, weight, None if own is None else weight + noise(own, seed)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pd.DataFrame(rows, columns=names, dtype="object")

    # as text, an id that is missing does not turn the others into floating-point numbers
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(score, "doc_id long, n_words long, n_features long, weight long, score long")


_KEY = ("_first", "doc_id", "_row")


def _literal(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(int(x)).cast("long").alias(n) for n, x in zip(_KEY, key)])


def kth_key(keys: DataFrame, k: int, n: int) -> tuple[int, ...]:
    """The ``k``-th smallest (from 1) of the ``n`` unique keys, columns ``_KEY``."""
    key = F.struct(*_KEY)
    low = high = None
    turn = 0
    while True:
        open_ = keys
        if low is not None:
            open_ = open_.where((F.col(_KEY[0]) >= low[0]) & (key > _literal(low)))
        if high is not None:
            open_ = open_.where((F.col(_KEY[0]) <= high[0]) & (key < _literal(high)))
        turn += 1
        chance = F.pmod(F.xxhash64(F.lit(turn), *_KEY), F.lit(max(1, n // PIVOTS))) == 0
        pivots = sorted(tuple(r) for r in open_.where(chance).limit(4 * PIVOTS).collect())
        if not pivots:
            continue
        cuts = F.array(*[_literal(p) for p in pivots])
        below = F.size(F.filter(cuts, lambda p: p < key))
        at = F.array_contains(cuts, key).cast("int")
        # 2 i: between the pivots i - 1 and i; 2 i + 1: at pivot i
        sizes = dict(open_.groupBy((2 * below + at).alias("place")).count().collect())
        for place in range(2 * len(pivots) + 1):
            here = sizes.get(place, 0)
            if k <= here:
                break
            k -= here
        else:
            raise ValueError("there are fewer keys than the one asked for")
        i, is_pivot = divmod(place, 2)
        if is_pivot:
            return pivots[i]
        low = pivots[i - 1] if i else low
        high = pivots[i] if i < len(pivots) else high
        n = here


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document with its weight, score and, if it is drawn, rank.

    ``percent`` of the documents with ``min_words`` or more are drawn without replacement,
    in proportion to how much likelier their features are in ``target``.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    rows = scored(docs, gains, seed).withColumn("_row", F.monotonically_increasing_id())
    # written, so the numbers of the rows stay
    rows = written(rows.withColumn(_KEY[0], -F.col("score")), "scored")
    may_win = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    candidates = rows.where(may_win).select(*_KEY)
    n = candidates.count()
    k = n * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, no_rank)
    last = kth_key(candidates, k, n)
    wins = F.coalesce(may_win & (F.struct(*_KEY) <= _literal(last)), F.lit(False))
    ranked = number_rows(rows.where(wins), list(_KEY), "rank", start=1)
    return ranked.select(*columns, "rank").unionByName(rows.where(~wins).select(*columns, no_rank))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_steps() -> str:
    """What four bits do to a CRC-32, for each of their 16 values."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return str(steps)


OP12_SQL = rf"""
WITH texts AS (
  SELECT false AS target, row_number() OVER () AS row_no, doc_id, text FROM documents
  UNION ALL SELECT true, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT target, row_no, doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[]
    ELSE regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM texts),
runs AS (
  SELECT target, row_no, unnest(flatten(list_transform([1, 2, 3], lambda l:
    list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))))) AS f
  FROM worded),
held AS (SELECT target, row_no, f, count(*) AS n FROM runs GROUP BY ALL),
spelt AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM held)),
steps AS (
  SELECT f, flatten(list_transform(range(1, len(h), 2), lambda i:
    [instr('0123456789ABCDEF', h[i + 1]) - 1, instr('0123456789ABCDEF', h[i]) - 1])) AS halves
  FROM spelt),
hashed AS (
  SELECT f, xor(list_reduce(halves, lambda c, x:
    xor(({_crc_steps()}::BIGINT[])[(xor(c, x::BIGINT) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS b
  FROM steps),
buckets AS (SELECT target, row_no, b, sum(n) AS n FROM held JOIN hashed USING (f) GROUP BY ALL),
sums AS (
  SELECT b.b, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t
  FROM (SELECT unnest(range({BUCKETS})) AS b) b LEFT JOIN buckets USING (b) GROUP BY b.b),
gains AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
weighed AS (
  SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM buckets JOIN gains USING (b) WHERE NOT target GROUP BY row_no),
rows_ AS (
  SELECT w.row_no, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || w.doc_id)[1:8])::BIGINT AS h
  FROM worded w LEFT JOIN weighed USING (row_no) WHERE NOT w.target),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM rows_),
drawn AS (
  SELECT *, n_words >= {MIN_WORDS} AND score IS NOT NULL AS eligible FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id, row_no) AS place,
    count(*) FILTER (eligible) OVER () AS n FROM drawn)
SELECT doc_id, n_features, weight, score,
  CASE WHEN eligible AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM ranked
"""
