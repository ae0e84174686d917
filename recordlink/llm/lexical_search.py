"""Ranked lexical search over a length-stratified index, exact.

Terms are ASCII letters (lower-cased) and digits and what lies beyond ASCII. A document's
length normaliser ``m`` is an integer, and a term's part in its score depends on nothing but
the term, its occurrences ``tf`` and ``m``. Documents with equal ``m`` are a stratum:

1. Every document is written with its number of terms and the occurrences of those terms
   that the queries hold. Lengths and document frequencies are counted over all of them.
2. Documents are sorted by ``m`` over the cluster; a stratum, however large, spans as many
   tasks as its rows need, and is indexed in blocks of ``BLOCK_DOCS`` documents. Postings
   of a block are ordered by term, then by ``tf``; the impact of each ``tf`` is computed
   once per block.
3. The most that a query can score in a block follows from the largest ``tf`` of each of
   its terms there. A query visits the blocks that a task holds in the order of these
   bounds and stops at the first that cannot reach its k-th best score so far. The next
   blocks of the task start from that score.
4. The best k of each task are ranked per query.

Queries are taken in blocks of ``BLOCK_CHARS`` characters, one after the other; the driver
and the broadcast hold the terms of one. Memory of a task: ``CHUNK`` postings.

Defined cases: a null or empty text, of a document or an item, has no terms; an item
without terms, or with a null id, has no rows; a document with a null id counts in all
statistics and is never returned; documents that repeat an id are ranked each on its own; equal
rows of items ask once, and an id with several texts asks with each of them; fewer than k documents with a
score above 0 are all returned; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlink.llm.common import LOWER, UPPER, only, table, words_of, written

K = 10
# Characters of the items that are searched for in one pass.
BLOCK_CHARS = 16_000_000
BLOCK_DOCS = 1024
# Postings that a task indexes at a time, and bounds that it holds at a time.
CHUNK = 2_000_000
BOUNDS = 5_000_000


class Queries:
    """Items as rows of term numbers, with how often an item holds a term."""

    def __init__(self, items: list[tuple[int, int, list[bytes]]]) -> None:
        """``items``: number, id and words of each item, none without words."""
        self.number = np.array([i[0] for i in items], dtype=np.int64)
        self.item_id = np.array([i[1] for i in items], dtype=np.int64)
        self.vocabulary: dict[bytes, int] = {}
        terms, counts, starts = [], [], [0]
        for *_, words in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            held, n = np.unique(np.array(own, dtype=np.int64), return_counts=True)
            terms.append(held)
            counts.append(n)
            starts.append(starts[-1] + len(held))
        self.terms, self.counts = np.concatenate(terms), np.concatenate(counts)
        self.starts = np.array(starts)

    def __len__(self) -> int:
        return len(self.number)


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats) and, packed, the known terms' numbers and ``tf``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = known.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                n.append(len(words))
                found = np.array([t for t in map(find, words) if t is not None], dtype="<i4")
                held, times = np.unique(found, return_counts=True)
                terms.append(held.tobytes())
                tfs.append(times.astype("<i4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "terms": terms, "tfs": tfs})

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    counted = rows.mapInPandas(count, "doc_id string, n long, terms binary, tfs binary")
    return counted.where("n > 0").withColumn("doc_id", F.col("doc_id").cast("long"))


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of ``size`` terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch["terms"]), dtype="<i4")
            total += np.bincount(held, minlength=size)
        held = np.nonzero(total)[0]
        yield pd.DataFrame({"term": held, "df": total[held]})

    counted = index.select("terms").mapInPandas(count, "term int, df long")
    sums = counted.groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    total = np.zeros(size, dtype=np.int64)
    total[sums["term"].to_numpy(dtype=np.int64)] = sums["df"].to_numpy(dtype=np.int64)
    return total


class Block:
    """The postings of some documents of one stratum."""

    def __init__(
        self, m: int, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray
    ) -> None:
        self.ids = ids
        order = np.lexsort((-tfs, terms))
        terms = terms[order]
        self.doc = np.repeat(np.arange(len(ids)), sizes)[order]
        tf, of = np.unique(tfs[order], return_inverse=True)
        tf = tf.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        self.impact = weight[terms] * impact[of]
        first = np.nonzero(np.diff(terms, prepend=-1))[0]
        self.terms = terms[first]
        self.edges = np.append(first, len(terms))
        # of each term, what its largest tf brings
        self.most = self.impact[first]

    def bounds(self, queries: Queries) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, queries.terms), len(self.terms) - 1)
        part = np.where(self.terms[at] == queries.terms, self.most[at] * queries.counts, 0)
        return np.add.reduceat(part, queries.starts[:-1])

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        at, counts = at[held], counts[held]
        first, n = self.edges[at], self.edges[at + 1] - self.edges[at]
        ends = np.cumsum(n)
        postings = np.repeat(first - (ends - n), n) + np.arange(n.sum())
        total = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(total, self.doc[postings], self.impact[postings] * np.repeat(counts, n))
        return total


class Best:
    """The best k of what one query has seen: score descending, then id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)

    @property
    def needed(self) -> int:
        """A document below this score is not among the best k."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.needed
        score = np.concatenate([self.score, score[may]])
        ids = np.concatenate([self.ids, ids[may]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _blocks(batches: list[pd.DataFrame], weight: np.ndarray) -> Iterator[Block]:
    """Blocks of rows that are sorted by ``m``."""
    whole = pd.concat(batches)
    m, ids = whole["m"].to_numpy(), whole["doc_id"].to_numpy()
    sizes = np.array([len(t) // 4 for t in whole["terms"]])
    terms = np.frombuffer(b"".join(whole["terms"]), dtype="<i4").astype(np.int64)
    tfs = np.frombuffer(b"".join(whole["tfs"]), dtype="<i4")
    at_posting = np.concatenate([[0], np.cumsum(sizes)])
    strata = [*np.nonzero(np.diff(m, prepend=m[0] - 1))[0], len(m)]
    for begin, end in zip(strata, strata[1:]):
        for a in range(begin, end, BLOCK_DOCS):
            b = min(a + BLOCK_DOCS, end)
            part = slice(at_posting[a], at_posting[b])
            yield Block(int(m[a]), ids[a:b], sizes[a:b], terms[part], tfs[part], weight)


def _search_chunk(waiting: list[pd.DataFrame], queries: Queries, weight: np.ndarray, best: list[Best]) -> None:
    blocks = list(_blocks(waiting, weight))
    together = max(1, BOUNDS // len(queries))
    for at in range(0, len(blocks), together):
        _visit(blocks[at : at + together], queries, best)


def _visit(blocks: list[Block], queries: Queries, best: list[Best]) -> None:
    bounds = np.stack([b.bounds(queries) for b in blocks])
    order = np.argsort(-bounds, axis=0, kind="stable")
    for q, found in enumerate(best):
        own = slice(queries.starts[q], queries.starts[q + 1])
        for b in order[:, q]:
            if bounds[b, q] < found.needed:
                break
            found.add(blocks[b].scores(queries.terms[own], queries.counts[own]), blocks[b].ids)


def _searched(index: DataFrame, queries: Queries, weight: np.ndarray, k: int) -> DataFrame:
    """The best k of each task: ``item``, ``item_id``, ``doc_id``, ``score``."""
    held = index.sparkSession.sparkContext.broadcast((queries, weight))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, weight = held.value
        best = [Best(k) for _ in range(len(queries))]
        waiting, postings = [], 0
        for batch in batches:
            waiting.append(batch)
            postings += sum(map(len, batch["terms"])) // 4
            if postings >= CHUNK:
                _search_chunk(waiting, queries, weight, best)
                waiting, postings = [], 0
        if postings:
            _search_chunk(waiting, queries, weight, best)
        n = [len(b.ids) for b in best]
        yield pd.DataFrame(
            {
                "item": np.repeat(queries.number, n),
                "item_id": np.repeat(queries.item_id, n),
                "doc_id": np.concatenate([b.ids for b in best]),
                "score": np.concatenate([b.score for b in best]),
            }
        )

    return index.mapInPandas(search, "item long, item_id long, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[Queries]:
    """Items with terms, in blocks of about ``BLOCK_CHARS`` characters."""
    asked = only(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        held = [(r["item"], r["item_id"], words_of(r["text"])) for r in block.toLocalIterator()]
        held = [h for h in held if h[2]]
        if held:
            yield Queries(held)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    answers = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for queries in _item_blocks(items):
        index = written(occurrences(docs, queries.vocabulary), "postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = document_frequencies(index, len(queries.vocabulary))
        ratios = [(2 * n_docs + 2) / (2 * int(x) + 1) for x in df]
        weight = np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)
        # as decimals, the product does not overflow
        m = F.expr(f"cast(25 + (75 * cast(n AS decimal(19, 0)) * {n_docs}BD) div {n_terms}BD AS long)")
        strata = index.where("doc_id IS NOT NULL AND octet_length(terms) > 0").withColumn("m", m)
        strata = strata.select("m", "doc_id", "terms", "tfs").repartitionByRange("m", F.xxhash64("doc_id"))
        found = _searched(strata.sortWithinPartitions("m"), queries, weight, k)
        answers = answers.unionByName(written(found, "found"))
    best_first = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), "doc_id")
    ranked = answers.withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH worded AS (SELECT row_number() OVER () AS row_no, doc_id, {_SQL_TERMS} AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT row_no, doc_id, t, count(*) AS tf FROM (SELECT row_no, doc_id, unnest(w) AS t FROM worded) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM worded WHERE len(w) > 0),
lengths AS (
  SELECT row_no, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM worded, totals WHERE len(w) > 0),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, totals GROUP BY t),
asked AS (
  SELECT row_number() OVER () AS item, item_id, {_SQL_TERMS} AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
wanted AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM asked) GROUP BY ALL),
scored AS (
  SELECT item, item_id, row_no, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (t) JOIN held USING (t) JOIN lengths USING (row_no)
  WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
