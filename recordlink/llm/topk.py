"""Exact top-k inner products with a bit-sliced index.

Rows are dealt into blocks of a few thousand. In a block every component becomes a stack
of bitmaps, one per bit and one bit per row, of its leading bits. A query's components,
rounded to a few leading bits as well, say which stacks to add: for each bit of the
weights the stacks of the components that have it are summed by carry-save adders, many
rows per machine word, and the sums are added with their shifts. From the most
significant slice of the result downward the k best rows are selected. What was rounded
away changes a score by a bound that is known, so the rows within twice that bound of the
k-th are resolved by their exact integer inner products. Vectors with components that do
not fit ``MOST_BITS`` bits once quantised are not indexed: in the same cells floating-point
scores with their error bound choose the rows that are scored in exact wide integers.
Every row is looked at, and the answer is exact.

Queries meet every block of rows, which is what was asked; both sides are dealt into
blocks of bounded size by a hash of the id, so equal vectors do not meet in one task. The
best k of each block are reduced per query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; null ids neither; an answer with a score that does not fit in a long is an error; vectors are compared with vectors of their length; rows that repeat an id are
candidates of their own, and such an id asks once, with its smallest vector; fewer than k
candidates are all returned; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlink.llm.common import only, table

K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK_ROWS = 3000
BLOCK_QUERIES = 2000
# Queries whose bitmaps are added at the same time.
TOGETHER = 16
# Leading bits kept of each component and of each query weight.
SLICE_BITS = 6
WEIGHT_BITS = 5
MOST_BITS = 26


def quantised(vector: Column) -> Column:
    """``floor(256 * x)`` of each component, x as double: integers, held as doubles."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        # beyond, doubles are integers
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _added(stack: np.ndarray) -> np.ndarray:
    """Sum of bit-sliced numbers: (bits, queries, numbers, words) -> (more bits, queries, words)."""
    while stack.shape[2] > 1:
        if stack.shape[2] % 2:
            stack = np.concatenate([stack, np.zeros_like(stack[:, :, :1])], axis=2)
        stack = _sum_of_two(stack[:, :, 0::2], stack[:, :, 1::2])
    return stack[:, :, 0]


def _sum_of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ripple-carry sum of two stacks of equally many slices, lowest slice first."""
    out = np.empty((a.shape[0] + 1, *a.shape[1:]), dtype=np.uint64)
    carry = np.zeros(a.shape[1:], dtype=np.uint64)
    for i in range(a.shape[0]):
        odd = a[i] ^ b[i]
        out[i] = odd ^ carry
        carry = (a[i] & b[i]) | (odd & carry)
    out[-1] = carry
    return out


def _shifted_sum(total: np.ndarray, more: np.ndarray, shift: int) -> np.ndarray:
    """``total + (more << shift)``."""
    bits = max(total.shape[0], more.shape[0] + shift)
    shape = (bits, *total.shape[1:])
    a, b = np.zeros(shape, dtype=np.uint64), np.zeros(shape, dtype=np.uint64)
    a[: total.shape[0]] = total
    b[shift : shift + more.shape[0]] = more
    return _sum_of_two(a, b)


class BlockIndex:
    """The bit slices of one block of rows (integers, one row per vector)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.n, self.width = rows.shape
        least = rows.min(axis=0)
        widest = int((rows.max(axis=0) - least).max())
        self.shift = max(0, widest.bit_length() - SLICE_BITS)
        self.bits = max(1, widest.bit_length() - self.shift)
        lead = (rows - least) >> self.shift
        # the middle of what a component's leading bits stand for, at its farthest from 0
        middle = (lead << self.shift) + least + ((1 << self.shift) - 1) / 2
        self.farthest = np.abs(middle).max(axis=0)
        self.words = -(-self.n // 64)
        plain = np.stack([self._bitmap((lead >> i) & 1) for i in range(self.bits)])
        nothing = np.zeros((self.bits, 1, self.words), dtype=np.uint64)
        # components, their complements for negative weights, and an empty one as filling
        self.slices = np.concatenate([plain, ~plain, nothing], axis=1)

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.zeros((self.width, self.words * 8), dtype=np.uint8)
        found = np.packbits(bits.T.astype(np.uint8), axis=1, bitorder="little")
        packed[:, : found.shape[1]] = found
        return packed.view(np.uint64)

    def _scores(self, weights: np.ndarray) -> np.ndarray:
        """Bit slices of the rounded scores of several queries, lowest slice first."""
        size = np.abs(weights)
        total = np.zeros((1, len(weights), self.words), dtype=np.uint64)
        for bit in range(int(size.max()).bit_length()):
            has = (size >> bit) & 1
            most = int(has.sum(axis=1).max())
            if not most:
                continue
            chosen = np.full((len(weights), most), 2 * self.width)
            query, part = np.nonzero(has)
            place = (np.cumsum(has, axis=1) - 1)[query, part]
            chosen[query, place] = np.where(weights[query, part] < 0, part + self.width, part)
            total = _shifted_sum(total, _added(self.slices[:, chosen]), bit)
        return total

    @staticmethod
    def _kth_best(slices: np.ndarray, eligible: np.ndarray, k: int) -> list[int]:
        """A lower bound of each query's k-th best score, from the top slice downward."""
        sure = np.zeros_like(eligible)
        open_ = eligible.copy()
        value = [0] * len(eligible)
        for i in range(slices.shape[0] - 1, -1, -1):
            ones = open_ & slices[i]
            enough = np.bitwise_count(sure | ones).sum(axis=1) >= k
            for q in np.nonzero(enough)[0]:
                value[q] |= 1 << i
            keep = enough[:, None]
            sure = np.where(keep, sure, sure | ones)
            open_ = np.where(keep, ones, open_ & ~slices[i])
        return value

    @staticmethod
    def _at_least(slices: np.ndarray, limits: list[int]) -> np.ndarray:
        """Bitmaps of the rows whose score reaches each query's limit."""
        top = (1 << slices.shape[0]) - 1
        limits = [min(max(x, 0), top) for x in limits]
        above = np.zeros(slices.shape[1:], dtype=np.uint64)
        equal = ~above
        for i in range(slices.shape[0] - 1, -1, -1):
            wanted = np.array([(x >> i) & 1 for x in limits], dtype=bool)[:, None]
            above |= np.where(wanted, np.uint64(0), equal & slices[i])
            equal &= np.where(wanted, slices[i], ~slices[i])
        return above | equal

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
        """``(query id, row id, exact score)`` of the best k rows for each query."""
        shift = max(0, int(np.abs(queries).max()).bit_length() - WEIGHT_BITS)
        weights = np.rint(queries / (1 << shift)).astype(np.int64)
        slices = self._scores(weights)
        rest = np.abs(queries - (weights << shift)) @ self.farthest
        slack = ((1 << self.shift) - 1) / 2 * np.abs(queries).sum(axis=1) + rest
        eligible = np.zeros((len(queries), self.words * 64), dtype=bool)
        eligible[:, : self.n] = query_ids[:, None] != self.ids[None, :]
        packed = np.packbits(eligible, axis=1, bitorder="little").view(np.uint64)
        kth = self._kth_best(slices, packed, k)
        few = eligible.sum(axis=1) < k
        unit = float(1 << (shift + self.shift))
        limits = [
            0 if few[q] else math.floor(kth[q] - 2 * slack[q] / unit) - 1 for q in range(len(queries))
        ]
        reached = (self._at_least(slices, limits) & packed).view(np.uint8)
        out = []
        for q, bits in enumerate(np.unpackbits(reached, axis=1, bitorder="little").astype(bool)):
            rows = np.nonzero(bits[: self.n])[0]
            exact = self.rows[rows] @ queries[q]
            order = np.lexsort((self.ids[rows], -exact))[:k]
            out += [(query_ids[q], self.ids[rows[i]], exact[i]) for i in order]
        return out


def _wide_best(query_id: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple]:
    """``(query id, row id, exact score)`` of the best k rows, for components of any size."""
    others = ids != query_id
    ids, rows = ids[others], rows[others]
    if len(ids) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            score = rows @ query
            slack = np.abs(rows) @ np.abs(query) * ((len(query) + 4) * 2.0**-52)
            low, high = score - slack, score + slack
        if np.isfinite(low).all() and np.isfinite(high).all():
            near = high >= np.partition(low, -k)[-k]
            ids, rows = ids[near], rows[near]
    weights = [int(x) for x in query.tolist()]
    exact = [sum(int(x) * w for x, w in zip(row, weights)) for row in rows.tolist()]
    best = sorted(zip(exact, ids.tolist()), key=lambda found: (-found[0], found[1]))[:k]
    return [(query_id, row_id, score) for score, row_id in best]


def _search_cell(k: int):
    least, most = -(1 << 63), (1 << 63) - 1

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            row_ids, ids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            vectors, asked = np.stack(rows["vector"]), np.stack(queries["vector"])
            # what the index adds up fits in a long
            limit = min(1 << MOST_BITS, math.isqrt((1 << 62) // vectors.shape[1]))
            fits, asked_fits = np.abs(vectors).max(axis=1) < limit, np.abs(asked).max(axis=1) < limit
            if fits.any() and asked_fits.any():
                index = BlockIndex(row_ids[fits], vectors[fits].astype(np.int64))
                some_ids, some = ids[asked_fits], asked[asked_fits].astype(np.int64)
                for at in range(0, len(some_ids), TOGETHER):
                    out += index.best(some_ids[at : at + TOGETHER], some[at : at + TOGETHER], k)
            wide_ids, wide = row_ids[~fits], vectors[~fits]
            for query_id, query, small in zip(ids.tolist(), asked, asked_fits):
                if not small:
                    out += _wide_best(query_id, query, row_ids, vectors, k)
                elif len(wide):
                    out += _wide_best(query_id, query, wide_ids, wide, k)
        held = [(q, i, min(max(int(x), least), most), least <= x <= most) for q, i, x in out]
        kinds = {"query_id": "int64", "vec_id": "int64", "score": "int64", "fits": "bool"}
        return pd.DataFrame(held, columns=list(kinds)).astype(kinds)

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` best other rows of ``vectors`` (``vec_id, embedding``) for every query row."""
    ready = (
        only(vectors, "vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select("vec_id", quantised(F.col("embedding")).alias("vector"))
        .withColumn("width", F.size("vector"))
    )
    queries = ready.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "width").agg(
        F.min("vector").alias("vector")
    )
    n_rows, n_queries = (
        ready.select(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first() or (0, 0)
    )
    row_blocks = max(1, -(-n_rows // block_rows))
    query_blocks = max(1, -(-n_queries // block_queries))

    def dealt(df: DataFrame, id_col: str, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.withColumn(own, block).withColumn(other, every)

    cell = ["width", "row_block", "query_block"]
    rows = dealt(ready, "vec_id", "row_block", row_blocks, "query_block", query_blocks)
    asked = dealt(queries, "query_id", "query_block", query_blocks, "row_block", row_blocks)
    found = (
        rows.groupBy(*cell)
        .cogroup(asked.groupBy(*cell))
        .applyInPandas(_search_cell(k), "query_id long, vec_id long, score long, fits boolean")
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fits"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first))
    too_large = F.raise_error(F.lit("a score of the answer does not fit in a long")).cast("long")
    score = F.when(F.col("fits"), F.col("score")).otherwise(too_large).alias("score")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP7_SQL = f"""
WITH ready AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM ready q JOIN ready c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
