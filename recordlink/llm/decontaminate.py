"""Benchmark decontamination with spaced seeds.

Fixed masks look at some positions of a window of words and ignore the others, so a hit
survives substitutions at the ignored ones. The masks' hashes of all benchmark items are
the index; the hashes of every window of every document are looked up in it. Around each
hit document and item are laid over each other, word by word. A stretch is an overlap if
it has ``MIN_OVERLAP`` words (or the whole item, if that is shorter) and at least
``MIN_EQUAL`` of them are equal. The longest is found from prefix sums in which an equal
word counts 1 and a different one -4: its sum is 0 or more. Different words at its ends are
then left out down to the least length.

The masks miss nothing: m different words leave m + 1 runs of equal ones, and with
``MIN_EQUAL`` of 6 words or more equal either a run has four words, or two runs with three
words and two around a different one fit the second mask (tests lay out all cases).

The benchmark is the stated query set. It is taken in blocks of bounded size, and each
block's index is broadcast; the documents are read row by row without a shuffle, so
neither a source nor a frequent passage can be hot.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts
overlap with nothing; items without id, without text or with fewer than ``MIN_WORDS`` words
are no evidence and are left out; rows that repeat an id are answered once each; extra
columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, table

# 1: the word counts, 0: it is ignored
MASKS = ("1111", "110011")
MIN_OVERLAP = 12
MIN_WORDS = 6
MIN_EQUAL = 0.8
# What a different word costs if an equal one gains 1: MIN_EQUAL are equal from sum 0 on.
LOSS = round(MIN_EQUAL / (1 - MIN_EQUAL))
# Hits, or words of alignments, that are looked at together.
TOGETHER = 2_000_000
# Characters of benchmark text in a block.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\w+")
_FOUND = "array<struct<item_id:bigint,start:bigint,stop:bigint,n_equal:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counted words at each place where the mask fits; 0 if one is unknown."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(len(mask)))
    known = np.ones(n, dtype=bool)
    for i, counted in enumerate(mask):
        if counted == "1":
            part = codes[i : i + n]
            known &= part >= 0
            total = (total ^ part.astype(np.uint64)) * _MIX
            total ^= total >> np.uint64(29)
    return np.where(known, total | np.uint64(1), np.uint64(0))


@dataclass
class SeedIndex:
    """Words, items and the sorted seed hashes of a block of the benchmark."""

    codes: dict[str, int]
    item_ids: list[int]
    items: list[np.ndarray]
    hashes: list[np.ndarray]
    places: list[np.ndarray]  # item number and position, per hash

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> SeedIndex:
        codes: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            words = words_of(text)
            if len(words) >= MIN_WORDS:
                ids.append(item_id)
                items.append(np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64))
        hashes, places = [], []
        for mask in MASKS:
            found = [seed_hashes(item, mask) for item in items]
            every = np.concatenate([*found, np.empty(0, dtype=np.uint64)])
            item = np.repeat(np.arange(len(found)), [len(f) for f in found])
            at = np.concatenate([*[np.arange(len(f)) for f in found], np.empty(0, dtype=np.int64)])
            order = np.argsort(every, kind="stable")
            hashes.append(every[order])
            places.append(np.stack([item, at], axis=1).reshape(-1, 2)[order].astype(np.int64))
        return SeedIndex(codes, ids, items, hashes, places)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(item) for item in self.items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.every = np.concatenate([*self.items, np.empty(0, dtype=np.int64)])
        self.least = np.minimum(MIN_OVERLAP, self.sizes)

    def _hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item numbers and shifts (place in the document less place in the item), in parts."""
        for mask, hashes, places in zip(MASKS, self.hashes, self.places):
            seen = seed_hashes(codes, mask)
            at = np.nonzero(seen)[0]
            if not len(at) or not len(hashes):
                continue
            first = np.searchsorted(hashes, seen[at], "left")
            first_hash = hashes[np.minimum(first, len(hashes) - 1)]
            there = first_hash == seen[at]
            at, first = at[there], first[there]
            n = np.searchsorted(hashes, seen[at], "right") - first
            for part in _parts(n):
                n_of, place = n[part], places[_ranges(first[part], n[part])]
                shift = np.repeat(at[part], n_of) - place[:, 1]
                # no shift is below the length of the longest item, or beyond the text
                width = len(codes) + len(self.every) + 1
                key = np.unique(place[:, 0] * width + shift + len(self.every))
                yield key // width, key % width - len(self.every)

    def _overlapping(self, codes: np.ndarray, item: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int]]:
        """Those of the alignments that hold an overlap."""
        begin = np.maximum(0, shift)
        size = np.minimum(len(codes), shift + self.sizes[item]) - begin
        long = size >= self.least[item]
        item, shift, begin, size = item[long], shift[long], begin[long], size[long]
        for part in _parts(size + 1):
            n, of = size[part], item[part]
            in_item = self.starts[of] + begin[part] - shift[part]
            equal = codes[_ranges(begin[part], n)] == self.every[_ranges(in_item, n)]
            # prefix sums of each alignment, from 0 on
            heads = np.cumsum(n + 1) - (n + 1)
            steps = np.zeros(len(equal) + len(n), dtype=np.int64)
            steps[_ranges(heads + 1, n)] = np.where(equal, 1, -LOSS)
            gain = np.cumsum(steps)
            gain -= np.repeat(gain[heads], n + 1)
            # an alignment's sums lie below all those of the one before, so its minima are its own
            below = np.repeat(np.arange(len(n)) * (int(n.max()) + 1) * (LOSS + 1), n + 1)
            lowest = np.minimum.accumulate(gain - below) + below
            least = self.least[of]
            rest = n + 1 - least
            ends = gain[_ranges(heads + least, rest)] >= lowest[_ranges(heads, rest)]
            for k in np.nonzero(np.add.reduceat(ends, np.cumsum(rest) - rest))[0]:
                yield int(of[k]), int(shift[part][k])

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """The longest overlap with each item: item id, first word, end, equal words."""
        if not text or not self.items:
            return []
        known = self.codes
        codes = np.array([known.get(w, -1) for w in words_of(text)], dtype=np.int64)
        alignments = {found for hits in self._hits(codes) for found in self._overlapping(codes, *hits)}
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in alignments:
            found = self._stretch(codes, self.items[item], shift)
            if found and (item not in best or (found[2], -found[0]) > (best[item][2], -best[item][0])):
                best[item] = found
        return sorted((self.item_ids[item], *place) for item, place in best.items())

    @staticmethod
    def _stretch(codes: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        begin, end = max(0, shift), min(len(codes), shift + len(item))
        equal = codes[begin:end] == item[begin - shift : end - shift]
        gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -LOSS))])
        # the first place before each end from which the sum is 0 or more
        first = np.searchsorted(-np.minimum.accumulate(gain), -gain, "left")
        stop = int(np.argmax(np.arange(len(gain)) - first))
        start, least = int(first[stop]), min(MIN_OVERLAP, len(item))
        if stop - start < least:
            return None
        while stop - start > least and not equal[stop - 1]:
            stop -= 1
        while stop - start > least and not equal[start]:
            start += 1
        return begin + start, begin + stop, int(equal[start:stop].sum())


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first``, ``first`` + 1 and so on, ``n`` of each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Consecutive parts with a sum of about ``TOGETHER``."""
    if len(n):
        cuts = np.nonzero(np.diff(np.cumsum(n) // TOGETHER))[0] + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
            yield slice(at, end)


def _index_blocks(benchmark: DataFrame) -> list[SeedIndex]:
    """Indexes of the benchmark's blocks, each of about ``BLOCK_CHARS`` at most."""
    items = only(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [
        SeedIndex.of([(r["item_id"], r["text"]) for r in items.where(block == b).orderBy("item_id", "text").collect()])
        for b in range(n)
    ]


def with_overlaps(docs: DataFrame, benchmark: DataFrame, name: str = "overlaps") -> DataFrame:
    """``docs`` with the array ``name``: item, first word, end and equal words of overlaps."""

    def finder(index: SeedIndex) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf(_FOUND)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(
                    [
                        [dict(zip(("item_id", "start", "stop", "n_equal"), o)) for o in shared.value.overlaps(t)]
                        for t in batch
                    ],
                    dtype=object,
                )

        return find("text")

    return docs.withColumn(name, F.concat(*[finder(index) for index in _index_blocks(benchmark)]))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = with_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap with a benchmark item go."""
    kept = docs.withColumn("_doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_doc", "_doc.text")
    found = with_overlaps(kept, table(spark, sf_dir, "benchmark"), "_overlaps")
    return found.where(F.size("_overlaps") == 0).select("_doc.*")
