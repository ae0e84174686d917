"""Best-two-fit packing of tokenized documents into sequences.

A sequence is filled greedily, longest unpacked piece first. If a gap remains, the
smallest piece in it is taken out again if two unpacked pieces fit the widened gap more
tightly. What a sequence gets depends on lengths only, so packing runs on the number of
pieces of each length, at most as many numbers as the sequence has tokens, and one
pattern of lengths is used for as many sequences as the numbers allow. The cluster
tokenizes, counts lengths, numbers the pieces by a distributed sort and looks up their
places; nothing whole passes through the driver. Many pieces of one length, for instance
of copies, are many row numbers and no group.

Tokenizing: white space separates tokens of this vocabulary in any case, so each distinct
word is tokenized once per worker and remembered, up to a bound.

Defined cases: a null text is empty; an empty text is one piece, the end token alone;
only documents longer than a sequence are cut; repeated rows are pieces of their own; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import kept_in_worker, only, table, written
from recordlink.operators.ordering import number_rows

SEQUENCE_TOKENS = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Distinct words that a worker remembers; as many older ones are kept for a while.
REMEMBERED = 500_000
MARK = "\x01"
# Cuts words of letters apart, without the marks and spaces around them, which cost time.
DIGIT = "0"
# To the tokenizer signs at the end of a word of letters are a word of their own, and capitals
# are small letters.
ENDS = string.punctuation
# How tokens end that are the last of a word.
WORD_END = "</w>"
# Letters up to here are composed, and what normalizing makes of each is the same everywhere.
LAST_LATIN = "\u024f"
# Documents that are tokenized at the same time.
TOGETHER = 50
_PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_small_latin(text: str) -> bool:
    """Letters alone, in small ones, of which normalizing makes the same."""
    return text.isalpha() and (text.isascii() or max(text) <= LAST_LATIN) and text == text.lower()


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit integers, word by word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words of small letters, which need no normalizing and no pattern
        self.letters = Tokenizer(self.tokenizer.model)
        by_digit = pre_tokenizers.CharDelimiterSplit(DIGIT)
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([by_digit, in_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # a word of its own that is one token, and no part of a word without it
        self.mark = int(self._encoded(MARK)[0])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Cut at what is white space to any tokenizer; other kinds stay inside a word."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _encoded(self, text: str) -> np.ndarray:
        """The ids of a text; of small letters with digits between, those of the letters alone."""
        tokenizer = self.letters if is_small_latin(text.replace(DIGIT, "")) else self.tokenizer
        found = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found[0].ids, dtype="<u4")

    def _marked(self, words: list[str]) -> list[bytes]:
        """The ids of words without the mark, encoded at once and cut at the marks behind them."""
        if not words:
            return []
        ids = self._encoded(f" {MARK} ".join([*words, ""]))
        ends = np.nonzero(ids == self.mark)[0].tolist()
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], ends)]

    def _lettered(self, words: list[str]) -> list[bytes]:
        """The ids of words of small letters, encoded at once and cut behind each last token."""
        if not words:
            return []
        ids = self._encoded(DIGIT.join(words))
        ends = (np.nonzero(self.last[ids])[0] + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):  # the vocabulary does not tell
            return self._marked(words)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        distinct = set().union(*parts)
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        # of these words only, which is quicker to look them up in than all that is remembered
        here = dict(zip(distinct, map(known.get, distinct)))
        ended, others = [], []
        missing: dict[str, None] = {}
        for word in [word for word, ids in here.items() if ids is None]:
            # set operations with a dict would walk through all that is remembered
            if word in older:
                here[word] = known[word] = older[word]
                continue
            letters = word.rstrip(ENDS)
            core, end = letters.lower(), word[len(letters) :]
            if not is_small_latin(core):
                others.append(word)
                continue
            if end not in known:
                known[end] = self._encoded(end).tobytes()
            ids = known.get(core) or older.get(core)
            if ids is None:
                missing[core] = None
                ended.append((word, core, end))
            else:
                known[core] = ids
                here[word] = known[word] = ids + known[end]
        known.update(zip(missing, self._lettered(list(missing))))
        # remembered by its core alone until it is met again, for most are rare
        here.update((word, known[core] + known[end]) for word, core, end in ended)
        plain = [w for w in others if MARK not in w]
        found = dict(zip(plain, self._marked(plain)))
        if len(plain) < len(others):
            found.update((word, self._encoded(word).tobytes()) for word in others if MARK in word)
        known.update(found)
        here.update(found)
        return [b"".join(map(here.__getitem__, p)) for p in parts]


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, kept from task to task until another step runs there."""
    return kept_in_worker(path, lambda: WordTokenizer(path))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of the documents' ids (with the end token) of at most ``capacity`` tokens.

    ``start`` counts the document's ids before the piece; ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit integers.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _tokenizer(path)
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                part = batch.iloc[first : first + TOGETHER]
                rows = []
                for doc_id, ids in zip(part["doc_id"], words.ids([t or "" for t in part["text"]])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        cut_ids = ids[at : at + width]
                        rows.append((doc_id, piece, at // 4, len(cut_ids) // 4, cut_ids))
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return only(docs, "doc_id", "text").mapInPandas(cut, _PIECE_FIELDS)


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with ``uses[length]`` pieces of each length."""

    times: int
    uses: dict[int, int]


def _best_pair(left: np.ndarray, below: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill ``gap`` best, if they beat ``more_than``."""
    first = np.nonzero(left[: gap // 2 + 1])[0]
    first = first[first > 0]
    if not len(first):
        return None
    second = below[gap - first]
    # the same length twice needs two pieces
    usable = (second > first) | ((second == first) & (left[first] > 1))
    sums = np.where(usable, first + second, 0)
    at = int(np.argmax(sums))
    return (int(first[at]), int(second[at])) if sums[at] > more_than else None


def best_two_fit(counts: Mapping[int, int], capacity: int = SEQUENCE_TOKENS) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces by length), in the order of packing."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    places = np.arange(capacity + 1)
    patterns = []
    while left.any():
        total = left.copy()
        below = np.maximum.accumulate(np.where(left > 0, places, 0))
        uses: dict[int, int] = {}
        gap = capacity
        while gap > 0 and below[gap] > 0:
            length = int(below[gap])
            n = int(min(left[length], gap // length))
            uses[length] = uses.get(length, 0) + n
            left[length] -= n
            gap -= n * length
            if left[length] == 0:
                below = np.maximum.accumulate(np.where(left > 0, places, 0))
        if gap > 0 and sum(uses.values()) > 1:
            smallest = min(uses)
            pair = _best_pair(left, below, gap + smallest, smallest)
            if pair:
                uses[smallest] -= 1
                for length in pair:
                    uses[length] = uses.get(length, 0) + 1
        uses = {length: n for length, n in uses.items() if n}
        times = int(min(total[length] // n for length, n in uses.items()))
        for length, n in uses.items():
            total[length] -= n * times
        left = total
        patterns.append(Pattern(times, uses))
    return patterns


def _runs(counts: Mapping[int, int], patterns: list[Pattern]) -> np.ndarray:
    """Where pieces go, by row number in order of length.

    Rows: first row number, first sequence, pieces per sequence, first offset, length.
    """
    next_row, first = {}, 0
    for length in sorted(counts):
        next_row[length] = first
        first += counts[length]
    runs, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for length, n in sorted(pattern.uses.items(), reverse=True):
            runs.append((next_row[length], sequence, n, offset, length))
            next_row[length] += n * pattern.times
            offset += n * length
        sequence += pattern.times
    return np.asarray(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id, piece, length``.

    ``pieces`` is read several times and should be a written table.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = _runs(counts, best_two_fit(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def place(rows: pd.Series) -> pd.DataFrame:
        of = shared.value
        row = rows.to_numpy()
        run = of[np.searchsorted(of[:, 0], row, side="right") - 1]
        behind = row - run[:, 0]
        sequence = run[:, 1] + behind // run[:, 2]
        offset = run[:, 3] + behind % run[:, 2] * run[:, 4]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    others = [c for c in pieces.columns if c not in ("length", "doc_id", "piece")]
    order = ["length", "doc_id", "piece", *[c for c in others if c != "ids"]]
    numbered = number_rows(pieces, order, "_row").withColumn("_place", place("_row"))
    return numbered.select(
        *pieces.columns, F.col("_place.sequence_id"), F.col("_place.offset")
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its token ids (from pieces that kept ``ids``) and documents.

    A group is one sequence, so at most ``capacity`` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )


def _packed_digests(docs: DataFrame) -> DataFrame:
    pieces = tokenized_pieces(docs, tokenizer_path())
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(digests, "pieces"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed_digests(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document that is left, packed."""
    return _packed_digests(docs)
