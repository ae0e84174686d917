"""Removal of every byte that lies in a string of 200 bytes that also starts elsewhere.

Prefix doubling on a sparse set of positions. A full suffix array of all bytes would move
dozens of times the input; only positions that can start or hold a repeat are ranked here.

1. Positions. The 64-byte strings of a text are hashed by doubling (1, 2, 4 ... 64 bytes).
   A position is kept if its hash is the least of all that begin in some window of 200
   bytes. Every window of 200 bytes holds such a position, about one in 70 bytes is one,
   and equal windows hold theirs at the same place.
2. First rank: the hash of the 64 bytes. A rank that occurs once is dropped.
3. Longer rank: the hash of all bytes that any window around the position can hold, 136
   before it to 200 after its start. Positions whose longer rank occurs again are repeats
   throughout. Whole copies end here.
4. Positions of which only the first rank recurs are compared at offsets in between: a
   window around a position begins 0 to 136 bytes before it. The offsets are ranked in
   blocks by the bytes that all windows of the block share, and blocks whose rank is unique
   are dropped; within the others the ranks of all windows of 200 bytes are compared.
5. The repeated stretches of each document are merged and cut out.

Ranks are 64-bit hashes; positions are sorted by them. Spark sorts and counts; nothing but
hashes, places and, for step 4, the bytes around a position is shuffled, apart from the
texts, which are shuffled compressed, twice. A rank shared by many positions is counted
by partial sums, and its positions are salted when joined; a block shared by more than
``HOT`` positions is not compared in one task, but its windows are counted by partial sums.

Defined cases: a null or empty text has no bytes; matches never cross documents; every row
counts as a document of its own, so rows that repeat id and text lose all they share; a
null id is joined like a value; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, table, written
from recordlink.operators.ordering import HOT_PARTS

LENGTH = 200
SEED = 64
REACH = LENGTH - SEED
BLOCKS = 3
BLOCK = -(-(REACH + 1) // BLOCKS)
# Texts are read in stretches, so that the arrays stay small however long a text is.
STRETCH = 1 << 17
# Bytes of text that are scanned one after the other, without an array of their own each.
TOGETHER = 1 << 20
# Rows of a block from which it is counted by the cluster instead of within a task.
HOT = 50_000
CHUNK = 20_000
SALTS = 64

_DRAW = np.random.default_rng(64_200)
_BYTES = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = ["doc_id", "text_hash", "pos"]
_PLACE_TYPE = "doc_id long, text_hash int, pos int"


def _doubled(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of strings twice as long, from pairs of ranks at ``offset``."""
    x = ranks[:-offset] * _A
    x ^= x >> np.uint64(32)
    x += ranks[offset:]
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def _running(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = best(values[: len(values) - (width - done)], values[width - done :])
    return values


def _positions_of_stretch(
    data: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions of neighbouring texts that end at ``ends``, and the ranks of all positions."""
    ranks = _BYTES[data]
    offset = 1
    while offset < SEED:
        ranks = _doubled(ranks, offset)
        offset *= 2
    width = REACH + 1
    least = _running(ranks, width, np.minimum)
    # no window reaches into the next text
    for end in ends.tolist():
        least[max(0, end - LENGTH + 1) : end] = 0
    # a position is kept if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    greatest = _running(padded, width, np.maximum)
    return np.nonzero(greatest == ranks)[0], ranks


def _longer(
    ranks: np.ndarray, kept: np.ndarray, first: np.ndarray, end: np.ndarray
) -> np.ndarray:
    """Rank of all bytes that windows around kept positions can hold, from ranks of ``SEED`` bytes.

    ``first`` and ``end`` bound these bytes. The ranks taken overlap at the end only and cover
    them; where they lie is part of the rank, so equal ranks stand for equal bytes and places.
    """
    x = (kept - first).astype(np.uint64) * _B + (end - kept).astype(np.uint64)
    last = end - SEED
    for step in range(-REACH, LENGTH, SEED):
        at = np.clip(kept + step, first, last)
        x = (x ^ ranks[at]) * _A
        x ^= x >> np.uint64(32)
        x *= _B
        x ^= x >> np.uint64(29)
    return x


def positions(data: bytes, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions of texts that follow each other, their first and their longer ranks.

    ``ends`` are the ends of the texts in ``data``, one text if not given.
    """
    n = len(data)
    ends = np.array([n]) if ends is None else ends
    margin = 2 * LENGTH
    places, firsts, longers = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for at in range(0, n, STRETCH):
        begin, stop = max(0, at - margin), min(n, at + STRETCH + margin)
        if stop - begin < LENGTH:
            begin = max(0, stop - LENGTH)
        if stop - begin < LENGTH:
            break
        inside = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, stop, "right")]
        kept, ranks = _positions_of_stretch(np.frombuffer(data, np.uint8, stop - begin, begin), inside - begin)
        place = kept + begin
        own = (place >= at) & (place < at + STRETCH)
        kept, place = kept[own], place[own]
        text = np.searchsorted(ends, place, "right")
        start_of = np.where(text > 0, ends[text - 1], 0)
        first = np.maximum(place - REACH, start_of) - begin
        end = np.minimum(place + LENGTH, ends[text]) - begin
        places.append(place)
        firsts.append(ranks[kept])
        longers.append(_longer(ranks, kept, first, end))
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(longers)


def _text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def ranked_positions(docs: DataFrame) -> DataFrame:
    """Kept positions with their first (64 bytes) and longer rank (all within reach)."""

    def some(texts: list[bytes], doc_ids: list, hashes: list) -> pd.DataFrame:
        ends = np.cumsum([len(t) for t in texts])
        places, ranks, longer = positions(b"".join(texts), ends)
        text = np.searchsorted(ends, places, "right")
        before = places - np.where(text > 0, ends[text - 1], 0)
        return pd.DataFrame(
            {
                "rank": ranks.view(np.int64),
                "longer": longer.view(np.int64),
                "doc_id": pd.array(doc_ids, dtype="Int64").take(text),
                "text_hash": np.array(hashes, dtype=np.int32)[text],
                "pos": before.astype(np.int32),
                "before": np.minimum(before, REACH).astype(np.int16),
                "after": np.minimum(ends[text] - places, LENGTH).astype(np.int16),
            }
        )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            waiting: list[tuple] = []
            held = 0
            for doc_id, text, text_hash in zip(batch["doc_id"], batch["text"], batch["text_hash"]):
                data = _text_bytes(text)
                if len(data) < LENGTH:
                    continue
                waiting.append((data, None if pd.isna(doc_id) else int(doc_id), text_hash))
                held += len(data)
                if held >= TOGETHER:
                    yield some(*map(list, zip(*waiting)))
                    waiting, held = [], 0
            if waiting:
                yield some(*map(list, zip(*waiting)))

    schema = f"rank long, longer long, {_PLACE_TYPE}, before short, after short"
    return docs.mapInPandas(scan, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text's bytes compressed, which is what is shuffled."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.map(lambda t: compressor.compress(_text_bytes(t)))

    return docs.select("doc_id", "text_hash", pack("text").alias("packed"))


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _blocks_of(data: bytes, rank: int, pos: int) -> Iterator[tuple]:
    """Of each block of offsets: its rank and the bytes in which its windows may differ."""
    left, right = data[max(0, pos - REACH) : pos], data[pos + SEED : pos + LENGTH]
    for block in range(BLOCKS):
        low, high = block * BLOCK, min(block * BLOCK + BLOCK - 1, REACH)
        if low > len(left) or REACH - high > len(right):
            continue
        shared = left[len(left) - low :] + right[: REACH - high]
        key = xxhash.xxh3_64_intdigest(shared, (rank + block) & ((1 << 64) - 1))
        more_left = left[max(0, len(left) - high) : len(left) - low][::-1]
        more_right = right[REACH - high : REACH - low]
        yield key - (1 << 63), low, more_left, more_right


def _ranked_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks of the ``wanted`` positions (place and ``rank``), read from the texts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["block", *_PLACE, "low", "more_left", "more_right"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text_hash, packed, places in zip(
                batch["doc_id"], batch["text_hash"], batch["packed"], batch["places"]
            ):
                data = _unpacked(packed)
                for place in places:
                    pos = place["pos"]
                    for key, low, left, right in _blocks_of(data, place["rank"], pos):
                        rows.append((key, doc_id, text_hash, pos, low, left, right))
                if len(rows) > CHUNK:
                    yield _frame(rows, columns)
                    rows = []
            yield _frame(rows, columns)

    # at most one position per byte of one document
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "rank")).alias("places"))
    joined = _join_docs(_packed(docs), lists, "inner").select("doc_id", "text_hash", "packed", "places")
    schema = f"block long, {_PLACE_TYPE}, low int, more_left binary, more_right binary"
    return joined.mapInPandas(read, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _join_docs(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Join by document; null ids match each other."""
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.col("d.text_hash") == F.col("f.text_hash")
    )
    added = [F.col(f"f.{c}") for c in facts.columns if c not in ("doc_id", "text_hash")]
    return docs.alias("d").join(facts.alias("f"), same, how).select("d.*", *added)


def _prefix_ranks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all prefixes of each string, and the strings' lengths."""
    sizes = np.array([len(s) for s in strings])
    data = np.zeros((len(strings), BLOCK), dtype=np.uint8)
    filled = np.arange(BLOCK) < sizes[:, None]
    data[filled] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    ranks = np.zeros((len(strings), BLOCK + 1), dtype=np.uint64)
    for i in range(BLOCK):
        x = (ranks[:, i] ^ _BYTES[data[:, i]]) * _A
        ranks[:, i + 1] = x ^ (x >> np.uint64(31))
    return ranks, sizes


def _window_ranks(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each window of each row's block by offset, and which windows exist."""
    left, left_size = _prefix_ranks(rows["more_left"].tolist())
    right, right_size = _prefix_ranks(rows["more_right"].tolist())
    low = rows["low"].to_numpy()
    width = np.minimum(low + BLOCK - 1, REACH) - low
    step = np.arange(BLOCK)
    other = width[:, None] - step
    exists = (other >= 0) & (step <= left_size[:, None]) & (other <= right_size[:, None])
    taken = np.take_along_axis(right, np.clip(other, 0, BLOCK), axis=1)
    block = rows["block"].to_numpy().view(np.uint64)[:, None]
    x = (left[:, :BLOCK] * _B + taken) * _A
    x ^= x >> np.uint64(32)
    x = (x + block + step.astype(np.uint64)) * _B
    return x ^ (x >> np.uint64(29)), exists


def _repeats_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last byte of repeats, from whole blocks (sorted by block)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ranks, exists = _window_ranks(rows)
        flat = ranks[exists]
        values, first, n = np.unique(flat, return_inverse=True, return_counts=True)
        again = np.zeros(ranks.shape, dtype=bool)
        again[exists] = n[first] > 1
        # neighbouring offsets as one stretch
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        most = rows["low"].to_numpy()[row] + end - 1
        least = rows["low"].to_numpy()[row] + begin
        found = rows.iloc[row][_PLACE].reset_index(drop=True)
        found["first"] = found["pos"].to_numpy() - most
        found["end"] = found["pos"].to_numpy() - least + LENGTH
        return found[["doc_id", "text_hash", "first", "end"]]

    waiting: list[pd.DataFrame] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += len(batch)
        if held < CHUNK:
            continue
        rows = pd.concat(waiting)
        block = rows["block"].to_numpy()
        whole = int(np.searchsorted(block, block[-1], "left"))
        if whole:
            yield solve(rows.iloc[:whole])
        waiting, held = [rows.iloc[whole:]], len(rows) - whole
    rows = pd.concat(waiting) if waiting else None
    if rows is not None and len(rows):
        yield solve(rows)


def _windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of hot blocks, as rank and place."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            rows = batch.iloc[at : at + 1000]
            ranks, exists = _window_ranks(rows)
            row, step = np.nonzero(exists)
            found = rows.iloc[row][["doc_id", "text_hash"]].reset_index(drop=True)
            found["first"] = (rows["pos"].to_numpy()[row] - rows["low"].to_numpy()[row] - step).astype(np.int32)
            found["window"] = ranks[row, step].view(np.int64)
            yield found


def _repeats(blocks: DataFrame) -> DataFrame:
    """Repeated stretches around positions of which only the first rank recurs."""
    stretch = "doc_id long, text_hash int, first int, end int"
    counts = blocks.groupBy("block").count()
    # fewer than rows / HOT blocks
    hot = written(counts.where(F.col("count") > HOT).select("block"), "hot-blocks")
    if not hot.limit(1).count():
        cold, in_hot = blocks, None
    else:
        cold = blocks.join(hot, "block", "left_anti")
        windows = blocks.join(hot, "block", "left_semi").mapInPandas(
            _windows_of, "doc_id long, text_hash int, first int, window long"
        )
        windows = written(windows, "hot-windows")
        again = windows.groupBy("window").count().where("count > 1").select("window")
        in_hot = windows.join(again, "window", "left_semi").select(
            "doc_id", "text_hash", "first", (F.col("first") + LENGTH).alias("end")
        )
    in_task = cold.repartition("block").sortWithinPartitions("block").mapInPandas(_repeats_in_task, stretch)
    return in_task if in_hot is None else in_task.unionByName(in_hot)


def _join_ranks(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``facts`` (keys, their number ``n`` of rows, and more), with the rest.

    Rows of a key that holds more than 1 / ``HOT_PARTS`` of all, of which there are fewer than
    ``HOT_PARTS``, are dealt over ``SALTS`` parts. ``rows`` are read once, ``facts``, a written
    table, several times.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(total / HOT_PARTS, SALTS)
    hot = F.broadcast(facts.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64("pos", "doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = facts.withColumn("_salt", F.explode(salts)).drop("n")
    return salted.join(copies, [*keys, "_salt"]).drop("_salt", "_hot")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, first, end`` of stretches of repeated strings; they overlap."""
    again = (
        ranked_positions(docs)
        .groupBy("rank")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.min("longer") != F.max("longer")).alias("differs"),
        )
        .where("n > 1")
    )
    # the scan is cheaper to repeat than all its rows are to keep
    shared = written(_join_ranks(ranked_positions(docs), written(again, "ranks"), ["rank"]), "positions")
    classes = shared.groupBy("rank", "longer").agg(
        F.count(F.lit(1)).alias("n"), F.first("differs").alias("differs"), F.min(F.struct(*_PLACE)).alias("place")
    )
    classes = written(classes, "classes")
    copies = classes.where("n > 1").select("rank", "longer", "n")
    throughout = _join_ranks(shared, copies, ["rank", "longer"]).select(
        "doc_id",
        "text_hash",
        (F.col("pos") - F.col("before")).alias("first"),
        (F.col("pos") + F.col("after")).alias("end"),
    )
    wanted = classes.where("differs").select("rank", "place.*")
    blocks = written(_ranked_blocks(docs, wanted), "blocks")
    found = throughout.unionByName(_repeats(blocks))
    return found.where(F.col("end") - F.col("first") >= LENGTH)


def _merged(stretches: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in stretches):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every document's remaining bytes: ``doc_id, n_bytes, n_removed, n_spans, spans, kept``.

    ``spans`` are the maximal removed runs (first byte, end), ``kept`` the other bytes.
    """
    source = only(docs, "doc_id", "text").withColumn("text_hash", F.hash("text"))
    stretches = repeated_stretches(source).distinct()
    # stretches of one document only
    lists = stretches.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first", "end")).alias("stretches")
    )
    joined = _join_docs(_packed(source), lists, "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
        for batch in batches:
            rows = []
            for doc_id, packed, found in zip(batch["doc_id"], batch["packed"], batch["stretches"]):
                data = _unpacked(packed)
                runs = _merged(found) if found is not None else []
                starts, ends = [0, *[b for _, b in runs]], [*[a for a, _ in runs], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(starts, ends))
                spans = [{"first": a, "end": b} for a, b in runs]
                rows.append((doc_id, len(data), len(data) - len(kept), len(runs), spans, kept))
            yield _frame(rows, columns)

    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<first:int,end:int>>, kept binary"
    )
    return joined.mapInPandas(cut, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same digests from every string of every text, for tests."""
    seen: dict[bytes, int] = {}
    for text in texts:
        data = _text_bytes(text)
        for i in range(len(data) - LENGTH + 1):
            key = data[i : i + LENGTH]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for text in texts:
        data = _text_bytes(text)
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if seen[data[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
