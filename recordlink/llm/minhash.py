"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Texts become sets of word shingles. Texts with equal sets are one class, so exact
   copies, however many, are one row from here on.
2. Each class has a MinHash signature. Classes that agree in a band share a bucket; the
   class that meets most others is the bucket's hub, and a hub with all classes of its
   buckets is a cluster. Any two classes that share a bucket share a cluster. Each row
   goes to its cluster; no pair is written down.
3. A large cluster is dealt into blocks, and pairs of blocks meet in cells of bounded size.
   In a cell signatures are compared in batches of 16: with m of n equal, a pair is given
   up once the posterior probability that its similarity reaches the threshold falls
   below ``MISS``. Classes that keep a partner stay.
4. The survivors' full sets meet in cells again. Members are held against the hub first;
   only those that are not linked to it are held against all others. A cell returns a
   spanning forest of its links, not all of them. Links are confirmed on the full sets.
5. Connected components of the links are the groups.

A pair is missed if it shares no bucket (similarity 0.85: 1 in 85,000; more alike: less)
or is given up (``MISS``). Work in cells grows with the square of the number of
*different* texts that share a bucket, rows sent with the square over the block size.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a
null or empty text has an empty set and is linked with nothing; rows with a null id are
linked like others, so they are bridges and get the component of their group, but they
never name one (the component is null if no row of the group has an id, and all its rows
are kept); rows that repeat an id are documents of their own; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, release_worker, table, written
from recordlink.llm.components import components
from recordlink.llm.shingles import shingles_of_texts
from recordlink.operators.ordering import join_group_facts

BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
# Classes of a block when signatures are compared, and shingles of one for full sets.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000

_SKETCH = ["n_shingles", "set_key", "bands", "signature"]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_607)
    a = draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


_A, _B = _permutations()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``HASHES`` hash functions over the set, as 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _A + _B
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``set_key`` (hash of the set), bands, signature."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_worker()
        for batch in batches:
            rows = []
            found = shingles_of_texts(batch["text"], words)
            for doc_id, text_hash, shingles in zip(batch["doc_id"], batch["text_hash"], found):
                shingles = np.unique(shingles)
                if not len(shingles):
                    rows.append((doc_id, text_hash, 0, None, None, None))
                    continue
                mark = signature(shingles)
                bands = [
                    xxhash.xxh3_64_intdigest(mark[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63)
                    for b in range(BANDS)
                ]
                whole = xxhash.xxh3_128_digest(shingles.tobytes())
                rows.append((doc_id, text_hash, len(shingles), whole, bands, mark.astype("<u2").tobytes()))
            frame = pd.DataFrame(rows, columns=["doc_id", "text_hash", *_SKETCH])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = (
        "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, signature binary"
    )
    rows = only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(sketch, schema)


@lru_cache
def least_equal(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the least number of equal hashes with which a pair goes on.

    With a uniform prior, m of n equal hashes leave Beta(m + 1, n - m + 1); that it reaches
    the threshold is as probable as at most m successes in n + 1 trials.
    """
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        least.append(m)
    return tuple(least)


def may_be_similar(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Whether each of ``a`` (rows of hashes) and ``b`` stay possible, batch after batch."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), dtype=np.int16)
    for i, needed in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int16)
        alive = alive[equal[alive] >= needed]
        if not len(alive):
            break
    possible = np.zeros(len(a), dtype=bool)
    possible[alive] = True
    return possible


def _cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each cell of a partition that is sorted by cell."""
    keys = ("hub", "low", "high")
    waiting: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        if len(waiting) == 1:
            return waiting[0]
        return {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}

    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        n = len(batch)
        if not n:
            continue
        differs = np.zeros(n - 1, dtype=bool)
        for k in keys:
            differs |= columns[k][1:] != columns[k][:-1]
        starts = [0, *(np.nonzero(differs)[0] + 1), n]
        for at, end in zip(starts, starts[1:]):
            part = {c: v[at:end] for c, v in columns.items()}
            if waiting and any(waiting[0][k][0] != part[k][0] for k in keys):
                yield whole()
                waiting = []
            waiting.append(part)
    if waiting:
        yield whole()


def _sides(cell: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of the two blocks of a cell, and whether they are one block."""
    low, high = cell["low"][0], cell["high"][0]
    return np.nonzero(cell["block"] == low)[0], np.nonzero(cell["block"] == high)[0], low == high


def _survivors(threshold: float):
    least = least_equal(threshold)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells_of(batches):
            node, hub = cell["node"], cell["hub"][0]
            marks = np.frombuffer(b"".join(cell["signature"]), dtype="<u2").reshape(len(node), -1)
            centre = int(np.nonzero(node == hub)[0][0])
            stays = may_be_similar(marks, np.broadcast_to(marks[centre], marks.shape), least)
            stays[centre] = stays.sum() > 1
            left, right, same = _sides(cell)
            # those given up against the hub may still have another partner
            for mine, theirs in ((left, right),) if same else ((left, right), (right, left)):
                for i in mine[~stays[mine]]:
                    if i == centre:
                        continue
                    others = theirs[theirs != i]
                    found = may_be_similar(np.broadcast_to(marks[i], (len(others), marks.shape[1])), marks[others], least)
                    if found.any():
                        stays[i] = True
                        stays[others[found]] = True
            kept = node[stays]
            yield pd.DataFrame({"hub": np.full(len(kept), hub), "node": kept})

    return prune


def _root(parents: list[int], i: int) -> int:
    while parents[i] != i:
        parents[i] = parents[parents[i]]
        i = parents[i]
    return i


def _confirmed(percent: int):
    """Links of a cell on full sets: 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells_of(batches):
            node, hub = cell["node"], cell["hub"][0]
            sets = [np.frombuffer(s, dtype="<u8") for s in cell["shingles"]]
            sizes = np.array([len(s) for s in sets])
            # who holds each shingle
            every = np.concatenate(sets)
            holder = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            values, holder = every[order], holder[order]

            def common(i: int) -> np.ndarray:
                first = np.searchsorted(values, sets[i], "left")
                n = np.searchsorted(values, sets[i], "right") - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                return np.bincount(holder[at], minlength=len(sets))

            def linked(i: int) -> np.ndarray:
                both = common(i)
                return np.nonzero(100 * both >= percent * (sizes + sizes[i] - both))[0]

            parents = list(range(len(sets)))
            links = []

            def link(i: int, j: int) -> None:
                a, b = _root(parents, i), _root(parents, j)
                if a != b:
                    parents[max(a, b)] = min(a, b)
                    links.append((min(node[i], node[j]), max(node[i], node[j])))

            centre = int(np.nonzero(node == hub)[0][0])
            for j in linked(centre):
                link(centre, int(j))
            left, right, same = _sides(cell)
            side = np.zeros(len(sets), dtype=np.int8)
            side[left] += 1
            side[right] += 2
            for i in range(len(sets)):
                if _root(parents, i) == _root(parents, centre):
                    continue
                for j in linked(i):
                    if same or side[i] != side[j]:
                        link(i, int(j))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return confirm


def _in_cells(members: DataFrame, weight: str, capacity: int, payloads: DataFrame) -> DataFrame:
    """Members of clusters with their payloads, sorted by cell within partitions.

    ``members``: hub, node and ``weight``; ``payloads``: node and what is compared. A
    cluster's blocks hold about ``capacity`` of weight each; the hub is sent to every cell
    of its cluster.
    """
    sizes = members.groupBy("hub").agg(
        F.sum(weight).alias("_weight"), F.count(F.lit(1)).alias("_size")
    )
    large = sizes.where(F.col("_weight") > capacity)
    placed = join_group_facts(members, large, ["hub"], "_size")
    blocks = F.greatest(F.ceil(F.coalesce("_weight", F.lit(1)) / capacity), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    placed = placed.withColumn("_blocks", blocks).withColumn("block", own)
    last = F.col("_blocks") - 1

    def cell(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    below = F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: cell(i, F.col("block")))
    above = F.transform(F.sequence(F.col("block"), last), lambda j: cell(F.col("block"), j))
    own_cells = F.concat(below, F.filter(above, lambda c: c["low"] < c["high"]))
    rows_of_cells = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: cell(i, j))
    )
    everywhere = F.flatten(rows_of_cells)
    cells = F.when(F.col("node") == F.col("hub"), everywhere).otherwise(own_cells)
    spread = placed.withColumn("_cell", F.explode(cells))
    spread = spread.select("hub", "_cell.low", "_cell.high", "block", "node").join(payloads, "node")
    return spread.repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high")


def _clusters(classes: DataFrame) -> DataFrame:
    """``hub`` and ``node``: a hub with every class that shares a bucket it is hub of."""
    buckets = classes.select("node", F.posexplode("bands").alias("band", "_hash"))
    buckets = buckets.select("node", F.xxhash64("band", "_hash").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(
        join_group_facts(buckets, sizes, ["bucket"], "size", "inner"), "buckets"
    )
    meets = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = shared.join(meets, "node")
    hubs = ranked.groupBy("bucket").agg(
        F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("_most"),
        F.max("size").alias("size"),
    )
    hubs = hubs.select("bucket", "size", (-F.col("_most.minus")).alias("hub"))
    return join_group_facts(shared.drop("size"), hubs, ["bucket"], "size").select("hub", "node").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept`` for every document.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 are linked; a component is named by its smallest id.
    """
    threshold = percent / 100
    source = only(docs, "doc_id", "text")
    sketches = written(sketched(docs, words), "sketches")
    # sets are equal, so are their bands and signatures
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("least_id"),
            # one row that has the set; its id may be missing
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("row"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")
    clusters = written(_clusters(classes).withColumn("_one", F.lit(1)), "clusters")
    cells = _in_cells(clusters, "_one", BLOCK_CLASSES, classes.select("node", "signature"))
    survivors = written(
        cells.mapInPandas(_survivors(threshold), "hub long, node long").distinct(), "survivors"
    )
    own = survivors.select("hub", F.col("hub").alias("node"))
    members = survivors.unionByName(own).distinct()
    members = written(members.join(classes.select("node", "n_shingles"), "node"), "members")

    # the full sets of the survivors, from one text of each class
    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            found = shingles_of_texts(batch["text"], words)
            for node, key, shingles in zip(batch["node"], batch["of"], found):
                whole = np.unique(shingles).tobytes()
                # an id that is repeated may bring another text of the same hash
                if xxhash.xxh3_128_digest(whole) == key:
                    rows.append((node, whole))
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    wanted = members.select("node").distinct().join(classes, "node")
    wanted = wanted.select("row.doc_id", "row.text_hash", "node", F.col("set_key").alias("of"))
    same = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.text_hash") == F.col("w.text_hash"))
    full = source.withColumn("text_hash", F.xxhash64("text")).alias("s").join(wanted.alias("w"), same)
    full = full.select("node", "of", "text").mapInPandas(full_sets, "node long, shingles binary")
    full = written(full, "sets").dropDuplicates(["node"])
    cells = _in_cells(members, "n_shingles", BLOCK_SHINGLES, full)
    links = cells.mapInPandas(_confirmed(percent), "a long, b long")
    roots = components(links)
    named = classes.join(roots, "node", "left").select(
        "set_key", "copies", "least_id", F.coalesce("root", "node").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = named.join(least, "root").select("set_key", "copies", "component_id")
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "set_key")
    joined = join_group_facts(rows.where("set_key IS NOT NULL"), facts, ["set_key"], "copies")
    empty = rows.where("set_key IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    answer = joined.select(*columns).unionByName(empty.select(*columns))
    return answer.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.drop("text_hash")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the smallest id stays, once."""
    kept = near_duplicates(docs).where("kept").select("doc_id", "text_hash").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), whole.alias("_doc"))
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    left = rows.alias("d").join(kept.alias("k"), same, "left_semi")
    return left.dropDuplicates(["doc_id", "text_hash"]).select("_doc.*")
