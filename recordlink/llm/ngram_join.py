"""Jaccard join of word n-gram sets by vertical partitioning.

1. Texts become sets of shingles. How frequent each is, is counted over all documents in
   ``COUNTERS`` counters that shingles share by hash. Counters in the order of their sums,
   rarest first, and shingles of a counter by hash, are the global order. It is cut into
   ``FRAGMENTS`` of equal total frequency. What the driver holds is the counters.
2. Texts with equal sets are one class from here on, so exact copies are one row. Two sets
   whose similarity reaches the threshold share one of the rarest shingles of each (the
   prefix filter), so classes meet under those; what very many texts hold stands last in
   the order and brings nobody together. Under each shingle the class that meets most
   others is the hub; a hub with all that it meets is a cluster. Any two classes that share
   a rare shingle share a cluster. Each row goes to its cluster; no pair is written down.
3. Sets are held against each other fragment by fragment: a fragment's partial overlaps are
   counted by themselves and added up per pair, and a pair goes as soon as the fragments
   left cannot bring it to the threshold. The prefixes come first, alone; only classes that
   are in a possible pair after them bring their whole sets, which are then read in
   ``FRAGMENTS``. Each time every member meets its hub, in blocks of bounded size. Members
   linked to the hub need not meet each other, for they are in one component; only members
   that are not meet all others, in cells of two blocks. Every sum is exact.
4. Connected components of the links are the groups. A cell returns a star per component.

Work is linear in a group of copies as far as they are linked to their hub; members that
are not cost their number times the size of the cluster.

Shingles are compared by 64-bit hashes. Defined cases: a text with fewer words than a
shingle is one shingle of all its words; a null or empty text, or one of white space, has
an empty set, is linked with nothing and is its own component; rows with a null id are
linked like others, they are bridges but never name a component (null only if no row of it
has an id); rows that repeat an id are documents of their own; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from copy import copy

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.clusters import groups_of, hub_clusters, shared_buckets
from recordlink.llm.common import LOWER, UPPER, only, table, written
from recordlink.llm.components import components
from recordlink.llm.shingles import shingle_set, shingles_of_texts
from recordlink.operators.ordering import join_group_facts
from recordlink.session import is_small

COUNTERS = 1 << 21
FRAGMENTS = 8
# Counters of one row, and shingles that a task gathers before it counts.
PART = 4096
GATHERED = 1_000_000
# Classes and shingles of a block.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 1_000_000
# Pairs that are listed to be counted; beyond, shingles are columns of matrices.
LISTED = 4_000_000
COLUMNS = 4096


def shingle_frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each counter occur in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        waiting, n = [], 0
        for batch in batches:
            for found in shingles_of_texts(batch["text"], words):
                waiting.append((found & np.uint64(COUNTERS - 1)).astype(np.int32))
                n += len(found)
                if n >= GATHERED:
                    total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        for part, counts in enumerate(total.reshape(-1, PART)):
            if counts.any():
                yield pd.DataFrame({"part": [part], "counts": [counts.tobytes()]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"]):
                here = np.frombuffer(counts, dtype=np.int64)
                totals[part] = totals[part] + here if part in totals else here
        yield pd.DataFrame({"part": list(totals), "counts": [t.tobytes() for t in totals.values()]})

    schema = "part int, counts binary"
    counted = only(docs, "text").mapInPandas(count, schema).repartition("part")
    total = np.zeros((COUNTERS // PART, PART), dtype=np.int64)
    for row in counted.mapInPandas(add_up, schema).toLocalIterator():
        total[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return total.reshape(-1)


class GlobalOrder:
    """Shingles by the rank of their counter, then by hash; cut into fragments."""

    def __init__(self, frequencies: np.ndarray, fragments: int = FRAGMENTS) -> None:
        order = np.argsort(frequencies, kind="stable")
        self.rank = np.empty(COUNTERS, dtype=np.uint32)
        self.rank[order] = np.arange(COUNTERS, dtype=np.uint32)
        sums = np.cumsum(frequencies[order])
        shares = sums[-1] * np.arange(1, fragments) / fragments
        # the last rank of each fragment but the last
        self.cuts = np.searchsorted(sums, shares).astype(np.uint32)
        # ranks up to here are of counters with a single occurrence
        self.alone = int(np.searchsorted(frequencies[order], 1, "right"))

    def sorted(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles in global order, and their ranks."""
        ranks = self.rank[shingles & np.uint64(COUNTERS - 1)]
        order = np.lexsort((shingles, ranks))
        return shingles[order], ranks[order]

    def place(self, shingle: np.uint64, rank: np.uint32) -> int:
        """A number that no later shingle falls below."""
        return (int(rank) << 42) | (int(shingle) >> 22)

    def ends(self, ranks: np.ndarray) -> np.ndarray:
        """Where each fragment of an ordered set ends."""
        return np.append(np.searchsorted(ranks, self.cuts, "right"), len(ranks)).astype("<i4")


def prefix_length(n: int, percent: int) -> int:
    """Of n shingles, the rarest of which one at least is shared with any similar set."""
    return n + (-percent * n // 100) + 1


def sketched(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``set_key`` (hash of the set) and its prefix.

    ``rare`` are the shingles of the prefix but those that occur once, ``last`` the place
    where the prefix ends in the global order.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for found in shingles_of_texts(batch["text"], words):
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                found, ranks = order.value.sorted(np.unique(found))
                n = prefix_length(len(found), percent)
                key = xxhash.xxh3_128_digest(found.tobytes())
                rare = found[:n][ranks[:n] >= order.value.alone].tobytes()
                rows.append((len(found), key, rare, order.value.place(found[n - 1], ranks[n - 1])))
            frame = pd.DataFrame(rows, columns=["n_shingles", "set_key", "rare", "last"])
            frame["last"] = frame["last"].astype("Int64")
            yield frame.assign(doc_id=batch["doc_id"], text_hash=batch["text_hash"])

    schema = "doc_id string, text_hash long, n_shingles long, set_key binary, rare binary, last long"
    rows = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("string"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")
    )
    return rows.mapInPandas(sketch, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def buckets_of(classes: DataFrame) -> DataFrame:
    """``node`` and ``bucket`` for each shingle of the prefix."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(r) // 8 for r in batch["rare"]]
            rare = np.frombuffer(b"".join(batch["rare"]), dtype=np.int64)
            yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), n), "bucket": rare})

    return classes.select("node", "rare").mapInPandas(unpack, "node long, bucket long")


def ordered_sets(docs: DataFrame, classes: DataFrame, words: int, order) -> DataFrame:
    """``node``, ``shingles`` in global order and ``ends`` of the fragments, of each class."""

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, key, text in zip(batch["node"], batch["of"], batch["text"]):
                found, ranks = order.value.sorted(shingle_set(text, words))
                # another row with the id and the hash of the text
                if xxhash.xxh3_128_digest(found.tobytes()) == key:
                    rows.append((node, found.tobytes(), order.value.ends(ranks).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles", "ends"])

    # one row of each class, found by its id, which may be missing, and the hash of its text
    wanted = classes.select("node", F.col("set_key").alias("of"), "row.doc_id", "row.text_hash")
    source = only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    same = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.text_hash") == F.col("w.text_hash"))
    # a small side spares sending all texts
    few = F.broadcast(wanted) if is_small(wanted) else wanted
    found = source.alias("s").join(few.alias("w"), same).select("node", "of", "text")
    found = found.mapInPandas(whole_sets, "node long, shingles binary, ends binary")
    # rows that repeat id and text bring the same set
    return written(found, "sets").dropDuplicates(["node"])


class Sets:
    """Some ordered sets, read fragment by fragment."""

    def __init__(self, rows: Mapping[str, np.ndarray]) -> None:
        self.all = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        self.ends = np.stack([np.frombuffer(e, dtype="<i4") for e in rows["ends"]]).astype(np.int64)
        self.sizes = self.ends[:, -1]

    def of(self, places: np.ndarray) -> Sets:
        some = copy(self)
        some.all = [self.all[i] for i in places]
        some.ends, some.sizes = self.ends[places], self.sizes[places]
        return some

    def fragment(self, f: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of fragment ``f`` of the chosen sets, and whose (place among the chosen)."""
        begin = self.ends[chosen, f - 1] if f else np.zeros(len(chosen), dtype=np.int64)
        end = self.ends[chosen, f]
        parts = [self.all[i][a:b] for i, a, b in zip(chosen, begin, end)]
        return np.concatenate(parts), np.repeat(np.arange(len(chosen)), end - begin)


class Prefixes:
    """The rarest shingles of some sets: one fragment, which each set ends at a place of its own."""

    def __init__(self, rows: Mapping[str, np.ndarray]) -> None:
        self.all = list(rows["shared"])
        self.sizes, self.last = rows["n_shingles"].astype(np.int64), rows["last"].astype(np.int64)

    def of(self, places: np.ndarray) -> Prefixes:
        some = copy(self)
        some.all = [self.all[i] for i in places]
        some.sizes, some.last = self.sizes[places], self.last[places]
        return some

    def fragment(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.all), np.repeat(np.arange(len(self.all)), [len(s) for s in self.all])


def _partial_overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape) -> np.ndarray:
    """How many shingles of one fragment each pair shares."""
    columns, at_a = np.unique(a[0], return_inverse=True)
    at_b = np.minimum(np.searchsorted(columns, b[0]), len(columns) - 1)
    shared = columns[at_b] == b[0] if len(columns) else np.zeros(len(b[0]), dtype=bool)
    at_b, of_b = at_b[shared], b[1][shared]
    held, at_b = np.unique(at_b, return_inverse=True)
    if not len(held):
        return np.zeros(shape, dtype=np.int32)
    new = np.full(len(columns), -1)
    new[held] = np.arange(len(held))
    at_a = new[at_a]
    at_a, of_a = at_a[at_a >= 0], a[1][at_a >= 0]
    n_b = np.bincount(at_b, minlength=len(held))
    if n_b[at_a].sum() <= LISTED:
        order = np.argsort(at_b, kind="stable")
        n = n_b[at_a]
        ends = np.cumsum(n)
        first = (np.cumsum(n_b) - n_b)[at_a]
        partner = of_b[order][np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        pairs = np.repeat(of_a, n) * shape[1] + partner
        return np.bincount(pairs, minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)
    total = np.zeros(shape, dtype=np.float32)
    for low in range(0, len(held), COLUMNS):
        in_a, in_b = (at_a >= low) & (at_a < low + COLUMNS), (at_b >= low) & (at_b < low + COLUMNS)
        left, right = np.zeros((shape[0], COLUMNS), np.float32), np.zeros((shape[1], COLUMNS), np.float32)
        left[of_a[in_a], at_a[in_a] - low] = 1
        right[of_b[in_b], at_b[in_b] - low] = 1
        total += left @ right.T
    return total.astype(np.int32)


def similar_pairs(a: Sets, b: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the pairs with 100 * intersection >= percent * union."""
    in_a, in_b = np.arange(len(a.sizes)), np.arange(len(b.sizes))
    overlap = np.zeros((len(in_a), len(in_b)), dtype=np.int64)
    for f in range(a.ends.shape[1]):
        overlap += _partial_overlaps(a.fragment(f, in_a), b.fragment(f, in_b), overlap.shape)
        left_a, left_b = a.sizes[in_a] - a.ends[in_a, f], b.sizes[in_b] - b.ends[in_b, f]
        most = overlap + np.minimum(left_a[:, None], left_b[None, :])
        # intersection / union >= t is the same as (1 + t) * intersection >= t * (both sizes)
        possible = (100 + percent) * most >= percent * (a.sizes[in_a][:, None] + b.sizes[in_b][None, :])
        rows, columns = possible.any(axis=1), possible.any(axis=0)
        if not rows.any():
            return in_a[:0], in_b[:0]
        if not (rows.all() and columns.all()):
            in_a, in_b = in_a[rows], in_b[columns]
            overlap, possible = overlap[np.ix_(rows, columns)], possible[np.ix_(rows, columns)]
    i, j = np.nonzero(possible)
    return in_a[i], in_b[j]


def possible_pairs(a: Prefixes, b: Prefixes, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may be similar as far as the first fragment tells.

    Where the prefix of one set ends first, all that it shares with the other up to there is
    in both prefixes, and what follows is at most the rest of the set.
    """
    overlap = _partial_overlaps(a.fragment(), b.fragment(), (len(a.sizes), len(b.sizes))).astype(np.int64)
    rest_a = (a.sizes - prefix_length(a.sizes, percent))[:, None]
    rest_b = (b.sizes - prefix_length(b.sizes, percent))[None, :]
    first = np.sign(a.last[:, None] - b.last[None, :])
    rest = np.where(first < 0, rest_a, np.where(first > 0, rest_b, np.maximum(rest_a, rest_b)))
    most = np.minimum(overlap + rest, np.minimum(a.sizes[:, None], b.sizes[None, :]))
    return np.nonzero((100 + percent) * most >= percent * (a.sizes[:, None] + b.sizes[None, :]))


def _held_against_hub(kind, pairs, percent: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, ("hub", "block")):
            node, hub = group["node"], group["hub"][0]
            centre, others = np.nonzero(node == hub)[0][:1], np.nonzero(node != hub)[0]
            if not len(others):
                continue
            sets = kind(group)
            meets = np.zeros(len(others), dtype=bool)
            meets[pairs(sets.of(centre), sets.of(others), percent)[1]] = True
            yield pd.DataFrame({"hub": np.full(len(others), hub), "node": node[others], "meets": meets})

    return compare


def _held_against_others(kind, pairs, percent: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in groups_of(batches, ("hub", "asking", "asked")):
            node, asks = cell["node"], cell["asks"].astype(bool)
            mine, theirs = np.nonzero(asks)[0], np.nonzero(~asks)[0]
            if not len(mine) or not len(theirs):
                continue
            sets = kind(cell)
            i, j = pairs(sets.of(mine), sets.of(theirs), percent)
            different = node[mine[i]] != node[theirs[j]]
            a, b = _star(node[mine[i[different]]], node[theirs[j[different]]])
            yield pd.DataFrame({"hub": np.full(len(a), cell["hub"][0]), "a": a, "b": b})

    return compare


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every linked node with the smallest node of its component among the given links."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[least]
        least = np.minimum(least, least[root])
        if (least == root).all():
            return nodes[root], nodes
        root = least


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """Per hub, how many blocks of bounded size its members fill."""
    by_size = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    by_number = F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)
    return members.groupBy("hub").agg(
        F.greatest(by_size, by_number, F.lit(1)).cast("int").alias(name), F.count(F.lit(1)).alias("_size")
    )


def _block(n: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def pairs_in_clusters(members: DataFrame, sets: DataFrame, kind, pairs, percent: int) -> DataFrame:
    """``hub``, ``a``, ``b``: pairs that connect what ``pairs`` finds within clusters.

    ``members``: hub, node, n_shingles; ``sets``: node and what ``kind`` reads. All members
    meet the hub. Who is in no pair with it meets all other members.
    """
    counts = written(_blocks(members, "_blocks"), "blocks")
    placed = join_group_facts(members, counts, ["hub"], "_size").where("node <> hub")
    rows = placed.select("hub", _block("_blocks").alias("block"), "node").unionByName(
        counts.select("hub", _every("_blocks").alias("block"), F.col("hub").alias("node"))
    )
    rows = rows.join(sets, "node").repartition("hub", "block").sortWithinPartitions("hub", "block")
    held = rows.mapInPandas(_held_against_hub(kind, pairs, percent), "hub long, node long, meets boolean")
    held = written(held, "held")
    found = held.where("meets").select("hub", F.col("hub").alias("a"), F.col("node").alias("b"))

    asking = held.where("NOT meets").join(members, ["hub", "node"]).select("hub", "node", "n_shingles")
    asked = _blocks(asking, "_asking").join(counts.select("hub", F.col("_blocks").alias("_asked")), "hub")
    asked = written(asked, "asked")
    mine = join_group_facts(asking, asked, ["hub"], "_size", "inner").select(
        "hub", _block("_asking").alias("asking"), _every("_asked").alias("asked"), "node", F.lit(True).alias("asks")
    )
    others = asked.drop("_size").join(counts.select("hub", "_size"), "hub")
    theirs = join_group_facts(members, others, ["hub"], "_size", "inner").where("node <> hub").select(
        "hub", _every("_asking").alias("asking"), _block("_asked").alias("asked"), "node", F.lit(False).alias("asks")
    )
    cell = ["hub", "asking", "asked"]
    cells = mine.unionByName(theirs).join(sets, "node").repartition(*cell).sortWithinPartitions(*cell)
    more = cells.mapInPandas(_held_against_others(kind, pairs, percent), "hub long, a long, b long")
    return found.unionByName(more)


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) of every document.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 are linked.
    """
    context = docs.sparkSession.sparkContext
    order = context.broadcast(GlobalOrder(shingle_frequencies(docs, words)))
    sketches = written(sketched(docs, words, percent, order), "sketches")
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("row"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("rare").alias("rare"),
            F.first("last").alias("last"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")
    sizes = classes.select("node", "n_shingles")
    shared = shared_buckets(buckets_of(classes))
    clusters = written(hub_clusters(shared), "clusters")
    members = written(clusters.join(sizes, "node"), "members")
    # what only one class has in its prefix is in no overlap of prefixes
    own = shared.groupBy("node").agg(F.collect_list("bucket").alias("shared"))
    prefixes = written(own.join(classes.select("node", "n_shingles", "last"), "node"), "prefixes")
    possible = pairs_in_clusters(members, prefixes, Prefixes, possible_pairs, percent)
    # a hub without a possible partner stays the centre of those that have one
    possible = written(possible, "possible")
    left = possible.select("hub", F.explode(F.array("hub", "a", "b")).alias("node")).distinct()
    left = written(left.join(sizes, "node"), "left")
    wanted = left.select("node").distinct().join(classes, "node")
    sets = ordered_sets(docs, wanted, words, order)
    links = pairs_in_clusters(left, sets, Sets, similar_pairs, percent).select("a", "b")
    roots = components(links)
    named = classes.join(roots, "node", "left").select(
        "set_key", "copies", "row.doc_id", F.coalesce("root", "node").alias("root")
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    facts = named.join(least, "root").select("set_key", "copies", "component_id")
    rows = sketches.select("doc_id", "n_shingles", "set_key")
    joined = join_group_facts(rows.where("set_key IS NOT NULL"), facts, ["set_key"], "copies")
    empty = rows.where("set_key IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return joined.select(*columns).unionByName(empty.select(*columns))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def groups_sql(words: int, percent: int, columns: str) -> str:
    """Groups of documents with similar sets, in plain SQL."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row_no, doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[]
    ELSE regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
sets AS (
  SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' '))) END AS s
  FROM worded),
held AS (SELECT row_no, len(s) AS n, unnest(s) AS f FROM sets),
links AS (
  SELECT a.row_no AS a, b.row_no AS b FROM held a JOIN held b ON a.f = b.f AND a.row_no <> b.row_no
  GROUP BY a.row_no, b.row_no, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached AS (
  SELECT row_no AS a, row_no AS b FROM sets
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS row_no, min(s.doc_id) AS component_id FROM reached r JOIN sets s ON s.row_no = r.b GROUP BY r.a)
SELECT {columns} FROM (SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least USING (row_no))
"""


OP13_SQL = groups_sql(4, 85, "doc_id, n_shingles, component_id")
