"""Lexical search, importance resampling and the n-gram join against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlink.llm import lexical_search, ngram_join, resampling, shingles

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_row", "_first", "rank", "score", "weight", "n", "m", "terms", "node", "hub", "bucket", "text_hash", "item", "size")


def documents(spark, rows):
    """Rows with every column of documents and some that clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("x") for c in CLASHES}).withColumn("a.b", F.lit(1)).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 11: lexical search


def plain_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(pattern.findall(lower(t)))) for i, t in docs if t]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if i is not None and t}:
        asked = pattern.findall(lower(text))
        found = []
        for doc_id, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in asked
                if t in c
            )
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 400)
    rng = random.Random(4)
    docs = [(i, prose(i, rng.choice([5, 20, 20, 20, 200]))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "... !"), (None, prose(3, 30)), (3, prose(77, 20)), (500, docs[7][1]), (499, docs[7][1])]
    docs += [(600, "É straße Ünï w1 W1 w-1"), (601, prose(5, 30_000))]
    items = [(i, prose(1000 + i, 12)) for i in range(20)] + [(30, docs[7][1]), (31, None), (32, "?!"), (None, "w1 w2")]
    items += [(33, "STRASSE straße É é"), (33, "w1 w1 w2"), (34, "nowhere"), (34, "nowhere"), (35, "w5"), (35, "w5")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "item", "doc_id")})
    got = lexical_search.search(documents(spark, docs), asked, 4).collect()
    assert sorted(map(tuple, got)) == plain_search(docs, items, 4)


def test_search_in_chunks_and_small_blocks(monkeypatch):
    """A task's answer does not depend on how its rows are cut."""
    rng = np.random.default_rng(0)
    queries = lexical_search.Queries([(0, 10, [b"a", b"b", b"a"]), (1, 11, [b"c"]), (2, 12, [b"b", b"d"])])
    weight = np.array([5, 9, 2, 30], dtype=np.int64)
    import pandas as pd

    rows = []
    for i, m in enumerate(np.sort(rng.integers(30, 34, 300))):
        terms = np.sort(rng.choice(4, rng.integers(1, 4), replace=False)).astype("<i4")
        rows.append((m, 1000 - i, terms.tobytes(), rng.integers(1, 5, len(terms)).astype("<i4").tobytes()))
    frame = pd.DataFrame(rows, columns=["m", "doc_id", "terms", "tfs"])
    answers = []
    for size, parts in ((1024, 1), (7, 1), (50, 6)):
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", size)
        monkeypatch.setattr(lexical_search, "BOUNDS", 3 * size)
        best = [lexical_search.Best(5) for _ in range(3)]
        for part in np.array_split(frame, parts):
            lexical_search._search_chunk([part], queries, weight, best)
        answers.append([(b.score.tolist(), b.ids.tolist()) for b in best])
    assert answers[0] == answers[1] == answers[2]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    docs = documents(spark, [(1, "a b")])
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(documents(spark, [(1, None), (2, "!")]), items).count() == 0


# 12: resampling


def plain_resampled(docs, target, percent=5, min_words=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = pattern.findall(lower(text or ""))
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]

    own, wanted = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in wanted for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    rows, keys = [], []
    for (doc_id, _), (n_words, f) in zip(docs, own):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n_words >= min_words:
                keys.append((-score, doc_id))
        rows.append((doc_id, len(f), weight, score))
    drawn = sorted(keys)[: len(keys) * percent // 100]
    ranks = {key: r for r, key in enumerate(drawn, 1)}
    return [(*r, None if r[3] is None else ranks.get((-r[3], r[0])) if r[1] >= 3 * min_words - 3 else None) for r in rows]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_equals_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(resampling, "PIVOTS", 3)
    monkeypatch.setattr(resampling, "STRETCH", 7)
    rng = random.Random(8)
    docs = [(i, prose(i, rng.randint(0, 60))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "É Straße-x " * 12), (None, prose(1, 40)), (903, "the same " * 30), (904, "the same " * 30)]
    target = [prose(2000, 80, 30), None, "the same É"]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = resampling.resampled(documents(spark, docs), items, percent)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert by_id(got.collect()) == by_id(plain_resampled(docs, target, percent))


def test_resampling_of_repeated_rows_and_nothing(spark):
    text = prose(1, 30)
    docs = documents(spark, [(1, text)] * 7 + [(2, text)] * 3)
    target = spark.createDataFrame([], "text string")
    got = resampling.resampled(docs, target, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert resampling.resampled(docs.limit(0), target).count() == 0
    assert {r["rank"] for r in resampling.resampled(docs, target, 5).collect()} == {None}


# 13: n-gram join


def plain_groups(rows, words, percent):
    sets = []
    for _, text in rows:
        found = lower(text or "")
        found = [w for w in re.split(r"[\x20\x09-\x0D]+", found) if w]
        n = min(words, len(found))
        sets.append({tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set())
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[of(j)] = of(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[of(i)] = min(least.get(of(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(of(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, n, length, edits):
    rng = random.Random(seed)
    base = prose(seed, length, 5000).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_groups_equal_brute_force(spark, monkeypatch, words, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1000)
    texts = near_copies(1, 30, 120, 5) + near_copies(2, 12, 40, 2) + near_copies(3, 8, 400, 12)
    common = prose(50, 60)
    texts += [prose(100 + i, 30, 9000) + " " + common for i in range(25)]
    texts += [None, "", " \t\n", "one", "ONE", "one two three", "one  two\tthree", "É é", texts[0].upper(), texts[0], prose(7, 8000, 400)]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    # ids that are missing or repeated
    rows = [(None if i % 17 == 3 else i, t) for i, t in rows] + [(2, "other text of its own"), (2, texts[0])]
    got = ngram_join.similar_groups(documents(spark, rows), words, percent).collect()
    assert by_id(got) == by_id(plain_groups(rows, words, percent))


def test_a_text_without_id_is_a_bridge(spark):
    words = [f"a{i}" for i in range(60)]
    left, right = ["x", "y", "z", *words[3:]], [*words[:-3], "p", "q", "r"]
    rows = [(1, " ".join(left)), (None, " ".join(words)), (3, " ".join(right))]
    want = plain_groups(rows, 1, 90)
    assert [r[2] for r in want] == [1, 1, 1]
    assert by_id(ngram_join.similar_groups(documents(spark, rows), 1, 90).collect()) == by_id(want)


def test_groups_of_nothing(spark):
    assert ngram_join.similar_groups(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert by_id(ngram_join.similar_groups(documents(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_overlaps_listed_or_by_matrices(monkeypatch):
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    b = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(5)]
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), list(map(len, s)))) for s in (a, b)]
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    assert ngram_join._partial_overlaps(*sides, (9, 5)).tolist() == want
    monkeypatch.setattr(ngram_join, "LISTED", 0)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    assert ngram_join._partial_overlaps(*sides, (9, 5)).tolist() == want


def test_shingles_do_not_depend_on_their_batch(monkeypatch):
    texts = [None, "", " a B\tc  d", "É x\ny Z", "\v", "x" * 500 + " " + "y" * 70, prose(1, 300)]
    for words in (1, 3, 4):
        alone = [next(shingles.shingles_of_texts([t], words)).tolist() for t in texts]
        for together in (1, 100, 10**6):
            monkeypatch.setattr(shingles, "TOGETHER", together)
            assert [f.tolist() for f in shingles.shingles_of_texts(texts, words)] == alone
        for t, found in zip(texts, alone):
            n = len((t or "").encode().split())
            assert len(found) == (max(1, n - words + 1) if n else 0)
    assert next(shingles.shingles_of_texts(["a b"], 3)).tolist() == next(shingles.shingles_of_texts([" A\nb "], 3)).tolist()
