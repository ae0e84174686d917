"""The training-data operators against brute force, and their defined odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordlink.llm import (
    decontaminate,
    html_text,
    language,
    line_dedup,
    minhash,
    packing,
    pii,
    substring_dedup,
    topk,
    url_reputation,
)
from recordlink.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    """Rows with every column of documents and some that clash with the operators' own."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).coalesce(2)


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in ("_text_hash", "score", "spans", "n_lines", "rank", "_doc", "text_hash")})


def rng_words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# 1: substrings


def digests(df):
    rows = substring_dedup.without_repeats(df).collect()
    return sorted(
        (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        for r in rows
    )


def test_substrings_equal_brute_force(spark):
    passage = " ".join(rng_words(1, 60))
    common = "licensed under the usual terms of the usual licence of this site, all of it. "
    texts = [None, "", "short", "é" * 150, "é" * 90 + "a" * 30]
    texts += [" ".join(rng_words(10 + i, 80)) + common + " ".join(rng_words(50 + i, 50)) for i in range(6)]
    texts += [" ".join(rng_words(100 + i, 40)) + passage[: 190 + 5 * i] + " ".join(rng_words(200 + i, 40)) for i in range(8)]
    texts += ["ab" * 400, "abc " * 100, texts[6], texts[6], texts[7][:199], texts[7][:200], texts[7][3:203]]
    # near copies with an edit here and there
    base = " ".join(rng_words(7, 150))
    for i in range(0, 800, 70):
        texts.append(base[:i] + "#" + base[i + 1 :])
    want = [(i, *d) for i, d in enumerate(substring_dedup.brute_force(texts))]
    assert digests(with_clashes(documents(spark, texts))) == want


def test_substrings_hot_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "STRETCH", 1000)
    base = " ".join(rng_words(3, 500))
    texts = [base[:i] + "##" + base[i + 2 :] for i in range(300, 2400, 90)] + [base * 3]
    want = [(i, *d) for i, d in enumerate(substring_dedup.brute_force(texts))]
    assert digests(documents(spark, texts)) == want


def test_substrings_stretches_do_not_change_positions(monkeypatch):
    data = (" ".join(rng_words(5, 2000)) + "xy" * 700).encode()
    whole = substring_dedup.positions(data)
    monkeypatch.setattr(substring_dedup, "STRETCH", 512)
    parts = substring_dedup.positions(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_substrings_texts_scanned_together_keep_their_positions():
    texts = [" ".join(rng_words(i, n)).encode() for i, n in enumerate((60, 300, 55, 2000, 70))]
    ends = np.cumsum([len(t) for t in texts])
    places, ranks, longer = substring_dedup.positions(b"".join(texts), ends)
    alone = [substring_dedup.positions(t) for t in texts]
    starts = ends - [len(t) for t in texts]
    assert (places == np.concatenate([a[0] + s for a, s in zip(alone, starts)])).all()
    assert (ranks == np.concatenate([a[1] for a in alone])).all()
    assert (longer == np.concatenate([a[2] for a in alone])).all()


def test_substrings_hot_ranks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PARTS", 1_000_000)
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    copy, passage = " ".join(rng_words(11, 120)), " ".join(rng_words(12, 70))
    texts = [copy] * 9 + [" ".join(rng_words(300 + i, 30)) + passage for i in range(8)] + [None, passage]
    want = [(i, *d) for i, d in enumerate(substring_dedup.brute_force(texts))]
    assert digests(documents(spark, texts)) == want


def test_substrings_repeated_rows_and_null_ids(spark):
    text = " ".join(rng_words(9, 100))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = substring_dedup.without_repeats(df).collect()
    assert [r["n_removed"] for r in rows] == [len(text)] * 3


# 2: urls


def test_url_parts_and_rules(spark):
    urls = {
        None: ("", "", None),
        "no scheme/x": ("", "", None),
        "http://EXAMPLE.com": ("example.com", "", None),
        "http://a.Example.com/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "http://x.net/fr/a": ("x.net", "/fr/a", "net/fr/"),
        "ftp://x.net/es": ("x.net", "/es", None),
        "http://h#a://b/c": ("h", "", None),
        "http://É.org?x/en/": ("É.org", "", None),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_reputation.judge_urls(pages, labels).collect()}
    assert got == dict(enumerate(urls.values()))


def test_url_reputation_shrinks_towards_domain(spark):
    pages, labels = [], []
    for i in range(600):
        host = f"h{i % 6}.bad.org" if i < 300 else f"h{i % 60}.good.org"
        pages.append((i, f"http://{host}/p"))
        if i % 2 or i < 240:
            labels.append((i, 0 if i < 300 else 1, 0))
    pages.append((1000, "http://new.bad.org/"))
    pages.append((1001, "http://new.good.org/"))
    found = url_reputation.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(labels + labels[:5] + [(None, None, None)], "doc_id long, quality int, toxic int"),
    )
    rows = {r["page_id"]: r for r in found.collect()}
    assert rows[0]["verdict"] == "block" and rows[400]["verdict"] == "allow"
    assert rows[1001]["verdict"] == "allow"
    assert rows[1000]["good_mean"] < rows[1001]["good_mean"]


# 3: language


def test_language_held_out_accuracy(spark, sf_dir):
    found = language.op3_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)


def test_signs_are_no_letters():
    assert language.words_of("½ ² ① Ⅷ 12 _") == []
    assert language.words_of("x²y É½a") == ["x", "y", "é", "a"]


def test_language_backs_off_and_odd_texts(spark):
    rows = [(1, "the house the mouse", "en"), (2, "das haus die maus", "de"), (3, "x", None), (4, None, "en")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("mousehouse")[0] == "en"
    assert model.predict("haus!")[0] == "de"
    assert model.predict(None) == ("und", 0.0) and model.predict("12 _ 3") == ("und", 0.0)
    asked = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "maus " * 50_000, "k")], "doc_id long, text string, score string")
    got = [r["lang_pred"] for r in language.identify(asked, model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "de"]


def test_language_counts_of_common_words_in_all_languages(spark):
    rows = [("aa", "shared " * 21 + "alpha " * 979), ("bb", "shared " * 19 + "beta " * 981)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    model = language.learn(labelled, min_share=0.02)
    assert model.languages == ["aa", "bb"]
    shared = np.exp(model.scores[model.words["shared"]])
    assert shared == pytest.approx([0.021, 0.019], rel=1e-3)
    # one word that both use does not outweigh others
    assert model.predict("shared shared shared beta")[0] == "bb"


def test_language_model_is_alike_at_every_size(spark):
    rows = [("aa", "one two two three three three"), ("bb", "un deux deux trois trois trois")]
    schema = "lang string, text string"
    small = language.learn(spark.createDataFrame(rows, schema))
    large = language.learn(spark.createDataFrame(rows * 200, schema))
    assert small.words == large.words and small.grams == large.grams
    assert np.allclose(small.scores, large.scores)


def test_language_without_labels(spark):
    model = language.learn(spark.createDataFrame([], "text string, lang string"))
    assert model.predict("words") == ("und", 0.0)


# 4: pages

ARTICLE = (
    "<article><header><h1>Title &amp; more</h1></header><p>First paragraph, long enough to count, "
    "with <a href=/x>a link</a> in it.<p>Second&nbsp;one\n is  here, and it goes on, and on.<br>After."
    "<ul><li>a point<li>another</ul></article>"
)
TEXT = (
    "Title & more First paragraph, long enough to count, with a link in it. "
    "Second one is here, and it goes on, and on. After. a point another"
)


@pytest.mark.parametrize(
    "before, after",
    [
        ("", ""),
        ("<nav><ul><li><a href=/>Home</a></ul></nav>", "<footer>&copy; someone, somewhere, some day, all of it</footer>"),
        ("<div class='cookie-notice'>We use cookies, many of them, on every page, always and ever.</div>", ""),
        ("<header><h1>Site</h1></header>", "<section id=comments><p>Nice article, really, a long and friendly comment.</p></section>"),
        ("<div id=sidebar><p>Popular, new, old, all of it, more than you would ever read.</p></div>", "<form><label>Mail</label><input></form>"),
        ("<script>var t='</p><p>not text, at all, never';</script><style>p{}</style>", "<div class=ad>Buy, buy, buy, it is the best thing in the world.</div>"),
        ("<!-- <p>a comment, in markup, that is long enough to count --> ", "<div class=related><a href=1>One</a><a href=2>Two</a></div>"),
    ],
)
def test_html_keeps_the_article(before, after):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{ARTICLE}{after}</body></html>"
    assert html_text.main_text(page) == TEXT


def test_html_without_article_element():
    body = "".join(f"<p>Paragraph {i}, with commas, and words enough to be seen as text.</p>" for i in range(4))
    page = f"<body><div class=menu><a href=1>x</a></div><div><h1>Head</h1><div class=post>{body}</div></div><div class=footer>f</div>"
    text = html_text.main_text(page)
    assert text.startswith("Head Paragraph 0,") and text.endswith("as text.") and "x" not in text.split()


def test_html_odd_pages(spark):
    deep = "<div>" * 20_000 + "<p>Deep text, deep enough to be found, at last." + "</div>" * 20_000
    pages = [None, "", "just words", "<p>cut off <a hre", "a < b &lt; c", deep, "<p>x</p>" * 50_000]
    df = spark.createDataFrame([(i, "u", p, "k") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = [r["text"] for r in html_text.extract_pages(df).orderBy("page_id").collect()]
    assert got[:6] == ["", "", "just words", "cut off", "a < b < c", "Deep text, deep enough to be found, at last."]
    assert got[6] == " ".join("x" * 50_000)


# 5: near copies


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    return [(len(s), c) for s, c in zip(sets, label)]


def near_texts():
    texts = [None, "", "  \n", "a", "A", "a b", "a b c", "a b c d"]
    for g in range(4):
        base = rng_words(g, 60 + 40 * g)
        for i in range(12):
            rng = random.Random(100 * g + i)
            copy = list(base)
            for _ in range(i // 2):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    # a chain in which only neighbours are alike
    chain = rng_words(77, 150)
    for i in range(0, 60, 6):
        texts.append(" ".join(chain[i : i + 90]))
    return texts + [texts[20], texts[20].upper()]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_copies_equal_brute_force(spark, monkeypatch, words, percent):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    texts = near_texts()
    rows = minhash.near_duplicates(with_clashes(documents(spark, texts)), words, percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute_components(texts, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_copies_odd_rows(spark):
    text = " ".join(rng_words(1, 30))
    rows = [(5, text), (5, text), (5, "other " + text[::-1]), (None, text), (None, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or 0, r["kept"]) for r in found) == [
        (False, 5, True), (False, 5, True), (False, 5, True), (True, 0, True), (True, 5, False),
    ]
    none = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == []


def test_near_copies_of_a_text_without_id(spark):
    centre = rng_words(32, 120, 10**6)
    copies = [" ".join([*centre[:i], "new", *centre[i + 1 :]]) for i in range(5, 115, 10)]
    # the text without id meets most others
    rows = [(None, " ".join(centre)), *enumerate(copies)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    # it links what is only similar through it
    assert got.pop(None)[1] == 0 and [got[i][1] for i in range(len(copies))] == [0] * len(copies)
    assert not [r for r in found if r["doc_id"] is None and r["kept"]]
    assert [r["doc_id"] for r in found if r["kept"] and r["doc_id"] is not None] == [0]


def test_near_copies_with_a_bridge_without_id(spark):
    words = rng_words(33, 100, 10**6)
    rows = [(1, " ".join(["x", "y", *words[2:]])), (None, " ".join(words)), (3, " ".join([*words[:-2], "p", "q"]))]
    for between in (rows[1], (2, rows[1][1])):
        df = spark.createDataFrame([rows[0], between, rows[2]], "doc_id long, text string")
        found = minhash.near_duplicates(df, words=1, percent=95).collect()
        assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in found) == sorted(
            [(1, 1, True), (between[0] or 0, 1, False), (3, 1, False)]
        )


def test_bayes_bounds_keep_similar_pairs():
    least = minhash.least_equal(0.85)
    assert list(least) == sorted(least) and all(m < n * 0.85 for m, n in zip(least, range(16, 145, 16)))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60_000, (4000, 144)).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.87, a, a + 1).astype("<u2")
    assert minhash.may_be_similar(a, b, least).mean() > 0.999
    far = np.where(rng.random(a.shape) < 0.4, a, a + 1).astype("<u2")
    assert not minhash.may_be_similar(a, far, least).any()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)]
    links = spark.createDataFrame(path + star + [(5000, 4999), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(51)}, 5000: 4999, 4999: 4999}


# 6: packing


def test_packing_places_every_piece(spark):
    rng = random.Random(4)
    texts = [None, "", " ".join(rng_words(1, 6000))] + [" ".join(rng_words(i, rng.randrange(1, 900))) for i in range(60)]
    df = with_clashes(documents(spark, texts)).withColumn("length", F.lit(1))
    pieces = packing.written(packing.tokenized_pieces(df, packing.tokenizer_path()), "pieces")
    packed = packing.pack(pieces)
    rows = packed.collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    bins = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(ids) == r["length"]
        assert r["start"] == 4096 * r["piece"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, whole.values()))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(map(len, whole.values())) // 4096) + 1
    for s in packing.packed_sequences(packed).collect():
        assert len(s["ids"]) == 4 * sum(p["length"] for p in s["parts"])


def test_packing_an_empty_table(spark):
    pieces = packing.tokenized_pieces(documents(spark, []), packing.tokenizer_path())
    assert packing.pack(packing.written(pieces, "pieces")).collect() == []


@given(st.lists(st.integers(1, 60), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_patterns_use_up_the_counts(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.best_two_fit(counts, 60)
    used = {}
    for p in patterns:
        assert 0 < sum(length * n for length, n in p.uses.items()) <= 60
        for length, n in p.uses.items():
            used[length] = used.get(length, 0) + n * p.times
    assert used == counts
    bins = sum(p.times for p in patterns)
    assert bins <= 1.25 * sum(lengths) / 60 + sum(n > 30 for n in lengths) + 1


def test_a_pair_replaces_the_smallest():
    # greedy leaves 6 + 3 with a gap of 1; 2 + 2 fill the gap of 4 without the 3
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0].uses == {6: 1, 2: 2}


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_tokens_by_word_are_those_of_the_text(text):
    words = packing._tokenizer(packing.tokenizer_path())
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids([text])[0], dtype="<u4").tolist() == want


def test_words_are_encoded_without_their_ends_and_capitals():
    words = packing.WordTokenizer(packing.tokenizer_path())
    encoded = []
    encode = words._encoded
    words._encoded = lambda text: encoded.append(text) or encode(text)
    text = "Word word word, WORD... word's it's' *** x<|endoftext|>! \u00c9t\u00e9? \u01c4a. \u0130a, \u03a3\u03c3. \u0149a; a\u0301b, \u1e9ba. it'S Abc' abc'"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids([text])[0], dtype="<u4").tolist() == want
    assert sum(t.lower().split("0").count("word") for t in encoded) == 1


def test_remembered_words_are_looked_up_and_not_walked_through():
    """A worker remembers up to a million words, and looks some up for every few documents."""

    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("walked through")

    words = packing.WordTokenizer(packing.tokenizer_path())
    once = words.ids(["one two three"])
    words.known, words.older = {}, Remembered(words.known)
    assert words.ids(["one two three"]) == once
    assert words.ids(["one four"]) == packing.WordTokenizer(packing.tokenizer_path()).ids(["one four"])
    assert {"one", "two", "three", "four"} <= words.known.keys()


def test_words_of_letters_are_remembered_by_their_cores():
    words = packing.WordTokenizer(packing.tokenizer_path())
    texts = ["Zuverge, zuverge. ZUVERGE!? Été été; don't zuvergé 7zu zu7 ", "zuverge Zuverge, ÉTÉ"]
    for text in [texts[0], *texts]:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids([text])[0], dtype="<u4").tolist() == want
    fresh = packing.WordTokenizer(packing.tokenizer_path())
    fresh.ids(texts[:1])
    assert "zuverge" in fresh.known and "Zuverge," not in fresh.known and "ZUVERGE!?" not in fresh.known
    assert fresh.ids(["a0b"]) == words.ids([" a0b "]) == [np.asarray(fresh.tokenizer.encode("a0b").ids, dtype="<u4").tobytes()]
    fresh.last[:] = False  # a vocabulary that does not tell where words end
    assert fresh.ids(["blentat rehaatnd"]) == words.ids(["blentat rehaatnd"])


def test_words_of_letters_are_cut_at_digits():
    """Words of letters need no marks with spaces around, which cost time; the ids stay the same."""
    words = packing.WordTokenizer(packing.tokenizer_path())
    marked = []
    encode = words._encoded
    words._encoded = lambda text: marked.append(text) or encode(text)
    text = "Reoush the THE s t don't 0 00 a0b word, ein\u00fctz \u0130a \x01 a\x01b  x\ty\nz"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids([text])[0], dtype="<u4").tolist() == want
    assert any("0" in t and t.replace("0", "").isalpha() for t in marked)


# 7: top k


def brute_top(rows, k):
    ready = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ready.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in {i: v for i, v in ready}.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ready if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01, 300.0])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.default_rng(int(scale))
    rows = [(i, (rng.normal(size=9) * scale).astype("f4").tolist()) for i in range(0, 700)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)]
    rows += [(2000, None), (2050, []), (2100, [None] * 9), (2150, [float("nan")] * 9), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=100, block_queries=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == brute_top(rows, 5)


def test_top_k_keeps_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(300)]
    # as candidates and as queries, far beyond a long with nothing to multiply it, and alike
    for i, x in [(7, 3e5), (50, -4e6), (51, 4e6), (100, 262144.0), (101, 5e8)]:
        rows[i][1][i % 6] = x
    rows += [(301, [0.0, 3e30, 0.0, 0.0]), (350, [1.0, 0.0, 2.0, 3.0]), (302, [2.0, 0.0, 1.0, 2.0])]
    rows += [(400 + i, rows[51][1]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=60, block_queries=4).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    assert got == brute_top(rows, 5) and {50, 100} <= {r[0] for r in got} and 301 in {r[2] for r in got}
    beyond = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit in a long"):
        topk.top_k(beyond, F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).collect() == []


# 8: lines


def test_lines_go_from_the_second_place_on(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    texts = [f"{a}\n{b}\nend", f"start\n {a} \n\n{b.replace(' ', '  ')}\n{c}", f"{a}\nother\n{b}", f"{a}\n{b}", None, ""]
    rows = line_dedup.dedup_lines(with_clashes(documents(spark, texts))).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [texts[0], f"start\n{c}", texts[2], "", None, ""]
    assert [(r["n_lines"], r["n_removed"], r["n_runs"]) for r in rows] == [
        (3, 0, 0), (5, 3, 1), (3, 0, 0), (2, 2, 1), (0, 0, 0), (1, 0, 0),
    ]


def test_lines_stage_keeps_columns_and_drops_what_is_empty(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = with_clashes(documents(spark, [line, line, f"{line}\nown", ""]))
    found = line_dedup.drop_repeated_lines(spark, docs, "").orderBy("doc_id")
    assert found.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["n_chars"], r["n_lines"]) for r in found.collect()] == [
        (0, line, len(line), "x"), (2, "own", 3, "x"), (3, "", 0, "x"),
    ]


def test_lines_of_repeated_rows_and_empty_tables(spark):
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


# 9: personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(d) for d in re.sub("[^0-9]", "", text)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(text):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    checks = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= n(m) <= 19 and luhn(m),
        "phone": lambda m: 9 <= n(m) <= 15,
    }
    found = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if checks[kind](m[0]):
                found.append((m.start(), no, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def pii_texts():
    rng = random.Random(2)
    parts = ["a@b.c", "x.y+z@mail-1.example.com.", "a@b.c_d@e.f", "@b.c", "1.2.3.4", "256.1.1.1", "01.002.0003.255", "1.2.3.4.5.6.7.8",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111", "+1 (555) 123-4567", "+49 30 1", "++123456789", "é", "漢", " ", "-", ".", "12", "\n", "+1234567890123456"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    return [*texts, None, "", "a" * 30_000 + "@" + "b." * 4000 + "c", "1" * 60_000, "1.2.3." * 3000, "+" + "1 " * 20_000, "a@b.c " * 500]


def test_base_spans_equal_the_plain_expressions(spark):
    texts = pii_texts()
    rows = pii.find_spans(with_clashes(documents(spark, texts))).orderBy("doc_id").collect()
    got = [[(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["base"]] for r in rows]
    assert got == [plain_spans(t) for t in texts]


def test_checksums_and_context(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013000", "DE88370400440532013000",
        "ssn: 123-45-6789", "order 123-45-6789", "call 555 123 4567", "555 123 4567", "ssn 666-45-6789",
    ]
    rows = pii.find_spans(documents(spark, texts)).orderBy("doc_id").collect()
    got = [[(s["kind"], s["text"]) for s in r["spans"]] for r in rows]
    assert got == [
        [("iban", "DE89 3704 0044 0532 0130 00")], [("iban", texts[1])], [], [("ssn", "123-45-6789")], [],
        [("tel", "555 123 4567")], [], [],
    ]
    assert rows[0]["spans"][0]["score"] > rows[1]["spans"][0]["score"]


# 10: benchmark


def test_overlaps_survive_substitutions(spark):
    items = [" ".join(rng_words(i, 40, 4000)) for i in range(5)] + [None, "too short", "six words are enough for it"]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0])], "item_id long, text string")
    changed = items[1].split()
    for i in range(3, 40, 7):
        changed[i] = "changed"
    filler = " ".join(rng_words(99, 200, 10**6))
    texts = [f"{filler} {items[0].upper()} {filler}", f"{filler}, {', '.join(changed)}; {filler}", filler, None, "",
             " ".join(items[2].split()[:8]) + filler, " ".join(items[3].split()[:14]) + " " + filler,
             "Six words; are enough for it", f"{items[4]} {items[4]}", " ".join(w for x in zip(items[0].split(), filler.split()) for w in x)]
    docs = with_clashes(documents(spark, texts))
    found = decontaminate.with_overlaps(docs, bench).orderBy("doc_id").collect()
    got = [[(o["item_id"], o["stop"] - o["start"], o["n_equal"]) for o in r["overlaps"]] for r in found]
    assert got[0] == [(0, 40, 40)]
    assert [o[0] for o in got[1]] == [1] and got[1][0][2] >= 30
    assert got[2:6] == [[], [], [], []]
    assert got[6] == [(3, 14, 14)] and got[7] == [(7, 6, 6)] and got[8] == [(4, 40, 40)] and got[9] == []


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch, sf_dir):
    whole = sorted(tuple(r) for r in decontaminate.op10_decontaminate(spark, sf_dir).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert sorted(tuple(r) for r in decontaminate.op10_decontaminate(spark, sf_dir).collect()) == whole
    assert whole


def brute_overlap(codes, item):
    """Whether any alignment has an overlap, without seeds."""
    for shift in range(-len(item) + 1, len(codes)):
        if decontaminate.SeedIndex._stretch(codes, item, shift):
            return True
    return False


def test_seeds_find_what_a_full_search_finds():
    rng = random.Random(5)
    items = [(i, " ".join(rng_words(i, 20, 50))) for i in range(4)]
    index = decontaminate.SeedIndex.of(items)
    missed = found = 0
    for trial in range(200):
        words = rng_words(1000 + trial, 30, 50)
        item = items[trial % 4][1].split()
        words[5:25] = [w if rng.random() < 0.9 else "zz" for w in item]
        codes = np.array([index.codes.get(w, -1) for w in words])
        if brute_overlap(codes, index.items[trial % 4]):
            found += 1
            missed += trial % 4 not in [o[0] for o in index.overlaps(" ".join(words))]
    assert found > 150 and missed <= 0.01 * found


def plain_overlap(words, item):
    """The stated rule on every stretch of every alignment."""
    least = min(decontaminate.MIN_OVERLAP, len(item))
    for shift in range(-len(item) + 1, len(words)):
        begin, end = max(0, shift), min(len(words), shift + len(item))
        equal = [words[i] == item[i - shift] for i in range(begin, end)]
        for i in range(len(equal)):
            for j in range(i + least, len(equal) + 1):
                if 5 * sum(equal[i:j]) >= 4 * (j - i):
                    return True
    return False


@pytest.mark.parametrize("n", range(6, 21))
def test_overlaps_with_all_substitutions(n):
    item = [f"i{i}" for i in range(n)]
    index = decontaminate.SeedIndex.of([(7, " ".join(item))])
    for changed in itertools.combinations(range(n), n // 5):
        words = ["new" if i in changed else w for i, w in enumerate(item)]
        found = index.overlaps(" ".join(["before", *words, "after"]))
        assert [o[0] for o in found] == [7], changed
        _, start, stop, n_equal = found[0]
        assert stop - start >= min(12, n) and 5 * n_equal >= 4 * (stop - start)
        assert n_equal == sum(w.startswith("i") for w in ["before", *words, "after"][start:stop])


def test_overlaps_equal_a_plain_search(monkeypatch):
    rng = random.Random(3)
    items = [rng_words(i, rng.randrange(6, 30), 60) for i in range(12)]
    index = decontaminate.SeedIndex.of([(i, " ".join(item)) for i, item in enumerate(items)])
    n_found = 0
    for trial in range(150):
        if trial == 75:
            monkeypatch.setattr(decontaminate, "TOGETHER", 10)
        item = items[trial % 12]
        part = item[rng.randrange(3) :][: rng.randrange(5, 30)]
        words = rng_words(500 + trial, 5, 60) + [w if rng.random() < 0.8 else rng.choice(item) for w in part] + rng_words(900 + trial, 5, 60)
        want = [i for i, x in enumerate(items) if plain_overlap(words, x)]
        assert [o[0] for o in index.overlaps(" ".join(words))] == want
        n_found += len(want)
    assert 40 < n_found < 150
