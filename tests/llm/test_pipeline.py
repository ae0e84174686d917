"""The pipeline as a whole and its stages' contracts."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recordlink.llm import language, line_dedup, minhash
from recordlink.llm.common import written


def plain_windows(lines):
    """Forward and backward windows of at least 50 words, as (first, last, content)."""
    rated = [(i, tuple(line.split())) for i, line in enumerate(lines) if line.split()]
    for start in range(len(rated)):
        n = 0
        for end in range(start, len(rated)):
            n += len(rated[end][1])
            if n >= line_dedup.MIN_WORDS:
                yield rated[start][0], rated[end][0], tuple(w for _, w in rated[start : end + 1])
                break
        n = 0
        for begin in range(start, -1, -1):
            n += len(rated[begin][1])
            if n >= line_dedup.MIN_WORDS:
                yield rated[begin][0], rated[start][0], tuple(w for _, w in rated[begin : start + 1])
                break


def plain_line_dedup(rows):
    first = {}
    for doc_id, text in sorted(rows):
        for a, _, content in plain_windows(text.split("\n")):
            first[content] = min(first.get(content, (doc_id, a)), (doc_id, a))
    out = {}
    for doc_id, text in rows:
        lines = text.split("\n")
        gone = {
            i for a, b, content in plain_windows(lines) if first[content] < (doc_id, a) for i in range(a, b + 1)
        }
        left = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            out[doc_id] = left
    return out


def plain_near_dedup(rows):
    sets = {}
    for doc_id, text in rows.items():
        w = text.encode().lower().split()
        n = min(5, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    kept = {i: i for i in sets}

    def root(i):
        while kept[i] != i:
            i = kept[i]
        return i

    holders = {}
    for i in sorted(sets):
        near = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            holders[s].append(i)
        for j, both in near.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                kept[max(a, b)] = min(a, b)
    return {i for i in kept if root(i) == i}


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} == set(after)
        elif name == "line_dedup":
            assert after == plain_line_dedup(list(before.items()))
        elif name == "minhash_near_dedup":
            assert set(after) == plain_near_dedup(before)
        else:
            assert 0 < len(after) < len(before)
    n = len(corpus_pipeline.STAGES)
    packed = corpus_pipeline.STAGES[n - 1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in ends.values():
        starts, lengths = np.array(sorted(placed)).T
        assert (starts == np.concatenate([[0], np.cumsum(lengths)[:-1]])).all() and lengths.sum() <= 4096


def test_run_on_odd_documents(spark, tmp_path):
    text = "the of and to in that is for on are with as at be this have from or one had by " * 4
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (3, "", "en"), (4, "12 34", "en"), (None, text + "x", None), (5, "das der die und " * 9, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), "_text_hash": F.lit(1), "spans": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # the text with a null id is a near copy of document 1
    assert got == [(False, 1), (False, 5)]


def test_run_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_stage_keeps_one_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (3, text), (4, text), (9, "own words")], "doc_id long, text string")
    kept = minhash.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 9]


def test_language_stage_leaves_columns_alone(spark):
    text = "the house and the mouse are in the garden of the old man "
    docs = spark.createDataFrame([(i, text * 3, "en") for i in range(8)], "doc_id long, text string, lang string")
    names = ["_text", "_doc", "_lang", "score", "lang_pred", "a.b"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    kept = language.keep_identified(spark, docs, "").collect()
    assert len(kept) == 8 and [kept[0][c] for c in names] == [f"own {c}" for c in names]
    near = minhash.drop_near_duplicates(spark, docs, "").collect()
    assert len(near) == 1 and [near[0][c] for c in names] == [f"own {c}" for c in names]


def test_stages_get_small_batches_and_leave_no_words_in_workers(spark):
    """Whole batches of 10,000 texts and the words of an earlier packing took an executor's memory."""
    import pandas as pd

    from recordlink import session
    from recordlink.llm import common, packing

    docs = spark.createDataFrame([(i, f"seldom{chr(97 + i)} words here") for i in range(8)], "doc_id long, text string")

    # as in one worker: the words that packing remembered go when another step runs there
    words = packing._tokenizer(packing.tokenizer_path())
    words.ids(["seldom words here"])
    assert packing._tokenizer(packing.tokenizer_path()) is words
    assert len(list(language._count_words(iter([pd.DataFrame({"lang": ["en"], "text": ["a word"]})])))) == 1
    assert not common._KEPT

    own = spark.newSession()
    assert own.conf.get(session.BATCH_CONF, None) is None
    corpus_pipeline.STAGES[2][1](own, own.createDataFrame(docs.collect(), docs.schema), None)
    assert int(own.conf.get(session.BATCH_CONF)) == session.BATCH_ROWS
    own.conf.set(session.BATCH_CONF, 77)
    session.small_batches(own)
    assert own.conf.get(session.BATCH_CONF) == "77"
