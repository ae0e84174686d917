"""Language identification: known words first, then ever shorter character n-grams.

A word that the learned vocabulary knows scores each language by the logarithm of its
frequency there. An unseen word backs off: its n-grams of the longest order of which any
is known score it, from ``ORDERS[0]`` letters down to single ones. A text's language is
the one with the largest sum over its words.

Words and n-grams are counted over all labelled rows: words are pre-counted per task, and
n-grams are counted from the word counts, so what is shuffled is as large as the
vocabulary. The model keeps what makes up at least ``MIN_SHARE`` of some language's words
(or of its n-grams of that length), with its counts in all languages. So it has at most
``1 / MIN_SHARE`` items of each kind per language at any size of input; that bounds what
is collected and broadcast. Frequencies are shares to which a constant is added, so they do
not depend on the size of the input either. Texts are scored row by row without a shuffle;
no source can be hot.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing could be learned; equal sums go to the first language in
alphabetical order; null languages are not learned from; repeated rows count each; extra
columns pass through ``identify`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, release_worker, table, written

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
MIN_SHARE = 2e-5
# More languages than this in the labels is taken for a mistake in the labels.
MAX_LANGUAGES = 300
# Words per task that are counted before they are sent on.
FLUSH = 200_000
# Added to each share, a tenth of the least that is kept.
SMOOTHING = 0.1 * MIN_SHARE
# Confidence is judged as if a longer text had this many words.
SURE_WORDS = 40

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if found and not "".join(found).isalpha():
        # signs such as one half count as word characters, but are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def ngrams_of(word: str, order: int) -> list[str]:
    """N-grams of the word between its two ends; single letters without them."""
    if order == 1:
        return list(word)
    held = f" {word} "
    return [held[i : i + order] for i in range(len(held) - order + 1)]


def _flushed(counts: dict, last: bool = False) -> Iterator[pd.DataFrame]:
    if counts and (last or sum(map(len, counts.values())) > FLUSH):
        rows = [(lang, item, n) for lang, found in counts.items() for item, n in found.items()]
        counts.clear()
        yield pd.DataFrame(rows, columns=["lang", "item", "n"])


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release_worker()
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            counts[lang].update(words_of(text))
            yield from _flushed(counts)
    yield from _flushed(counts, last=True)


def _count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word, n in zip(batch["lang"], batch["item"], batch["n"]):
            found = counts[lang]
            for order in ORDERS:
                for gram in ngrams_of(word, order):
                    found[f"{order}{gram}"] += n
            yield from _flushed(counts)
    yield from _flushed(counts, last=True)


@dataclass
class Model:
    """Log frequencies by language (columns) of words and n-grams (rows)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray

    def _back_off(self, word: str) -> list[int]:
        """Rows of the known n-grams of the longest order that has any."""
        for order in ORDERS:
            known = self.grams[order]
            rows = [known[g] for g in ngrams_of(word, order) if g in known]
            if rows:
                return rows
        return []

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows: list[int] = []
        weights: list[float] = []
        for word, n in Counter(words).items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
            else:
                # an unseen word counts as much as a known one: the mean of its n-grams
                found = self._back_off(word)
                rows += found
                weights += [n / len(found)] * len(found) if found else []
        total = np.asarray(weights) @ self.scores[rows] if rows else np.zeros(len(self.languages))
        best = int(np.argmax(total))
        sure = np.exp((total - total[best]) * min(1.0, SURE_WORDS / len(words)))
        return self.languages[best], float(1 / sure.sum())


def _scores(kept: list, languages: list[str], totals: dict, of_total) -> tuple[dict, np.ndarray]:
    """Rows of the items and their smoothed log frequencies."""
    rows: dict[str, int] = {}
    for r in kept:
        rows.setdefault(r["item"], len(rows))
    shares = np.full((len(rows), len(languages)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    for r in kept:
        shares[rows[r["item"]], place[r["lang"]]] += r["n"] / totals[r["lang"], of_total(r["item"])]
    return rows, np.log(shares)


def learn(labelled: DataFrame, min_share: float = MIN_SHARE) -> Model:
    """Count words and n-grams of ``labelled`` (``lang``, ``text``) over the cluster."""
    schema = "lang string, item string, n long"
    rows = only(labelled, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    words = rows.mapInPandas(_count_words, schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = written(words, "language-words")

    def kept(counts: DataFrame, group: Column) -> tuple[list, dict]:
        """All counts of what makes up ``min_share`` of a language and group; and all totals."""
        counts = counts.withColumn("of", group)
        sums = counts.groupBy("lang", "of").agg(F.sum("n").alias("total"))
        totals = {(r["lang"], r["of"]): r["total"] for r in sums.limit(MAX_LANGUAGES * 10).collect()}
        if len({lang for lang, _ in totals}) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
        # at most 300 languages of five orders
        common = counts.join(F.broadcast(sums), ["lang", "of"]).where(F.col("n") >= min_share * F.col("total"))
        # as many as the model has
        chosen = counts.join(F.broadcast(common.select("item").distinct()), "item", "left_semi")
        return chosen.select("lang", "item", "n").orderBy("item", "lang").collect(), totals

    known, word_totals = kept(words, F.lit("0"))
    grams = words.mapInPandas(_count_ngrams, schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    known_grams, gram_totals = kept(written(grams, "language-grams"), F.substring("item", 1, 1))
    languages = sorted({lang for lang, _ in word_totals})
    word_rows, word_scores = _scores(known, languages, word_totals, lambda item: "0")
    gram_rows, gram_scores = _scores(known_grams, languages, gram_totals, lambda item: item[0])
    by_order: dict[int, dict[str, int]] = {order: {} for order in ORDERS}
    for item, row in gram_rows.items():
        by_order[int(item[0])][item[1:]] = row + len(word_rows)
    return Model(languages, word_rows, by_order, np.concatenate([word_scores, gram_scores]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_worker()
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang", "score"])

    answered = docs.withColumn("_answer", predict(F.col(f"`{text_col}`")))
    return answered.withColumns(
        {"lang_pred": F.col("_answer.lang"), "score": F.col("_answer.score")}
    ).drop("_answer")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by crc32 of the id as text (a null id: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = only(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


# A document stays if its language is known with at least this confidence.
MIN_SCORE = 0.3


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told are left out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    sure = (F.col("_lang.lang_pred") != UNKNOWN) & (F.col("_lang.score") >= MIN_SCORE)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = identify(docs.select(F.col("text").alias("_text"), whole.alias("_doc")), model, "_text")
    kept = kept.withColumn("_lang", F.struct("lang_pred", "score"))
    return kept.where(sure).select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
