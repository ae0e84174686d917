"""Line dedup: later copies of runs of lines, found by winnowing over line hashes.

A run of lines counts from ``MIN_WORDS`` words on. From each line the shortest window that
holds so many words is taken forward and backward; the least line hash in a window is its
fingerprint. Equal windows have equal fingerprints, so every repeated run is guaranteed to
share one. Fingerprints selected at one place only are left out; around the others the
windows are held against each other by all their lines, and every window that occurs at an
earlier place (by doc_id, then line) is deleted. Windows of a run overlap, so together
they extend each match both ways to its full length: a line goes exactly if some run of
at least ``MIN_WORDS`` words around it occurs at an earlier place.

Only DataFrame functions run. The windows of a document are made within its row; what is
shuffled are hashes. No pairs of places are formed: each window is compared with the first
one of its kind, counts and firsts are summed up before the shuffle, and frequent windows
are joined by broadcast (``join_group_facts``), of which there are fewer than 2,000.

Lines are compared by their words, so blanks and empty lines do not matter; line breaks
are ``\\n``. Lines inside a deleted run go with it, empty ones included.

Defined cases: a null text stays null with no lines; an empty text has one empty line and
stays; rows that repeat both id and text are one document and are treated alike; a null id
comes first; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, table, written
from recordlink.operators.ordering import join_group_facts

MIN_WORDS = 50
BLANKS = r"[ \t\r\f]+"
_KEY = ["doc_id", "_text_hash"]


def _lines(text: Column) -> Column:
    """Place, hash and number of words of each line that has words."""
    words = F.transform(
        F.split(text, "\n", -1), lambda line: F.filter(F.split(line, BLANKS, -1), lambda w: w != "")
    )
    rated = F.transform(
        words,
        lambda w, at: F.struct(
            at.alias("at"), F.xxhash64(F.array_join(w, " ")).alias("hash"), F.size(w).alias("words")
        ),
    )
    return F.filter(rated, lambda line: line["words"] > 0)


def _window(lines: Column) -> Column:
    """The shortest beginning of ``lines`` with ``MIN_WORDS`` words, null if there is none."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))

    def step(seen: Column, line: Column) -> Column:
        full = seen["words"] >= MIN_WORDS
        return F.struct(
            F.when(full, seen["n"]).otherwise(seen["n"] + 1).alias("n"),
            F.when(full, seen["words"]).otherwise(seen["words"] + line["words"]).alias("words"),
        )

    return F.aggregate(
        lines, start, step, lambda s: F.when(s["words"] >= MIN_WORDS, s["n"]).cast("int")
    )


def _described(window: Column) -> Column:
    """First and last line, fingerprint and content of a window (lines in page order)."""
    hashes = F.transform(window, lambda line: line["hash"])
    return F.struct(
        F.element_at(window, 1)["at"].alias("first"),
        F.element_at(window, -1)["at"].alias("last"),
        F.array_min(hashes).alias("fingerprint"),
        F.xxhash64(hashes).alias("content"),
        F.size(window).alias("size"),
    )


def windows_of(lines: Column) -> Column:
    """The forward window from each line and the backward window to each line."""
    n = F.size(lines)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def forward(i: Column) -> Column:
        return F.slice(lines, i, F.lit(MIN_WORDS))

    def backward(i: Column) -> Column:
        begin = F.greatest(i - MIN_WORDS + 1, F.lit(1))
        return F.slice(lines, begin, i - begin + 1)

    # a line has a word at least, so a window has MIN_WORDS lines at most
    ahead = F.transform(places, lambda i: F.slice(lines, i, F.coalesce(_window(forward(i)), F.lit(0))))
    behind = F.transform(
        F.transform(places, lambda i: F.struct(i.alias("i"), _window(F.reverse(backward(i))).alias("n"))),
        lambda w: F.slice(lines, F.greatest(w["i"] - F.coalesce(w["n"], F.lit(0)) + 1, F.lit(1)), F.coalesce(w["n"], F.lit(0))),
    )
    full = F.filter(F.concat(ahead, behind), lambda w: F.size(w) > 0)
    return F.array_distinct(F.transform(full, _described))


def _repeated_windows(docs: DataFrame) -> DataFrame:
    """Windows that occur at an earlier place: ``_KEY``, ``first`` and ``last`` line."""
    text = only(docs, "doc_id", "text").where("text IS NOT NULL")
    lined = text.select("doc_id", F.xxhash64("text").alias("_text_hash"), _lines(F.col("text")).alias("_lines"))
    found = lined.select(*_KEY, F.explode(windows_of(F.col("_lines"))).alias("_w"))
    found = written(found.select(*_KEY, "_w.*"), "windows")
    # fingerprints that were selected around more than one place
    shared = (
        found.groupBy("fingerprint")
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.min(F.struct(*_KEY, "first")).alias("_least"),
            F.max(F.struct(*_KEY, "first")).alias("_most"),
        )
        .where(F.col("_least") < F.col("_most"))
        .select("fingerprint", "n_windows")
    )
    around = join_group_facts(found, shared, ["fingerprint"], "n_windows", "inner").drop("n_windows")
    content = ["fingerprint", "content", "size"]
    place = F.struct(*_KEY, "first")
    firsts = (
        around.groupBy(*content)
        .agg(F.count(F.lit(1)).alias("n_places"), F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(F.col("_first") < F.col("_last"))
        .drop("_last")
    )
    same = join_group_facts(around, firsts, content, "n_places", "inner")
    return same.where(F.col("_first") < place).select(*_KEY, "first", "last")


def _runs(windows: Column) -> Column:
    """Overlapping or touching windows, sorted, as maximal runs."""
    kind = "array<struct<first:int,last:int>>"

    def step(runs: Column, w: Column) -> Column:
        end = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (w["first"] <= F.get(runs, F.size(runs) - 1)["last"] + 1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], w["last"]).alias("last"))
        before = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
        return (
            F.when(joins, F.concat(before, F.array(longer)))
            .otherwise(F.concat(runs, F.array(w)))
            .cast(kind)
        )

    return F.aggregate(F.array_sort(windows), F.array().cast(kind), step)


def _without(lines: Column, runs: Column) -> Column:
    """``lines`` without those of the runs: the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    gaps = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    return F.flatten(gaps)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining ``text``, ``n_lines``, ``n_removed`` and ``n_runs``."""
    repeated = _repeated_windows(docs).groupBy(*_KEY).agg(
        F.collect_set(F.struct("first", "last")).alias("_windows")  # of one document
    )
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))) & (
        F.col("d._text_hash") == F.col("r._text_hash")
    )
    joined = rows.alias("d").join(repeated.alias("r"), same, "left").select("d.*", "r._windows")
    none = F.array().cast("array<struct<first:int,last:int>>")
    joined = joined.withColumn("_cut", F.when(F.col("_windows").isNotNull(), _runs(F.col("_windows"))).otherwise(none))
    lines = F.split("text", "\n", -1)
    remaining = F.array_join(_without(lines, F.col("_cut")), "\n")
    removed = F.aggregate("_cut", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
            "n_removed": removed.cast("bigint"),
            "n_runs": F.size("_cut").cast("bigint"),
            "text": F.when(F.size("_cut") > 0, remaining).otherwise(F.col("text")),
        }
    ).drop("_windows", "_cut", "_text_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated runs go, and with them documents of which nothing is left."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = dedup_lines(docs.select("doc_id", "text", whole.alias("_doc")))
    changed = F.col("n_removed") > 0
    nothing = changed & (F.regexp_replace("text", r"\s", "") == "")
    new = {
        "text": F.col("text"),
        "n_chars": F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("_doc.n_chars")),
    }
    kept = found.where(~F.coalesce(nothing, F.lit(False)))
    return kept.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


OP8_SQL = f"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
words AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos,
    list_filter(string_split_regex(unnest(lines), '[ \\t\\r\\f]+'), lambda w: w <> '') AS w FROM split),
lines AS (
  SELECT doc_id, pos, array_to_string(w, ' ') AS line, len(w) AS n,
    sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos) AS until FROM words WHERE len(w) > 0),
windows AS (
  SELECT doc_id, pos AS a, max(pos) OVER f AS b, list(line) OVER f AS content,
    max(until) OVER f - until + n AS size
  FROM (SELECT *, until - n AS before FROM lines)
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER f AS a, pos AS b, list(line) OVER f AS content,
    until - min(until - n) OVER f AS size
  FROM lines
  WINDOW f AS (PARTITION BY doc_id ORDER BY until RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
placed AS (
  SELECT *, min((doc_id, a)) OVER (PARTITION BY content) AS earliest FROM windows WHERE size >= {MIN_WORDS}),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM placed WHERE earliest < (doc_id, a)),
marked AS (
  SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone),
counts AS (
  SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_runs, list(pos) AS cut FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_runs, 0) AS n_runs,
  CASE WHEN cut IS NULL THEN text ELSE
    array_to_string(list_filter(lines, lambda x, i: NOT list_contains(cut, i)), chr(10)) END AS text
FROM split LEFT JOIN counts USING (doc_id)
"""
