"""Personal data: expressions propose spans, checksums confirm them, context scores them.

Base kinds are kept as they match: email, ip (parts at most 255), card (12 to 19 digits,
Luhn) and phone (9 to 15 digits). Further kinds are proposed with a starting score that a
checksum (mod 97 for iban) or a context word in the 40 characters before the span raises;
they are kept from ``MIN_SCORE`` on, unless they overlap a base span.

Only DataFrame functions run, row by row: nothing is shuffled, so no source or text can
be hot. Spark finds all matches of an expression but not where they are; splitting the
text at the same expression gives the gaps between them, and the running sum of gap and
match lengths gives the places, in code points. Sums are run in stretches of the matches
(``_running``), so a text with many of them costs no square of their number.

The expressions are written so that a long run of word characters or digits is read once:
quantifiers are possessive where giving back could not help, and a match may only start
where a run starts or where the last match ended. They find the same spans as the plain
forms in the contract, which the SQL uses.

Defined cases: a null text is empty; an empty text has no spans; matches that fail their
check are dropped without a second try; repeated documents are answered once each; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import ascii_lower, only, table

_LOCAL = r"[A-Za-z0-9._%+-]"
_NUMBERS = "array<bigint>"
STRETCH = 256
FAR = (1 << 63) - 1

MIN_SCORE = 0.6
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass Luhn's check."""
    digits = F.split(F.reverse(_digits(text)), "")
    values = F.filter(digits, lambda d: d != "")

    def weigh(d: Column, place: Column) -> Column:
        value = d.cast("int")
        twice = value * 2
        return F.when(place % 2 == 0, value).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(values, weigh), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97 (country and check last)."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(signs, F.lit(0), step) == 1


def _count_between(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """What proposes a span, what confirms it, and what it is worth."""

    name: str
    pattern: str  # as Spark reads it
    check: Callable[[Column], Column]
    base: bool = True
    score: float = 1.0
    context: tuple[str, ...] = ()
    needs: str | None = None  # a text without this has no match


# fixed values: the base expressions of the contract, in their order
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        needs="@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"),
        needs=".",
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        lambda m: _count_between(m, 12, 19) & luhn(m),
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _count_between(m, 9, 15), needs="+"),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
        mod97,
        base=False,
        score=0.7,
        context=("iban", "konto", "account", "compte", "cuenta"),
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda m: ~m.rlike("^(?:000|666|9)"),
        base=False,
        score=0.3,
        context=("ssn", "social security", "insurance number"),
        needs="-",
    ),
    Kind(
        "tel",
        r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
        lambda m: F.lit(True),
        base=False,
        score=0.3,
        context=("tel", "phone", "call", "fax", "mobil", "telefon"),
    ),
)


def _running(
    rows: DataFrame, columns: dict[str, str], merge: Callable[[Column, Column], Column]
) -> DataFrame:
    """Add each column of numbers (by its new name) merged up to each place, inclusive.

    Arrays grow by copies, so they are merged within stretches of ``STRETCH`` numbers, then
    over the stretches' ends. Each step is a column of its own that is read twice: read
    once, Spark would put it inside the next step's lambda and compute it for every element.
    """

    def grown(numbers: Column) -> Column:
        def step(seen: Column, v: Column) -> Column:
            n = F.size(seen)
            return F.concat(seen, F.array(F.when(n == 0, v).otherwise(merge(F.get(seen, n - 1), v))))

        return F.aggregate(numbers, F.array().cast(_NUMBERS), step)

    def stretches(numbers: Column) -> Column:
        n = F.size(numbers)
        firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda i: grown(F.slice(numbers, i, F.lit(STRETCH))))

    def whole(parts: Column) -> Column:
        n = F.size(parts)
        ends = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ends, F.lit(1), F.greatest(n - 1, F.lit(0))))
        merged = F.zip_with(
            parts,
            F.slice(before, F.lit(1), n),
            lambda p, b: F.when(b.isNull(), p).otherwise(F.transform(p, lambda v: merge(b, v))),
        )
        return F.flatten(merged)

    parts = rows.withColumns({name: stretches(F.col(of)) for name, of in columns.items()})
    return parts.withColumns({name: whole(F.col(name)) for name in columns})


def _located(rows: DataFrame) -> DataFrame:
    """Places of each kind's matches; the end of the gap before each is kept for its context."""

    def part(gap: Column, match: Column) -> Column:
        return F.struct(
            F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS).alias("gap"),
            match.alias("text"),
            (F.length(gap) + F.length(match)).cast("bigint").alias("until"),
        )

    parts, lengths = {}, {}
    for kind in KINDS:
        gaps, matches = F.col(f"_g_{kind.name}"), F.col(f"_m_{kind.name}")
        parts[f"_p_{kind.name}"] = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, part)
        lengths[f"_l_{kind.name}"] = F.transform(f"_p_{kind.name}", lambda p: p["until"])
    stops = {f"_e_{k.name}": f"_l_{k.name}" for k in KINDS}
    return _running(rows.withColumns(parts).withColumns(lengths), stops, lambda a, b: a + b)


def _rated_spans(parts: Column, stops: Column, kind: Kind, number: int) -> Column:
    """The spans of one kind that pass its check, with their scores."""

    def rated(s: Column) -> Column:
        near = F.lit(False)
        for word in kind.context:
            near = near | F.contains(ascii_lower(s["gap"]), F.lit(word))
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            s["start"].alias("start"),
            F.lit(number).alias("kind_no"),
            s["stop"].alias("stop"),
            F.lit(kind.name).alias("kind"),
            s["text"].alias("text"),
            F.least(F.round(score, 2), F.lit(1.0)).alias("score"),
            F.lit(kind.base).alias("base"),
        )

    def placed(p: Column, stop: Column) -> Column:
        return F.struct(
            (stop - F.length(p["text"])).alias("start"), stop.alias("stop"), p["text"].alias("text"), p["gap"].alias("gap")
        )

    passed = F.filter(F.zip_with(parts, stops, placed), lambda s: kind.check(s["text"]))
    return F.transform(passed, rated)


def _without_overlaps(rows: DataFrame) -> DataFrame:
    """Drop further spans that score too low or overlap a base span; ``spans`` are sorted.

    A span overlaps a base span that starts before it (or with it: base kinds come first) if
    the farthest of their ends lies beyond its start, and one that starts after it if the
    next such start lies before its end.
    """
    ends = F.transform("spans", lambda s: F.when(s["base"], s["stop"]).otherwise(F.lit(0).cast("bigint")))
    starts = F.transform(F.reverse("spans"), lambda s: F.when(s["base"], s["start"]).otherwise(F.lit(FAR)))
    rows = rows.withColumns({"_ends": ends, "_starts": starts})
    rows = _running(rows, {"_reach": "_ends"}, F.greatest)
    rows = _running(rows, {"_next": "_starts"}, F.least)
    rated = F.zip_with("spans", "_reach", lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
    kept = F.zip_with(
        rated,
        F.reverse("_next"),
        lambda t, n: F.struct(
            t["s"].alias("s"),
            (
                t["s"]["base"]
                | ((t["s"]["score"] >= MIN_SCORE) & (t["reach"] <= t["s"]["start"]) & (n >= t["s"]["stop"]))
            ).alias("stays"),
        ),
    )
    return rows.withColumn("spans", F.transform(F.filter(kept, lambda t: t["stays"]), lambda t: t["s"]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: kind, start, stop, text and score, ordered by place.

    The order is by start, then kind as in ``KINDS``; ``base`` tells the base kinds.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = only(docs, id_col, text_col).withColumn("_text", text)
    for kind in KINDS:
        found = F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0))
        none = F.array().cast("array<string>")
        if kind.needs:
            found = F.when(F.contains("_text", F.lit(kind.needs)), found).otherwise(none)
        rows = rows.withColumn(f"_m_{kind.name}", found)
    rows = rows.withColumns(
        {
            f"_g_{k.name}": F.when(
                F.size(f"_m_{k.name}") > 0, F.split("_text", k.pattern, -1)
            ).otherwise(F.array().cast("array<string>"))
            for k in KINDS
        }
    )
    rows = _located(rows)
    spans = [
        _rated_spans(F.col(f"_p_{kind.name}"), F.col(f"_e_{kind.name}"), kind, number)
        for number, kind in enumerate(KINDS)
    ]
    rows = rows.select(f"`{id_col}`", F.array_sort(F.concat(*spans)).alias("spans"))
    return _without_overlaps(rows).select(f"`{id_col}`", "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _sql_spans(name: str, pattern: str) -> str:
    """Places of the matches, from the gaps between them, as ``_located`` does it."""
    matches = f"regexp_extract_all(t, '{pattern}')"
    gaps = f"string_split_regex(t, '{pattern}')"
    return f"""
{name}_parts AS (SELECT doc_id, {matches} AS m, {gaps} AS g FROM texts),
{name}_rows AS (
  SELECT doc_id, unnest(m) AS m, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i
  FROM {name}_parts WHERE len(m) > 0),
{name}_at AS (
  SELECT doc_id, m, gap, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM {name}_rows),
{name}_spans AS (
  SELECT doc_id, m, lower(right(gap, {CONTEXT_CHARS})) AS gap, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop,
    regexp_replace(m, '[^0-9]', '', 'g') AS d FROM {name}_at)"""


def _sql_near(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(gap, '{w}')" for w in words) + ")"


_BY_NAME = {k.name: k for k in KINDS}
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN reverse(d)[i]::INT
      WHEN reverse(d)[i]::INT * 2 > 9 THEN reverse(d)[i]::INT * 2 - 9 ELSE reverse(d)[i]::INT * 2 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(
    string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c:
    CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c:
    CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"""

OP9_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
{_sql_spans("ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)")},
{_sql_spans("card", "[0-9](?:[ -]?[0-9])+")},
{_sql_spans("phone", "[+][0-9][ ().0-9-]+[0-9]")},
{_sql_spans("iban", _BY_NAME["iban"].pattern)},
{_sql_spans("ssn", _BY_NAME["ssn"].pattern)},
{_sql_spans("tel", _BY_NAME["tel"].pattern)},
base AS (
  SELECT doc_id, 0 AS no, 'email' AS kind, start, stop FROM email_spans
  UNION ALL SELECT doc_id, 1, 'ip', start, stop FROM ip_spans
    WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3
      OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0
  UNION ALL SELECT doc_id, 2, 'card', start, stop FROM card_spans
    WHERE CASE WHEN length(d) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END
  UNION ALL SELECT doc_id, 3, 'phone', start, stop FROM phone_spans WHERE length(d) BETWEEN 9 AND 15),
proposed AS (
  SELECT doc_id, 4 AS no, 'iban' AS kind, start, stop FROM iban_spans WHERE {_MOD97}
  UNION ALL SELECT doc_id, 5, 'ssn', start, stop FROM ssn_spans
    WHERE NOT regexp_matches(m, '^(?:000|666|9)') AND {_sql_near(_BY_NAME["ssn"].context)}
  UNION ALL SELECT doc_id, 6, 'tel', start, stop FROM tel_spans WHERE {_sql_near(_BY_NAME["tel"].context)}),
every AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM proposed p WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.start < p.stop AND p.start < b.stop)),
found AS (
  SELECT doc_id,
    count(*) FILTER (WHERE no = 0) AS n_email, count(*) FILTER (WHERE no = 1) AS n_ip,
    count(*) FILTER (WHERE no = 2) AS n_card, count(*) FILTER (WHERE no = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (WHERE no < 4) AS of_base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip,
  coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(of_base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""
