"""Texts with many spans, and pages whose layout hides the article."""

import random
import re

import pytest

from recordlink.llm import html_text, pii

SCHEMA = "doc_id bigint, text string"


def overlapping_texts():
    rng = random.Random(8)
    parts = ["call 555-123-4567", "+1 555-123-4567", "tel 4111111111111111", "tel 555.123.4567", "ssn 123-45-6789",
             "x@555-123-4567.com", "phone 1.2.3.4", " ", "\n", "555 123 4567 ", "41111111111111", "11"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def plain_further(text, base):
    """The further kinds without a checksum, one span held against every base span."""
    found = []
    for kind in pii.KINDS:
        if kind.name not in ("ssn", "tel"):
            continue
        last = 0
        for m in re.finditer(kind.pattern, text):
            near = text[last : m.start()][-pii.CONTEXT_CHARS :].lower()
            last = m.end()
            passes = kind.name == "tel" or not re.match("000|666|9", m[0])
            free = all(b <= m.start() or a >= m.end() for a, b in base)
            if passes and free and any(w in near for w in kind.context):
                found.append((kind.name, m.start(), m.end()))
    return sorted(found)


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_further_spans_overlap_no_base_span(spark, monkeypatch, stretch):
    monkeypatch.setattr(pii, "STRETCH", stretch)
    texts = overlapping_texts()
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(s["kind"], s["start"], s["stop"], s["base"]) for s in r["spans"]]
        assert [s[1] for s in spans] == sorted(s[1] for s in spans)
        base = [(a, b) for _, a, b, is_base in spans if is_base]
        further = sorted((k, a, b) for k, a, b, is_base in spans if not is_base and k != "iban")
        assert further == plain_further(texts[r["doc_id"]], base)
        assert all(texts[r["doc_id"]][s["start"] : s["stop"]] == s["text"] for s in r["spans"])


def test_a_hundred_thousand_spans_in_one_text(spark):
    text = "\n".join(f"user{i}@example.com call 555-123-{i % 10_000:04d}" for i in range(50_000))
    spans = pii.find_spans(spark.createDataFrame([(1, text)], SCHEMA)).first()["spans"]
    assert len(spans) == 100_000
    assert all(text[s["start"] : s["stop"]] == s["text"] for s in spans)


PROSE = "A paragraph of prose, with commas, and words enough to be seen as the text of an article, really."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=all><div><h1>T</h1><p>{PROSE}<p>{PROSE}</div></form>", f"T {PROSE} {PROSE}"),
        (f"<main><h1>T</h1><article><p>{PROSE}</article><section><p>{PROSE}</section></main>", f"T {PROSE} {PROSE}"),
        (
            f"<article><p>{PROSE}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>",
            f"{PROSE} one two three",
        ),
        (f"<article><p class='summary post-header'>{PROSE}<p>{PROSE}</article>", f"{PROSE} {PROSE}"),
        (f"<article><p>{PROSE}<div class=share-of-wealth><p>{PROSE}</div></article>", f"{PROSE} {PROSE}"),
        # what is no part of the article still goes
        (f"<article><p>{PROSE}<div class=share><a href=1>Share</a></div></article><form><p>{PROSE}<input></form>", PROSE),
        (f"<main><article><p>{PROSE}</article><section class=comments><p>{PROSE}</section></main>", PROSE),
        (f"<main><article><p>{PROSE}</article><div><a href=1>More, and more, of this, and of that</a></div></main>", PROSE),
    ],
)
def test_parts_of_the_article_stay(page, text):
    assert html_text.main_text(page) == text
