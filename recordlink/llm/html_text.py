"""Main text of web pages by tree scoring.

A page becomes a tree. Menus, headers, footers, sidebars, notices, adverts, forms,
comments and the like are cut off by element, role, class and id. Every remaining
paragraph gives points for its length and its commas to its ancestors, less with each
level; a container's points are discounted by the share of its text that lies in links.
The best container, the article around it if there is one, and the siblings that look
like text are kept; their blocks are joined in page order. A form around prose is no form
but the page, a name that may mean anything (``share``, ``header``) cuts off no prose, and
lists of links stay inside an article.

Each page is read by itself, so nothing is shuffled and no host can be hot. The tree is
walked with loops, not recursion, so that deep nesting does no harm.

Defined cases: a null or empty page has an empty text; a page cut off in the middle is
read as far as it goes, without a half tag at its end; a page without anything that looks
like an article gives all its text outside what was cut off; repeated rows are answered
once each; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm.common import only, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# their content is not markup
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template textarea title head nav footer aside button select "
    "option menu dialog iframe object embed svg canvas audio video fieldset label".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an open element on the left is closed by a start tag on the right
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section "
    "summary table ul td th tr tbody thead tfoot caption".split()
)
SAME_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
SCOPE = frozenset("html body article section div main table ul ol dl td th tr nav aside header footer form blockquote button".split())
# words in class, id or role that mark what is not the article
JUNK_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login register paywall sidebar rail aside widget widgets menu "
    "menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar "
    "comment comments commentlist respond reply replies disqus discussion footer foot colophon "
    "copyright masthead sitehead header related recommended recommendations share sharing social "
    "tags taglist skip search searchbox feedback toc hidden complementary contentinfo search".split()
)
# of these the ones that name parts of an article as well
WEAK_WORDS = frozenset("header share sharing social tags skip search toc feedback notice related".split())
# so many characters directly in a block are prose
PROSE_CHARS = 80
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form".split())
GOOD_WORDS = frozenset("article body content entry main page post story text blog".split())
BONUS = {"article": 25, "main": 15, "section": 3, "div": 5, "blockquote": 3, "pre": 3, "td": 3}
MALUS = frozenset("ol ul dl form address".split())

_TAG = re.compile(
    r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL
)
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_ATTR = re.compile(
    r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
    re.IGNORECASE,
)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element; ``parts`` are its texts (str) and elements in page order."""

    __slots__ = ("tag", "attrs", "parent", "parts", "score", "chars", "linked", "own", "prose", "cut")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[str | Node] = []
        self.score = 0.0
        self.chars = self.linked = self.own = self.prose = 0
        self.cut = False

    def names(self) -> tuple[set[str], dict[str, str]]:
        """Words of class and id, and the attributes that matter."""
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(self.attrs)}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        return {p.lower() for p in _NAME_PART.findall(named)}, found


def parse(page: str) -> Node:
    """The page as a tree; forgiving about tags that are missing, crossed or cut off."""
    root = Node("html")
    at, here, end = 0, root, len(page)
    lower: str | None = None
    while at < end:
        start = page.find("<", at)
        if start < 0:
            here.parts.append(page[at:])
            break
        if start > at:
            here.parts.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        match = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
        if match is None:
            if re.match(r"</?[A-Za-z]", page[start : start + 3]):
                break  # half a tag at the end
            here.parts.append("<")
            at = start + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            node = here
            while node is not root and node.tag != tag:
                # an inline element's end does not close the block around it
                if tag in INLINE and node.tag not in INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in ("html", "body"):
            if match[3]:
                root.attrs += match[3] if tag == "html" else ""
            continue
        if tag in CLOSES_P:
            here = _closed(here, ("p",), SCOPE)
        if tag in SAME_CLOSES:
            limits = frozenset("table ul ol dl select".split())
            here = _closed(here, SAME_CLOSES[tag], limits)
        node = Node(tag, match[3], here)
        here.parts.append(node)
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == end else page
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                break
            close = page.find(">", stop)
            at = end if close < 0 else close + 1
        elif tag not in VOID and not match[3].endswith("/"):
            here = node
        elif tag not in VOID and tag not in ("svg", "path"):
            here = node  # HTML ignores the slash of an element that needs an end
    return root


def _closed(here: Node, tags: tuple[str, ...], limits: frozenset[str]) -> Node:
    """Where to go on after closing the open elements ``tags`` around ``here``."""
    node: Node | None = here
    result = here
    while node is not None and node.parent is not None:
        if node.tag in tags:
            result = node.parent
        elif node.tag in limits:
            break
        node = node.parent
    return result


def _walk(root: Node) -> Iterator[Node]:
    """All elements that are not cut off, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.cut)


def _inside(node: Node, tags: tuple[str, ...]) -> Node | None:
    """The outermost ancestor (or the node itself) of one of these kinds."""
    found = None
    up: Node | None = node
    while up is not None:
        if up.tag in tags:
            found = up
        up = up.parent
    return found


def _is_junk(node: Node) -> bool:
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag == "form":
        return node.prose < 2
    if tag in ("article", "main", "html"):
        words, found = node.names()
        return bool(words & {"comment", "comments", "ad", "ads", "related", "teaser", "promo"})
    if tag == "header":
        if _inside(node, ("article", "main")) is None:
            return True
        return not any(isinstance(p, Node) and p.tag in HEADINGS for p in node.parts)
    if not node.attrs:
        return False
    words, found = node.names()
    if "hidden" in found or found.get("aria-hidden") == "true" or _INVISIBLE.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in JUNK_ROLES:
        return True
    junk = words & JUNK_WORDS
    if junk and not (node.prose and junk <= WEAK_WORDS):
        if words & {"header", "title", "head"} and not words & (JUNK_WORDS - {"header"}):
            return not any(isinstance(p, Node) and p.tag in HEADINGS for p in node.parts)
        # a page-wide wrapper named like "with-sidebar" is not the sidebar
        return not words & {"main", "article", "layout", "wrapper", "container", "page"} or node.tag in INLINE
    return False


def _count_prose(root: Node) -> None:
    """How many blocks of prose each element holds; an article or its title counts for two."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if isinstance(p, Node) and p.tag not in DROPPED)
    for node in reversed(order):
        if node.tag in ("article", "main", "h1"):
            node.prose += 2
        elif sum(len(p.strip()) for p in node.parts if isinstance(p, str)) >= PROSE_CHARS:
            node.prose += 1
        if node.parent is not None:
            node.parent.prose += node.prose


def _measure(root: Node) -> list[Node]:
    """Cut off what is not the article; text and link lengths of all that is left."""
    _count_prose(root)
    order = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        for p in reversed(node.parts):
            if isinstance(p, Node):
                p.cut = _is_junk(p)
                if not p.cut:
                    todo.append(p)
    for node in reversed(order):
        node.own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        kids = [p for p in node.parts if isinstance(p, Node) and not p.cut]
        node.chars = node.own + sum(k.chars for k in kids)
        node.linked = node.chars if node.tag == "a" else sum(k.linked for k in kids)
    return order


def _block_text(node: Node) -> str:
    """Text directly in a block, with that of the inline elements in it."""
    out, todo = [], list(reversed(node.parts))
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif not p.cut and p.tag in INLINE:
            todo.extend(reversed(p.parts))
    return "".join(out)


def _link_share(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(order: list[Node]) -> Node | None:
    """Let paragraphs pass points to their ancestors; the container with most of them."""
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag in INLINE or node.tag in HEADINGS or node.chars == 0:
            continue
        text = " ".join(_block_text(node).split())
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        if node.tag not in ("p", "pre", "blockquote", "li", "td"):
            node.score += points
            scored[id(node)] = node
        up, share = node.parent, 1.0
        for level in range(5):
            if up is None:
                break
            up.score += points * share
            scored[id(up)] = up
            up, share = up.parent, (1 / 2, 1 / 6, 1 / 9, 1 / 12, 0)[level]
    best, most = None, 0.0
    for node in order:
        if id(node) not in scored:
            continue
        words, _ = node.names()
        extra = BONUS.get(node.tag, 0) - (3 if node.tag in MALUS else 0) + (10 if words & GOOD_WORDS else 0)
        node.score = (node.score + extra) * (1 - _link_share(node))
        if node.score > most:
            best, most = node, node.score
    return best


def _kept(best: Node) -> list[Node]:
    """The best container, or the article around it, with the siblings that are text."""
    article = _inside(best, ("article",)) or _inside(best, ("main",))
    if article is not None:
        best = article
    if best.parent is None:
        return [best]
    least = max(10.0, best.score * 0.2)
    in_main = _inside(best.parent, ("main",)) is not None
    kept = []
    for p in best.parent.parts:
        if p is best:
            kept.append(best)
        elif isinstance(p, Node) and not p.cut:
            share = _link_share(p)
            heading = p.tag in ("h1", "h2") and not kept
            prose = p.tag == "p" and p.chars > PROSE_CHARS and share < 0.25
            part = in_main and p.tag in ("section", "div") and p.prose and share < 0.25
            if heading or prose or part or (p.score >= least and share < 0.5):
                kept.append(p)
    return kept


def _is_link_list(node: Node) -> bool:
    if node.tag not in ("ul", "ol", "div", "section", "table", "dl") or node.chars == 0:
        return False
    links = sum(n.tag == "a" for n in _walk(node))
    return links >= 3 and _link_share(node) > 0.6


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space as single spaces."""
    blocks: list[str] = []
    current: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(current)).split())
        current.clear()
        if text:
            blocks.append(text)

    in_article = _inside(node, ("article",)) is not None
    todo: list[Node | str | None] = [node]
    while todo:
        p = todo.pop()
        if p is None:
            end_block()
        elif isinstance(p, str):
            current.append(p)
        elif p.cut or (p is not node and not in_article and _is_link_list(p)):
            continue
        elif p.tag in INLINE:
            todo.extend(reversed(p.parts))
        else:
            end_block()
            todo.append(None)
            todo.extend(reversed(p.parts))
    end_block()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    best = _score(_measure(root))
    if best is None:
        within = [n for n in _walk(root) if n.tag in ("article", "main") and n.chars]
        chosen = [_inside(within[0], ("article", "main"))] if within else [root]
    else:
        chosen = _kept(best)
    return " ".join(text for node in chosen for text in _blocks(node))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    rows = only(pages, "page_id", "url", html_col)
    return rows.select("page_id", "url", extract(F.col(f"`{html_col}`")).alias("text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
