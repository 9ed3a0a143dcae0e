"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative, by weights learned
from labelled pages: those that mark their article themselves.  A linear scan finds the contiguous
region with the highest score; blocks inside it that belong to menus, notices, forms and the like
are taken out, and the rest is the text.  A mark is one more weight: a word outside it is worth the
less, the more of the page's words the mark holds, from nearly 1 beside a teaser that is marked to
-1 where everything else is marked.  Where it is worth less than nothing the marked regions are the
text, all of them; where it is worth something, the scan runs over the whole page.

Weights are log-odds of counts over all labelled pages.  A feature is a tag
from a fixed list, so the table of weights has a fixed size.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lociq.llm.common import plain

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Element names of the HTML standard by what they do to text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math canvas object audio video".split())
INLINE = frozenset(
    "img a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements and roles that never hold the article (fixed values).
APART = frozenset("nav footer aside form head menu dialog button select option fieldset legend datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that name such blocks (fixed values).
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu
    menubar breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices
    notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social
    comment comments respond reply replies disqus related recommended pagination pager toolbar masthead topbar disclaimer copyright""".split()
)
#: Name parts that turn the meaning around, and those of the article itself (fixed values).
NOT = frozenset("has no not with without".split())
OWN = frozenset("content main article post entry story".split())
TAILS = frozenset("box wrap wrapper container area section block list item inner bar panel slot title text body row col".split())
#: Void elements that end a line; other void elements stand inside one.
BREAKS = frozenset(("br", "hr"))
#: Blocks that mark the article (fixed values).
ARTICLE = frozenset(("article", "main"))
#: Features with weights: words, and every tag of these; all others share one.
TAGS = tuple(sorted(APART | ARTICLE | INLINE | VOID | {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "header", "section", "table", "tr", "td", "th", "blockquote", "pre", "dl", "dt", "dd", "body", "html", "figure"}))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: A closing tag that is left out: which open elements a new one ends (fixed values).
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": set(), "option": {"select"}}


_MARKED = re.compile(r"<(?:article|main)\b", re.I)
#: A tag of the article's own costs this much of a word.
LEAST_COST = 0.01


@dataclass
class Block:
    """A run of text between block tags, the tags since the one before, and where it stands."""

    text: str
    n_words: int
    tags: list[str]
    apart: bool
    article: bool


def _names_apart(name: str) -> bool:
    """Whether one class or id names a block that is not the article."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    found = set(parts)
    if not found & NAMES or found & NOT:
        return False
    if found & OWN:
        ends = [p for p in parts if p not in TAILS]
        return "content" not in found and bool(ends) and ends[-1] in NAMES
    return True


def _is_apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in APART:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in ("html", "body", *ARTICLE):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(map(_names_apart, value.split())):
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(_ATTRIBUTE, " ", attributes)))


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; one linear pass over its tags."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, apart, article
    parts: list[str] = []
    tags: list[str] = []
    at = 0

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def flush() -> None:
        nonlocal tags
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                apart, article = state()
                out.append(Block(text, text.count(" ") + 1, tags, apart, article))
                tags = []

    def close(names, until=frozenset()) -> None:
        """Ends open elements of these names that stand above the nearest one in ``until``."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in _HOLDS and stack[k][0] not in names or stack[k][0] in INLINE:
                continue
            return

    while match := _TOKEN.search(page, at):
        parts.append(page[at : match.start()])
        at = match.end()
        ending, tag, attributes = match.group(1), match.group(2), match.group(3)
        if tag:
            tag = tag.lower()
            alone = tag in VOID or attributes.rstrip().endswith("/")
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(page, at)
                if not alone:
                    at = found.end() if found else len(page)
                tags.append(tag)
                continue
            apart, article = state()
            own = _is_apart(tag, attributes, article)
            if tag not in INLINE and tag not in VOID or tag in BREAKS or (own and not apart and not alone):
                flush()
            if tag in _ENDS_P:
                close({"p"})
            if tag in _ENDS:
                close(_ENDS[tag], _HOLDS[tag])
            tags.append(tag)
            if not alone:
                apart, article = state()
                stack.append((tag, apart or own, article or tag in ARTICLE))
        elif ending:
            ending = ending.lower()
            if ending not in INLINE or (len(stack) > 1 and stack[-1][0] == ending and stack[-1][1] != stack[-2][1]):
                flush()
            tags.append("/" + ending)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == ending:
                    del stack[k:]
                    break
                if ending in INLINE and stack[k][0] not in INLINE:
                    break
    parts.append(page[at:])
    flush()
    return out


def feature(tag: str) -> str:
    name = tag.lstrip("/")
    return tag if name in TAG_SET else "other"


TAG_SET = frozenset(TAGS)


def scored(found: list[Block]) -> list[tuple[Block, str]]:
    """Blocks with their context: ``article`` and ``outside`` on pages that mark an article with
    words in it, ``plain`` on others, ``apart`` for menus and the like anywhere."""
    marked = any(b.article and not b.apart for b in found)
    return [(b, "apart" if b.apart else ("article" if b.article else "outside") if marked else "plain") for b in found]


def outside_weight(found: list[tuple[Block, str]]) -> float:
    """Worth of a word outside the mark: 1 less twice the share of words that the mark holds."""
    words = Counter()
    for b, context in found:
        words[context] += b.n_words
    total = words["article"] + words["outside"]
    return 1.0 - 2.0 * words["article"] / total if total else 1.0


def count_features(page: str) -> Counter:
    """Words and tags inside and outside the article of one labelled page; empty for others."""
    counts = Counter()
    for b, context in scored(blocks(page)):
        if context != "plain":
            inside = context == "article"
            counts["word", inside] += b.n_words
            for tag in b.tags:
                counts[feature(tag), inside] += 1
    return counts


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """What a tag costs: from the log-odds of standing inside the article of labelled pages.

    A word is worth 1.  A tag found mostly inside costs next to nothing, one found outside up to
    ``4``; a tag that labelled pages do not have costs ``other``.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page and _MARKED.search(page):
                    total.update(count_features(page))
        rows = [(f, int(inside), n) for (f, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["feature", "inside", "n"],
        )

    rows = plain(pages, "html").mapInArrow(counts, "feature string, inside long, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    n = {(r["feature"], r["inside"]): r["n"] for r in rows}
    weights = {"other": -0.5}
    for name in {f for f, _ in n} - {"word"}:
        odds = math.log((n.get((name, 1), 0) + 1) / (n.get((name, 0), 0) + 1))
        weights[name] = -min(4.0, max(LEAST_COST, 1.0 - odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open range of the contiguous run with the highest sum; empty if none is positive."""
    best, best_start, best_end, run, start = 0.0, 0, 0, 0.0, 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > best:
            best, best_start, best_end = run, start, k + 1
    return best_start, best_end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The article's text: blocks in page order, joined by one space."""
    if not page:
        return ""
    found, scores = scored(blocks(page)), []
    outside = outside_weight(found)
    if outside < 0:
        # Every marked block scores above zero and every other below: the marked regions, all of them.
        return " ".join(b.text for b, context in found if context == "article")
    for b, context in found:
        cost = -sum(weights.get(feature(t), weights["other"]) for t in b.tags)
        worth = {"article": 1.0, "plain": 1.0, "outside": outside, "apart": 0.0}[context]
        scores.append(worth * b.n_words - cost if context != "apart" else 0.0)
    start, end = best_region(scores)
    return " ".join(b.text for b, context in found[start:end] if context != "apart")


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per page.

    Null and empty pages, and pages without words outside menus and the like, have an empty text.
    Without labelled pages every tag scores alike.  Rows are independent; only the counts of the
    labelled pages are shuffled, one row for each feature and task.
    """
    weights = learn_weights(pages) if weights is None else weights
    slim = plain(pages, "page_id", "url", "html")
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return slim.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
