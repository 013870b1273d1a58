"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read once into tokens in page order. Words score above zero and tags below, by the
log-likelihood ratio of standing inside or outside the article, learned from labelled pages:
those with exactly one <article> element, which is never a feature itself. One linear scan
finds the contiguous stretch with the largest sum, the first of several.

Elements that are never part of an article (menus, footers, sidebars, forms, scripts, styles
and the like, and hidden ones) have no words, wherever they stand. Elements that only their
class, id or role calls an advert, a notice or reader comments have none either, unless they
hold more than half of the page's words and of its paragraphs and headings: a name on what
wraps the article does not cost it.

Blocks are what block-level tags separate. Inside a block white space becomes one space, <br>
and table cells count as white space, character references are decoded, and blocks are joined
by an empty line. Null, empty and wordless pages give ""; equal pages give equal texts.
Attribute values are quoted only after "="; other quotes in a tag are part of its names.
Broken markup never fails: a quoted value or comment without its end runs to the end of the
page, an element without its end closes with an outer one, and <article>, <main> and <body>
end left-out elements that are never closed. Reading takes time and memory linear in a page's
length, however long or deeply nested it is. Tags beyond the standard ones are one kind.
Counts for learning cover every labelled page; without any, FALLBACK holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, map_texts

#: Elements whose text is never part of an article.
LEFT_OUT = frozenset("nav footer aside form script style noscript iframe svg button select textarea template dialog menu head title object canvas video audio map".split())
#: Words of class, id or role attributes with the same meaning.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs byline-links comment comments comment-list comment-section consent "
    "contentinfo cookie cookies cookie-banner disqus_thread disqus footer gdpr hidden masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "notifications overlay pagination pager popup promo promos related related-posts respond responses search share sharing sidebar sidebars site-footer site-header skip "
    "social social-links sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACES = frozenset("br td th".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 article main blockquote".split())
#: Tags with scores of their own (fixed values); others are "other".
TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes "
    "noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody "
    "td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_MARK = re.compile(r"<(?:!--(.*?)(?:-->|--!>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_MAYBE_HIDDEN = re.compile(r"\bhidden\b(?!-)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")

#: Parts of a compound name that keep it in, such as content-with-sidebar.
KEPT_IN_NAMES = frozenset("article body container content entry has layout main overflow page post story text with wrapper".split())
_PARTS = re.compile(r"[\s_-]+")

#: Scores without labelled pages.
FALLBACK = {"word": 1.0, "link": 0.3}
FALLBACK_TAG = -3.0


class Token(NamedTuple):
    """A tag, or a piece of text with its number of words."""

    kind: str
    words: int
    text: str
    block: int
    inside: bool


def _is_hidden(attributes: str) -> bool:
    """A hidden attribute, style with display:none, or aria-hidden=true; not these words in other values."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is never part of an article."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main", "input"):
        return False
    return bool(_MAYBE_HIDDEN.search(attributes)) and _is_hidden(attributes)


def _named_out(attributes: str) -> bool:
    """Whether a class, id or role calls the element something that is not part of an article."""
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(_PARTS.split(name))
            if name in LEFT_OUT_NAMES or parts & LEFT_OUT_NAMES and not parts & KEPT_IN_NAMES:
                return True
    return False


class _Reader:
    """Reads a page into tokens. Named elements are numbered; each token knows the innermost it stands in."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.stack: list[tuple[str, bool, int]] = []  # name, left out, number of the named element or -1
        self.open: Counter[str] = Counter()
        self.out = self.inside = self.links = 0
        self.left: list[str] = []  # the open left-out elements
        self.named: list[int] = []  # numbers of the open named elements
        self.outer: list[int] = []  # by number: the named element around it, or -1
        self.last_end: dict[str, int] = {}

    def pop(self) -> str:
        name, left, number = self.stack.pop()
        self.open[name] -= 1
        if left:
            self.out -= 1
            self.left.pop()
        self.inside -= name == "article"
        self.links -= name == "a"
        if number >= 0:
            self.named.pop()
        return name

    def push(self, name: str, left: bool, named: bool) -> None:
        number = -1
        if named:
            number = len(self.outer)
            self.outer.append(self.named[-1] if self.named else -1)
            self.named.append(number)
        self.stack.append((name, left, number))
        self.open[name] += 1
        if left:
            self.out += 1
            self.left.append(name)
        self.inside += name == "article"
        self.links += name == "a"

    def never_closed(self, name: str, at: int) -> bool:
        if name not in self.last_end:
            self.last_end[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}", self.page, re.IGNORECASE)), default=-1)
        return self.last_end[name] < at

    def read(self) -> Iterator[tuple[Token, int]]:
        page, size = self.page, len(self.page)
        at = block = 0
        while at < size:
            mark = page.find("<", at)
            text = page[at:] if mark < 0 else page[at:mark]
            found = _MARK.match(page, mark) if mark >= 0 else None
            if mark >= 0 and not found:  # a bare "<" is text
                text += "<"
            if text and not self.out:
                text = html.unescape(text) if "&" in text else text
                yield Token("link" if self.links else "word", len(text.split()), text, block, self.inside > 0), self.named[-1] if self.named else -1
            if not found:
                at = size if mark < 0 else mark + 1
                continue
            at = found.end()
            name = (found[3] or "").lower()
            if not name:
                continue
            if found[2]:
                if self.open[name] > 0:
                    while self.pop() != name:
                        pass
            else:
                attributes = found[4] or ""
                if self.out and name in ("article", "main", "body"):
                    if self.never_closed(self.left[0], at):
                        while self.out:
                            self.pop()
                leave = _left_out(name, attributes, self.inside > 0)
                if name not in _VOID and not attributes.endswith("/"):
                    if name in _RAW:
                        end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                        at = end.end() if end else size
                    else:
                        if name in ("p", "li") and self.stack and self.stack[-1][0] == name:
                            self.pop()
                        self.push(name, leave, bool(attributes) and not leave and name not in ("html", "body", "article", "main") and _named_out(attributes))
            if name in _BLOCKS:
                block += 1
            kind = name if name in TAGS else "other"
            yield Token(("/" if found[2] else "") + kind, 0, " " if name in _SPACES and not self.out else "", block, self.inside > 0), self.named[-1] if self.named else -1


def tokens_of(page: str) -> list[Token]:
    """The page's tokens; what stands in left-out elements has no text."""
    reader = _Reader(page)
    read = list(reader.read())
    if not reader.outer:
        return [t for t, _ in read]
    held = [[0, 0] for _ in reader.outer]  # words and paragraphs of each named element
    total = [0, 0]
    for t, number in read:
        for own in (total, held[number]) if number >= 0 else (total,):
            own[0] += t.words
            own[1] += t.kind in _PARAGRAPHS
    for number in range(len(held) - 1, -1, -1):
        if reader.outer[number] >= 0:
            for i in (0, 1):
                held[reader.outer[number]][i] += held[number][i]
    gone: list[bool] = []
    for number, (words, paragraphs) in enumerate(held):
        few = 2 * words <= total[0] or 2 * paragraphs <= total[1] and total[1] > 0
        gone.append(few or reader.outer[number] >= 0 and gone[reader.outer[number]])
    return [Token(t.kind, 0, "", t.block, t.inside) if number >= 0 and gone[number] and t.text else t for t, number in read if not (number >= 0 and gone[number] and t.kind in FALLBACK)]


def learn_scores(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Scores of words and tags from all pages with exactly one article; counts are summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in chunks(batch, 0):
                for raw in texts:
                    page = raw.decode("utf-8", "replace")
                    if len(re.findall(r"<article[\s>]", page, re.IGNORECASE)) != 1:
                        continue
                    for t in tokens_of(page):
                        counts[t.kind, t.inside] += t.words if t.kind in ("word", "link") else 1
        keys = [k for k in counts if counts[k]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    found = pages.select(F.col(f"`{column}`").cast("string").alias("html")).mapInArrow(run, "kind string, inside boolean, n long")
    # as many rows as there are kinds: words, links and the tags of TAGS
    rows = found.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("here"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("there")).orderBy("kind").collect()
    total_in, total_out = sum(r.here for r in rows), sum(r.there for r in rows)
    if not total_in:
        return dict(FALLBACK)
    scores = {}
    for r in rows:
        ratio = log((r.here + 1) / (total_in + len(rows))) - log((r.there + 1) / (total_out + len(rows)))
        if r.kind in FALLBACK:
            scores[r.kind] = min(2.0, max(0.1, ratio))
        elif r.kind not in ("article", "/article"):
            scores[r.kind] = max(-6.0, min(-0.05, ratio))
    scores["article"] = scores["/article"] = -0.05
    return FALLBACK | scores


def best_stretch(values: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the largest sum (empty if none is above zero); the first if several are."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str, scores: dict[str, float]) -> str:
    tokens = tokens_of(page)
    low, high = best_stretch([t.words * scores[t.kind] if t.kind in FALLBACK else scores.get(t.kind, FALLBACK_TAG) for t in tokens])
    blocks: dict[int, list[str]] = {}
    for t in tokens[low:high]:
        if t.text:
            blocks.setdefault(t.block, []).append(t.text)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extract_main_text(pages: DataFrame, column: str = "html", scores: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (its code points) to each page."""
    known = learn_scores(pages, column) if scores is None else scores

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            made = [main_text(t.decode("utf-8", "replace"), known) for t in texts]
            return [made, [len(t) for t in made]]

        return kernel

    return map_texts(pages, column, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, keep)
