"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of block tags from the root to it. Text length and punctuation are
summed for each path and divided by its number of blocks; each of the two series (a value a block, in page order) is
smoothed, both are fused, and the blocks of paths above a threshold are the content. A block's weight is its text times
its path's ratio if it is content, not mostly links, and else nothing; weights decide all that follows.

- An element that a class, id or role, a form or page header marks as something else than the article goes, unless it
  holds the article by weight: an article or main element of more weight than all that isn't marked, or most of the
  page's weight with next to nothing outside of it. Reader comments go even if they outweigh the article. A class of
  which such a word is only a part (alert-history), or a topic of texts too (discussion, in an article), lowers the
  element's score, the mean of its paths' ratios over its text; it goes if that is below the threshold.
- The article is the article (else main) element of most weight, with other articles and parts beside it of at least
  half its weight. Without one it is the least element with three quarters of the weight, and content outside of it stays
  too.
- In an article or main element content stays, and, unless it is mostly links, what lies between its content, running
  text before and after that, and headings; lists of links, share and tag lines around it go. Elsewhere what isn't
  content is kept between the title and the last content, and as headings and, later, list items, cells and the like
  within the article; the rest (copyright lines, tags, crumbs) goes.

Navigation, footers, asides, buttons, dialogs, scripts, styles, templates and comments in the markup are never text.
Character references are decoded, white space inside a block becomes one space (a line break is white space), blocks
are joined by an empty line. A page is read in one pass and its elements are summed in one more, in time proportional
to its length, however deep or broken it is. Pages are read whole; a null or empty page gives an empty text. Of
elements of equal weight the first counts. Repeated rows each get their result; other columns pass through, one of the
output's name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.batches import parts

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name, up to its end; a quoted value may hold the end's sign.
_REST = re.compile(r"[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Their content isn't markup: it runs to the end tag.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Part of the running text of a block.
INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
)
#: Elements that are never part of the article.
OUTSIDE = frozenset(("head", "nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "svg", "math", "object", "canvas", "audio", "video"))
#: Elements that are part of it only if they hold most of the page.
AROUND = frozenset(("form", "fieldset"))
#: Start tags that end an open element of the same group, unless one of the barriers is in between.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIERS = ("ul", "ol", "table", "dl", "div", "article", "section", "body")
_P_BARRIERS = (*_BARRIERS, "td", "li")
#: Words in class or id that mark an element as something else than the article.
HINTS = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
     "notice", "notices", "alert", "newsletter", "subscribe", "subscription", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
     "footer", "copyright", "comment", "comments", "disqus", "discussion", "replies", "share", "sharing", "social", "related", "recommended", "recommendations",
     "popup", "modal", "overlay", "login", "signup", "toolbar", "pagination", "pager", "skip", "widget", "banner", "masthead")
)
#: Those of reader comments, whose id marks a section within an article too.
COMMENTS = frozenset(("comment", "comments", "disqus", "replies"))
#: Hints that are also what a part of an article is about: alone in a class there, they only lower its score.
TOPICS = frozenset(("discussion", "related", "social", "promotion", "consent", "subscription"))
#: Words that say no more than that an element is a part of the page: beside a hint, they leave it as it is.
PARTS = frozenset(
    ("area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "group", "icon", "icons", "inner",
     "item", "items", "label", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "articles", "stories", "right", "row", "section",
     "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "primary", "secondary", "global", "mobile", "desktop")
)
#: What a hint beside other words leaves of an element's score. A path of near the highest score passes any threshold with it,
#: as a deviation of values up to 1 is at most a half.
LOWERED = 0.7
#: Lines about the page that have an article's tag path as often as not; they go at its edges.
ABOUT = re.compile(
    r"(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b|(?:tags?|topics?|categor(?:y|ies)|filed under|posted in)\s*:"
    r"|(?:share|tweet|follow us|teilen|partager|compartir)(?:\s+(?:this|it|on|via|by|auf|sur|en)\b[^.!?]*)?$",
    re.I,
)
ABOUT_CHARS = 120
#: Of the article's weight, what another article, or a part of the page beside it, needs to stay with it.
BESIDE = 0.5
#: A word in a class or id that these come before tells of the page's layout, and so does one before the last two.
LAYOUT = frozenset(("no", "has", "with", "without"))
STATES = frozenset(("open", "closed"))
TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements of running text: in an article, a class that a hint is only a part of doesn't mark them if they hold sentences.
RUNNING = TITLES | {"p", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption"}
BESIDES = frozenset(("article", "section", "div"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"))
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、；：！？]")
#: Of the standard deviation of the fused series; paths at or above it are content.
THRESHOLD = 0.8
#: What a neighbour counts in the Gaussian mean of the series (half a block's deviation).
NEIGHBOUR = math.exp(-2)
#: Share of the weight that the article holds on a page without article and main.
ARTICLE_SHARE = 0.75
_WEAK, _MARK, _READERS = 1, 2, 3


def _mark(tag: str, attributes: str, in_article: bool, in_main: bool) -> int:
    """Whether an element is marked as something else than the article: 0 no, 1 its score is lowered, 2 yes, 3 as reader
    comments."""
    found = _MARK if tag in AROUND or tag == "header" and not in_article else 0
    if not attributes.strip() or tag in ("html", "body", "main") or tag == "article" and "comment" not in attributes:
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if tag != "article" and (name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value)):
            found = max(found, _MARK)
        if name not in ("class", "id"):
            continue
        for token in value.split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if words and words[-1] in STATES:
                continue
            hints = [w for k, w in enumerate(words) if (w in HINTS or w == "header" and not in_article) and LAYOUT.isdisjoint(words[:k])]
            if in_article and name == "id" and (tag in TITLES or tag == "section" and COMMENTS.isdisjoint(hints)):
                continue  # an anchor
            if hints:
                others = [w for w in words if w not in HINTS and w != "header" and len(w) > 2]
                weak = len(hints) < len(words) if in_article and tag in RUNNING else not PARTS.issuperset(others) or in_main and TOPICS.issuperset(words)
                found = max(found, _READERS if not COMMENTS.isdisjoint(hints) else _WEAK if weak else _MARK)
    return found


class Page:
    """Elements in page order (each after its parent) and blocks of text, without those that are never text."""

    def __init__(self, source: str) -> None:
        self.parents, self.tags, self.paths, self.outside, self.marks, self.nested, self.titled = [-1], ["#"], [0], [False], [0], [False], [False]
        self.elements: list[int] = []  # of each block
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._ids = {(-1, "#"): 0}
        self._stack, self._open = [0], defaultdict(list)  # open elements; of each tag, its places there
        self._blocks = [0]  # places of the open elements that are no running text
        self._text, self._linked_here = [], 0
        self._scan(source)
        self._flush()

    def _scan(self, source: str) -> None:
        at, n, quotes = 0, len(source), True
        while at < n:
            sign = source.find("<", at)
            if sign < 0:
                self._add(source[at:])
                return
            if sign > at:
                self._add(source[at:sign])
            if source.startswith("<!--", sign):
                past = source.find("-->", sign + 4)
                at = n if past < 0 else past + 3
            elif source.startswith("<![CDATA[", sign):
                past = source.find("]]>", sign)
                self._add(source[sign + 9 : n if past < 0 else past], plain=True)
                at = n if past < 0 else past + 3
            elif source.startswith(("<!", "<?"), sign):
                past = source.find(">", sign)
                at = n if past < 0 else past + 1
            else:
                name = _NAME.match(source, sign)
                end = source.find(">", sign) if name else -1
                if name is None:
                    self._add("<")
                    at = sign + 1
                elif end < 0:  # no tag ends any more
                    self._add(source[sign:])
                    return
                else:
                    rest = _REST.match(source, name.end()) if quotes else None
                    quotes = rest is not None  # a quote that never ends: from here on, tags end at the first sign
                    at = rest.end() if rest else end + 1
                    at = self._tag(source, name[1].lower(), source[sign + 1] == "/", source[name.end() : at - 1], at)

    def _tag(self, source: str, tag: str, ends: bool, attributes: str, at: int) -> int:
        if ends:
            self._end(tag)
            return at
        self._start(tag, attributes)
        if tag in RAW and not attributes.endswith("/"):
            found = _RAW_END[tag].search(source, at)
            past = source.find(">", found.start()) if found else -1
            self._end(tag)
            return len(source) if past < 0 else past + 1
        return at

    def _add(self, text: str, plain: bool = False) -> None:
        text = text if plain or "&" not in text else entities.unescape(text)
        self._text.append(text)
        if self._open["a"]:
            self._linked_here += len(text.strip())

    def _flush(self) -> None:
        element = self._stack[-1]
        if self._text and not self.outside[element]:
            text = " ".join("".join(self._text).split())
            if text:
                self.elements.append(element), self.texts.append(text), self.linked.append(self._linked_here)
        self._text, self._linked_here = [], 0

    def _top(self, tags: tuple[str, ...]) -> int:
        """The place of the last open element of some tags, or -1."""
        return max(self._open[t][-1] if self._open[t] else -1 for t in tags)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
            place = self._top(CLOSES.get(tag, ("p",)))
            if place >= 0 and place > self._top(_BARRIERS if tag in CLOSES else _P_BARRIERS):
                self._pop_to(place)
        parent, in_article = self._stack[-1], bool(self._open["article"])
        outside = self.outside[parent] or tag in RAW or tag in OUTSIDE
        mark = 0 if outside else _mark(tag, attributes, in_article, in_article or bool(self._open["main"]))
        if tag in INLINE and (mark or outside != self.outside[parent]):
            self._flush()  # a marked span parts the text around it
        path = self.paths[parent]
        if tag not in INLINE:
            path = self._ids.setdefault((path, tag), len(self._ids))
        self.parents.append(parent), self.tags.append(tag), self.paths.append(path), self.outside.append(outside)
        self.marks.append(mark), self.nested.append(in_article), self.titled.append(self.titled[parent] or tag == "h1")
        if attributes.endswith("/") and tag in ("svg", "path"):
            return
        self._open[tag].append(len(self._stack))
        if tag not in INLINE:
            self._blocks.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            tag = self.tags[self._stack.pop()]
            self._open[tag].pop()
            if self._blocks[-1] == len(self._stack):
                self._blocks.pop()

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        place = self._open[tag][-1] if self._open[tag] else -1
        if place < 0 or tag in INLINE and place < self._blocks[-1]:
            return  # a stray end tag; one of running text closes no block
        e = self._stack[place]
        if tag in INLINE and (self.marks[e] or self.outside[e] != self.outside[self.parents[e]]):
            self._flush()
        self._pop_to(place)


def smoothed(values: list[float]) -> list[float]:
    """A Gaussian mean over each value and its neighbours in page order."""
    if not values:
        return []
    weights = [NEIGHBOUR, 1.0, NEIGHBOUR]
    return (np.convolve(values, weights)[1:-1] / np.convolve(np.ones(len(values)), weights)[1:-1]).tolist()


def path_ratios(paths: list, texts: list[str]) -> list[float]:
    """The fused series: of each block, its path's text length and punctuation by block, each smoothed and scaled."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in zip(paths, texts):
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    by_length = smoothed([length[p] / count[p] for p in paths])
    by_marks = smoothed([(1 + marks[p]) / count[p] for p in paths])
    top_length, top_marks = max(by_length, default=1.0), max(by_marks, default=1.0)
    return [math.sqrt(a / top_length * b / top_marks) for a, b in zip(by_length, by_marks)]


def threshold(fused: list[float]) -> float:
    if not fused:
        return 0.0
    mean = sum(fused) / len(fused)
    return THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))


def selected(fused: list[float]) -> list[bool]:
    least = threshold(fused)
    return [x >= least for x in fused]


def _sums(page: Page, values: list[float]) -> list[float]:
    """Of each element, the sum of its blocks' values, those of the elements in it included."""
    out = [0.0] * len(page.tags)
    for e, value in zip(page.elements, values):
        out[e] += value
    for e in range(len(out) - 1, 0, -1):
        out[page.parents[e]] += out[e]
    return out


def _ratios(page: Page) -> tuple[list[float], list[bool], list[float]]:
    """Of each block, its path's ratio, whether it is content by that, and its weight."""
    fused = path_ratios([page.paths[e] for e in page.elements], page.texts)
    content = selected(fused)
    return fused, content, [len(t) * x if c and 2 * a <= len(t) else 0.0 for t, x, c, a in zip(page.texts, fused, content, page.linked)]


def _dropped(page: Page, fused: list[float], weights: list[float]) -> list[bool]:
    """Of each element, whether it is, or is in, one that is marked and doesn't hold the article."""
    n = len(page.tags)
    marked, gone = [False] * n, [False] * n
    if not any(page.marks):
        return gone
    weight = _sums(page, weights)
    # A lowered score: the mean of the paths' ratios by text; what is mostly links counts nothing.
    scores = _sums(page, [LOWERED * len(t) * x if 2 * a <= len(t) else 0.0 for t, x, a in zip(page.texts, fused, page.linked)])
    sizes, least = _sums(page, [float(len(t)) for t in page.texts]), threshold(fused)
    sentences = _sums(page, [float(2 * a <= len(t) and PUNCTUATION.search(t) is not None) for t, a in zip(page.texts, page.linked)])
    titles = _sums(page, [float(page.titled[e]) for e in page.elements])
    marks = list(page.marks)
    for e in range(1, n):
        if marks[e] == _WEAK:
            spared = sentences[e] or page.tags[e] in TITLES if page.nested[e] and page.tags[e] in RUNNING else scores[e] >= least * sizes[e]
            marks[e] = 0 if spared else _WEAK
        marked[e] = marked[page.parents[e]] or marks[e] > 0
    free = sum(w for e, w in zip(page.elements, weights) if not marked[e])
    articles = [0.0] * n  # of each element, the weight of unmarked articles in it
    for e in range(n - 1, 0, -1):
        articles[page.parents[e]] += weight[e] if page.tags[e] in ("article", "main") and not marks[e] else articles[e]
    for e in range(1, n):
        gone[e] = gone[page.parents[e]]
        if gone[e] or not marks[e]:
            continue
        if articles[e] and articles[e] >= free and not page.nested[e]:
            continue
        most, alone = 2 * weight[e] > weight[0], free == 0 if marks[e] == _READERS else 10 * free < weight[e]
        gone[e] = not (most and (titles[e] or alone and sentences[e]))
    return gone


def _above(page: Page, element: int) -> int:
    """What a title stands in."""
    while page.titled[element]:
        element = page.parents[element]
    return element


def _within(page: Page, span: tuple[int, int], content: list[bool], own: list[bool], about: list[bool]) -> list[str]:
    """The blocks in an article or main element that are its text. Between the first and the last content of its paths
    everything stays but lists of links; before and after, content and running text do, and headings anywhere. A line
    about the page goes there only outside of running text: in it, it may be the article's own."""
    places = [k for k, e in enumerate(page.elements) if span[0] <= e <= span[1]]
    sure = [k for k in places if content[k] and own[k] and not about[k]]  # what is about the page bounds nothing
    if not sure:
        return [page.texts[k] for k in places]
    texts = {page.paths[page.elements[k]] for k in sure}  # paths that hold text; a path of links alone needs sentences
    out = []
    for k in places:
        tags = {page.tags[page.elements[k]], page.tags[page.parents[page.elements[k]]]}
        sentence = PUNCTUATION.search(page.texts[k]) is not None
        running = not RUNNING.isdisjoint(tags)
        if sure[0] <= k <= sure[-1]:
            kept = own[k] or content[k] and (sentence or page.paths[page.elements[k]] in texts)
        elif about[k] and not running:
            kept = False
        else:
            kept = own[k] and (content[k] or running) or content[k] and sentence
        if kept or not TITLES.isdisjoint(tags):
            out.append(page.texts[k])
    return out


def extract_blocks(source: str | None) -> list[str]:
    """The blocks of the article, in page order."""
    if not source:
        return []
    page = Page(source)
    fused, _, weights = _ratios(page)
    gone = _dropped(page, fused, weights)
    left = [k for k, e in enumerate(page.elements) if not gone[e]]
    if not left:
        return []
    page.elements, page.texts, page.linked = ([x[k] for k in left] for x in (page.elements, page.texts, page.linked))
    _, content, weights = _ratios(page)
    about = [len(t) <= ABOUT_CHARS and ABOUT.match(t) is not None for t in page.texts]
    own = [2 * a <= len(t) for t, a in zip(page.texts, page.linked)]
    if not any(weights):  # links only
        weights = [float(len(t)) if c else 0.0 for t, c in zip(page.texts, content)]
    weight = _sums(page, weights)
    n = len(page.tags)
    last, depth = list(range(n)), [0] * n
    for e in range(n - 1, 0, -1):
        last[page.parents[e]] = max(last[page.parents[e]], last[e])
    for e in range(1, n):
        depth[e] = depth[page.parents[e]] + 1
    for tag in ("article", "main"):
        found = [e for e in range(1, n) if page.tags[e] == tag and weight[e] > 0]
        if found:
            root = max(found, key=lambda e: (weight[e], -depth[e], -e))
            beside = [e for e in range(1, n) if page.tags[e] == tag or page.tags[e] in BESIDES and page.parents[e] == page.parents[root]]
            roots: list[int] = []
            for e in sorted({root, *(e for e in beside if weight[e] >= BESIDE * weight[root] and not e <= root <= last[e])}):
                if not roots or e > last[roots[-1]]:
                    roots.append(e)
            return [t for e in roots for t in _within(page, (e, last[e]), content, own, about)]
    root = max((e for e in range(n) if weight[e] >= ARTICLE_SHARE * weight[0]), key=lambda e: (depth[e], -e))
    while page.tags[root] in RUNNING | INLINE | {"ul", "ol", "dl", "tr", "tbody", "table"} and page.parents[root] > 0:
        root = page.parents[root]
    inside = [root <= e <= last[root] for e in page.elements]
    # The page's title stays where it stands within the least element around all that is content, and what it leads in.
    chosen = [c and (o or i) for c, o, i in zip(content, own, inside)]
    plain = [c and not a for c, a in zip(chosen, about)]
    chosen = plain if any(plain) else chosen
    held = _sums(page, [float(c) for c in chosen])
    around = max((e for e in range(n) if held[e] == held[0]), key=lambda e: (depth[e], -e))
    first, final = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    titles = [k for k in range(first) if page.titled[page.elements[k]] and _above(page, page.elements[k]) <= root <= last[_above(page, page.elements[k])]]
    start = titles[-1] if titles else first
    out = []
    for k, (e, text) in enumerate(zip(page.elements, page.texts)):
        tags = {page.tags[e], page.tags[page.parents[e]]}
        title = k == start or page.titled[e] and (content[k] or around <= e <= last[around])
        running = not RUNNING.isdisjoint(tags)
        if about[k] and not first <= k <= final:
            continue
        within = start < k < final or running and k > start or not TITLES.isdisjoint(tags)
        if title or chosen[k] or own[k] and (within if inside[k] else start < k < first and running):
            out.append(text)
    return out


def extract(source: str | None) -> str:
    """The article's text."""
    return "\n\n".join(extract_blocks(source))


@F.arrow_udf(T.StringType())
def _extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in parts(pages):
        yield pa.array([extract(x.as_py()) for x in batch], pa.string())


def main_text(html: Column) -> Column:
    """string: the main text of a page; empty if it has none."""
    return _extract(html)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each."""
    return pages.withColumn(text, main_text(F.col(html)))
