import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry
from sheafwork.llm import html_extract as h


def plain_article(page):
    """The article of the generated pages, whose only block tags are p and h1."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = entry.queries()["op8_html_extraction"](spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


BODY = "<p>Long text, with commas, and more. Indeed it goes on, for a while.<p>A second one: it too, has marks."


@pytest.mark.parametrize(
    "page, blocks",
    [
        (None, []),
        ("", []),
        ("<html><head><title>t</title></head><body></body></html>", []),
        ("just text &amp; more <b>bold</b> end", ["just text & more bold end"]),
        ("a < b and c", ["a < b and c"]),
        ("<article><p>x<span class='ad'>buy</span>y</p></article>", ["x", "y"]),
        ("<article><h1>T</h1><p>a<br>b&nbsp;&eacute;<!-- no --> c</p><pre> k\n k </pre></article><p>out, of it.</p>", ["T", "a b é c", "k k"]),
        (f"<nav><a>m</a></nav><div id=cookie-bar>We use cookies.</div><main>{BODY}</main><footer>f</footer>", ["Long text, with commas, and more. Indeed it goes on, for a while.", "A second one: it too, has marks."]),
        (f"<div><h2>Head</h2>{BODY}<ul><li>one<li>two</ul></div><section id=comments><p>nice, post.</p></section><form><p>mail</form><script>if(a<b)'</p>'</script>", ["Head", "Long text, with commas, and more. Indeed it goes on, for a while.", "A second one: it too, has marks.", "one", "two"]),
        (f"<div class=x>{BODY}</div><div><ul><li><a href=1>first link</a><li><a href=2>other</a></ul></div>", ["Long text, with commas, and more. Indeed it goes on, for a while.", "A second one: it too, has marks."]),
    ],
)
def test_pages(page, blocks):
    assert h.extract_blocks(page) == blocks


ONE, TWO = "Long text, with commas, and more. Indeed it goes on, for a while.", "A second one: it too, has marks."
COMMENT = "Nice, post. I like it, very much, too. Indeed it is, all in all, a long one."


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<div class='content no-sidebar'><article>{BODY}</article></div>", [ONE, TWO]),
        (f"<div class='site has-comments'><h1>T</h1>{BODY}</div>", ["T", ONE, TWO]),
        (f"<div class='layout with-sidebar'>{BODY}<div class=sidebar>Side, text.</div></div>", [ONE, TWO]),
        (f"<div class='layout sidebar-left'><nav>n</nav><article>{BODY}</article><div class=sidebar>Side, text.</div></div>", [ONE, TWO]),
        (f"<div class='layout sidebar-left'><h1>T</h1>{BODY}<div class=sidebar>Side, text.</div></div>", ["T", ONE, TWO]),
        (f"<article>{BODY}<section id=discussion><h2 id=related-work>Related</h2><p class=notice-period>A month, at least.</section></article>", [ONE, TWO, "Related", "A month, at least."]),
        # What surrounds the article still goes.
        (f"<article>{BODY}<section id=comments><p>Nice, post.</section><div class=related-posts>More, here.</div><p class=ad-label>Advert</article>", [ONE, TWO]),
        (f"<div>{BODY}</div><div id=comments>{20 * f'<p>{COMMENT}</p>'}</div>", [ONE, TWO]),
        (f"<article>{BODY}</article><div id=comments>{20 * f'<article class=comment>{COMMENT}</article>'}</div>", [ONE, TWO]),
        (f"<div class=related><article>Teaser, short.</article></div><div>{BODY}</div>", [ONE, TWO]),
    ],
)
def test_hints_spare_what_holds_the_article(page, blocks):
    assert h.extract_blocks(page) == blocks


@pytest.mark.parametrize("n", [1, 5, 20])
def test_selected_blocks_outside_the_root_stay(n):
    long = n * f"<p>{ONE}</p><p>{TWO}</p>"
    title = "<h1>Title</h1><p>Lead</p>"
    assert h.extract_blocks(f"<div id=post>{title}<div class=body>{long}</div></div>") == ["Title", "Lead"] + n * [ONE, TWO]
    assert h.extract_blocks(f"<div id=post>{title}<div>{4 * long}</div><div>{long}</div></div>") == ["Title", "Lead"] + 5 * n * [ONE, TWO]
    linked = f"<div><h1><a href=1>Title</a></h1><div>{4 * long}</div><ul><li><a href=2>other</a></ul></div>"
    assert h.extract_blocks(linked) == ["Title"] + 4 * n * [ONE, TWO]


ARTICLE = f"<h1>Title</h1><p>{ONE} {TWO}</p><p>{TWO} {ONE}</p>"
WRAPPERS = [
    "<body class='comments-open'>%s</body>",
    "<body><div class='with-sidebar'>%s</div></body>",
    "<body><div id='page' class='has-banner'>%s</div></body>",
    "<body><main class='no-comments'>%s</main></body>",
    "<body><form>%s</form></body>",
    "<body><div class='site menu'>%s</div></body>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("tag", ["<article>%s</article>", "<article class='post comments-open'>%s</article>", "<div class=post>%s</div>"])
def test_wrappers_lose_no_article(wrapper, tag):
    page = wrapper % ("<nav><a href=a>Home</a></nav>" + tag % ARTICLE + "<footer>f</footer>")
    assert h.extract_blocks(page) == ["Title", f"{ONE} {TWO}", f"{TWO} {ONE}"]


#: Pages without article, main, or any word that says what is what.
BARE = [
    f"<div><div><span>Home</span> <span>News</span></div>{ARTICLE}<div>All rights of this page</div></div>",
    f"<div>Some site</div><div>{ARTICLE}</div><div>Made by us</div>",
    f"<table><tr><td>Top<td>More</table><div><div>{ARTICLE}</div></div><table><tr><td>Map<td>Help</table>",
    f"<ul><li>Home<li>Shop<li>About</ul><div>{ARTICLE}</div><ul><li>Terms<li>Privacy</ul>",
    f"<div><div>12 May</div>{ARTICLE}<div><div>Topics</div><div>sea</div><div>wind</div></div></div>",
    f"<section><div>Home / Sea</div><div>{ARTICLE}</div></section><section><div>Top</div></section>",
    f"<dl><dt>Site<dd>Shop</dl>{ARTICLE}<div><div>Tel</div></div>",
    f"<div>{ARTICLE}</div>",
]


def test_ratios_decide_without_marks(monkeypatch):
    want = ["Title", f"{ONE} {TWO}", f"{TWO} {ONE}"]
    assert [h.extract_blocks(p) for p in BARE] == [want] * len(BARE)
    monkeypatch.setattr(h, "selected", lambda fused: [True] * len(fused))
    assert sum(h.extract_blocks(p) != want for p in BARE) == 7


#: Articles with something else in them, or parts of the article under a word that tells of something else elsewhere.
INSIDE = [
    (f"<article>{ARTICLE}<section class=discussion><h2>Discussion</h2><p>{ONE}</p></section></article>", ["Discussion", ONE]),
    (f"<article>{ARTICLE}<div class=related-work><p>{TWO}</p></div></article>", [TWO]),
    (f"<main>{ARTICLE}<div class=alert-history>{ONE}</div></main>", [ONE]),
    (f"<article>{ARTICLE}</article><div class=social-science-lesson><p>{ONE} {TWO}</p></div>", [f"{ONE} {TWO}"]),
    (f"<article>{ARTICLE}</article><article><p>{ONE} {TWO}</p><p>{TWO} {ONE}</p></article>", [f"{ONE} {TWO}", f"{TWO} {ONE}"]),
    (f"<article>{ARTICLE}<p><a href=1>{ONE}</a></p></article>", [ONE]),
    (f"<article>{ARTICLE}<h2><a href=#x>Part</a></h2><p>{ONE}</p><p>Copyright law, all rights reserved.</p></article>", ["Part", ONE, "Copyright law, all rights reserved."]),
]
MENUS = [
    "<article><ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul>%s</article>",
    "<main>%s<ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul></main>",
    "<article><div><a href=1>Home</a> <a href=2>Sea</a></div>%s<div>Share on Twitter</div><div>Tags: a, b</div></article>",
    "<article>%s<div>12 May</div></article>",
    "<article>%s<div class=related-reading><div>Sea</div><div>Wind</div></div></article>",
]


@pytest.mark.parametrize("page, more", INSIDE)
def test_words_only_lower_the_score_of_parts_of_an_article(page, more):
    assert h.extract_blocks(page) == ["Title", f"{ONE} {TWO}", f"{TWO} {ONE}", *more]


def test_ratios_decide_within_an_article(monkeypatch):
    want = ["Title", f"{ONE} {TWO}", f"{TWO} {ONE}"]
    pages = [m % ARTICLE for m in MENUS]
    assert [h.extract_blocks(p) for p in pages] == [want] * len(MENUS)
    assert h.extract_blocks(f"<article>{ARTICLE}<ul><li><a href=1>Home</a></ul><p>{ONE}</p></article>") == [*want, ONE]
    monkeypatch.setattr(h, "threshold", lambda fused: 0.0)
    assert sum(h.extract_blocks(p) != want for p in pages) == 2  # the others hold links or lines about the page


@pytest.mark.parametrize("line", ["Share on Twitter", "Tags: a, b", "Copyright 2020 Foo Inc.", "All rights reserved"])
def test_lines_about_a_page_without_article(line):
    want = ["Title", f"{ONE} {TWO}", f"{TWO} {ONE}"]
    for page in (f"<div>{ARTICLE}<p>{line}</p></div>", f"<div>{ARTICLE}</div><p>{line}</p>", f"<p>{line}</p><div>{ARTICLE}</div>"):
        assert h.extract_blocks(page) == want
    assert h.extract_blocks(f"<div>{ARTICLE}<p>{line}</p><p>{ONE}</p></div>") == [*want, line, ONE]


class Plain(HTMLParser):
    """Blocks and their tag paths of a well-formed page, by another parser."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.rows, self.text = [], [], ""
        self.feed(page), self.cut()

    def cut(self):
        if self.text.strip():
            self.rows.append((tuple(t for t in self.stack if t not in h.INLINE), " ".join(self.text.split())))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag not in h.INLINE:
            self.cut()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in h.INLINE:
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data


def test_ratios_against_another_version():
    r = random.Random(5)

    def grown(depth):
        if depth == 0 or r.random() < 0.2:
            return " ".join(r.choice(["word", "a, b.", "<b>bold</b>", "end!"]) for _ in range(r.randrange(1, 9)))
        return "".join(f"<{t}>{grown(depth - 1)}</{t}>" for t in (r.choice(["div", "section", "blockquote"]) for _ in range(r.randrange(1, 4))))

    for _ in range(40):
        page = grown(4)
        rows = Plain(page).rows
        own = h.Page(page)
        assert own.texts == [t for _, t in rows]
        paths = [p for p, _ in rows]
        mean = lambda f: [sum(f(t) for q, t in rows if q == p) / paths.count(p) for p in paths]
        length, marks = mean(len), [(a + 1 / paths.count(p)) for a, p in zip(mean(lambda t: len(h.PUNCTUATION.findall(t))), paths)]
        e = h.NEIGHBOUR

        def smooth(x):
            pad = [None, *x, None]
            return [sum(w * v for w, v in zip((e, 1, e), pad[k : k + 3]) if v is not None) / sum(w for w, v in zip((e, 1, e), pad[k : k + 3]) if v is not None) for k in range(len(x))]

        a, b = smooth(length), smooth(marks)
        want = [math.sqrt(x / max(a) * y / max(b)) for x, y in zip(a, b)]
        assert h.path_ratios([own.paths[x] for x in own.elements], own.texts) == pytest.approx(want)
        spread = (sum((x - sum(want) / len(want)) ** 2 for x in want) / len(want)) ** 0.5
        sure = [(x > h.THRESHOLD * spread, y) for x, y in zip(want, h.selected(want)) if abs(x - h.THRESHOLD * spread) > 1e-9]
        assert all(x == y for x, y in sure)


@pytest.mark.parametrize(
    "page, size",
    [
        ("<div " * 100_000, 499_999),
        ("<div>x " * 100_000, 300_000 - 2),
        ("<div>" * 50_000 + "</p>" * 50_000, 0),
        ("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, 0),
        ("<p><li>" + "<b>" * 30_000 + "<h1></h1>" * 30_000, 0),
        ("<a x='>' " * 50_000, None),
        ("<script>" + "</script" * 50_000, 0),
        ("<!--" * 50_000, 0),
    ],
)
def test_time_grows_with_the_length_of_a_broken_page(page, size):
    began = time.process_time()
    text = h.extract(page)
    assert size is None or len(text) == size
    assert time.process_time() - began < 4  # a quadratic reader takes minutes


def test_long_and_broken_pages():
    assert h.extract("<article><p>" + "word " * 200_000 + "</article>") == ("word " * 200_000).strip()
    assert h.extract("<div>" * 3000 + "deep" + "</b></div>" * 10) == "deep"
    assert h.extract('<article><p title="open>a</p><p>b</article>') in ("a\n\nb", "b")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in h.extract_pages(pages).collect()] == [(1, "a"), (1, "a"), (None, "")]
    assert h.extract_pages(pages.where("false")).count() == 0
