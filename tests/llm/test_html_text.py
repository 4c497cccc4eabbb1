import html
import re

import pytest

from emberlog.llm import html_text, queries


def by_hand(page):
    """The article of the driver's page template."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())


def test_driver_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: (r.url, by_hand(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text) == pages[r.page_id] and r.n_chars == len(r.text)


LONG = "A paragraph of the article with quite a few words in it, so that it is dense. "
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="notice">
<header><h2>Site name</h2><p>Slogan of the site</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, a long notice about cookies that says many words and more words still.</p></div>
%s
<aside><p>Sidebar text that nobody wants to read at all.</p></aside>
<section id="comments"><p>First! A reader's comment that is as long as the article's paragraphs, really long.</p></section>
<form><label>Name</label><input value=x><button>Send</button></form><footer>&copy; Footer</footer><script>document.write("<p>no</p>")</script></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Title</h1><p>%s</p><p>Two&nbsp;&amp; three</p></article>" % LONG, "Title " + LONG.strip() + " Two & three"),
        ("<main><h1>T</h1><div><p>%s<p>Next</div><div><p>Other part</p></div></main>" % LONG, "T " + LONG.strip() + " Next Other part"),
        ("<article><p>one<br>two</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "one two a b c d"),
        ("<article><p>in<b>li</b>ne <i>x</i></p>\n\n<p>  spaced \n out </p></article>", "inline x spaced out"),
        ("<article><!-- no --><p>%s</p><div class='ad'>Buy!</div><p>end &lt;tag&gt; &#233;</p></article>" % LONG, LONG.strip() + " end <tag> é"),
        ("<article><p><b>open<p>and on</p></article>", "open and on"),
        ("<article><p>a > b, a < b & c</p></article>", "a > b, a < b & c"),
        ("<article><h1>Only a title</h1></article>", "Only a title"),
        ("<article></article>", ""),
        ("<main><article><p>%s</p><ol class=commentlist><li>Nice!</li></ol><div id=sideBar>s</div></article></main>" % LONG, LONG.strip()),
    ],
)
def test_articles(body, want):
    assert html_text.main_text(PAGE % body) == want


def test_without_article_element():
    body = "<div id=wrap><div class=post><p>%s</p><p>%s</p><p>%s</p></div></div>" % (LONG, LONG, LONG)
    assert html_text.main_text(PAGE % body) == " ".join([LONG.strip()] * 3)


def test_link_lists_lose_against_text():
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>A link with several words in it {i}</a></li>" for i in range(60)) + "</ul></div>"
    body = links + "<div><p>%s</p><p>%s</p></div>" % (LONG * 3, LONG)
    assert html_text.main_text("<html><body>" + body + "</body></html>").startswith("A paragraph of the article")


@pytest.mark.parametrize(
    "page,want",
    [(None, ""), ("", ""), ("just text", "just text"), ("<p>x", "x"), ("<", "<"), ("<p", ""), ("<p>a</p", "a"), ("<!-- open <p>x", ""), ("<script>x", ""), ("&amp", "&"), ("<div>" * 5000 + "deep", "deep"), ("</p></div>x", "x"), ("<p title='>'>q</p>", "q")],
)
def test_broken_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p a=it's>hello world</p><p>second it</p>", "hello world second it"),
        ("<p a=\"it's\" b='say \"x\"' c = 'd>'>hello</p><p>it's</p>", "hello it's"),
        ("<!--> <p>text after empty comment</p>", "text after empty comment"),
        ("<!---><p>x</p><!-- - --!><p>y</p>", "x y"),
        ("<div class=related><p>only block</p></div>", "only block"),
        ('<div class="content has-sidebar"><h1>T</h1><p>%s</p></div><div class=sidebar>s</div>' % LONG, "T " + LONG.strip()),
        ("<div class=comments><p>%s</p><p>%s</p></div><p>short</p>" % (LONG, LONG), "short"),
    ],
)
def test_stray_quotes_comments_and_wrappers(page, want):
    assert html_text.main_text(page) == want


def test_a_misleading_article_loses():
    links = "".join(f"<li><a href=/{i}>teaser {i}</a></li>" for i in range(30))
    page = "<article><ul>%s</ul></article><div><p>%s</p><p>%s</p></div>" % (links, LONG * 2, LONG)
    assert html_text.main_text(page) == (LONG * 3).strip()


def plain_density(page):
    """Densities of well-formed pages by the formula, over a tree of the standard library; name -> (density, sum)."""
    import math
    import xml.etree.ElementTree as E

    root = E.fromstring(page)
    chars = lambda e: sum(len(t.strip()) for t in e.itertext())
    links = lambda e: sum(chars(x) for x in ([e] if e.tag == "a" else e.iter("a")))
    share = links(root) / chars(root)

    def density(e):
        c, lc, t, lt = chars(e), links(e), max(sum(1 for _ in e.iter()) - 1, 1), max(sum(1 for _ in e.iter("a")) - (e.tag == "a"), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        top = math.log(c / max(lc, 1) * t / lt + 1)
        return c / t * (top / math.log(base) if base > math.e else top)

    return {e.get("id"): (density(e), sum(density(x) for x in e if x.tag not in ("a", "b"))) for e in root.iter() if e.get("id")}


def test_densities_equal_the_formula():
    page = (
        "<body id='0'><div id='1'><ul id='2'><li id='3'><a>some link</a></li><li id='4'><a>other</a> text</li></ul></div>"
        "<div id='5'><h1 id='6'>Title</h1><p id='7'>first paragraph with <b>bold</b> words</p><p id='8'>second <a>link</a> here</p></div></body>"
    )
    tree = html_text._Tree(page)
    density, total = tree.densities()
    nodes = [i for i, t in enumerate(tree.tag) if t not in ("a", "b")]
    want = plain_density(page)
    assert len(nodes) == len(want)
    for i, (d, s) in zip(nodes, (want[str(k)] for k in range(len(want)))):
        assert density[i] == pytest.approx(d) and total[i] == pytest.approx(s)


def test_densities_decide(monkeypatch):
    page = "<div><p>%s</p><p>%s</p></div><div><ul><li><a href=/>link</a></li></ul></div>" % (LONG, LONG)
    assert html_text.main_text(page) == (LONG * 2).strip()
    real = html_text._Tree.densities
    monkeypatch.setattr(html_text._Tree, "densities", lambda self: tuple([0.0] * len(x) for x in real(self)))
    assert html_text.main_text(page) != (LONG * 2).strip()


def test_table(spark):
    rows = [(1, None, "u", "x"), (2, "<p>" + "word " * 100_000 + "</p>", None, "y"), (None, "<p>a</p>", "u", "z"), (2, "<p>b</p>", "u", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 1), (1, 0), (2, 1), (2, 499_999)]
    assert html_text.extract_text(df.limit(0)).count() == 0
