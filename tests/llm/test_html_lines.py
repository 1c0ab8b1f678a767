import html as entities
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import html_lines, registry

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a>b}</style><script>var t="</p><p>no";</script></head><body class="main-menu-open">
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="header"><p>Some site header</p></div><div class="cookie-notice">We use cookies.</div><aside>Side text that is long enough to count as text in any case, surely.</aside>
{open}<header><h1>Title &amp; more</h1><p>By someone</p></header><p>First   para&shy;graph<br>with&nbsp;a <b>bold <i>word</b> and 1 &lt; 2.
<p>Of.</p><div class="ad">Buy now</div><blockquote>Quoted text</blockquote><ul><li>one<li>two</ul><form><label>Mail</label><input></form>
<section id="comments"><h2>Comments</h2><p>Nice one!</p></section><p>Last.</p>{close}
<footer>&copy; us</footer><!-- <p>hidden</p> --><p class="advert">ad</p></body></html>"""


def test_article_page():
    text = html_lines.main_text(PAGE.replace("{open}", "<article>").replace("{close}", "</article>"))
    assert text.split("\n\n") == ["Title & more", "First para\xadgraph with a bold word and 1 < 2.", "Of.", "Quoted text", "one", "two", "Last."]


def test_other_article_marks():
    want = html_lines.main_text(PAGE.replace("{open}", "<article>").replace("{close}", "</article>"))
    for tag in ('div class="post-content wide"', "div id=article", "section role='main'", "main"):
        assert html_lines.main_text(PAGE.replace("{open}", f"<{tag}>").replace("{close}", f"</{tag.split()[0]}>")) == want


def test_page_without_article_marks():
    body = "".join(f"<p>Paragraph {k} of a text that goes on for a good while, as articles do.</p>" for k in range(5))
    page = f"<body><nav><a href=x>Home</a></nav><div><a href=a>Link one</a></div><div><a href=b>Link two</a></div>{body}<div><a href=c>Next page of links to read</a></div></body>"
    assert html_lines.main_text(page).count("\n\n") == 4 and "Link" not in html_lines.main_text(page)


def test_damaged_markup():
    assert html_lines.main_text(None) == html_lines.main_text("") == html_lines.main_text("<p>") == ""
    assert html_lines.main_text("<article><p>text <!-- never closed <p>x") == "text"
    assert html_lines.main_text("<article><p>text<script>x") == "text"
    assert html_lines.main_text("<article><p>text</div></nav></article> <p>later") == "text"
    assert html_lines.main_text("<article><p>a < b and c</p><p title='>'>q</p></article>") == "a < b and c\n\nq"
    assert html_lines.main_text("<article><p>one" + "<b>" * 3000 + "</article>") == "one"
    assert html_lines.main_text("just text") == "just text"
    assert html_lines.main_text("<body><h1>T</h1><p>A short page.</p></body>") == "T\n\nA short page."
    for tag in ("button", "svg", "select", "title", "iframe", "template", "noscript", "textarea"):
        assert html_lines.main_text(f"<article><p>one<{tag} x=1><p>two</article>") == "one\n\ntwo"
        assert html_lines.main_text(f"<article><p>one<{tag} x=1>no</{tag.upper()} ><p>two</article>") == "one\n\ntwo"
    assert html_lines.main_text("<head><title>T<body><p>text") == "text"
    assert html_lines.main_text("<article><a name=top>One<p>two <a href=x>three<p>four</article>") == "One\n\ntwo three\n\nfour"
    assert len(html_lines.main_text("<article>" + "<p>x<svg><button>" * 20_000)) == 20_000 * 3 - 2


def test_query_against_the_pages_own_structure(spark, sf):
    """In these pages the article element is the main text, in blocks that p and h1 begin."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = registry.op7_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<article>" + "<p>word word</p>" * 30_000, "t"), (2, "u", "<article><p>x", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_lines.extract(df).collect()
    assert len(out) == 4 and sorted(r["n_chars"] for r in out) == [0, 0, 1, 30_000 * 9 + 29_999 * 2]
    assert html_lines.extract(df.filter("false")).count() == 0


def link(k):
    return f"<div><a href=/{k}>Link number {k}</a></div>"


def plain_between(weights, edges, window):
    """The same by looking at every window that holds a line."""
    far = window - 1 if edges else 0
    at = lambda k: weights[k] if 0 <= k < len(weights) else 0
    first, last = -far, len(weights) - 1 + far
    size = min(window, last - first + 1)
    return [not any(not sum(at(k) for k in range(s, s + size)) for s in range(max(first, i - size + 1), min(i, last - size + 1) + 1)) for i in range(len(weights))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from((0, 0, 0, 1, 90)), max_size=25), st.booleans(), st.integers(1, 5))
def test_windows_against_every_window(weights, edges, window):
    got = html_lines.between(weights, edges, window)
    assert got == plain_between(weights, edges, window)
    assert all(kept for kept, w in zip(got, weights, strict=True) if w)


def test_windows_choose_on_every_page():
    """Lists of links go, inside marked articles too; fewer links than a window stay between paragraphs."""
    two, three = link(1) + link(2), link(1) + link(2) + link(3)
    for start, end in (("<article>", "</article>"), ("<body>", "</body>"), ("<div class=post-content>", "</div>")):
        for links, n in ((two, 2), (three, 0), (three + link(4), 0)):
            text = html_lines.main_text(f"{start}<p>First.</p>{links}<p>Of.</p><div class=ad>Buy</div>{end}")
            assert text.split("\n\n") == ["First."] + [f"Link number {k + 1}" for k in range(n)] + ["Of."]
        assert html_lines.main_text(f"{start}<p>First.</p>{three}<p>Of.</p>{end}", window=4).count("Link") == 3
    assert html_lines.main_text(f"<body>{link(1)}<p>Short.</p>{two}</body>") == "Short."
    assert html_lines.main_text(f"<article>{link(1)}<p>Short.</p>{two}</article>").count("\n\n") == 3
    assert html_lines.main_text(f"<article>{three}</article>").count("Link") == 3 and html_lines.main_text(f"<body>{three}</body>") == ""
    assert html_lines.main_text("<body><p><a href=a>A</a> | <a href=b>B</a> | <a href=c>C</a></p><p>Text</p></body>") == "Text"
    assert html_lines.main_text("<article><h1><a href=x>Title</a></h1><p><a href=y>Author</a></p><p><a href=z>Topic</a></p></article>").startswith("Title")


def test_adverts_inside_and_outside_of_unmarked_text():
    body = "<p>Short lead</p><p>" + "A paragraph of some length. " * 5 + "</p>"
    page = f"<body><div class=banner>Big sale</div>{body}<div id=ad-1><p>Buy this</p><p>Or that</p><p>Or both</p></div><p>Last.</p><div class=sponsored>More</div>{link(1)}</body>"
    assert html_lines.main_text(page).split("\n\n") == ["Short lead", ("A paragraph of some length. " * 5).strip(), "Last."]


def test_pages_without_their_article_marks(spark, sf):
    """The same text comes from these pages when nothing marks the article."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", r["html"])
        assert set(html_lines.main_text(r["html"]).split("\n\n")) <= set(html_lines.main_text(bare).split("\n\n"))
