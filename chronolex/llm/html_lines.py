"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one line for each block of the page, with character references decoded and white space made
single. Lines inside boilerplate containers (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles) go with the markup, and so do lines outside the article where a page marks one. A line that is left weighs its
letters and digits outside links; headings weigh with their links. Weights are summed over a sliding window of lines. The
text surges where the sums leave zero and dives where a whole window weighs nothing: every line of such a window is dropped,
and all lines between a surge and the next dive are the text, light ones included. So lists of links go, wherever they are,
and no block and no page goes for being short.

Beyond the first and the last line of a page there are lines without weight, so links at a page's edges go; the edges that
markup gives to an article have nothing beyond them. An article in which nothing weighs is kept whole.

Defined results: a null or empty page, or one without text, has an empty text and 0 characters. Unclosed comments, scripts
and styles are read to the end of the page, as browsers do; other unclosed and stray tags swallow nothing. Rows are
independent; ties cannot arise.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from chronolex.llm.common import col, id_type, map_texts

WINDOW = 3
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
#: Elements whose content is no text of the page; those in the first list last to the page's end where they are not closed.
RAW = ("script", "style")
OPAQUE = {t: re.compile(f"</{t}\\s*>", re.I) for t in (*RAW, "textarea", "template", "noscript", "iframe", "svg", "select", "title", "button")}
HREF = re.compile(r"(?:^|\s)href\b", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NO_WORD = re.compile(r"[\W_]+")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html main menu nav ol pre section table ul p li td th dd dt span figcaption".split())
DROPPED = frozenset("nav footer aside form head menu dialog header".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)|sponsor(?:ed)?|promo(?:tion)?|banner|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|site-?header|masthead|top-?bar|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|login|search|comments?|comment-?list|disqus|replies|reply|respond|related|recommend(?:ed|ations)?|share|sharing|social|widget|pagination|pager|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-]|\d)", re.I)
HEADER = re.compile(r"(?:^|\s)(?:page|site|main|top|global)?[_-]?header(?:$|\s)", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
VOID_BLOCKS = frozenset(("hr",))
CONTENT = re.compile(r"(?:^|\s)(?:article|post|story|entry)(?:-(?:body|content|text|main))?(?:$|\s)|(?:^|\s)(?:main|page|body)-?content(?:$|\s)|(?:^|\s)content-?(?:body|main)(?:$|\s)", re.I)


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and (MARKED.search(value) or not in_article and HEADER.search(value)):
            return True
    return False


def begins_article(tag: str, attributes: str) -> bool:
    """An article or main element, or a container that says in its role, class or id that it is one."""
    if tag in ("article", "main"):
        return True
    if not attributes or tag not in ("div", "section", "td"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ("main", "article") or name in ("class", "id") and CONTENT.search(value):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """Text, in a boilerplate container, in the article, weight: for each line that has text."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    free: list[str] = []
    in_link = False
    never_closed: set[str] = set()

    def end_line() -> None:
        nonlocal parts, free, in_link
        in_link = False
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                weighs = text if len(free) == len(parts) else entities.unescape("".join(free))
                out.append((text, stack[-1][1], stack[-1][2], len(NO_WORD.sub("", weighs))))
            parts, free = [], []

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if not in_link:
                free.append(text)

    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in OPAQUE and not slash and tag not in never_closed:
            if end := OPAQUE[tag].search(page, at):
                at = end.end()
                continue
            if tag in RAW:
                at = len(page)
                break
            never_closed.add(tag)
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            in_link = not slash and stack[-1][0] not in HEADINGS and HREF.search(attributes) is not None
        if tag not in BLOCKS and tag != "span":
            continue
        if tag in BLOCKS:
            end_line()
        if tag in VOID_BLOCKS or attributes.endswith("/") and tag == "span":
            continue
        if slash:
            if tag in CONTAINERS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag in ("p", "span", "li", "td", "th", "dd", "dt") and stack[k][0] not in ("p", "span"):
                        break
            continue
        if tag in CONTAINERS:
            if tag in ("body", "article", "main"):
                while any(name == "head" for name, _, _ in stack):
                    stack.pop()
            _, skip, inside = stack[-1]
            if tag in BLOCKS:
                while stack[-1][0] in ("p", "span") or tag in ("li", "dd", "dt", "td", "th") and stack[-1][0] in ("li", "dd", "dt", "td", "th"):
                    stack.pop()
                _, skip, inside = stack[-1]
            own = unwanted(tag, attributes, inside)
            if own and tag == "span":
                end_line()
            if tag in ("h1", "h2") and inside and stack[-1][0] == "header" and not own:
                skip = any(s for _, s, _ in stack[:-1])
            stack.append((tag, skip or own, inside or begins_article(tag, attributes)))
    add(page[at:].rpartition("<")[0] if re.match(r"[^<]*<[A-Za-z/!][^<>]*\Z", page[at:]) else page[at:])
    end_line()
    return out


def between(weights: list[int], edges: bool, window: int = WINDOW) -> list[bool]:
    """For each line whether it is between a surge and a dive: in no window of lines without weight.

    edges says that lines without weight lie beyond the first and the last line.
    """
    beyond = window - 1 if edges else 0
    w = [0] * beyond + weights + [0] * beyond
    window = min(window, len(w))
    out = [True] * len(w)
    total = sum(w[:window])
    for k in range(len(w) - window + 1):
        if k:
            total += w[k + window - 1] - w[k - 1]
        if not total:
            out[k : k + window] = [False] * window
    return out[beyond : beyond + len(weights)]


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The lines between surges and dives."""
    lines = [x for x in lines_of(page) if not x[1]] if page else []
    marked = any(inside for _, _, inside, _ in lines)
    if marked:
        lines = [x for x in lines if x[2]]
    weights = [n for *_, n in lines]
    if marked and not any(weights):
        weights = [len(t) for t, *_ in lines]
    return "\n\n".join(t for (t, *_), kept in zip(lines, between(weights, not marked, window), strict=True) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""

    def make():
        def f(rows):
            out = [main_text(h) for h in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": out, "n_chars": list(map(len, out))}

        return f

    own = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return map_texts(own, make, f"page_id {id_type(pages, id_col)}, url string, text string, n_chars long")
