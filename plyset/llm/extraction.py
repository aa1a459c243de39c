"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, threshold clusters.

A page goes once through the standard library's event parser. Block tags end a line; a line has its
text, its number of tags, the characters of it inside links, and the element it lies in. Elements that
say by tag, role, class or id that they are no article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) are left out with all they hold; their lines never count.

Then content regions are sought among the lines, inside ``article`` or ``main`` elements where a page has
them: ratios are smoothed with a Gaussian kernel, lines above a standard deviation are clustered
content, and a region is the marked element or else the smallest element that holds nearly all of the
clusters, with the page's last heading before it. A region is given whole: short paragraphs between
long ones stay, and only lists of several links go.

White space in a line becomes one space, ``br`` counts as white space, character references are
decoded by the parser, and lines are joined by one newline.

The parser of some releases takes time that grows with the square of constructs left open, so a page is
first cut where browsers read no tag any more: from an unclosed comment, and from the last ``<`` without
a ``>``; runs of ``<`` that begin no tag are text.

Defined results: null and empty html, and pages without text, give an empty text; ids and urls may be
null and repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.text import batches

BATCH = 1 << 20
SIGMA = 2.0
RADIUS = 4
#: Share of the clustered text that a region without marks must hold.
COVER = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold paragraphs.
HOLDERS = frozenset("article body center div html main section table tbody td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no article text, whatever they are called.
APART = frozenset(
    "head title script style noscript template nav footer aside form button select option optgroup textarea fieldset iframe frameset noframes noembed object applet embed svg canvas audio video map "
    "menu dialog search datalist".split()
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist note status".split())
#: Words of class and id that say the same; those of the second line also begin longer words.
APART_WORDS = frozenset(
    "ad ads adbox adslot adunit adwrap banner billboard promo promos promotion promoted cookie gdpr consent notice notices alert popup modal overlay toast paywall signup login nav navbar menu menus pager share sharing "
    "social widget widgets related recommended trending footer header masthead topbar sidebar sidebars rail aside reply replies respond disqus discussion toolbar search form copyright legal disclaimer skip skiplink".split()
)
APART_STARTS = ("advert", "adsby", "sponsor", "cookie", "comment", "breadcrumb", "newsletter", "sidebar", "footer", "navig", "subscri", "pagina", "recommend", "skipto", "googlead")
#: Words that turn the next one round: a page "with-sidebar" is not a sidebar.
TURNS = frozenset("has have with no without show hide is not js".split())
NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
COMMENTS = re.compile(r"\W*\d*\W*(?:reader |leserkommentare|user )?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment))\W*\d*\W*", re.IGNORECASE)
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
#: Elements whose end is left out: a new one of these ends the open one of the first list, up to the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
}


def apart_by_name(names: str) -> bool:
    before = ""
    for word in NAMES.findall(names):
        word = word.lower()
        if before not in TURNS and (word in APART_WORDS or word.startswith(APART_STARTS)):
            return True
        before = word
    return False


class Lines(HTMLParser):
    """The lines of a page, with the element each lies in; elements are numbered as they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.apart = ["#page"], [-1], [False]
        self.marked: list[int] = []
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.links = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element
        self.text: list[str] = []
        self.n_tags, self.n_linked, self.at = 0, 0, 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if self.lines and self.tags[self.at] in HEADING and COMMENTS.fullmatch(text):
                self.apart[self.parents[self.at]] = True  # from here on
            elif text:
                self.lines.append((text, self.n_tags, self.n_linked, self.at))
            self.text = []
        self.n_tags, self.n_linked = 0, 0

    def pop(self) -> None:
        tag = self.tags[self.stack.pop()]
        self.open[tag] -= 1
        self.links -= tag == "a"

    def close_first(self, closed: set[str], limit: set[str]) -> None:
        """End the innermost open element of ``closed``, unless one of ``limit`` is nearer."""
        if not any(self.open.get(t) for t in closed):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in limit:
                return
            if tag in closed:
                while len(self.stack) > depth:
                    self.pop()
                return

    def kept_apart(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        inside = self.apart[self.stack[-1]]
        if tag in APART:
            return True
        named = dict(attrs)
        told = f"{named.get('class') or ''} {named.get('id') or ''}"
        role = (named.get("role") or "").lower()
        if tag == "header":
            return True
        if tag in HEADING and self.open.get("header") and self.marked_above():  # an article's own header has its title
            header = next(e for e in self.stack if self.tags[e] == "header")
            return self.apart[self.parents[header]]
        if inside or role in APART_ROLES or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or HIDDEN.search(named.get("style") or ""):
            return True
        if tag in ("html", "body", "main", "a", "h1") or tag == "article" and not self.marked_above():
            return tag == "article" and any(w.lower().startswith("comment") for w in NAMES.findall(told))
        return told != " " and apart_by_name(told)

    def marked_above(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
            if self.open.get("p"):
                self.close_first({"p"}, {"table", "td", "th", "button", "object"})
        self.n_tags += 1
        if tag in ("br", "wbr") or tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in ENDS:
            self.close_first(*ENDS[tag])
        here = len(self.tags)
        self.apart.append(self.kept_apart(tag, attrs))
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(here)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        if not self.apart[here] and (tag in ("article", "main") or any(k == "role" and (v or "").lower() in ("main", "article") for k, v in attrs)):
            self.marked.append(here)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # browsers read <x/> as <x>

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.n_tags += 1
        if tag == "br":
            self.text.append(" ")
        if self.open.get(tag):
            while self.tags[self.stack[-1]] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if self.apart[self.stack[-1]]:
            return
        if not self.text:
            self.at = self.block()
        self.text.append(data)
        if self.links:
            self.n_linked += len(data.strip())

    def block(self) -> int:
        """The innermost open block element."""
        for e in reversed(self.stack):
            if self.tags[e] in BLOCK or e == 0:
                return e


def readable(html: str) -> str:
    """The page without what is left open at its end."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0:
        last = html.rfind("-->")  # the first comment after the last end is the open one
        html = html[: html.find("<!--", last + 1 if last >= 0 else 0)]
    end = html.rfind(">") + 1
    tail = html[end:]
    cut = re.search(r"<[A-Za-z/!?]", tail)
    return html[:end] + (tail[: cut.start()] if cut else tail)


def parse(html: str) -> Lines:
    lines = Lines()
    lines.feed(readable(html))
    lines.close()
    lines.end_line()
    return lines


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """A Gaussian over the neighbours; at the ends the kernel is what lies inside."""
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[RADIUS:-RADIUS]
    return np.convolve(ratio, kernel, "full")[RADIUS:-RADIUS] / weight


def clusters(texts: list[int], tags: list[int], linked: list[int]) -> np.ndarray:
    """Which lines are content by their smoothed ratio; links count as tags do, not as text. At least the best line is."""
    ratio = np.maximum(np.array(texts, float) - np.array(linked, float), 0) / np.maximum(1, np.array(tags, float))
    smooth = smoothed(ratio)
    return (smooth >= smooth.std()) & (smooth > 0) | (smooth >= smooth.max())


def main_text(html: str) -> str:
    page = parse(html)
    n = len(page.tags)
    last = list(range(n))  # the last element inside each one
    for e in range(n - 1, 0, -1):
        last[page.parents[e]] = max(last[page.parents[e]], last[e])
    lines = page.lines
    if not lines:
        return ""

    def within(e: int) -> list[int]:
        return [k for k, x in enumerate(lines) if e <= x[3] <= last[e]]

    outer = []
    for e in page.marked:
        if not outer or e > last[outer[-1]]:
            outer.append(e)
    articles = [e for e in page.marked if page.tags[e] == "article"]
    if len(outer) == 1 and page.tags[outer[0]] == "main":  # a page with one article in its main element
        inner = [e for e in articles if not any(a < e <= last[a] for a in articles)]
        outer = inner if len(inner) == 1 and within(inner[0]) else outer
    marked = [(e, own) for e in outer if (own := within(e))]
    sought = sorted({k for _, own in marked for k in own}) if marked else list(range(len(lines)))
    content = clusters(*([lines[k][c] if c else len(lines[k][0]) for k in sought] for c in range(3)))
    seeds = {k for k, yes in zip(sought, content) if yes}
    if marked:
        chosen = sorted({k for _, own in marked if any(k in seeds for k in own) for k in own})
    else:
        weight = [0] * n
        for k in seeds:
            weight[lines[k][3]] += len(lines[k][0])
        for e in range(n - 1, 0, -1):
            weight[page.parents[e]] += weight[e]
        region = max(e for e in range(n) if weight[e] >= COVER * weight[0])
        while region and (page.tags[region] not in HOLDERS or len(within(region)) == 1):
            region = page.parents[region]  # one paragraph holds the most: its neighbours belong to it
        chosen = within(region)
        first = chosen[0] if chosen else 0
        head = [k for k in range(first) if page.tags[lines[k][3]] == "h1"]
        chosen = (head[-1:] + chosen) if not any(page.tags[lines[k][3]] == "h1" for k in chosen) else chosen

    def link_list(k: int) -> bool:
        text, _, linked, e = lines[k]
        return page.tags[e] in ("li", "td", "dd", "dt") and linked >= 0.9 * len(text.replace(" ", "")) and linked > 0

    lists = {k for k in chosen if link_list(k)}  # a menu has several
    return "\n".join(lines[k][0] for k in chosen if k not in lists or not (lists & {k - 1, k + 1}))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its number of code points."""

    def run(stream):
        for part in batches(stream, "html", BATCH):
            texts = [main_text(h.as_py() or "") for h in part.column("html")]
            same = [part.column(c).combine_chunks() for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    typed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return typed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
