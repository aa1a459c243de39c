import html as entities
import random
import time

import pytest

from plyset.llm.extraction import apart_by_name, clusters, extract, main_text, readable

WORDS = "the of and on in ühr naïve <b a&b to 5>3 with tion ing able said — “no” 日本 then over after".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).strip() + "."


def inline(rng, text):
    """The text as markup that shows the same: references, inline tags, line breaks for blanks."""
    out = []
    for w in text.split(" "):
        w = entities.escape(w) if rng.random() < 0.8 else "".join(f"&#{ord(c)};" for c in w)
        out.append(rng.choice(["{}"] * 6 + ["<b>{}</b>", "<i class='x'>{}</i>", '<a href="/p?a=1&b=2">{}</a>', "<span>{}</span>", "{}<wbr>", "{}<!-- note > -->"]).format(w))
    s = out[0]
    for w in out[1:]:
        s += rng.choice([" "] * 8 + ["\n", "  ", "&nbsp;", "<br>", "\t ", " <br/>\n"]) + w
    return s


BOILERPLATE = [
    "<nav><ul><li><a href=/>{0}</a><li><a href=/b>{1}</a></ul></nav>", '<div class="ad">{0} {1}</div>', '<div id="cookie-banner"><p>{0}</p><button>OK</button></div>', "<aside><p>{0}</p></aside>",
    '<div class="sidebar"><h3>{1}</h3><p>{0}</p></div>', "<form action=/s><label>{0}</label><input name=q><button>{1}</button></form>", "<script>var a = '<p>{1}</p>';</script>", "<style>p > a {{ margin: 0 }}</style>",
    '<div class="advertisement"><a href=/x>{0}</a></div>', '<div class="share-buttons"><a>{1}</a></div>', '<ul class="related"><li><a href=/>{0}</a></li></ul>', '<div role="complementary">{0}</div>', "<noscript>{0}</noscript>",
    '<div class="siteNotice">{0}</div>', '<ins class="adsbygoogle">{0}</ins>', "<iframe src=/x>{0}</iframe>", '<p style="display: none">{0}</p>',
]
AFTER = ['<section id="comments"><h2>Comments</h2><article class="comment"><p>{0}</p></article><p>{1}</p></section>', '<div class="comment-list"><p>{0}</p><div><p>{1}</p></div></div>', "<section><h3>Comments (3)</h3><p>{0}</p><p>{1}</p></section>", "<footer>&copy; {0}</footer>"]


def page(seed):
    rng = random.Random(seed)
    paragraphs = [sentence(rng, rng.choice([1, 2, 8, 30, 80, 200])) for _ in range(rng.randint(1, 12))] + [sentence(rng, 40)]
    rng.shuffle(paragraphs)
    title = sentence(rng, 6)
    part = lambda kinds: rng.choice(kinds).format(entities.escape(sentence(rng, rng.choice([3, 15, 60]))), entities.escape(sentence(rng, 3)))
    body = ""
    for p in paragraphs:
        if rng.random() < 0.3:
            body += part(BOILERPLATE)
        kind = rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>"])
        body += kind.format(inline(rng, p)) + rng.choice(["", "\n", "<hr>"])
    head = f"<h1>{inline(rng, title)}</h1>"
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div id="content" class="post">', "</div>"), ('<div class="page with-sidebar"><div class="text">', "</div></div>")])
    inner = "" if "text" in open_ and False else head
    top = "".join(part(BOILERPLATE) for _ in range(rng.randint(0, 4)))
    end = "".join(part(BOILERPLATE + AFTER) for _ in range(rng.randint(0, 4)))
    inside = part(AFTER) if rng.random() < 0.4 else ""
    text = f"<!DOCTYPE html><html><head><title>{entities.escape(title)}</title></head><body><header><h2>{part(['{1}'])}</h2></header>{top}{open_}{inner}{body}{inside}{close}{end}"
    text += rng.choice(["</body></html>", "", "<footer>" + entities.escape(sentence(rng, 9)), "<!-- open " + entities.escape(sentence(rng, 9))])
    return text, "\n".join(" ".join(x.split()) for x in [title, *paragraphs])


@pytest.mark.parametrize("seed", range(150))
def test_generated_pages(seed):
    html, want = page(seed)
    assert main_text(html) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""), ("plain text", "plain text"), ("<p>one<p>two", "one\ntwo"), ("<p>a&amp;b &lt;x&gt;&nbsp; c</p>", "a&b <x> c"), ("<script>x", ""), ("<nav>menu</nav>", ""),
        ("<body><p>a<br>b<br/>c</p>", "a b c"), ("<p>in<b>si</b>de</p>", "inside"), ("<article><p>short</p></article><div><p>" + "long words " * 50 + "</p></div>", "short"),
        ("<p>before<!-- never ends <p>after", "before"), ("<p>1 < 2 and <x", "1 < 2 and"), ("<article><header><h1>Title</h1><p>By X</p></header><p>Text of it.</p></article>", "Title\nText of it."),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"), ("<main><p>a</p><form><p>b</p></form><p>c</p></main>", "a\nc"), ("<article><div class='no-ads'><p>kept</p></div></article>", "kept"),
        ("<article><p>x</p><div class=comments><p>c</p>", "x"), ("<article><p>one</p><h3>Comments</h3><p>two</p></article>", "one"), ("<main><h2>News</h2><article><h1>T</h1><p>" + "words " * 60 + "</p></article></main>", "T\n" + " ".join(["words"] * 60)),
    ],
)
def test_pages_by_hand(html, want):
    assert main_text(html) == want


def test_names():
    assert all(map(apart_by_name, ["ad", "top-ad", "adSlot", "ads_wide", "cookieBar", "site-footer", "commentList", "newsletter2", "x sidebar"]))
    assert not any(map(apart_by_name, ["address", "added", "header-less article"[7:], "with-sidebar", "no-ads", "shadow", "radio", "leaderboard", "content", "roadside"]))


def test_clusters_pick_the_dense_lines():
    chosen = clusters([5] * 20 + [400, 3, 500] + [5] * 20, [3] * 20 + [2] * 3 + [3] * 20, [5] * 20 + [0] * 3 + [5] * 20)
    assert chosen[20:23].all() and not chosen[:15].any() and not chosen[-15:].any()
    assert clusters([3], [2], [0]).all()


def test_time_stays_near_linear():
    begin = time.process_time()
    for s in ("<" * 100_000, "<a " * 30_000, "<a " * 30_000 + ">", "<!--" * 30_000, '<a b="' * 10_000, '<a b="' * 3_000 + ">", "</" * 30_000, "<div>" * 30_000 + "x", "<p>a" * 30_000, "<li>b" * 30_000, "x" * 2_000_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "&amp" * 50_000):
        main_text(s)
    assert time.process_time() - begin < 20
    assert readable("a<!-- x --> b <!-- c <!-- d") == "a<!-- x --> b "


def test_defined_results(spark):
    rows = [(None, None, None, 1), (2, "u", "", 2), (2, "u", "<p>é🙂</p>", 3), (3, "v", "<p>" + "long " * 300_000, 4)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "", 0), (2, "u", 0), (2, "u", 2), (3, "v", 1_499_999)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
