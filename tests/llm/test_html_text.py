import html
import re

import pytest

from versara.llm.common import table
from versara.llm.html_text import Page, extract, main_text, op9_html

ARTICLE = "The first paragraph has some length, a few commas, and so counts for its container. " * 2


def test_whole_table(spark, sf):
    """The pages' articles, cut by their own tags."""
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = op9_html(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", body)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


@pytest.mark.parametrize(
    "noise",
    [
        '<nav><a href="/">Home</a><a href="/x">About, us</a></nav>', "<header><h1>Site name</h1></header>", "<footer><p>Copyright, all rights, reserved, for ever.</p></footer>",
        '<aside class="sidebar"><p>Other, stories, that, you, may, like.</p></aside>', '<div id="cookie-notice">We use cookies, accept?</div>', '<div class="ad-slot"><p>Buy now, cheap, cheap, cheap, cheap, cheap.</p></div>',
        "<form><label>Name, please</label><input></form>", '<script>var x = "<p>no, no, no</p>";</script>', "<style>p{color:red}</style>", '<section id="comments"><div class="comment"><p>I disagree, with, all, of, this, entirely.</p></div></section>',
        '<div class="related-posts"><ul><li><a href="a">One story</a></li><li><a href="b">Two story</a></li></ul></div>', "<!-- a comment, with, commas -->", '<div style="display:none">hidden, text, here</div>', '<ul><li><a href="1">Menu one</a></li><li><a href="2">Menu two</a></li></ul>',
    ],
)
@pytest.mark.parametrize("shape", ["<article><h1>Head</h1>{}</article>", '<div class="page"><div class="post-content"><h1>Head</h1>{}</div></div>', "<main><h1>Head</h1><div>{}</div></main>"])
def test_noise_goes_and_text_stays(noise, shape):
    body = shape.format(f"<p>{ARTICLE}<p>Second &amp; <b>bo</b>ld &lt;tag&gt;\n caf&eacute;, one,<br>two.</p><ul><li>item one</li><li>item two</li></ul><p>Short.</p>")
    want = f"Head\n{ARTICLE.strip()}\nSecond & bold <tag> café, one, two.\nitem one\nitem two\nShort."
    for page in (f"<html><head><title>T</title></head><body>{noise}{body}</body></html>", f"<body>{body}{noise}"):
        assert main_text(page) == want


LONG = "Here is a sentence of the article, with a comma, and with words enough to count for something. "


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f'<body><nav><a href="/">Home</a></nav><div class="legal-notice"><h1>Act</h1><p>{LONG}</p><p>{LONG * 2}</p></div></body>', ["Act", LONG, LONG * 2]),
        (f'<article><p>{LONG}</p><p class="comment-on-law">On the law, briefly.</p></article>', [LONG, "On the law, briefly."]),
        (f'<body><div><p>{LONG}</p><div class="social-history-text"><p>Social history, in short.</p></div></div></body>', [LONG, "Social history, in short."]),
        (f"<article><header><h1>Head</h1><p>A lead, short.</p></header><p>{LONG}</p></article>", ["Head", "A lead, short.", LONG]),
        (f'<article><p>{LONG}</p><ul><li><a href="1">Smith (1990)</a></li><li><a href="2">Jones (1991)</a></li></ul></article>', [LONG, "Smith (1990)", "Jones (1991)"]),
        (f'<body><div class="wrap"><div><p>{LONG * 10}</p></div><div><p>{LONG}</p></div></div></body>', [LONG * 10, LONG]),
        (f'<body><form><div id="main"><p>{LONG}</p><p>{LONG}</p></div></form></body>', [LONG, LONG]),
        (f'<body><div><p>{LONG}</p><p>{LONG}</p></div><div id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>', [LONG, LONG]),
        (f'<body><div><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></body>', [LONG, LONG]),
        ("<div>" * 40 + f"<p>{LONG}</p>" + "</div>" * 40 + f"<div><p>{LONG}</p></div>", [LONG]),
    ],
)
def test_text_outweighs_names(page, kept):
    assert main_text(page) == "\n".join(x.strip() for x in kept)


def brute_scores(tree, at=()):
    """Scores of a tree of (tag, children) with texts as leaves, by walking from each paragraph to the root."""
    scores, letters = {}, {}

    def walk(node, path):
        tag, children = node
        for i, child in enumerate(children):
            if isinstance(child, str):
                worth = 1 + child.count(",") + len(child) / 100
                up = path if tag == "div" else path[:-1]
                for level in range(len(up)):
                    scores[up[: len(up) - level]] = scores.get(up[: len(up) - level], 0) + worth * (1 if not level else 0.5 * (2 / 3) ** (level - 1))
            else:
                walk(child, (*path, i))

    walk(tree, (0,))
    return scores


def test_scores_against_brute_force():
    import random

    rng = random.Random(3)

    def grow(depth):
        if not depth or rng.random() < 0.3:
            return ("p", ["x" * rng.randrange(1, 200) + "," * rng.randrange(4)])
        return ("div", [grow(depth - 1) for _ in range(rng.randrange(1, 4))])

    show = lambda node: node if isinstance(node, str) else f"<{node[0]}>{''.join(map(show, node[1]))}</{node[0]}>"
    for _ in range(50):
        tree = ("div", [grow(5), grow(5)])
        page = Page(show(tree))
        best, score = page._best([(e, "".join(parts), link) for e, parts, link in page.blocks])
        assert score == pytest.approx(max(brute_scores(tree).values()))


@pytest.mark.parametrize(("source", "want"), [(None, ""), ("", ""), ("just text", "just text"), ("<p>One.", "One."), ("a < b", "a < b"), ("<p>&nbsp;</p>", ""), ("<div>a<p>b</div>c", "a\nb\nc"), ("<table><tr><td>x<td>y</table>", "x\ny"), ("<p>unclosed <b", "unclosed")])
def test_small_pages(source, want):
    assert main_text(source) == want


def test_large_and_broken_pages_end(spark):
    for source in ("<div>" * 20_000 + "x", "<p>a, b" * 20_000, "<" * 50_000, "<a x='" * 5_000, "</div>" * 20_000, "<b>" * 20_000 + "</p>" * 20_000, "<!--" * 20_000, "<script>" * 1_000):
        main_text(source)
    assert main_text("<p>" + "long, " * 100_000 + "end</p>").endswith("end")


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>a</p>", "t", 1), (1, "u", "<p>a</p>", "t", 1), (None, None, None, None, None), (2, None, "", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted((str(r.page_id), r.text) for r in extract(df).collect()) == [("1", "a"), ("1", "a"), ("2", ""), ("None", "")]
    assert extract(df.where("false")).collect() == []
