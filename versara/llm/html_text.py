"""Main text of web pages by scoring their trees."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table

_TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)")
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles that never hold the article: what is in them goes.
DROPPED = frozenset("nav footer aside head menu button select option svg canvas object audio video dialog label input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
#: Words of class and id that speak against an element, those of them that mean readers' comments, and words
#: that say nothing of what an element holds.
AGAINST = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar widget share sharing social nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay related recommend recommended recommendations pagination pager toolbar skip hidden copyright legal disclaimer outbrain taboola tags sitemap search form".split())
REMARKS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
PLAIN = frozenset("the of and area bar block body bottom box btn button buttons bottom center class col column container content desktop element entry first fixed form group holder icons inner item items js last left link links list main mobile module outer panel post posts primary row secondary section sidebar site slot small sticky story stories text thread top unit wide wrap wrapper right page right".split())
#: How many times the worth of the rest of the page an element has to be worth to stand though its class
#: speaks against it.
OUTWEIGHS = 4.0
CLEAN, MARKED, REMARK, GONE = range(4)
_CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_LISTS = frozenset("ul ol div table section dl p".split())


def _standing(tag: str, raw: str, in_article: bool) -> int:
    """GONE by tag, role or attribute; MARKED or REMARK if its class or id speaks against it, which is weighed
    against the text; else CLEAN. A name speaks against an element if it holds such a word and no word of
    another subject: ``cookie-notice`` does, ``comment-on-law`` doesn't."""
    if tag in DROPPED or tag == "header" and not in_article:
        return GONE
    found = MARKED if tag == "form" else CLEAN
    if not raw or raw.isspace():
        return found
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return GONE
    if attrs.get("role", "").lower() in ROLES:
        return GONE
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return found
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()}
        if words <= AGAINST | REMARKS | PLAIN:
            found = max(found, REMARK if words & REMARKS else MARKED if words & AGAINST else CLEAN)
    return found


class Page:
    """The tree of a page in document order: element i spans elements i to ``end[i]`` - 1. ``blocks`` holds
    [element, text parts, letters of links] in page order; elements that are gone leave none. ``against[i]`` is
    the outermost element at or above i whose class speaks against it (0: none), ``remark`` those of comments."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.end, self.links, self.against = ["#root"], [-1], [0], [0], [0]
        self.remark: set[int] = set()
        self.blocks: list[list] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        tag, parent, end = self.tag, self.parent, self.end
        stack, off, anchors, fresh = [0], [False], [0], True
        at, size, articles = 0, len(source), 0
        opened: Counter[str] = Counter()

        def text(piece: str) -> None:
            nonlocal fresh
            if off[-1] or not piece:
                return
            if fresh:
                if piece.isspace():
                    return
                self.blocks.append([next(i for i in reversed(stack) if tag[i] in BLOCK or not i), [], 0])
                fresh = False
            piece = html.unescape(piece) if "&" in piece else piece
            block = self.blocks[-1]
            block[1].append(piece)
            if anchors[-1]:
                block[2] += len(piece)

        def pop(depth: int) -> None:
            nonlocal fresh, articles
            while len(stack) > depth:
                i = stack.pop()
                off.pop()
                anchors.pop()
                end[i] = len(tag)
                fresh |= tag[i] in BLOCK
                articles -= tag[i] in ("article", "main")
                opened[tag[i]] -= 1

        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if tag[stack[depth]] == name:
                        pop(depth)
                        break
                    if name not in BLOCK and tag[stack[depth]] in ("td", "th", "li", "div", "article", "section", "body", "p"):
                        break
                fresh |= name in BLOCK
                continue
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
                continue
            if name in _CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if tag[stack[depth]] == "p":
                        pop(depth)
                        break
                    if tag[stack[depth]] in BLOCK:
                        break
                if name in HEADINGS and tag[stack[-1]] in HEADINGS:
                    pop(len(stack) - 1)
            if name in _SIBLINGS:
                ends, bounds = _SIBLINGS[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if tag[stack[depth]] in bounds:
                        break
                    if tag[stack[depth]] in ends:
                        pop(depth)
                        if name != "tr" or tag[stack[-1]] != "tr":
                            break
            if name == "br" or name in VOID:
                if name == "hr":
                    fresh = True
                elif name == "br":
                    text(" ")
                continue
            if name in ("html", "body") and opened[name]:
                continue
            i = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            end.append(0)
            self.links.append(name == "a")
            standing = GONE if off[-1] else _standing(name, m[3], articles > 0)
            hide, above = standing == GONE, self.against[stack[-1]]
            self.against.append(above or (i if standing in (MARKED, REMARK) else 0))
            if standing == REMARK and not above:
                self.remark.add(i)
            if m[3].endswith("/") and name not in BLOCK and name != "a":
                end[i] = i + 1
                continue
            stack.append(i)
            opened[name] += 1
            off.append(hide)
            anchors.append(anchors[-1] or name == "a")
            fresh |= name in BLOCK
            articles += name in ("article", "main")
        pop(0)

    def main_text(self) -> str:
        """The blocks of the best container and of its good siblings, one line each.

        What classes speak against is first left aside. Then each such element is weighed, unless there is
        text in an ``article`` or ``main``: it stands if it is worth several times the best container of the
        rest; comments stand only where there is nothing else."""
        blocks = []
        for element, parts, link in self.blocks:
            if line := " ".join("".join(parts).split()):
                blocks.append((element, line, min(link, len(line))))
        rest = [x for x in blocks if not self.against[x[0]]]
        best, score = self._best(rest)
        worth: dict[int, float] = {}
        for element, line, link in blocks:
            if mark := self.against[element]:
                worth[mark] = worth.get(mark, 0.0) + _worth(line, link)
        stand = {m for m, w in worth.items() if m not in self.remark and w > OUTWEIGHS * max(score, 1.0)}
        if not stand and score <= 0:
            stand = set(worth)
        if any(self.tag[i] in ("article", "main") and self.letters[i] for i in range(len(self.tag))):
            stand = set()
        if stand:
            rest = [x for x in blocks if self.against[x[0]] in stand or not self.against[x[0]]]
            best, score = self._best(rest)
        return "\n".join(self._lines(rest, best, score))

    def _best(self, blocks: list) -> tuple[int, float]:
        """The element of the best score. A block's worth goes to the element around its paragraph, half of it
        to the one above, and two thirds of what an element passed on to each further one, up to the root; a
        score is discounted by link density."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        own, passed, letters, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        for element, line, link in blocks:
            letters[element] += len(line)
            linked[element] += link
            if tag[element] not in HEADINGS and tag[element] not in ("summary", "figcaption", "caption"):
                own[element if tag[element] in _CONTAINERS else max(parent[element], 0)] += _worth(line, link)
        for i in range(n - 1, 0, -1):
            letters[parent[i]] += letters[i]
            linked[parent[i]] += linked[i]
            passed[parent[i]] += own[i] / 2 + passed[i] * 2 / 3
        self.letters, self.density = letters, [linked[i] / letters[i] if letters[i] else 0.0 for i in range(n)]
        score = [(own[i] + passed[i]) * (1 - self.density[i]) for i in range(n)]
        best = max(range(n), key=lambda i: (score[i], -i))
        return best, score[best]

    def _lines(self, blocks: list, best: int, score: float) -> list[str]:
        """The lines of the container (of the article around it, if there is one) and of its siblings that are
        text: those with few links that hold a sentence, or are paragraphs, headings, lists or tables
        themselves. Lists of links stay inside an article; elsewhere those go whose links are short."""
        tag, parent, end, letters, density = self.tag, self.parent, self.end, self.letters, self.density
        n = len(tag)
        if score <= 0:
            return [line for _, line, _ in blocks] if density[0] < 0.5 else []
        longest, anchors = [0] * n, self.links[:]
        for element, line, _ in blocks:
            longest[element] = max(longest[element], len(line))
        for i in range(n - 1, 0, -1):
            anchors[parent[i]] += anchors[i]
            longest[parent[i]] = max(longest[parent[i]], longest[i])
        at, tagged = best, False
        while at > 0 and not tagged:
            if tag[at] in ("article", "main"):
                best, tagged = at, True
            at = parent[at]
        kept = [(best, end[best])]
        for i in range(parent[best] + 1, end[parent[best]] if best else 0):
            if parent[i] == parent[best] and i != best and letters[i] and density[i] < (0.25 if letters[i] > 80 else 0.01):
                if tag[i] in _TEXTUAL or longest[i] > 80:
                    kept.append((i, end[i]))
        inside = bytearray(n)
        for a, b in kept:
            inside[a:b] = b"\x01" * (b - a)
        for i in range(1, n):
            if not tagged and tag[i] in _LISTS and anchors[i] > 1 and density[i] > 0.66 and letters[i] < 30 * anchors[i]:
                inside[i : end[i]] = bytes(end[i] - i)
        around = parent[best] if best and not tagged else -1
        return [line for element, line, _ in blocks if inside[element] or element == around and len(line) > 80]


_CONTAINERS = frozenset("div section article main body #root center td blockquote form".split())
_TEXTUAL = HEADINGS | frozenset("p ul ol dl table blockquote pre figure".split())


def _worth(line: str, link: int) -> float:
    """A point for a block, one for each comma and one for every hundred letters, less its share of links."""
    return (1 + line.count(",") + line.count("，") + len(line) / 100) * (1 - link / len(line))


def main_text(source: str | None) -> str:
    """The article's text of a page; empty if there is none."""
    return Page(source).main_text() if source else ""


def _texts(batches):
    for batch in small_batches(batches):
        out = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for every row, from the whole html, however long.

    Null or empty html, and pages without text: an empty text. Of containers with the same score the first in
    the page is taken. Null ids and urls stay null. Repeated rows come back as often; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
