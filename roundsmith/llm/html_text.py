"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags, in one linear scan. Pass 1 classifies each block by link
density, stop-word density and length; blocks within navigation, forms, adverts or comments (by element,
role or class) are bad, and blocks without a clear verdict are short. Pass 2 gives each short block the
label of its nearest decided neighbour, first within its own container, else across containers; of two
as near, a heading takes the one after, others the one before.

Hints, not needed for a verdict: an article or main element keeps its blocks apart from those around it,
which are at best short and have no good neighbours. Class names that would leave a page without text are
not believed. Where no block is good, as on pages of short blocks or in a language without a list here,
blocks that are not bad are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage

#: Share of a block's characters in links from which it is bad, and up to which a block can be good.
LINK_HIGH, LINK_LOW = 0.5, 0.2
#: Share of stop words from which a block of SHORT characters is good; below the second, a page is taken
#: for one in another language, and a long block of a page in a known one for no prose.
STOP_HIGH, STOP_LOW = 0.15, 0.03
SHORT, LONG = 70, 140
SKIP = frozenset("script style noscript template iframe object svg math canvas audio video map select datalist textarea title button".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
PLACE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article aside body center details dialog div footer form header main menu nav section td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CUE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|sidebar\w*|side|nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|masthead|header|footer|foot|copyright|legal|disclaimer|comment\w*|disqus|repl(?:y|ies)|respond|discussion|related|recommended|share|sharing|social|widget\w*|teaser|tags)(?=$|[\s_-])", re.I)
ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form alertdialog".split())
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[^\W\d_]+")
NOTE = re.compile(r"\W*(?:©|\(c\) |copyright\b)", re.I)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("a an and are as at be by for from has he in is it its of on that the this to was were will with or but not you they we his her which have had der die das und ist von zu den mit sich des auf für nicht ein eine als auch dem im le la les de du et un une est que qui dans pour par sur pas au aux avec ne se en il elle el los las y una con por para su al lo del como más o".split())


@dataclass(slots=True)
class Block:
    text: str
    links: int  # code points of links, white space apart
    place: int  # 2: within an element or role of boilerplate; 1: only a class or id says so; 0: neither
    inside: int  # number of the article element around it, 0 if none
    parent: int  # number of the container around it
    head: bool = False  # a heading


def _cue(name: str, attrs: str) -> int:
    if name in PLACE:
        return 2
    found = 0
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLE:
            return 2
        if key in ("class", "id") and CUE.search(value):
            found = 1
    return found


class _Tags:
    """Finds where tags end, in time linear in the page whatever it holds."""

    def __init__(self, html: str):
        self.html, self.plain = html, False
        self.unclosed = {'"': len(html) + 1, "'": len(html) + 1}  # from here on no such quote follows

    def end(self, at: int) -> int:
        """Place of the > that ends a tag: the first one outside quoted values; -1 if there is none at all.
        Once quotes would take all that is left for one tag, they have no meaning from there on."""
        html, pos = self.html, at
        while not self.plain:
            m = STOP.search(html, pos)
            if not m:
                self.plain = True
                break
            k = m.start()
            if m[0] == ">":
                return k
            pos = k + 1
            before = k - 1
            while before >= at and html[before].isspace():
                before -= 1
            if before >= at and html[before] == "=" and k < self.unclosed[m[0]]:
                close = html.find(m[0], pos)
                if close < 0:
                    self.unclosed[m[0]] = k
                else:
                    pos = close + 1
        return html.find(">", at)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, with white space as one space; empty ones are left out."""
    out: list[Block] = []
    parts: list[str] = []
    links, n_articles, n_parents, heading = 0, 0, 0, False
    stack: list[tuple] = []  # name, state
    opened: dict[str, int] = {}
    start = (0, False, 0, 0)  # place, link, article, parent
    state = start
    tags = _Tags(html)

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, links, state[0], state[2], state[3], heading))
            parts, links = [], 0

    def pop() -> str:
        nonlocal state
        name = stack.pop()[0]
        opened[name] -= 1
        state = stack[-1][1] if stack else start
        return name

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        m = NAME.match(html, lt + 1) if 0 <= lt else None
        while lt >= 0 and not m and html[lt + 1 : lt + 2] not in ("!", "?"):  # a bare < is text
            lt = html.find("<", lt + 1)
            m = NAME.match(html, lt + 1) if 0 <= lt else None
        end = lt if lt >= 0 else n
        stop = -1
        if m:
            stop = tags.end(m.end())
            if stop < 0:  # no tag ends any more: the rest is text
                end, lt = n, -1
        if end > at:
            chunk = unescape(html[at:end])
            parts.append(chunk)
            if state[1]:
                links += len("".join(chunk.split()))
        if lt < 0:
            break
        if not m:  # a comment or declaration
            if html.startswith("<!--", lt):
                k = html.find("-->", lt + 4)
                at = k + 3 if k >= 0 else n
            else:
                k = html.find(">", lt)
                at = k + 1 if k >= 0 else n
            continue
        at, attrs = stop + 1, html[m.end() : stop]
        closing = m[0][0] == "/"
        name = m[0][closing:].lower()
        if name in BLOCK:
            close()
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closing
        elif name == "br":
            parts.append(" ")
        if closing:
            if opened.get(name):
                while pop() != name:
                    pass
            continue
        if name in SKIP:
            if name in RAW:
                k = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                k = k.start() if k else n
            else:
                k = _past(html, name, at)
            k = html.find(">", k)
            at = n if k < 0 else k + 1
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        while stack and stack[-1][0] in CLOSES.get(name, {"p"} if name in BLOCK else ()):
            pop()
        place, link, article, parent = state
        cue = _cue(name, attrs)
        if name in ("article", "main") and not cue and not article:
            n_articles += 1
            place, article = 0, n_articles  # a container left open before it does not hold it
        elif cue and name not in ("body", "html"):
            place = max(place, cue)
        if name in CONTAINER:
            n_parents += 1
            parent = n_parents
        state = (place, link or name == "a", article, parent)
        if name in BLOCK or name == "a" or cue:
            stack.append((name, state))
            opened[name] = opened.get(name, 0) + 1
    close()
    return out


def _past(html: str, name: str, at: int) -> int:
    """Where the end tag of an element with nested ones of its name begins; the text's end if nowhere."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start()
    return len(html)


def link_density(b: Block) -> float:
    return b.links / max(1, len("".join(b.text.split())))


def stop_density(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(page: list[Block], trust: int = 1) -> list[str]:
    """good, bad, or short for each block. trust: the least place that is believed to be boilerplate."""
    free = [b.place < trust or not b.place for b in page]
    density = [stop_density(b.text) if f else (0, 0) for b, f in zip(page, free, strict=True)]
    hits, words = sum(d[0] for d in density), sum(d[1] for d in density)
    known = hits >= STOP_LOW * words
    has_article = any(f and b.inside for b, f in zip(page, free, strict=True))
    linked = [f and link_density(b) >= LINK_HIGH for b, f in zip(page, free, strict=True)]
    out = []
    for k, (b, f) in enumerate(zip(page, free, strict=True)):
        if not f:
            out.append("bad")
        elif linked[k]:  # within an article, and as a heading, a single link is no menu
            menu = k and linked[k - 1] and not page[k - 1].head or linked[k + 1 : k + 2] == [True] and not page[k + 1].head
            out.append("short" if b.head or b.inside and not menu else "bad")
        elif has_article and not b.inside:
            out.append("short")
        elif len(b.text) < LONG and not b.inside and NOTE.match(b.text):
            out.append("bad")
        elif len(b.text) >= SHORT and (density[k][0] >= STOP_HIGH * density[k][1] > 0 or not known) and link_density(b) < LINK_LOW:
            out.append("good")
        elif len(b.text) >= LONG and link_density(b) < LINK_LOW and density[k][0] >= STOP_LOW * density[k][1]:
            out.append("good")
        else:
            out.append("short")
    return out


def second_pass(page: list[Block], labels: list[str]) -> list[str]:
    """Labels of all blocks: short ones take that of the nearest decided neighbour."""
    n = len(page)
    has_article = any(b.inside for b, label in zip(page, labels, strict=True) if label != "bad")
    any_good = "good" in labels

    def sweep(order: Iterator[int]) -> list[tuple[int, int]]:
        """For each block the last decided one in this order: of its container, and of its article."""
        own: dict[int, int] = {}
        near: dict[int, int] = {}
        found = [(-1, -1)] * n
        for k in order:
            b = page[k]
            found[k] = own.get(b.parent, -1), near.get(b.inside, -1)
            if labels[k] != "short" and not (b.inside and b.place):  # boilerplate inside an article says nothing of its neighbours
                own[b.parent] = near[b.inside] = k
        return found

    before, after = sweep(range(n)), sweep(range(n - 1, -1, -1))
    out = list(labels)
    for k in range(n):
        if labels[k] != "short":
            continue
        b = page[k]
        if not any_good:
            out[k] = "good" if b.inside or not has_article else "bad"
            continue
        for level in (0, 1):
            x, y = before[k][level], after[k][level]
            if x >= 0 or y >= 0:
                first = y < 0 or x >= 0 and (k - x < y - k or k - x == y - k and not b.head)
                out[k] = labels[x if first else y]
                break
        else:
            out[k] = "good" if b.inside else "bad"
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: its good blocks, joined by line ends; empty for none or a null page."""
    page = blocks(html or "")
    for trust in (1, 2):
        labels = second_pass(page, first_pass(page, trust))
        if "good" in labels or all(b.place != 1 for b in page):
            break
    return "\n".join(b.text for b, label in zip(page, labels, strict=True) if label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html).

    Null html counts as empty and gives an empty text; null ids and urls stay null; rows that repeat
    stay; other columns are ignored; an empty table gives no rows. Texts are never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(storage.table(spark, sf_dir, "pages"))
