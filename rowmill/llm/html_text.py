"""Main text of web pages by line-block distribution.

Markup is stripped in one pass to a list of lines, one for each block of the page in order, each with its length, the length
of its links and the element that contains it. Lengths are summed over sliding windows of `WINDOW` lines: the text surges
where the sum rises from 0 above the threshold and dives where it falls back to 0; the lines between a surge and its dive are
kept whole, short ones included, with the headings right before them. The threshold is a share of the page's largest window,
so a short article is still the peak of its own page; it holds for text that stands in the page itself, while the article's
own element keeps its low regions as well.

What a line counts is its text outside links, and 0 where links make up most of it, unless one link holds a whole paragraph
of prose. Lines of containers that hold less than `SHARE` of what the page's largest container holds count 0 too: they neither
start nor end a surge, and stay where they stand within one. Small containers inside the largest one are part of it, as are
sections, lists and tables beside the large ones under the same parent: these count, so an article may end in a short list.
Names are evidence besides: text that belongs to menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments, by element or by class, id or role (a whole name, or a compound of such words and layout words alone), is
an empty line. Where a page has <article> or <main>, text outside them counts 0, and within them all of it counts and marked
parts leave no line, so that an article stays in one piece; everyday names (share, legal, menu) count there only for parts that
links or short lines make up.

Time is linear in the page, broken markup included: an unclosed quote or comment is looked for once.

Defined cases: null or empty html, or a page without main text, gives an empty text; unclosed elements end with the
element that holds them; rows that repeat are each answered; regions of equal windows
are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, SHARE = 3, 0.2
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe object canvas textarea select".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
#: A tag that ends itself; an unquoted value may end in a slash as well.
_ALONE = re.compile(r"(?:^|[\s\"'])/$")
#: Elements that begin or end a block, that hold no content, and that never hold main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu head title button dialog fieldset label option audio video".split())
#: Words of a class, id or role that mark text around the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion teaser menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts disclaimer newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond discussion disqus reader-comments related recommended popup modal overlay pagination pager search copyright legal hidden contentinfo complementary".split()
)
#: Words that with a mark make up a compound name of the same meaning; any other word (has-, related-work) makes it another thing.
LAYOUT = frozenset("area bar block body bottom box btn button buttons center column container content fixed form global group icons inner item items left link links list main outer page panel post primary region right row secondary section site slot small sticky top unit wrap wrapper".split())
#: Marks that name parts of articles too: inside an article they count only where links or short lines make up the element.
EVERYDAY = frozenset("alert alerts banner copyright disclaimer discussion foot head header hidden legal menu notice notices rail related reply respond search share sharing side social widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that make up a container of lines.
CONTAINERS = frozenset("article aside body dialog div fieldset footer form header html main menu nav section table td ul ol dl".split())
#: Containers that are parts of the text they stand in.
FLOW = frozenset("section table td ul ol dl".split())
#: An end tag closes nothing beyond one of these, unless it is that of an article or the page.
BARRIERS = frozenset("article main body aside nav footer header form".split())
LINK_SHARE, LINK_LINE, SHORT_LINE = 0.5, 0.8, 40
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(token: str) -> set[str]:
    """The marks that a class, id or role is made of, or none if it is about anything else."""
    if token.lower() in MARKS:
        return {token.lower()}
    words = {p.lower() for p in _PART.findall(token)}
    return words & MARKS if words <= MARKS | LAYOUT else set()


def _tokens(page: str):
    """(text before, element name or "", whether it closes, attributes) of each tag, comment or raw element in turn; at the end the text left."""
    n, at, begin = len(page), 0, 0
    gone: set[str] = set()  # what does not occur any more from here on

    def find(what: str, start: int) -> int:
        if what in gone:
            return -1
        i = page.find(what, start)
        if i < 0:
            gone.add(what)
        return i

    while True:
        i = page.find("<", at)
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = find("-->", i + 4)
            yield page[begin:i], "", False, ""
            at = begin = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", i):
            end = find("]]>", i)
            yield page[begin:i], "", False, ""
            at = begin = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, i + 1)
        if not m and page[i + 1 : i + 2] not in ("!", "?"):
            at = i + 1
            continue
        pos = m.end() if m else i + 2
        end = -1
        while m:  # a quoted value may hold the sign that ends a tag
            stop = _STOP.search(page, pos) if ">" not in gone else None
            if not stop:
                gone.add(">")
                break
            if stop[0] == ">":
                end = stop.start()
                break
            close = find(stop[0], stop.end())
            if close < 0:
                end = find(">", stop.end())
                break
            pos = close + 1
        if not m:
            end = find(">", pos)
        if end < 0:  # no tag ends any more: the rest is text
            break
        name = m[1].lower() if m else ""
        closes = page[i + 1] == "/"
        yield page[begin:i], name if name not in RAW else "", closes, page[m.end() : end] if m and not closes else ""
        at = begin = end + 1
        if name in RAW and not closes and page[end - 1] != "/":
            m = _RAW_END[name].search(page, at)
            at = begin = m.end() if m else n
    yield page[begin:], "", False, ""


def _marked(attributes: str) -> tuple[bool, bool, bool]:
    """(marks text around the article, marks the article itself, the former by everyday words alone)"""
    around = main = False
    found: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            around = True
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name in ("class", "id", "role"):
            if name == "role" and value.lower() in ("main", "article"):
                main = True
            for token in value.split():
                found |= _names(token)
    return around or bool(found), main, not around and found <= EVERYDAY


class Line(NamedTuple):
    """A block's text, its length outside links (0 if it counts for nothing), container, whether it is a heading, and whether it is in an article."""

    text: str
    length: int
    container: int
    heading: bool
    inside: bool


class _Open:
    """An open element, and what its lines come to so far."""

    def __init__(self, name: str, around: bool, inside: bool, number: int, doubtful: bool, first: int):
        self.name, self.around, self.inside, self.number, self.doubtful, self.first = name, around, inside, number, doubtful, first
        self.text = self.links = self.rows = 0


def lines(page: str, tree: list[tuple[int, str]] | None = None) -> list[Line]:
    """The lines of a page, in order. tree gets the parent and element of every container by number; 0 is the page."""
    tree = [] if tree is None else tree
    tree.append((-1, ""))
    out: list[Line | None] = []
    root = _Open("", False, False, 0, False, 0)
    stack = [root]
    piece: list[str] = []
    links = anchors = several = 0
    places: dict[str, list[int]] = {}  # where elements of a name are open; "block!" and "barrier!" for all of these

    def flush():
        nonlocal links, several
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        top, linked, links, one, several = stack[-1], links, 0, several == 1, 0
        if not text:
            return
        for e in doubtful:
            e.text, e.links, e.rows = e.text + len(text), e.links + linked, e.rows + 1
        if top.around:
            if not top.inside:
                out.append(Line("", 0, top.number, False, False))
            return
        prose = one and len(text) >= SHORT_LINE and any(stack[i].name == "p" for i in places.get("block!", ())[-1:])
        counts = len(text) if top.inside or prose and linked >= LINK_LINE * len(text) else len(text) - linked if linked < LINK_LINE * len(text) else 0
        out.append(Line(text, max(0, counts), top.number, any(e.name in HEADINGS for e in stack[-3:]), top.inside))

    def kinds(name: str) -> tuple[str, ...]:
        return (name, *(("block!",) if name in BLOCKS else ()), *(("barrier!",) if name in BARRIERS else ()))

    def close(i: int):
        nonlocal anchors
        for e in reversed(stack[i:]):
            anchors -= e.name == "a"
            for k in kinds(e.name):
                places[k].pop()
            if e.doubtful:
                doubtful.remove(e)
                if e.rows and (e.links >= LINK_SHARE * e.text or e.text < SHORT_LINE * e.rows):
                    out[e.first :] = [None] * (len(out) - e.first)
        del stack[i:]

    doubtful: list[_Open] = []
    for text, name, closes, attributes in _tokens(page):
        if text:
            piece.append(text)
            if anchors:
                links += len(text.strip())
        if not name:
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closes:
            i = (places.get(name) or [0])[-1]
            if i and (name in ("article", "main", "body", "html") or i >= (places.get("barrier!") or [0])[-1]):
                close(i)
        elif name not in VOID and not _ALONE.search(attributes):
            if name in BLOCKS:  # a block ends open paragraphs and what they hold; an item ends the item before
                i = (places.get("block!") or [0])[-1]
                if i and (stack[i].name == "p" or name == "li" and stack[i].name == "li" or name in ("dt", "dd") and stack[i].name in ("dt", "dd")):
                    close(i)
            around, inside = stack[-1].around, stack[-1].inside
            mark, main, everyday = _marked(attributes) if attributes else (False, False, False)
            mark = mark and name not in HEADINGS
            doubt = mark and inside and everyday and not around
            outside = name in OUTSIDE and not (name == "header" and inside)
            hit = around or outside or mark and not doubt and name not in ("html", "body", "article", "main")
            hit = hit or name == "article" and mark and inside
            number = stack[-1].number
            if name in CONTAINERS:
                tree.append((number, name))
                number = len(tree) - 1
            e = _Open(name, hit, inside or name in ("article", "main") and not hit or main, number, doubt and not hit, len(out))
            for k in kinds(name):
                places.setdefault(k, []).append(len(stack))
            stack.append(e)
            anchors += name == "a"
            several += name == "a"
            if e.doubtful:
                doubtful.append(e)
    flush()
    close(1)
    return [x for x in out if x]


def _home(held: dict[int, int], tree: list[tuple[int, str]]) -> set[int]:
    """Containers whose lines are the page's text: those that hold at least SHARE of what the largest holds, what stands inside
    the only one of these, and sections, lists and tables that stand with them under their common parent."""
    most = max(held.values(), default=0)
    large = {c for c, n in held.items() if n >= SHARE * most}

    def above(c: int) -> list[int]:
        out = []
        while c >= 0:
            out.append(c)
            c = tree[c][0]
        return out

    if not large:
        return large
    paths = [above(c)[::-1] for c in large]
    common = 0
    for level in zip(*paths):
        if len(set(level)) > 1:
            break
        common = level[0]
    whole = len(large) == 1 and tree[common][1] not in ("", "html", "body")
    home: set[int] = set()
    for c in range(len(tree)):  # parents come before what they hold
        parent, name = tree[c]
        if c in large or c == common:
            home.add(c)
        elif parent in home and (whole or name in FLOW):
            home.add(c)
    return home - ({common} - large)


def main_text(page: str | None) -> str:
    tree: list[tuple[int, str]] = []
    found = lines(page or "", tree)
    if any(x.inside and x.length for x in found):
        found = [x if x.inside else x._replace(text="", length=0) for x in found]
        home = {x.container for x in found}
    else:
        held: dict[int, int] = {}
        for x in found:
            held[x.container] = held.get(x.container, 0) + x.length
        home = _home(held, tree)
        found = [x if x.container in home else x._replace(length=0) for x in found]
    length = [x.length for x in found]
    size = len(length)
    window = [sum(length[i : i + WINDOW]) for i in range(size)]
    peak = max(window, default=0)
    if not peak:
        return ""
    kept, i = [], 0
    while i < size:
        if not window[i]:
            i += 1
            continue
        end = i
        while end < size and window[end]:
            end += 1
        full = [j for j in range(i, min(size, end + WINDOW - 1)) if length[j]]
        if max(window[i:end]) >= SHARE * peak or any(found[j].inside or found[j].container in home and tree[found[j].container][1] not in ("", "html", "body") for j in full):
            a, b = full[0], full[-1] + 1
            while a and found[a - 1].heading and found[a - 1].text:
                a -= 1
            kept += [x.text for x in found[a:b] if x.text]
        i = end + WINDOW - 1
    return "\n\n".join(kept)


def _extract(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE: dict = {}
