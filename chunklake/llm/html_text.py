"""HTML main text by consensus host paths.

Each page's containers are scored by the text of their blocks; a page votes for the generalised
tag-class path of its best container; Spark adds the votes per host; and every page is extracted
again from the containers on its host's winning path, or from its own best where it has none.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, broadcast_if_small, for_texts, materialise

#: Elements without content, elements whose content is no markup, elements that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head label fieldset datalist noscript template svg math object canvas audio video".split()) | RAW
#: Elements that begin and end a block, those that part words, and those whose end tags do not reach beyond a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead tr ul caption".split())
PARTING = frozenset("br td th".split())
PHRASE = frozenset("a abbr b big cite code del em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a text's own words rather than groups of blocks.
TEXTUAL = frozenset("p li dd dt td th tr blockquote pre figcaption summary address".split()) | HEADING | PHRASE
#: Elements whose class, id or role words don't count, since page-wide words stand there.
PLAIN = frozenset("html body main article".split())
#: Heads of names that mark what is no article text: on any element, and on groups only.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices notification notifications banner banners "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar sidebar sidebars aside widget widgets footer contentinfo complementary "
    "comment comments commentlist replies disqus form login signup signin newsletter popup modal overlay hidden".split()
)
UNWANTED_GROUP = frozenset("alert alerts disclaimer topbar masthead skip rail foot toc copyright reply respond discussion register search subscribe subscription paywall share sharing social follow related recommended recommendations popular trending teaser teasers promotion promoted dialog".split())
#: Words that name a shape or place and leave the word before them the head of a name.
SHAPE = frozenset("area bar block body bottom box button buttons card cards column container content entry field group holder inner item items left link links list listing module new news outer panel post posts article articles stories right row section side slot space spot strip table text thread title top unit view wrap wrapper zone a b c x".split())
#: Names that tell how an element looks or what it allows, and elements that name a page's own text.
MODIFIER = re.compile(r"(?:has|with|no|is|without)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|on|off)", re.IGNORECASE)
LANDMARK = frozenset("article main h1".split())
#: Words of a class or id that name the wrapper of a text, and those of them that name one text; rounds in which marked elements are spared.
WRAPPER, SINGLE = frozenset("article post entry story content main".split()), frozenset("article post entry story".split())
MOST_ROUNDS = 20
#: What a block credits to its container and to that one's container, and the bonus of elements that name an article.
PARENT, GRANDPARENT, NAMED = 1.0, 0.5, 1.25
#: A winning path that holds less than this share of the page's own best is not used.
LEAST_SHARE = 0.25

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)?))?)?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_ITEMS = frozenset("li dt dd tr option".split())


@dataclass(slots=True)
class Element:
    """``last``: the greatest number inside; ``box``: the nearest block, itself included; ``kind``: equal for equal paths of a page."""

    tag: str
    step: str
    up: Element | None
    number: int
    box: Element = None
    last: int = 0
    kind: int = 0
    marked: bool = False
    hard: bool = False
    wrapper: bool = False
    in_header: bool = False
    in_link: bool = False
    in_heading: bool = False
    in_single: bool = False
    phrases: dict[str, int] = field(default_factory=dict)

    @property
    def path(self) -> str:
        """Generalised: classes sorted, digits replaced."""
        steps, e = [], self
        while e:
            steps.append(e.step)
            e = e.up
        return ">".join(reversed(steps))

    def holds(self, other: Element) -> bool:
        return self.number <= other.number <= self.last


@dataclass(slots=True)
class Block:
    home: Element
    text: str
    linked: int


@dataclass(slots=True)
class Page:
    """The elements in page order, the texts with their elements (``None`` parts blocks), and the kinds by (kind above, step)."""

    elements: list[Element]
    texts: list[tuple[Element, str] | None]
    kinds: dict[tuple[int, str], int]


@lru_cache(4096)
def _names(tag: str, classes: str, id_: str, role: str) -> tuple[str, bool, bool, bool, bool]:
    """The element's step; whether its names mark it, name a header, a wrapper, a single text.

    Only whole names count, by their heads: the last word that is no shape. ``ad-slot-3`` and
    ``article-comments`` mark, ``ad-hoc`` and ``related-work`` do not.
    """
    step = ".".join([tag, *sorted({_DIGITS.sub("N", c).replace(">", "") for c in classes.split()})])
    names = [w for w in f"{classes} {id_} {role}".split() if not MODIFIER.fullmatch(w)]
    words = [[w.lower() for w in _WORD.findall(n) if not w.isdigit()] for n in names]
    wrapper, single = (any((x in known for w in words for x in w)) for known in (WRAPPER, SINGLE))
    if tag in PLAIN:
        return step, tag == "article" and any(len(w) == 1 and w[0] in UNWANTED for w in words), False, tag in ("article", "main"), tag in ("article", "main")
    heads = set()
    for w in words:
        while len(w) > 1 and w[-1] in SHAPE:
            w = w[:-1]
        heads.update(w[-1:])
    unwanted = heads & UNWANTED or tag not in TEXTUAL and heads & UNWANTED_GROUP
    return step, bool(unwanted), "header" in heads, wrapper, single


def _element(tag: str, attrs: dict[str, str], up: Element | None, number: int) -> Element:
    step, marked, header, wrapper, single = _names(tag, attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))
    e = Element(tag, step, up, number, marked=marked, wrapper=wrapper)
    e.box = e if tag in BLOCK or up is None else up.box
    style = attrs["style"].replace(" ", "").lower() if "style" in attrs else ""
    e.hard = tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    e.in_header, e.in_link, e.in_heading, e.in_single = tag == "header" or header, tag == "a", tag in HEADING, single
    if up:
        e.hard |= up.hard
        e.in_header |= up.in_header
        e.in_link |= up.in_link
        e.in_heading |= up.in_heading
        e.in_single |= up.in_single
    return e


class _Builder:
    """The tree of a page: what is open, and what ends when something else begins."""

    def __init__(self) -> None:
        self.now = _element("#", {}, None, 0)
        self.page = Page([self.now], [], {})
        self.open: dict[str, int] = {}

    def _leave(self, to: Element) -> None:
        """Close everything inside ``to``."""
        last = len(self.page.elements) - 1
        while self.now is not to:
            self.now.last = last
            self.open[self.now.tag] -= 1
            if self.now.tag in PHRASE:
                self.now.box.phrases[self.now.tag] -= 1
            self.now = self.now.up

    def text(self, text: str) -> None:
        if text:
            self.page.texts.append((self.now, text))

    def part(self, tag: str) -> None:
        if tag in PARTING:
            self.page.texts.append((self.now, " "))
        elif tag in BLOCK:
            self.page.texts.append(None)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.part(tag)
        if tag in BLOCK:  # an open paragraph ends where a block begins, and so do items and cells of the same kind
            e = self.now.box
            if e.up and (e.tag == "p" or e.tag in HEADING and tag in HEADING or e.tag == tag and tag in _ITEMS):
                self._leave(e.up)
        if tag in VOID:
            return
        up = self.now
        e = _element(tag, attrs, up, len(self.page.elements))
        e.kind = self.page.kinds.setdefault((up.kind, e.step), len(self.page.kinds) + 1)
        self.page.elements.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in PHRASE:
            e.box.phrases[tag] = e.box.phrases.get(tag, 0) + 1
        self.now = e

    def end(self, tag: str) -> None:
        self.part(tag)
        if not (self.now.box.phrases if tag in PHRASE else self.open).get(tag):
            return
        e = self.now
        while e.tag != tag:
            e = e.up
        self._leave(e.up)


def _attributes(page: str, at: int, stop: int) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on and the place of the ``>`` that ends them, ``stop`` if there is none."""
    attrs: dict[str, str] = {}
    while at < stop and page[at] != ">":
        m = _ATTRIBUTE.match(page, at, stop)
        at = m.end()
        if m[1]:
            attrs.setdefault(m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or ""))
    return attrs, at


def parse(page: str) -> Page:
    """One pass. A tag that never ends because a quote stays open ends at its first ``>``, as do all after it."""
    b, at, seek, n, plain = _Builder(), 0, 0, len(page), False
    raw_end: dict[str, re.Pattern] = {}
    while (k := page.find("<", seek)) >= 0:
        after = page[k + 1 : k + 2]
        end = after == "/"
        m = _NAME.match(page, k + 1 + end)
        if not m and after not in ("!", "?"):
            seek = k + 1  # a sign in the text
            continue
        b.text(page[at:k])
        if not m:
            close = "-->" if page.startswith("<!--", k) else ">"
            stop = page.find(close, k + (2 if close == "-->" else 1))
            at = seek = n if stop < 0 else stop + len(close)
            continue
        tag = m[0].lower()
        stop = page.find(">", m.end()) if plain else n
        attrs, stop = _attributes(page, m.end(), stop if stop >= 0 else n)
        if stop == n and not plain:
            plain = True
            stop = page.find(">", m.end())
            attrs, stop = _attributes(page, m.end(), stop) if stop >= 0 else ({}, n)
        at = seek = min(n, stop + 1)
        if stop == n:
            break
        if end:
            b.end(tag)
            continue
        b.start(tag, attrs)
        if tag in RAW:
            ends = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE))
            stop = ends.search(page, at)
            at = seek = stop.start() if stop else n
    b.text(page[at:])
    b._leave(b.page.elements[0])  # noqa: SLF001
    b.page.elements[0].last = len(b.page.elements) - 1
    return b.page


def _outermost(page: Page, spared: set[int]) -> list[int]:
    """For each element the number of the outermost marked one around or at it that is not spared, else 0."""
    out = [0]
    for e in page.elements[1:]:
        out.append(out[e.up.number] or (e.number if e.marked and e.number not in spared else 0))
    return out


def _to_spare(page: Page, soft: list[int]) -> set[int]:
    """Marked elements that hold a heading h1, an article or a main, or most of the text outside links.

    None while such an element stands outside of marked ones.
    """
    landmarks = set()
    for e in page.elements[1:]:
        if e.tag in LANDMARK and not e.hard and not e.in_header:
            if not soft[e.number]:
                return set()
            if soft[e.up.number]:
                landmarks.add(soft[e.number])
    held: dict[int, int] = {}
    for e, text in filter(None, page.texts):
        if not e.in_link and not e.hard:
            held[soft[e.number]] = held.get(soft[e.number], 0) + len(text.strip())
    total = sum(held.values())
    return landmarks | {k for k, n in held.items() if k and 2 * n > total}


def _wanted(e: Element, soft: list[int]) -> bool:
    """Of a page's or an article's header only headings stay, and those only inside of what names a text."""
    return not e.hard and not soft[e.number] and (not e.in_header or e.in_heading and e.in_single)


def blocks_in(page: Page) -> list[Block]:
    """Text blocks in page order, without those of unwanted elements."""
    spared: set[int] = set()
    for _ in range(MOST_ROUNDS):
        soft = _outermost(page, spared)
        more = _to_spare(page, soft)
        if not more:
            break
        spared |= more
    out: list[Block] = []
    parts: list[str] = []
    home, linked = page.elements[0], 0
    for item in [*page.texts, None]:
        if item is None:
            if parts and (text := _SPACE.sub(" ", "".join(parts)).strip()):
                out.append(Block(home, text, linked))
            parts, linked = [], 0
        elif _wanted(item[0], soft):
            e, text = item
            if "&" in text:
                text = html_lib.unescape(text)
            if not parts:
                home = e.box
            parts.append(text)
            linked += len(text) if e.in_link else 0
    return out


def blocks_of(page: str | None) -> list[Block]:
    return blocks_in(parse(page or ""))


def best_container(blocks: list[Block]) -> Element | None:
    """The container whose blocks hold the most text outside links; none without text.

    A block that is an element of its own, such as a paragraph, credits the element around it.
    """
    score: dict[int, float] = {}
    seen: dict[int, Element] = {}
    for b in blocks:
        worth = max(0, len(b.text) - 2 * b.linked)
        box = b.home.up if b.home.up and b.home.tag in TEXTUAL else b.home
        for share in (PARENT, GRANDPARENT, GRANDPARENT / 2):
            if box is None or box.up is None and share != PARENT:
                break
            score[box.number] = score.get(box.number, 0.0) + share * worth * (NAMED if box.tag in ("article", "main") else 1.0)
            seen[box.number] = box
            box = box.up
    return max(seen.values(), key=lambda e: (score[e.number], -e.number), default=None)


def main_container(blocks: list[Block]) -> Element | None:
    """The best container, or the article, else main, else wrapper around it, unless links are most of what that adds.

    A wrapper is named as one or adds a heading h1; it is looked for below the body.
    """
    best = best_container(blocks)
    if best is None or best.tag in ("article", "main", "body", "html", "#"):
        return best
    around, e = [], best.up
    while e and e.tag not in ("body", "html", "#"):
        around.append(e)
        if e.tag == "article":
            break
        e = e.up
    by_home = sorted(blocks, key=lambda b: b.home.number)
    numbers = [b.home.number for b in by_home]
    sums = [(0, 0, 0)]
    for b in by_home:
        h1 = b.home.tag == "h1"
        sums.append((sums[-1][0] + len(b.text), sums[-1][1] + b.linked, sums[-1][2] + h1))
    within = lambda e: [y - x for x, y in zip(sums[bisect_left(numbers, e.number)], sums[bisect_right(numbers, e.last)], strict=True)]
    inner = within(best)
    for e in sorted(around, key=lambda e: ("article", "main").index(e.tag) if e.tag in ("article", "main") else 2):
        chars, linked, h1 = (x - y for x, y in zip(within(e), inner, strict=True))
        if chars and (e.wrapper or h1) and 2 * linked <= chars:
            return e
    return best


def _on_path(page: Page, path: str) -> list[bool]:
    """For each element whether it is or stands in a container on ``path``."""
    first, *steps = path.split(">")
    kind: int | None = 0 if first == "#" else None
    for s in steps:
        kind = None if kind is None else page.kinds.get((kind, s))
    out = [kind == 0]
    for e in page.elements[1:]:
        out.append(out[e.up.number] or e.kind == kind)
    return out


def extract(page: str | None, path: str | None) -> str:
    """The blocks on ``path``, or in the page's own main container, joined by an empty line.

    Where the path's blocks are some of the own container's, the own ones stay; where they are others,
    the path is used if it holds LEAST_SHARE of the own text.
    """
    tree = parse(page or "")
    blocks = blocks_in(tree)
    best = main_container(blocks)
    if best is None:
        return ""
    own = [best.holds(b.home) for b in blocks]
    if path:
        on = _on_path(tree, path)
        on_path = [on[b.home.number] for b in blocks]
        size = lambda chosen: sum(len(b.text) for b, c in zip(blocks, chosen, strict=True) if c)
        both = [x and y for x, y in zip(own, on_path, strict=True)]
        if path == best.path or (not any(both) or both == own) and size(on_path) >= LEAST_SHARE * size(own):
            own = on_path
    return "\n\n".join(b.text for b, c in zip(blocks, own, strict=True) if c)


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count: dict[tuple[str, str], int] = {}
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (e := main_container(blocks_of(page))) is not None:
                key = (_host(url), e.path)
                count[key] = count.get(key, 0) + 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(count.values()), pa.int64())], names=["host", "path", "votes"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, votes``: the winner of each host's vote; of equal counts the least path."""
    votes = for_texts(pages).select(url_col, html_col).mapInArrow(_votes, "host string, path string, votes bigint")
    sums = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = sums.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), "path")).alias("b"))
    return best.select("host", "b.path", "b.votes")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(page, path) for page, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), b.column(3)], names=["id", "url", "text", "n_chars", "host_path"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars, host_path`` of every page.

    Null or empty html gives an empty text; pages with null or malformed URLs vote together as the
    host without a name; repeated pages stay and vote each; other columns are not looked at. White
    space inside a block becomes one space; ``br`` is white space; character references are decoded.
    """
    winners = materialise(host_paths(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("path").alias("__path")))
    at = F.instr(url_col, "://")
    host = F.translate(F.regexp_extract(F.when(at > 0, F.substr(url_col, at + F.lit(3))).otherwise(F.lit("")), r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(host, F.lit("")).alias("__host"))
    both = rows.join(broadcast_if_small(winners, winners.count()), "__host", "left").select("id", "url", "html", "__path")
    out = both.mapInArrow(_texts, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint, host_path string")
    return out.withColumnRenamed("id", id_col)
