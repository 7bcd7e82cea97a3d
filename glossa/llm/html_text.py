"""Main text of web pages by two-pass block rules.

A page is read once into blocks: runs of text between block-level tags, with the containers they stand in. The first pass labels each block
from its stop-word density, length and link density, and from containers that are never text (navigation, forms, adverts, comments and the
like). Blocks that stay undecided, mostly short ones, take the label of their nearest decided neighbour in the second pass. Inside an article
or main element, neighbours outside it do not count, and blocks are text where nothing decides otherwise.

Containers and articles are evidence, not filters. A form, or a container known by its class alone that holds an article's worth of prose, is opened where it
holds most of the page's prose and hardly any is left without it: such a container is the page's layout. Articles that hold less prose than the rest of the page are not the page's article, and then
all blocks that the rules call text are. Stop words say nothing about scripts, and about pages in languages, that they do not cover: there length and links decide.

A null or empty page has no text. Broken markup is read as it comes: unclosed elements end with their container, text after an unfinished tag
is kept, script and style without an end run to the end of the page. The work grows with a page's length, however its tags nest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to a in is that for it was on are as with be by this at from or an not have but they which he she we you
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un une du que est pour qui dans par plus au sur ce il pas ne se son avec ou sont
    el los y las del se una su al lo como más o pero sus le ha me si sin sobre este ya entre con para por no""".split()
)
#: Elements whose content is never text, elements that are never part of an article, and elements that end a block.
RAW = frozenset("script style template noscript textarea iframe svg math object audio video canvas title select option xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog head datalist fieldset label legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements of BOILERPLATE that may be a page's layout, and elements that the next of their kind ends.
LAYOUT = frozenset("form fieldset".split())
CELLS = {"li": "li", "td": "td", "th": "td", "dd": "dd", "dt": "dd"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A class or id is one of a container that is never text if all its parts are known here and one of them is of the first kind.
CLASS = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|nav\w*|menus?|breadcrumbs?|sidebar|side|aside|footer|"
    r"foot|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus|newsletter|subscri\w*|login|signup|search|widgets?|pagination|pager|tags|copyright|legal|skip",
    re.I,
)
#: Classes that close a container whatever it holds.
READERS = re.compile(r"comments?|commentlist|respond|repl(?:y|ies)|disqus|cookies?\w*|consent|gdpr|ads?|advert\w*|sponsor\w*|popup|modal|overlay", re.I)
BESIDE = frozenset("site page main global primary secondary top bottom left right post posts entry article articles user blog mobile list box bar area section links link buttons button icons form container wrapper inner body item items block".split())
HEADER_CLASS = re.compile(r"(?:(?:site|page|global|main|top)?[_-]?)header", re.I)
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_PARTS = re.compile(r"[_-]+")
_TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_WORD = re.compile(r"\w+")
#: Scripts written without blanks, of which a character says about as much as three others; letters of scripts that STOP_WORDS covers.
_DENSE = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_LETTER = re.compile(r"[^\W\d_]")
_OTHER_LETTER = re.compile(r"[^\W\d_A-Za-zª-ɏḀ-ỿ]")

SHORT, LONG, LINKS, LOW, HIGH = 70, 200, 0.5, 0.10, 0.25
#: Of the prose of long blocks, the share with stop words under which they do not cover the page's language; of the prose a container holds, the share that may be left
#: without it where it is opened.
COVERED, REST = 0.2, 0.1
#: Characters of prose without which a container that is known by its class alone is no layout.
ARTICLE = 400
HARD, SOFT = 2, 1


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    closed: int = -1  # the innermost container around it that is never text
    bad: bool = False
    article: int = 0  # which article element it stands in; 0: none
    text: str = ""
    size: int = 0  # characters, those of dense scripts thrice
    density: float = 0.0
    covered: bool = True  # whether its script is one of the stop words


def _closing(name: str, page: str, at: int) -> int:
    """Where a raw element's end tag ends."""
    m = re.compile(rf"</{name}\b", re.I).search(page, at)
    return page.find(">", m.end()) + 1 or len(page) if m else len(page)


def _attributes(tag: str, at: int) -> dict[str, str]:
    """Names and values in order, from behind the tag's name; of attributes of one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, at):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _never_text(token: str) -> bool:
    parts = [x for x in _PARTS.split(token) if x]
    known = [bool(CLASS.fullmatch(x)) for x in parts]
    return any(known) and all(k or x.lower() in BESIDE for k, x in zip(known, parts, strict=True))


def _classed(a: dict[str, str]) -> int:
    """HARD or SOFT if class or id is one of a container that is never text, else 0."""
    found = [x for x in f"{a.get('class', '')} {a.get('id', '')}".split() if _never_text(x)]
    return 0 if not found else HARD if any(READERS.fullmatch(p) for x in found for p in _PARTS.split(x)) else SOFT


class _Reader:
    """Reads a page into blocks. Of each container that is never text: hard, whether it or one around it is HARD; around, the next one around it, or -1; least, the
    prose it must hold to be the page's layout."""

    def __init__(self, page: str):
        self.out: list[Block] = []
        self.hard: list[bool] = []
        self.around: list[int] = []
        self.least: list[int] = []
        # open elements: name, innermost container that is never text, article, whether in an article element, whether an article cannot reopen it
        self.stack: list[tuple[str, int, int, bool, bool]] = []
        self.open: dict[str, int] = {}  # how many of each name are in the stack
        self.now, self.links, self.articles, self.breaks = Block(), 0, 0, 0
        self.read(page)
        self.end_block()

    def top(self) -> tuple[int, int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (-1, 0, False, False)

    def push(self, name: str, *rest) -> None:
        self.stack.append((name, *rest))
        self.open[name] = self.open.get(name, 0) + 1

    def pop_to(self, name: str) -> None:
        """Close the innermost element of that name and all in it, if one is open."""
        while self.open.get(name, 0):
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == name:
                break

    def end_block(self) -> None:
        if self.now.parts:
            self.now.text = " ".join(html.unescape("".join(self.now.parts)).split())
            if self.now.text:
                self.out.append(self.now)
        closed, article, *_ = self.top()
        self.now = Block(closed=closed, article=article)

    def add(self, text: str) -> None:
        if text:
            self.now.parts.append(text)
            if self.links:
                self.now.linked += len(text.strip())
            if not text.isspace():
                self.breaks = 0

    def closing_kind(self, name: str, a: dict[str, str], article: int, own: bool) -> int:
        """HARD or SOFT if an element is never text by its name, role or class, else 0."""
        if "hidden" in a or a.get("aria-hidden") == "true" or name in BOILERPLATE and name not in LAYOUT or name == "header" and not article or a.get("role", "").lower() in ROLE:
            return HARD
        if name in ("article", "main"):
            return 0
        kind = _classed(a) or SOFT * (not article and any(HEADER_CLASS.fullmatch(x) for k in ("class", "id") for x in a.get(k, "").split()))
        # within an article, classes tell its comments and boxes from its text
        return HARD if kind and own else kind or SOFT * (name in LAYOUT)

    def start(self, name: str, tag: str) -> None:
        a = _attributes(tag, len(name) + 1) if len(tag) > len(name) + 2 else {}
        if name in CELLS and self.stack and CELLS.get(self.stack[-1][0]) == CELLS[name]:
            self.pop_to(self.stack[-1][0])
        closed, article, own, final = self.top()
        if name in ("article", "main"):
            # it reopens what class alone has closed
            if not final and not _classed(a):
                closed = -1
            if closed < 0 or not self.hard[closed]:
                if not article:
                    self.articles += 1
                    article = self.articles
                own = own or name == "article"
        kind = self.closing_kind(name, a, article, own) if a or name in BOILERPLATE or name == "header" else 0
        if kind:
            self.hard.append(kind == HARD or closed >= 0 and self.hard[closed])
            self.around.append(closed)
            self.least.append(0 if name in LAYOUT else ARTICLE)
            closed, final = len(self.hard) - 1, final or kind == HARD or name in LAYOUT
        if name != "p":
            self.push(name, closed, article, own, final)
        self.end_block()
        self.now.closed = closed

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            low = page.find("<", at)
            if low < 0:
                self.add(page[at:])
                break
            self.add(page[at:low])
            if page.startswith("<!--", low):
                end = page.find("-->", low + 4)
                at = n if end < 0 else end + 3
                continue
            m = _TAG_NAME.match(page, low + 1)
            if not m:
                if page.startswith(("<!", "<?", "</"), low):
                    at = page.find(">", low) + 1 or n
                else:
                    self.add("<")
                    at = low + 1
                continue
            end = _TAG_END.match(page, m.end())
            stop = end.end() if end else (page.find(">", low) + 1 or n)
            tag, name, closing = page[low:stop], m[1].lower(), page[low + 1] == "/"
            at = stop
            if name in RAW and not closing:
                if not tag.endswith("/>"):
                    at = _closing(name, page, stop)
                if name not in INLINE:
                    self.add(" ")
            elif name == "a":
                self.links = 0 if closing else 1
            elif name == "br":
                self.breaks += 1
                self.add(" ")
                if self.breaks > 1:
                    self.end_block()
            elif name not in INLINE:
                self.links = 0
                if closing:
                    self.pop_to(name)
                    self.end_block()
                elif name == "body":
                    self.pop_to("head")
                    self.end_block()
                elif name in VOID or name in ("h1", "h2", "h3", "h4", "h5", "h6", "tr", "html"):
                    if name == "tr" and self.stack and self.stack[-1][0] in ("td", "th"):
                        self.pop_to(self.stack[-1][0])
                    self.end_block()
                else:
                    self.start(name, tag)


def _measured(reader: _Reader) -> None:
    """Sizes, densities, and whether stop words say anything about a block."""
    for b in reader.out:
        words = _WORD.findall(b.text.lower())
        b.density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        b.size = len(b.text)
        other = 0 if b.text.isascii() else len(_OTHER_LETTER.findall(b.text))
        if other:
            b.size += 2 * len(_DENSE.findall(b.text))
            b.covered = 2 * other <= len(_LETTER.findall(b.text))
    open_ = (b for b in reader.out if b.closed < 0 or not reader.hard[b.closed])
    long = [b for b in open_ if b.covered and b.size >= LONG and b.linked <= LINKS * len(b.text)]
    mass = sum(b.size for b in long)
    if mass and sum(b.size for b in long if b.density >= LOW) < COVERED * mass:
        for b in long:
            b.covered = False


def first_label(b: Block) -> bool | None:
    """True: text, False: boilerplate, None: undecided."""
    if b.bad:
        return False
    if b.linked > LINKS * len(b.text):
        return False
    if b.size < SHORT:
        return None
    if not b.covered:
        return True if b.size >= LONG else None
    if b.density >= HIGH or b.density >= LOW and b.size >= LONG:
        return True
    if b.density < LOW and b.size >= LONG and not b.article:
        return False
    return None


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is text: the first pass, then for undecided blocks the nearest decided neighbour in the same article element (or
    outside all of them); of two as near, the one that is text. Without any, a block is text inside an article element and not outside."""
    first = [first_label(b) for b in found]
    n = len(found)

    def decided(order: Iterator[int]) -> list[int]:
        """Of each block, the last one before it in this order that is decided and counts for it."""
        out, last = [-1] * n, {}
        for i in order:
            out[i] = last.get(found[i].article, -1)
            if first[i] is not None and not (found[i].bad and found[i].article):
                last[found[i].article] = i
        return out

    left, right = decided(iter(range(n))), decided(reversed(range(n)))
    out = []
    for i in range(n):
        own = first[i]
        if own is None and found[i].article:
            near = [k for k in (right[i], left[i]) if k >= 0 and first[k]]
            own = bool(near) or not any(first[k] is False for k in (left[i], right[i]) if k >= 0)
        elif own is None:
            near = [k for k in (right[i], left[i]) if k >= 0]
            own = bool(near) and bool(first[min(near, key=lambda k: (abs(k - i), not first[k]))])
        out.append(own)
    return out


def _layout(reader: _Reader, kept: list[bool], opened: list[bool]) -> int | None:
    """A container to open: a soft one that holds more than half of the page's prose, as far as no hard one closes that, where hardly any is kept.
    Of nested ones that hold about the same prose it is the innermost."""
    held = [0] * len(opened)
    whole = left = 0
    for b, good in zip(reader.out, kept, strict=True):
        if b.closed >= 0 and reader.hard[b.closed]:
            continue
        b.bad = False
        if good or first_label(b):
            whole += b.size
            left += b.size * good
            if b.closed >= 0:
                held[b.closed] += b.size
    for c in reversed(range(len(held))):  # containers around others come before them
        if reader.around[c] >= 0:
            held[reader.around[c]] += held[c]
    shut = [c for c in range(len(held)) if not opened[c] and not reader.hard[c] and held[c] >= reader.least[c]]
    most = max((held[c] for c in shut), default=0)
    if 2 * most <= whole or left > REST * most:
        return None
    return max(c for c in shut if held[c] >= (1 - REST) * most)


def main_blocks(page: str) -> list[Block]:
    """The blocks of a page's main text, in order."""
    reader = _Reader(page)
    found, opened = reader.out, [False] * len(reader.hard)
    _measured(reader)
    while True:
        shut: list[bool] = []
        for c, outer in enumerate(reader.around):
            shut.append(not opened[c] or outer >= 0 and shut[outer])
        for b in found:
            b.bad = b.closed >= 0 and shut[b.closed]
        kept = labels(found)
        more = _layout(reader, kept, opened)
        if more is None:
            break
        while more >= 0:  # and all around it
            opened[more], more = True, reader.around[more]
    good = [b for b, x in zip(found, kept, strict=True) if x]
    # the prose of the articles against that outside them; short blocks outside are no prose
    inside = [b for b in good if b.article]
    outside = sum(b.size for b in good if not b.article and b.size >= SHORT)
    return inside if inside and sum(b.size for b in inside) >= outside else good


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, joined by line feeds."""
    return "\n".join(b.text for b in main_blocks(page or ""))


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """The rows of pages, with `column` replaced by the columns text and n_chars; others of these names go. Rows are independent and repeated ones alike."""
    rows = pages.drop(*(c for c in ("text", "n_chars") if c != column))
    keep = [c for c in rows.columns if c != column]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(column).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != column)
    return rows.mapInArrow(task, f"{fields}text string, n_chars long")


def op2(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html")))
