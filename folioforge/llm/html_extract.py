"""Main text of web pages by a minimum cut.

A page is parsed into text blocks.  A small classifier gives every block a cost
for calling it boilerplate and one for calling it content; these become the
capacities of its edges to the source and the sink.  Blocks that follow each
other, and blocks that are close in the element tree, are joined by smoothness
edges.  The minimum cut labels all blocks at once: a short block between content
is content, a wordy advert beside the article is not.

The graph is a chain plus edges between blocks of one parent and between a
section's first and last block, so it has O(blocks) edges; Dinic's algorithm on
it takes a few phases.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

# Fixed values of HTML: how elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A button is a control, except in a heading, where it is the heading's text.
HIDDEN = frozenset("script style noscript template head title svg annotation annotation-xml iframe noembed noframes object canvas audio video select option datalist textarea button".split())
#: Up to its own end tag nothing in it is markup.
RAW = frozenset("script style noscript title textarea xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: A start tag of the key ends an open element of the value (up to the scope).
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = frozenset("ul ol dl table".split())
CELLS = frozenset("td th table".split())
#: End tags that may end a table's cells from inside.
OF_TABLE = frozenset("tr table tbody thead tfoot body html".split())
#: All that a head may hold; any other start tag, and text, ends it.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
SCOPE = frozenset("ul ol dl table td th body html article section div aside nav main footer header form menu".split())

#: Containers that speak for or against content, with log odds.
TAG_ODDS = {"article": 3.0, "main": 2.5, "nav": -6.0, "aside": -6.0, "footer": -6.0, "header": -2.5, "menu": -6.0, "dialog": -6.0, "search": -6.0}
ROLE_ODDS = {"main": 2.5, "article": 3.0, "navigation": -6.0, "banner": -4.0, "complementary": -6.0, "contentinfo": -6.0, "search": -6.0, "dialog": -6.0, "alertdialog": -6.0, "alert": -6.0, "menu": -6.0, "menubar": -6.0, "note": -1.0}
#: Words of class and id attributes.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsbygoogle banner sponsor sponsored sponsors promo promotion promoted comment comments discussion disqus respond replies reply feedback sidebar sidebars rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination footer foot masthead header topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending copyright legal disclaimer tags taglist skip skiplink hidden".split()
)
CONTENT = frozenset("article content post entry story main maincontent articlebody body text prose".split())
#: has-sidebar and the like tell of the layout, not of what the element holds.
LAYOUT = frozenset("has with no without".split())
#: What these words name is not the article of the page, though articles may be in it.
OTHERS = frozenset("comment comments discussion disqus respond replies reply feedback related recommended recommendations trending sponsored promoted".split())
CLASS_ODDS, GOOD_ODDS, FORM_ODDS = -5.0, 1.0, -6.0
#: What makes a form one: a form with less than so much text for each control is.
CONTROLS, TEXT_OF_CONTROL = frozenset("input select textarea button label".split()), 100
#: A class word gives way where the element has so many times the text that the page says elsewhere.
OUTWEIGHS = 4
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
NAME = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
VALUE = re.compile(r"[^\s>]*")
BETWEEN = re.compile(r"[\s/]*")
PRIOR, SMOOTH, NEAR, LONELY = -0.4, 1.6, 0.8, 1.0


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


def markup(html: str) -> Iterator[tuple[str, str, dict | None]]:
    """("text", characters, None), ("start", tag, attributes) and ("end", tag, None).

    As in browsers: comments, declarations and processing instructions are left
    out, unclosed ones to the end of the page, and so is a tag that the page
    breaks off in.  Every character is looked at a bounded number of times, and
    no input is an error.
    """
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start != at:
            yield "text", html[at : start if start >= 0 else n], None
        if start < 0:
            return
        m = TAG.match(html, start)
        if not m:
            after = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, start)), None)
                end = start + len(short) if short else html.find("-->", start + 4) + 3
                if end < 3:
                    return
                at = end
            elif after in ("!", "?") or after == "/" and start + 2 < n:
                at = html.find(">", start) + 1
                if not at:
                    return
            else:
                yield "text", "<", None
                at = start + 1
            continue
        tag, attributes, at = m[2].lower(), {}, m.end()
        while True:
            at = BETWEEN.match(html, at).end()
            if at >= n:
                return
            if html[at] == ">":
                at += 1
                break
            name = NAME.match(html, at)
            at, value = name.end(), ""
            if equals := EQUALS.match(html, at):
                at = equals.end()
                if html[at : at + 1] in ("'", '"'):
                    end = html.find(html[at], at + 1)
                    if end < 0:
                        return
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = VALUE.match(html, at)[0]
                    at += len(value)
            attributes.setdefault(name[0].lower(), value)
        if m[1]:
            yield "end", tag, None
            continue
        yield "start", tag, attributes
        if tag in RAW or tag == "plaintext":
            end = _raw_end(tag).search(html, at) if tag in RAW else None
            yield "text", html[at : end.start() if end else n], None
            at = end.start() if end else n


@dataclass
class Block:
    text: str
    node: int  # the number of the innermost open element
    odds: float  # of the containers
    tag: str
    linked: int = 0
    alone: float = 0.0  # the odds if the wrappers of its article were of no opinion
    free: float = 0.0  # the odds without any class word or form


@dataclass(slots=True)
class _Open:
    tag: str
    number: int
    odds: float
    hidden: bool
    bare: float = 0.0  # odds without the class words of wrappers
    alone: float = 0.0
    inside: bool = False  # an article or main
    block: str = "body"  # the innermost block element
    heading: bool = False
    free: float = 0.0
    suspect: int = -1  # its place in the list of suspects


@dataclass(slots=True)
class _Suspect:
    """An element with a class word against it, or a form: the blocks and controls in it."""

    node: int
    kind: str  # form, word, other
    first: int
    controls: int
    last: int = -1


class Parser:
    """Tolerant parser that yields text blocks; unclosed elements end as in browsers.

    ``parent`` and ``depth`` describe the element tree by the numbers of its
    elements.  The open elements are also listed by tag, so that nothing walks
    down the stack: the work is linear in the page, however deep it nests.
    """

    def __init__(self, html: str):
        pardoned: set[int] = set()
        while True:
            self._parse(html, pardoned)
            more = self._pardons(pardoned) if self.suspects else set()
            if not more:
                return
            pardoned |= more

    def _parse(self, html: str, pardoned: set[int]) -> None:
        self.pardoned = pardoned
        self.suspects: list[_Suspect] = []
        self.controls = 0
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked = 0
        for kind, x, attributes in markup(html):
            if kind == "text":
                self._text(x)
            elif kind == "start":
                self._start(x, attributes)
            else:
                self._end(x)
        self._flush()
        self._pop_to(0)
        self._weigh_articles()

    # elements

    def _last(self, tags) -> int:
        """The place of the innermost open element of ``tags``, else -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _start(self, tag: str, attributes: dict) -> None:
        if self.stack:
            self._close_head(tag)
        if tag in CONTROLS and attributes.get("type", "").lower() != "hidden":
            self.controls += 1
        if tag in VOID:
            if tag in BLOCK:
                self._flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self._flush()
        if tag in SIBLING:
            self._close_sibling(SIBLING[tag])
        elif tag in CLOSES_P:
            if (p := self._last(("p",))) > self._last(SCOPE):
                self._pop_to(p)
            if tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
                self._pop_to(len(self.stack) - 1)
        top = self.stack[-1] if self.stack else _Open("", 0, 0.0, False)
        odds, bare, free, hidden, role, suspect = self._judge(tag, attributes, top)
        inside = top.inside or role is not None
        alone = self._inherit(top.alone if top.inside else top.bare, odds) if inside else 0.0
        odds, bare, hidden = self._inherit(top.odds, odds), self._inherit(top.bare, bare), hidden or top.hidden
        free = self._inherit(top.free, free)
        if role == "main":
            odds = alone
        if suspect:
            self.suspects.append(_Suspect(len(self.parent), suspect, len(self.blocks), self.controls))
        self.parent.append(top.number)
        self.depth.append(self.depth[top.number] + 1)
        self.places.setdefault(tag, []).append(len(self.stack))
        block = tag if tag in BLOCK else top.block
        self.stack.append(_Open(tag, len(self.parent) - 1, odds, hidden, bare, alone if inside else odds, inside, block, top.heading or tag in HEADINGS, free, len(self.suspects) - 1 if suspect else -1))

    def _close_head(self, tag: str) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self._pop_to(len(self.stack) - 1)
        elif tag == "body" and not self.places.get("template") and self.places.get("head"):
            self._pop_to(self.places["head"][0])

    def _inherit(self, outer: float, own: float) -> float:
        # what is negative stays so inside; an article in a page part of no
        # opinion speaks for itself
        return min(outer, own) if outer < -2 or own < -2 else max(-8.0, min(5.0, outer + own))

    def _end(self, tag: str) -> None:
        i = self._last((tag,))
        if i < 0 or (tag not in OF_TABLE and self._last(CELLS) > i):
            return
        if tag not in BLOCK and max(self._last(SCOPE), self._last(("p",))) > i:
            return  # a stray inline end tag doesn't end blocks
        self._pop_to(i)

    def _pop_to(self, i: int) -> None:
        gone = self.stack[i:]
        if any(o.tag in BLOCK for o in gone):
            self._flush()
        for o in gone:
            self.places[o.tag].pop()
            if o.suspect >= 0:
                x = self.suspects[o.suspect]
                x.last, x.controls = len(self.blocks), self.controls - x.controls
        del self.stack[i:]

    def _close_sibling(self, tags: set[str]) -> None:
        i = self._last(tags)
        if i <= self._last(LISTS):
            return
        while i and self.stack[i - 1].tag in tags:
            i -= 1
        self._pop_to(i)

    # text

    def _text(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and not data.isspace():
            self._close_head("")
        if self.stack and self.stack[-1].hidden:
            return
        data = unescape(data) if "&" in data and not (self.stack and self.stack[-1].tag in ("xmp", "plaintext")) else data
        self.parts.append(data)
        if any(o.tag == "a" for o in self.stack[-4:]):
            self.linked += len(data.strip())

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                o = self.stack[-1] if self.stack else _Open("", 0, 0.0, False)
                self.blocks.append(Block(text, o.number, o.odds, o.block, self.linked, o.alone, o.free))
        self.parts, self.linked = [], 0

    def _weigh_articles(self) -> None:
        # articles in a wrapper with a bad word: where the rest of the page has
        # less to say, the word is about the layout
        held = sum(len(b.text) - b.linked for b in self.blocks if b.alone > b.odds)
        if held > sum(len(b.text) - b.linked for b in self.blocks if b.odds >= -2):
            for b in self.blocks:
                b.odds = b.alone

    def _pardons(self, pardoned: set[int]) -> set[int]:
        """Elements whose class word or form tag is not about the text in them.

        A form counts against its text by its controls.  A class word is about the
        layout where the element holds most of what the page says: OUTWEIGHS times
        the text elsewhere, or, for the words of OTHERS, all of it.  The largest
        such element goes first, with those inside that hold more than half of it.
        """
        said, could = [0], [0]  # text of blocks taken for content as it is, and without class words
        for b in self.blocks:
            size, evidence = len(b.text) - b.linked, _evidence(b)
            said.append(said[-1] + (size if b.odds >= -2 and evidence + b.odds > 0 else 0))
            could.append(could[-1] + (size if b.free >= -2 and evidence + b.free > 0 else 0))
        own = lambda x: could[x.last] - could[x.first]
        elsewhere = lambda x: said[-1] - said[x.last] + said[x.first]
        held = [x for x in self.suspects if x.node not in pardoned and own(x)]
        forms = {x.node for x in held if x.kind == "form" and own(x) >= TEXT_OF_CONTROL * x.controls}
        if forms:
            return forms
        words = [x for x in held if x.kind == "word" and own(x) > OUTWEIGHS * elsewhere(x) or x.kind == "other" and not elsewhere(x)]
        # what it hides already counts elsewhere if it is not hidden
        words = [x for x in words if said[x.last] - said[x.first] < own(x)]
        if not words:
            return set()
        top = max(words, key=own)
        return {x.node for x in self.suspects if x.kind != "form" and top.first <= x.first and x.last <= top.last and 2 * own(x) > own(top)}

    def _judge(self, tag: str, attributes: dict, top: _Open) -> tuple[float, float, float, bool, str | None, str | None]:
        """Log odds, those without class words, those without form and class words,
        whether it is hidden, article or main, and the kind of suspect."""
        get = lambda k: unescape(attributes.get(k) or "")
        style = get("style").replace(" ", "").lower()
        hidden = tag in HIDDEN and not (tag == "button" and top.heading)
        hidden = hidden or "hidden" in attributes or "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true"
        role_name = get("role").lower()
        odds = TAG_ODDS.get(tag, 0.0) + ROLE_ODDS.get(role_name, 0.0)
        if tag == "header" and self._last(("article", "main")) >= 0:
            odds += 2.0  # the heading of an article, not of the page
        role = next((x for x in ("main", "article") if x in (tag, role_name)), None)
        free, suspect = odds, None
        pardoned = len(self.parent) in self.pardoned
        if (tag == "form" or role_name == "form") and not pardoned:
            suspect, odds = "form", odds + FORM_ODDS
        bare = odds
        if tag not in ("html", "body", "article", "main", "h1", "h2", "h3"):
            names = ([w.lower() for w in WORD.findall(x)] for k in ("class", "id") for x in get(k).split())
            words = {w for name in names if name and name[0] not in LAYOUT for w in name}
            if words & NOT_CONTENT:
                if not pardoned:
                    odds += CLASS_ODDS
                    bare = odds if words & OTHERS else bare
                    suspect = suspect or ("other" if words & OTHERS else "word")
            elif words & CONTENT:
                odds, free = odds + GOOD_ODDS, free + GOOD_ODDS
                bare = odds
        return odds, bare, free, hidden, role, suspect


def log_odds(b: Block) -> float:
    """The classifier: above 0 it takes the block for content."""
    return b.odds + _evidence(b)


def _evidence(b: Block) -> float:
    """What the block itself says, without its containers."""
    words = len(b.text.split())
    density = b.linked / max(1, len(b.text))
    x = PRIOR + min(2.5, 0.9 * math.log1p(words / 4)) - 5.0 * density * (1 if words < 60 else 0.3)
    if b.text[-1:] in ".!?…»”\"。":
        x += 0.6
    if b.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        x += 0.6
    if b.text[0] in "©" or b.text.lower().startswith("copyright"):
        x -= 3.0
    return x


def _edges(p: Parser) -> Iterator[tuple[int, int, float]]:
    """Between a block and the next, and the next but some of the same parent."""
    parent, depth = p.parent, p.depth
    by_parent: dict[int, int] = {}
    for i, b in enumerate(p.blocks):
        if i:
            # what is walked here was opened or closed between the two
            x, y = p.blocks[i - 1].node, b.node
            distance = depth[x] + depth[y]
            while x != y:
                if depth[x] >= depth[y]:
                    x = parent[x]
                else:
                    y = parent[y]
            yield i - 1, i, SMOOTH / max(1, distance - 2 * depth[x] - 1)
        up = parent[b.node]
        if up in by_parent and by_parent[up] < i - 1:
            yield by_parent[up], i, NEAR
        by_parent[up] = i


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least total cost: True keeps a block.

    ``gain`` i: what is lost by dropping block i (negative: by keeping it);
    an edge (i, j, c) costs c where i and j get different labels.
    """
    n = len(gain)
    source, sink = n, n + 1
    to, cap, head = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, forward: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forward)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        add(*((source, i, g, 0.0) if g > 0 else (i, sink, -g, 0.0)))
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                back = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[back] ^ 1]
                del path[back:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = to[e]


def label(html: str, least: float = 0.0) -> list[tuple[Block, bool]]:
    """Blocks, and whether they are kept; ``least`` is added for blocks of which
    no container speaks against them."""
    p = Parser(html)
    return list(zip(p.blocks, min_cut([log_odds(b) + (least if b.odds >= -2 else 0.0) for b in p.blocks], list(_edges(p)))))


def main_text(html: str | None) -> str:
    """The kept blocks in page order, joined by two line ends.  Where none is
    kept, short plain blocks are all that the page has to say."""
    kept = [b.text for b, keep in label(html or "") if keep] or [b.text for b, keep in label(html or "", LONELY) if keep]
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null html = empty page.  Pages are independent of each other; repeated rows
    give repeated results.  Pages of any length and nesting are parsed whole, and
    no page is an error: comments, declarations and tags without an end run to
    the end of the page.  Formulas are text; buttons are not, except in headings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
