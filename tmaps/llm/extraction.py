"""HTML main-text extraction by composite text density.

Every element has C characters and T tags below it, of which LC characters and LT tags
belong to links. Its composite density is C / T, adjusted for links:

    C/T * log((C / LC) * (T / LT)) / log(ln(LC * C / (C - LC) + LC_body * C / C_body + e))

where a count of 0 is taken as 1. The element whose children's densities have the largest
sum holds the article. The least density on the path from it to ``body`` is the threshold:
going up that path, neighbours as dense as that, of at least ``LIKE`` of the article's own
density and not made of links, belong to the article too. The outermost ``article`` around
the result is taken whole, with the articles beside it; below ``main`` also the headings,
paragraphs and as dense neighbours of the path up to it. Without an article, ``main`` is
taken whole. Readers' comments are no articles, whatever their element.

What is marked as something else is left out before the counts: scripts and styles, menus,
page headers and footers, sidebars, forms, adverts, comments (by element, role, or a whole
class or id). A class or id is a hint: headings and paragraphs are never left out for it,
nor what holds most of the page's unlinked text (unless it names readers' comments and
nothing else); words that name subjects as well ("related", "discussion") count only for
what is mostly links, but some of them ("notice", "share") mark a ``div`` that has them as its
class. A name with "comment" or "disqus" in it marks comments whatever its other words are.

Inside a block, white space is one space; blocks are joined by an empty line. ``br`` is
white space. A tag cut off by the end of the page is no text.

Defined cases: null and empty pages give the empty text, as do pages without text; null
ids and urls stay; repeated rows give repeated results; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import pieces

# fixed values: names of the markup language and words that sites use in class and id
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s"
                   " samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form header menu dialog button select"
                    " textarea input iframe svg canvas object embed audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar"
                          " toolbar tablist status".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle googleads sponsor"
                          " sponsored promo banner banners sidebar sidebars menu menus topmenu submenu nav navbar topnav subnav sidenav"
                          " navigation breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr popup modal overlay"
                          " newsletter login signup pagination pager toolbar".split())
# words that name subjects too: what they mark goes only if most of it is links
HINT_WORDS = frozenset("aside foot respond responses discussion notice notices notification alert promotion promoted subscribe"
                       " subscription share sharing social related recommended recommendations widget form search copyright".split())
# as the class of a plain box these name what it is, not what it is about
BOX_WORDS = frozenset("notice notices notification alert share sharing social related recommended promotion subscribe search".split())
BOXES = frozenset(["div", "ul", "span"])
PART_WORDS = frozenset("comment comments disqus".split())
# a class such as "ad-box" says no more than "ad"
NEUTRAL_WORDS = frozenset("top bottom left right main site page global primary secondary box block bar wrapper wrap container inner"
                          " outer area list links section item items unit slot row col column panel post article entry posts articles entries"
                          " button buttons icon icons message messages text user reader site".split())
KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6 p".split())  # never left out for a class or id
# a start tag of the first closes an open one of the second, up to the third
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1"
                     " h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
LIKE = 0.25
DEPTH = 512  # deeper elements are kept as neighbours, as browsers do
P_SCOPE = frozenset("button table td th caption object applet html".split())
NEEDED = frozenset(["article", "main"])
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre br".split())

# how surely an element is something else: by a word that may be a subject, by a word (also
# for comments beside other words), as readers' comments, or by its name, its role or being hidden
HINT, WORD, COMMENT, SURE = 1, 2, 3, 4

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z)|/?[a-zA-Z][^>]*\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(65536)
def named(token: str, subject: bool, box: bool = False) -> int:
    """What a whole class or id says; the id of a section is its subject, the class of a
    plain box is not."""
    words = [w.rstrip("0123456789") for w in _WORD.findall(_CAMEL.sub(" ", token).lower())]
    said = [w for w in words if w and w not in NEUTRAL_WORDS]
    if not said or not all(w in COMMENT_WORDS or w in DROPPED_WORDS or w in HINT_WORDS for w in said):
        return WORD if not subject and any(w in PART_WORDS for w in said) else 0
    if any(w in COMMENT_WORDS for w in said):
        return COMMENT
    return WORD if not subject and any(w in DROPPED_WORDS or box and w in BOX_WORDS for w in said) else HINT


class Page:
    """Elements in document order (parents before children) and texts in page order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.dropped = ["#page"], [-1], [0]
        self.open = Counter()  # open elements by name
        self.items: list[tuple[int, str | None]] = []  # (element, text), or None for a block's edge
        self.parse(html)

    def parse(self, html: str) -> None:
        stack, at, page_end = [0], 0, len(html)
        for m in iter(_Scanner(html)):
            if m.start() > at:
                self.items.append((stack[-1], unescape(html[at:m.start()])))
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                self.close(stack, name)
                continue
            if name in CLOSES_P:
                self.imply(stack, ("p",), P_SCOPE)
            if name in CLOSES:
                self.imply(stack, *CLOSES[name])
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.dropped.append(self.marked(name, m.group(3)))
            if name == "br":
                self.items.append((k, " "))
            elif name not in INLINE:
                self.items.append((stack[-1], None))
            if name not in VOID and len(stack) < DEPTH:
                stack.append(k)
                self.open[name] += 1
        if at < page_end:
            self.items.append((stack[-1], unescape(html[at:])))

    def leave(self, stack: list[int], depth: int) -> None:
        for k in stack[depth:]:
            self.open[self.tag[k]] -= 1
        del stack[depth:]

    def close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1) if self.open[name] else ():
            if self.tag[stack[depth]] == name:
                if any(self.tag[x] not in INLINE for x in stack[depth:]):
                    self.items.append((stack[depth], None))
                self.leave(stack, depth)
                return
            if name in INLINE and self.tag[stack[depth]] not in INLINE:
                return  # a stray end tag does not close the blocks around it
        if name == "p":
            self.items.append((stack[-1], None))

    def imply(self, stack: list[int], names, scope) -> None:
        if not any(self.open[x] for x in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name in names:
                self.leave(stack, depth)
                return
            if name in scope:
                return

    @staticmethod
    def marked(name: str, attributes: str) -> int:
        if name in DROPPED:
            return SURE
        if name in ("html", "body", "main") or len(attributes) < 3:
            return 0
        mark = 0
        for m in _ATTR.finditer(attributes[:-1]):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id"):
                if name not in KEPT:
                    said = max((named(x, key == "id" and name == "section", key == "class" and name in BOXES) for x in value.split()), default=0)
                    mark = max(mark, said if name != "article" or said == COMMENT else 0)
            elif key == "role":
                if value.strip().lower() == "comment":
                    mark = max(mark, COMMENT)
                elif name != "article" and value.strip().lower() in DROPPED_ROLES:
                    return SURE
            elif name == "article":
                continue
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return SURE
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return SURE
        return mark

    def left_out(self) -> list[bool]:
        """Elements that are marked as something else, with all below them."""
        n, tag, parent, mark = len(self.tag), self.tag, self.parent, self.dropped
        # elements that hold the article cannot be left out, nor a heading's own wrapper inside it
        holds, titled, inside = [False] * n, [False] * n, [False] * n
        # (a reader's comment, or an article of a part for comments, is not the article, unless
        # the page has no other)
        readers, free = [False] * n, False
        for k in range(1, n):
            inside[k] = inside[parent[k]] or tag[k] in NEEDED
            readers[k] = readers[parent[k]] or mark[k] == COMMENT
            free = free or tag[k] in NEEDED and not readers[k]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            holds[k] = holds[k] or tag[k] in NEEDED and not (free and readers[k])
            holds[p] = holds[p] or holds[k]
            titled[p] = titled[p] or titled[k] or tag[k] == "h1"
        # characters outside and inside of links, without what is surely something else
        gone, linked, plain, links = [False] * n, [False] * n, [0] * n, [0] * n
        for k in range(1, n):
            gone[k] = gone[parent[k]] or mark[k] >= COMMENT and not holds[k]
            linked[k] = linked[parent[k]] or tag[k] == "a"
        for k, text in self.items:
            if text and not gone[k]:
                (links if linked[k] else plain)[k] += len(text) - text.count(" ")
        for k in range(n - 1, 0, -1):
            plain[parent[k]] += plain[k]
            links[parent[k]] += links[k]
        out = [False] * n
        for k in range(1, n):
            if out[parent[k]]:
                out[k] = True
            elif mark[k] and not holds[k] and not (titled[k] and (inside[k] and tag[k] == "header" or tag[k] not in DROPPED)):
                most = 2 * plain[k] > plain[0]
                out[k] = mark[k] >= COMMENT or not most and (mark[k] == WORD or links[k] >= plain[k])
        return out

    def above(self, k: int) -> list[int]:
        """The elements that hold this one, innermost first."""
        path = []
        while self.parent[k] >= 0:
            k = self.parent[k]
            path.append(k)
        return path

    def text(self) -> str:
        n, tag, parent = len(self.tag), self.tag, self.parent
        out = self.left_out()
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for k in range(1, n):
            linked[k] = linked[parent[k]] or tag[k] == "a"
        for k, text in self.items:
            if text and not out[k]:
                size = len(text) - text.count(" ")
                chars[k] += size
                if linked[k]:
                    link_chars[k] += size
        for k in range(n - 1, 0, -1):
            if out[k]:
                continue
            p = parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k] + (tag[k] == "a")
        body = next((k for k in range(n) if tag[k] == "body"), 0)
        if not chars[body]:
            body = 0
        ratio = link_chars[body] / max(1, chars[body])

        def density(k: int) -> float:
            c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
            if not c:
                return 0.0
            base = math.log(max(lc * c / max(1, c - link_chars[k]) + ratio * c + math.e, math.e))
            return c / t * max(0.0, math.log(max(c / lc * (t / lt), 1e-9)) / max(math.log(base), 1.0) if base > 1 else math.log(max(c / lc * (t / lt), 1e-9)))

        titles = [False] * n
        for k in range(n - 1, 0, -1):
            titles[parent[k]] = titles[parent[k]] or not out[k] and (titles[k] or tag[k] == "h1")
        dense = [density(k) if not out[k] else 0.0 for k in range(n)]
        total = [0.0] * n
        for k in range(1, n):
            total[parent[k]] += dense[k]
        best = max((k for k in range(n) if not out[k]), key=lambda k: (total[k], chars[k], -k), default=0)
        path = [best, *self.above(best)]
        around = [k for k in path if tag[k] in NEEDED]
        if not around:  # the densest place lies outside of the article that the page names
            chosen = [k for k in range(n) if tag[k] in NEEDED and not out[k] and chars[k]]
            if chosen:
                around = [max(chosen, key=lambda k: (chars[k], -k))]
                around += [k for k in self.above(around[0]) if tag[k] in NEEDED]
        taken, own = [False] * n, set()
        children: dict[int, list[int]] = {}
        for k in range(1, n):
            children.setdefault(parent[k], []).append(k)
        if around:
            # the outermost article whole, and what belongs to it: up to `main`, or beside it
            whole = next((k for k in reversed(around) if tag[k] == "article"), around[-1])
            taken[whole] = True
            up = self.above(whole)
            mains = [i for i, k in enumerate(up) if tag[k] == "main"]
            in_main = bool(mains)
            up = up[:mains[-1] + 1] if in_main else up[:1]
            threshold = min([LIKE * dense[whole], *(dense[k] for k in up)])
            spoken = {k for k, text in self.items if text and not text.isspace()}
            for k in up:
                if in_main:
                    own.add(k)
                for x in children.get(k, ()):
                    if in_main and k in spoken and tag[x] in INLINE:  # a part of its text
                        taken[x] = True
                    if out[x] or x == whole or not chars[x] or 2 * link_chars[x] >= chars[x]:
                        continue
                    if tag[x] == "article" or in_main and (tag[x] in TEXT_TAGS or tag[x] in INLINE or titles[x] or dense[x] >= threshold):
                        taken[x] = True
        else:
            up = path[:path.index(body) + 1] if body in path else path
            threshold = min(dense[k] for k in up)
            taken[best] = True
            for k in up[1:]:
                for x in children.get(k, ()):
                    if not out[x] and dense[x] >= max(threshold, LIKE * dense[best]) and 2 * link_chars[x] < max(1, chars[x]) and tag[x] not in INLINE:
                        taken[x] = True
            if not chars[best]:
                taken[0] = True
        for k in range(1, n):
            taken[k] = (taken[k] or taken[parent[k]]) and not out[k]
        for k in own:
            taken[k] = True  # its own text; its children were chosen
        blocks, now = [], []
        for k, text in self.items:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif taken[k]:
                now.append(text)
        if now:
            blocks.append("".join(now))
        return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


class _Scanner:
    """Tags and comments in order; the contents of raw elements are one tag's tail."""

    def __init__(self, html: str) -> None:
        self.html = html

    def __iter__(self):
        at, html = 0, self.html
        while True:
            m = _TAG.search(html, at)
            if m is None:
                return
            at = m.end()
            yield m
            name = m.group(2)
            if name and not m.group(1) and name.lower() in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                yield _Skip(at, len(html) if end is None else end.start())
                at = len(html) if end is None else end.start()


class _Skip:
    """A stretch that is neither text nor a tag."""

    def __init__(self, start: int, end: int) -> None:
        self._start, self._end = start, end

    def start(self) -> int:
        return self._start

    def end(self) -> int:
        return self._end

    def group(self, _: int) -> None:
        return None


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
