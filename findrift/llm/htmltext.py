"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's streaming parser turns a page into lines (blocks), each with its element.  Lines
inside elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts,
forms or comments go first.  A line's ratio is its text length per tag; the ratios are smoothed with a
Gaussian and split by a threshold, which clusters the lines into content and the rest.  The content
lines choose the region: the common ancestor of all ``article`` and ``main`` elements where those hold
enough of the content, else that of the content lines, with headings and paragraphs beside it.

Where the page marks its article, all of the region's lines are kept, short ones too.  Where it does not,
the cluster decides on the lines: link lists outside it go, and so do divisions of the region in which
no line is content.  Every step is linear in the page, however deep or broken its markup.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of a block ends an open paragraph; these end an open element of their own kind as well.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SAME_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
SKIP_TAGS = frozenset(
    "head script style noscript template nav header footer aside form menu search dialog button select textarea iframe object svg canvas audio video map".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names, split at anything but letters and digits and at camel case.
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices notification popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "footer masthead topbar comment comments commentlist disqus respond replies reactions share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login paywall pagination pager".split()
)
#: After these a word says what a wrapper goes without or beside, not what it is.
BESIDE = frozenset("has with no without".split())
CONTAINERS = ("article", "main")
#: Elements that are too small to be a region, and headings, which belong to a region beside them.
LEAVES = frozenset("p li td th tr h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that say nothing of what they hold.
DIVISIONS = frozenset("div section center td tr table tbody span a b i em strong small font".split())


class _Lines(HTMLParser):
    """Collects lines: (text, tags, element number, linked characters); elements count in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}  # where in the stack a name is open
        self.blocks: list[int] = []  # where in the stack blocks are open
        self.parent, self.tag, self.bad = [-1], [""], [False]
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.home = self.linked = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.home, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _cut(self, at: int) -> None:
        """Closes the elements from ``at`` in the stack on."""
        for name, _ in self.stack[at:]:
            self.places[name].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del self.stack[at:]

    def _close(self, names: set[str], stop: set[str]) -> None:
        """Closes the innermost element of ``names``, unless one of ``stop`` is open inside it."""
        last = lambda group: max((self.places[n][-1] for n in group if self.places.get(n)), default=-1)
        at = last(names)
        if at > last(stop):
            self._end_line()
            self._cut(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self._cut(self.blocks[-1])
            if tag in SAME:
                self._close(SAME[tag], SAME_STOP[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1][1]
        self.parent.append(above)
        self.tag.append(tag)
        self.bad.append(self.bad[above] or unwanted(tag, attrs))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, len(self.tag) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if self.blocks and self.blocks[-1] >= at:
            self._end_line()
            if tag not in BLOCKS:
                return  # a stray inline end tag does not close the blocks inside
        # Inline elements left open inside a closed block end with it.
        self._cut(at)

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] in ("script", "style"):
            return
        if not self.parts and not data.isspace():
            self.home = self.stack[-1][1]
        elif self.parts and self.bad[self.stack[-1][1]] != self.bad[self.home]:
            # An inline element that is unwanted must not take the line around it along.
            self._end_line() if self.bad[self.home] else None
            if self.bad[self.stack[-1][1]]:
                return
            self.home = self.stack[-1][1]
        if self.parts or not data.isspace():
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()


_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """True for elements that never hold the article: by tag, role, hidden state, class or id."""
    if tag in SKIP_TAGS:
        return True
    for name, value in attrs:
        if name in ("class", "id") and value and tag not in ("html", "body", "main"):
            words = [w.lower() for w in _WORD.findall(value)]
            if any(w in SKIP_WORDS and (not i or words[i - 1] not in BESIDE) for i, w in enumerate(words)):
                return True
        elif name == "role" and value and value.lower() in SKIP_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel of 2 * ceil(3 sigma) + 1 taps, renormalised at the ends."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(values, kernel)[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel)[r : r + len(values)]


def content_lines(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines belong to the content cluster: smoothed text-to-tag ratio over the threshold."""
    ratio = lengths / np.maximum(tags, 1)
    soft = smooth(ratio.astype(float))
    return soft >= min(soft.std(), soft.max())


def long_lines(lengths: np.ndarray, tags: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The picked lines that are content by themselves and not only beside it; all where there are none."""
    ratio = lengths / np.maximum(tags, 1)
    own = picked & (ratio >= min(smooth(ratio).std(), ratio.max()))
    return own if own.any() else picked


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one per line; empty where the page has none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    lines = [x for x in page.lines if not page.bad[x[2]]]
    if not lines:
        return ""
    lengths = np.array([len(x[0]) for x in lines])
    tags = np.array([x[1] for x in lines])
    picked = content_lines(lengths, tags)
    strong = long_lines(lengths, tags, picked)
    weight = [0] * len(page.parent)
    for x, n in zip(lines, np.where(strong, lengths, 0).tolist(), strict=True):
        weight[x[2]] += n
    last = list(range(len(page.parent)))
    for i in range(len(page.parent) - 1, 0, -1):
        above = page.parent[i]
        weight[above] += weight[i]
        last[above] = max(last[above], last[i])
    root, marked = _region(page, lines, weight, last)
    inside = [root <= x[2] <= last[root] for x in lines]
    keep = inside if marked else [a and b for a, b in zip(inside, _clustered(page, lines, root, picked, strong), strict=True)]
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def _region(page: _Lines, lines: list[tuple[str, int, int, int]], weight: list[int], last: list[int]) -> tuple[int, bool]:
    """The element that holds the content, and whether the page marks it: the common ancestor of all articles and mains with text, or of all content lines.

    Articles and mains count where they hold 0.4 of the content; headings and paragraphs beside the
    region widen it to the element around them (headings only, where that is the body).
    """
    outer, own, head = [], [False] * len(page.parent), [0] * len(page.parent)
    near = [0] * len(page.parent)  # the innermost heading or paragraph around
    for i in range(1, len(page.parent)):
        above, tag = page.parent[i], page.tag[i]
        own[i] = own[above] or tag in CONTAINERS
        if own[i] and not own[above] and weight[i]:
            outer.append(i)
        head[i] = i if tag in HEADINGS else head[above]
        near[i] = i if tag in HEADINGS or tag == "p" else near[above]
    marked = bool(outer) and sum(weight[i] for i in outer) >= 0.4 * weight[0]
    if marked:
        root = outer[0]
        while last[root] < outer[-1]:
            root = page.parent[root]
    else:
        root = max((i for i, w in enumerate(weight) if w == weight[0]), default=0)
    while root > 0 and page.tag[root] not in BLOCKS or page.tag[root] in LEAVES:
        root = page.parent[root]
    homes = sorted(x[2] for x in lines)
    lo, hi = bisect_left(homes, root), bisect_right(homes, last[root])
    while root > 0 and page.tag[root] not in ("main", "body", "html"):
        parent = page.parent[root]
        wide_lo, wide_hi = bisect_left(homes, parent), bisect_right(homes, last[parent])
        beside = homes[wide_lo:lo] + homes[hi:wide_hi]  # each line is beside the region once
        if page.tag[parent] in ("body", "html", ""):
            found = any(head[h] and page.parent[head[h]] == parent for h in beside)
        else:
            found = any(near[h] > parent for h in beside)
        if not found:
            break
        root, lo, hi = parent, wide_lo, wide_hi
    return root, marked


def _clustered(page: _Lines, lines: list[tuple[str, int, int, int]], root: int, picked: np.ndarray, strong: np.ndarray) -> list[bool]:
    """Which lines of an unmarked region stay: by the cluster, so far as a paragraph or heading doesn't speak for them.

    A line of which 0.8 is link text stays only if it is content itself; text right in the region stays
    if it is in the cluster; a division of the region stays if it has a content line, a paragraph or a
    heading.
    """
    branch, held = [0] * len(page.parent), set()
    for i in range(root + 1, len(page.parent)):
        above = page.parent[i]
        branch[i] = i if above == root else branch[above] if above > root else 0
        if page.tag[i] in HEADINGS or page.tag[i] == "p":
            held.add(branch[i])
    held |= {branch[x[2]] for x, k in zip(lines, strong, strict=True) if k}
    out = []
    for (text, _, home, linked), soft, own in zip(lines, picked.tolist(), strong.tolist(), strict=True):
        of = branch[home]
        if linked >= 0.8 * len(text) and not own:
            out.append(False)
        elif not of:
            out.append(soft)
        else:
            out.append(page.tag[of] not in DIVISIONS or of in held)
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of every page: ``id_col``, ``keep``, text, n_chars (code points).

    Text inside a block has its white space turned into single spaces; blocks are joined by one line
    feed; nothing else is dropped or cut.  Null, empty and text-free pages give an empty text.  One
    output row per input row, repeated rows included; a kept column named text or n_chars gives way to
    the output; other columns are ignored.
    """
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars", id_col.lower()))
    names = [id_col, *keep, "text", "n_chars"]
    n = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            texts = [main_text(h.as_py()) for h in part.column(n)]
            out = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *out], names=names)

    schema = T.StructType(
        [*[T.StructField(c, df.schema[c].dataType) for c in (id_col, *keep)], T.StructField("text", T.StringType()),
         T.StructField("n_chars", T.LongType())]
    )
    return lean(df.select(id_col, *keep, html_col)).mapInArrow(run, schema)
