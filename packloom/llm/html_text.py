"""Main text of web pages: text-to-tag ratios over a stream of parser events.

The standard library's parser feeds events to a builder that holds one line
(block of text) at a time. A line has its text, the tags met since the line
before, the share of its text inside links, and the element it lies in.
Text-to-tag ratios are smoothed with a Gaussian over the page's lines. Names,
roles and tags that speak of menus, adverts, comments and the like are a
feature: they divide the ratio of the lines inside, unless most of the page's
prose is in there, as in a wrapper that is called after its sidebar. A
threshold then splits the lines into two clusters, content and rest.

The region is the element with the largest balance: the text of the content
cluster inside it, less what is of the other cluster and is linked or
divided. An article or main element goes before others of equal balance. All
lines of the region count, short ones too, save linked and divided ones of the
lower cluster. All of it is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SECTION = frozenset("article body div main section table td".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
# Elements whose text is not shown, or is a control's.
_UNSEEN = frozenset("button canvas datalist head iframe noscript object option script select style svg template textarea title".split())
# Elements that seldom hold content.
_APART = frozenset("aside dialog footer form menu nav search".split())
_ENDS = _UNSEEN | _APART
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id that speak of what is no content.
_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation
    navigations newsletter notice notices outbrain pagination pager paywall popup promo promos promotion promoted recommended related
    respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar
    widget widgets""".split()
)
_HEAD_NAMES = frozenset(("header", "site-header", "page-header", "top-header"))
_WITH = frozenset("has have no not with without".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
# Marks of elements: none, named after something else too, outright, a header.
PLAIN, WEAK, STRONG, HEADER = range(4)
# What a mark divides the smoothed ratio by.
_DIVIDED = 100.0


def _named(value: str) -> int:
    """What a class or id says: outright if the last word of a name does."""
    mark = PLAIN
    for name in value.split():
        words = _WORD.findall(name)
        if words and words[0] not in _WITH and not _NAMES.isdisjoint(words):
            mark = max(mark, STRONG if words[-1] in _NAMES else WEAK)
    return mark


class _Line:
    __slots__ = ("links", "node", "tags", "text")

    def __init__(self, text, tags, links, node):
        self.text, self.tags, self.links, self.node = text, tags, links, node


class _Lines(HTMLParser):
    """Events to lines, and a tree of the elements that may be a region or are
    marked. ``skip`` counts open elements whose text is not shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, starts a skip, is a node
        self.count: Counter[str] = Counter()  # open elements by tag
        self.parent, self.tag, self.mark = [0], ["html"], [PLAIN]  # of each node
        self.inner = [0]  # open nodes
        self.parts: list[str] = []
        self.tags = self.links = self.skip = self.anchors = 0

    def parse_marked_section(self, i, report=1):
        """A declaration like <![x[...]]>, of whatever kind, is no text."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _looks(self, tag: str, attrs) -> tuple[bool, int]:
        """Whether an element is not shown, and its mark."""
        if tag in _UNSEEN:
            return True, PLAIN
        mark = WEAK if tag == "form" else STRONG if tag in _APART else PLAIN
        inside = self.count["article"] or self.count["main"]
        if tag == "header" and not inside:
            mark = HEADER
        whole = tag in ("html", "body", "article", "main")
        for k, v in attrs:
            if k == "hidden":
                return not whole, PLAIN
            if not v:
                continue
            if k == "aria-hidden" and v.lower() == "true" or k == "style" and "display:none" in v.replace(" ", "").lower():
                return not whole, PLAIN
            if whole and tag != "article":
                continue
            if k == "role" and v.lower() in _ROLES:
                mark = max(mark, STRONG)
            elif k in ("class", "id"):
                low = v.lower()
                named = _named(low)
                if tag == "article":  # a comment or an advert of its own; other names are the site's
                    named = STRONG if named and not {"comment", "comments", "ad", "advert", "promo", "sponsored"}.isdisjoint(_WORD.findall(low)) else PLAIN
                mark = max(mark, named)
                if mark == PLAIN and not inside and not _HEAD_NAMES.isdisjoint(low.split()):
                    mark = HEADER
        return False, mark

    def _end_line(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.lines.append(_Line(text, self.tags, self.links, self.inner[-1]))
                self.tags = self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ") if not self.skip else None
            self.tags += 1
            return
        if tag not in _INLINE:
            self._end_line()
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            self._close("p", _CLOSES_P - {"p"})
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close(tag, frozenset(("ul", "ol", "dl", "table", "select")) | _SECTION - {"td"})
        unseen, mark = self._looks(tag, attrs)
        if tag in _INLINE and mark:
            unseen, mark = True, PLAIN
        node = not self.skip and (tag in _SECTION or mark != PLAIN)
        if node:
            self.parent.append(self.inner[-1])
            self.tag.append(tag)
            self.mark.append(mark)
            self.inner.append(len(self.parent) - 1)
        self.skip += unseen
        self.anchors += tag == "a"
        self.count[tag] += 1
        self.open.append((tag, unseen, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "object"):
            self.handle_endtag(tag)

    def _close(self, tag, until=frozenset()):
        """Close the innermost ``tag``, and what is open inside it."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                break
            if name in until:
                return
        while len(self.open) > k:
            name, unseen, node = self.open.pop()
            self.count[name] -= 1
            self.skip -= unseen
            self.anchors -= name == "a"
            if node:
                self.inner.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ") if not self.skip else None
            return
        if tag not in _INLINE:
            self._end_line()
        if tag in _INLINE:
            self._close(tag, _CLOSES_P | _SECTION | {"li"})
        elif tag not in ("html", "body"):
            self._close(tag, frozenset() if tag in _SECTION or tag in _ENDS or tag in ("header", "ul", "ol", "table") else _SECTION | _ENDS)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data)

    def done(self) -> list[_Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed_ratios(lines: list[_Line], sigma: float = 1.0) -> np.ndarray:
    """Characters outside links per tag, smoothed over neighbouring lines."""
    r = np.array([max(len(x.text) - x.links, 0) / max(x.tags, 1) for x in lines], float)
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(r)), kernel)[reach : reach + len(r)]
    return np.convolve(r, kernel)[reach : reach + len(r)] / weight


def content_cluster(ratios: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Which lines are above the threshold that separates two clusters: midway
    between the clusters' means, iterated from the overall mean."""
    cut = ratios.mean()
    for _ in range(rounds):
        high = ratios >= cut
        if high.all() or not high.any():
            break
        new = (ratios[high].mean() + ratios[~high].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return ratios >= min(cut, ratios.max())


def _upwards(values: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Sums over subtrees; nodes are numbered from the outside in."""
    out = values.tolist()
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return np.array(out)


def main_text(html: str) -> str:
    """Blocks of the page's content, in page order, joined by blank lines."""
    parser = _Lines()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    parent, mark = parser.parent, np.array(parser.mark)
    nodes = len(parent)
    node = np.array([x.node for x in lines])
    size = np.array([len(x.text) for x in lines], float)
    links = np.array([x.links for x in lines], float)
    by_node = lambda values: _upwards(np.bincount(node, values, minlength=nodes), parent)

    # Marks count unless nearly all prose is inside; weak ones not even with most of it.
    prose = np.maximum(size - links, 0)
    held = by_node(prose)
    share = held / max(held[0], 1.0)
    marked = (mark != PLAIN) & ~((share >= 0.95) | (mark == WEAK) & (share >= 0.5))
    apart, heads = [False] * nodes, [False] * nodes  # in a marked element; in a header only
    for k in range(1, nodes):
        apart[k] = apart[parent[k]] or bool(marked[k] and mark[k] != HEADER)
        heads[k] = heads[parent[k]] or bool(marked[k] and mark[k] == HEADER)
    apart, heads = np.array(apart)[node], np.array(heads)[node]

    ratios = smoothed_ratios(lines)
    chosen = content_cluster(np.where(apart | heads, ratios / _DIVIDED, ratios))
    poor = ~chosen & (apart | heads | (2 * links >= size))
    # Headings and other short lines weigh nothing either way.
    balance = by_node(np.where(chosen, size, np.where(poor, -size, 0.0)))
    eligible = [k for k in range(nodes) if parser.tag[k] in _SECTION or not k]
    region = max(eligible, key=lambda k: (balance[k], parser.tag[k] in ("article", "main"), k))
    inside = [False] * nodes
    for k in range(region, nodes):
        inside[k] = k == region or inside[parent[k]] and k > 0
    # A header inside the region is the article's own, unless the region is the page.
    keep = np.array(inside)[node] & ~(poor & ~(heads & ~apart & (parser.tag[region] not in ("html", "body")) & (2 * links < size)))
    return "\n\n".join(x.text for x, ok in zip(lines, keep.tolist(), strict=True) if ok)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns ``keep``, text string (empty if none),
    n_chars long (its code points). Null or empty pages give an empty text;
    broken markup is read as far as the parser gets, which is to its end.
    Nothing is shortened. Repeated rows are repeated; other columns, whatever
    their names, are left out. Empty input: no rows."""
    source = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column(len(names)).to_pylist()]
                cols = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{schema}, text string, n_chars long")
    return out.toDF(*keep, "text", "n_chars")
