"""Main text of HTML pages.

The standard library's parser is run as a stream of events that builds lines: a block of text with the
number of tags in it, the letters of it that are links, and where it stands. Each line has a ratio of text to
tags; the ratios are smoothed with a Gaussian over their neighbours and clustered by a threshold (a share of
their deviation). Clusters of lines over the threshold select the regions of content: the smallest element
that holds nearly all of their text, and the smallest one of each cluster that stands apart. A region's lines
are the text, short ones too, with the headings right above it. Lines under the threshold outside a region
aren't, nor are runs of mere links under it in a region that no tag calls an article. On pages without such a tag the
lone dense lines at both ends of the block with most dense text (a notice, a copyright line) aren't content either.

Tags, roles and names are features besides: a region grows to the article or main element that it stands in, and
to that element's fellow articles; what stands in menus, headers, footers, asides, forms, adverts, notices and
comments isn't content, unless only a class or id says so of what holds most of the dense text.

Defined results: null and empty pages give an empty text; a page whose lines are all navigation gives an
empty text; unclosed and truncated markup is read as far as it goes; repeated rows give repeated rows. Time is
in proportion to the page, however deep its elements are nested.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow

BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Whatever stands in these is never content.
DROPPED = frozenset("aside button datalist dialog footer form head iframe input label menu nav noscript object option script search select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body html".split())
#: Words of class and id, and roles, that mark what is not the article.
SIDE = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: With one of these a name speaks of the article or of a layout: entry-header, has-sidebar.
OWN = frozenset("article content entry has hidden no not post story with without".split())
#: What may stand beside such a word where only whole names count: share-box, related-posts.
FRAME = frozenset("area articles bar block box button buttons container form global icons inner item items left links list main mobile page panel posts right section site thread top widgets wrap wrapper".split())
PART = re.compile(r"[\s_-]+")
SIDE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
#: An opened block closes these, if they are open and nearer than the element that holds them.
CLOSES = {**{t: "p" for t in BLOCKS if t not in ("html", "head", "body")}, "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
SIGMA, THRESHOLD = 1.0, 0.5
#: The share of the dense text that a region holds, of a line's letters that makes it a link, and the links in a row that make a menu.
NEARLY_ALL, LINK, MENU = 0.9, 0.8, 3
#: The share of the main block's dense text under which a lone line at its ends isn't content.
LITTLE = 0.25
#: Headings, without digits and signs, that open the comments where nothing else marks them.
DISCUSSION = frozenset("comments|comment|reader comments|leave a comment|leave a reply|post a comment|discussion|responses|kommentare|kommentar schreiben|commentaires|laisser un commentaire|comentarios|deja un comentario".split("|"))
SPACE = re.compile(r"\s+")


def side_name(name: str, whole: bool) -> bool:
    """Whether a class or id marks what isn't content: by any of its words, or if whole, by all of them."""
    parts = [p for p in PART.split(name.lower()) if p]
    side = SIDE.intersection(parts)
    if whole:
        return bool(side - {"header"}) and SIDE.union(FRAME).issuperset(parts)
    return bool(side) and not OWN.intersection(parts)


class Lines(HTMLParser):
    """Events to lines: (text, tags, element, side, letters in links). element is a key of parent and kind; side is by tag or role, marks are apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.link = False
        self.open: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, not content, key
        self.count: Counter = Counter()  # of the open tags
        self.parent = [-1]
        self.kind = [""]
        self.marked: dict[int, bool] = {}  # elements whose class or id isn't content's, and whether by a whole name

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, side, key = self.open[-1]
            self.lines.append((text, self.tags, key, side, self.links))
            self.tags = 0
        self.parts, self.links = [], 0

    def push(self, tag: str, side: bool) -> None:
        self.parent.append(self.open[-1][2])
        self.kind.append(tag)
        self.open.append((tag, side or self.open[-1][1], len(self.parent) - 1))
        self.count[tag] += 1

    def close_from(self, k: int) -> None:
        self.count.subtract(t for t, _, _ in self.open[k:])
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = any(name == "href" for name, _ in attrs)
        close = CLOSES.get(tag)
        if close and (self.count[close] or close == "td" and self.count["th"]):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == close or close == "td" and self.open[k][0] == "th":
                    self.close_from(k)
                    break
                if self.open[k][0] in CONTAINERS or self.open[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID:
            return
        side = tag in DROPPED
        within = self.count["article"] + self.count["main"] > 0
        if not side and tag == "header":
            side = not within
        mark = None
        if not side and attrs and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if value and name == "role" and value.lower() in SIDE_ROLES or name == "hidden":
                    side = True
                elif value and name in ("class", "id") and tag in BLOCKS and tag not in HEADINGS:
                    names = value.split()
                    if any(side_name(n, True) for n in names):
                        mark = True
                    elif mark is None and name == "class" and not within and any(side_name(n, False) for n in names):
                        mark = False
        elif attrs and tag in ("article", "main"):
            # a reader's comment is often an article of its own
            if any(name == "class" and value and side_name(n, True) for name, value in attrs for n in (value or "").split()):
                mark = True
        if side and tag not in BLOCKS:
            self.flush()  # what stands before an inline element isn't its text
        if tag in BLOCKS or side or self.open[-1][1]:
            self.push(tag, side)
            if mark is not None:
                self.marked[len(self.parent) - 1] = mark

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = False
        if self.count[tag]:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    self.flush()
                    self.close_from(k)
                    return
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.parts.append(data)
            if self.link:
                self.links += len(data.strip())


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(math.ceil(2 * SIGMA))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel, mode="valid")


def dense_lines(p: Lines) -> tuple[list[bool], list[bool]]:
    """Whether each line's smoothed ratio is over the threshold, and whether its own one is too. Every line takes part,
    so that what stands beside menus is smoothed down."""
    own = np.array([len(text) / max(1, tags) for text, tags, *_ in p.lines], float)
    ratio = smoothed(own)
    least = THRESHOLD * ratio.std()
    return (ratio >= least).tolist(), ((ratio >= least) & (own >= least)).tolist()


def extract(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    if all(side for *_, side, _ in p.lines):
        return ""
    _mark_discussions(p)
    dense, alone = dense_lines(p)
    marked = _within(p, _trusted(p, dense))
    kept = [not side and not marked[key] for _, _, key, side, _ in p.lines]
    if not any(k and d for k, d in zip(kept, dense, strict=True)):
        dense = alone = kept
    apart = _within(p, _apart(p, kept, alone))
    kept = [k and not apart[line[2]] for k, line in zip(kept, p.lines, strict=True)]
    regions, named = _regions(p, kept, dense)
    inside, named = _within(p, regions), _within(p, named)
    # beside a region a line must be dense by itself: smoothing lends to neighbours
    take = [k and (d or inside[line[2]]) for k, d, line in zip(kept, alone, p.lines, strict=True)]
    for a, b in _menus(p, kept, alone):
        for i in range(a, b):
            take[i] = take[i] and named[p.lines[i][2]]
    for i in range(len(take) - 2, -1, -1):  # headings right above
        if kept[i] and take[i + 1] and p.kind[p.lines[i][2]] in HEADINGS:
            take[i] = True
    return "\n\n".join(line[0] for line, t in zip(p.lines, take, strict=True) if t)


def _within(p: Lines, keys: set[int]) -> list[bool]:
    """For every element whether it is one of keys or stands in one."""
    out = [False] * len(p.parent)
    for k in range(len(p.parent)):  # parents come before their children
        out[k] = k in keys or p.parent[k] >= 0 and out[p.parent[k]]
    return out


def _totals(p: Lines, weight: list[int]) -> list[int]:
    """weight by element, with all that stands in it."""
    total = list(weight)
    for k in range(len(p.parent) - 1, 0, -1):
        total[p.parent[k]] += total[k]
    return total


def _mark_discussions(p: Lines) -> None:
    """Marks the elements that a heading like "3 comments" opens."""
    first: dict[int, int] = {}
    for i, (_, _, key, _, _) in enumerate(p.lines):
        if p.kind[key] in HEADINGS:
            first.setdefault(p.parent[key], i)
        else:
            first.setdefault(key, -1)
    for key, i in first.items():
        if i >= 0 and p.kind[key] in ("div", "section") and key not in p.marked:
            words = " ".join(re.findall(r"[^\W\d_]+", p.lines[i][0].lower()))
            if words in DISCUSSION:
                p.marked[key] = True


def _trusted(p: Lines, dense: list[bool]) -> set[int]:
    """The marked elements that aren't content: those that hold most of the dense text are layout, unless an
    article or main element stands apart from them. For a whole name nearly all is asked for."""
    if not p.marked:
        return set()
    weight = [0] * len(p.parent)
    for (text, _, key, side, _), d in zip(p.lines, dense, strict=True):
        if d and not side:
            weight[key] += len(text)
    article = _within(p, {k for k, t in enumerate(p.kind) if t in ("article", "main")})
    total, named = _totals(p, weight), _totals(p, [n if article[k] else 0 for k, n in enumerate(weight)])
    return {k for k, whole in p.marked.items() if not (total[k] > (NEARLY_ALL if whole else 0.5) * total[0] and named[k] == named[0])}


def _apart(p: Lines, kept: list[bool], alone: list[bool]) -> set[int]:
    """Where no tag says which element is the article: the elements at either end of the block with most dense text, beside
    it or beside what it stands in, whose dense text is a lone line or none, and little against the block's. A block has
    several dense lines, so that pages whose paragraphs have an element each have no such ends."""
    if any(k in ("article", "main") for k in p.kind):
        return set()
    weight, count, first = [0] * len(p.parent), [0] * len(p.parent), [len(p.lines)] * len(p.parent)
    for i, ((text, _, key, _, _), k, d) in enumerate(zip(p.lines, kept, alone, strict=True)):
        first[key] = min(first[key], i)
        if k and d:
            weight[key] += len(text)
            count[key] += 1
    weight, count = _totals(p, weight), _totals(p, count)
    children: list[list[int]] = [[] for _ in p.parent]
    for k in range(len(p.parent) - 1, 0, -1):
        children[p.parent[k]].append(k)
        first[p.parent[k]] = min(first[p.parent[k]], first[k])
    out, at = set(), 0
    while (best := max(children[at], key=lambda k: weight[k], default=0)) and p.kind[best] in CONTAINERS and count[best] >= 2:
        little = {k for k in children[at] if p.kind[k] not in HEADINGS and count[k] <= 1 and weight[k] < LITTLE * weight[best]}
        rest = [first[k] for k in children[at] if k not in little and count[k]]
        out |= {k for k in little if first[k] < min(rest) or first[k] > max(rest)}
        at = best
    return out


def _regions(p: Lines, kept: list[bool], dense: list[bool]) -> tuple[set[int], set[int]]:
    """The elements that hold content; and those of them that a tag calls an article."""
    weight = [0] * len(p.parent)
    clusters: list[dict[int, int]] = []
    open_ = False
    for (text, _, key, _, _), k, d in zip(p.lines, kept, dense, strict=True):
        if k and d:
            weight[key] += len(text)
            if not open_:
                clusters.append({})
            clusters[-1][key] = clusters[-1].get(key, 0) + len(text)
        open_ = d and (k or open_)
    total = _totals(p, weight)
    children: list[list[int]] = [[] for _ in p.parent]
    for k in range(1, len(p.parent)):
        children[p.parent[k]].append(k)
    at = 0
    while best := max(children[at], key=lambda k: total[k], default=0):
        if p.kind[best] not in CONTAINERS or total[best] < NEARLY_ALL * total[at]:
            break
        at = best
    regions = {at}
    inside = _within(p, regions)
    for c in clusters:  # a cluster apart: the nearest element that holds it
        if not any(inside[k] for k in c):
            homes = {_container(p, k) for k in c}
            regions |= homes if len(homes) == 1 else set()
    # the article that a region stands in, or the articles that hold most of it
    up = [-1] * len(p.parent)  # the outermost article, else main, around each element
    for k in range(1, len(p.parent)):
        above = up[p.parent[k]]
        up[k] = k if p.kind[k] == "article" and (above < 0 or p.kind[above] == "main") or p.kind[k] == "main" and above < 0 else above
    regions = {up[k] if up[k] >= 0 else k for k in regions}
    articles = [k for k in range(len(p.parent)) if p.kind[k] == "article" and up[k] == k and k not in p.marked]
    beside = {p.parent[k] for k in articles if total[k]}
    fellows = {k for k in articles if total[k] or p.parent[k] in beside}
    if 2 * sum(total[k] for k in fellows) > total[0]:
        # of an element around them only what is dense counts besides
        regions = {k for k in regions if up[k] >= 0 and p.kind[up[k]] == "article"} | fellows
    return regions, {k for k in regions if p.kind[k] in ("article", "main")}


def _container(p: Lines, key: int) -> int:
    while key > 0 and p.kind[key] not in CONTAINERS:
        key = p.parent[key]
    return key


def _menus(p: Lines, kept: list[bool], dense: list[bool]):
    """Runs [a, b) of at least MENU lines in a row that are links and under the threshold."""
    at = None
    for i in range(len(p.lines) + 1):
        text, links = (p.lines[i][0], p.lines[i][4]) if i < len(p.lines) else ("", 0)
        if i < len(p.lines) and kept[i] and not dense[i] and links >= LINK * len(text):
            at = i if at is None else at
        elif at is not None:
            if i - at >= MENU:
                yield at, i
            at = None


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row. Map only."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
