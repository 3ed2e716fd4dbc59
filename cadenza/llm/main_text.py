"""Main text of web pages by tag-path ratios.

A page is cut into nodes: the text between two block tags, under the path of open block tags from the
root. For every path of a page, the characters outside links and the punctuation marks of its nodes are
summed and divided by the number of nodes; both ratios are smoothed over the nodes in page order,
averaged back to the path, and multiplied. Paths above a share of the page's mean (weighted by
characters) are content. A container that has most of its text on content paths gives the rest of its
nodes too, but for link lists, and so do headings in front of a selected node. Where a page marks its
article (`article`, else `main` or role=main), only nodes inside it can be chosen, and paths there are
left out only if they consist of links.

What the markup itself names as something else never competes: navigation, page headers (a header inside
an article is the article's), footers, asides, forms, dialogs, scripts, styles, hidden elements, and
elements whose class, id or role names a menu, sidebar, notice, advert, share bar or comments.

A page is one row, so its paths are complete where it is read: nothing is shuffled, and a task holds a
few megabytes of pages at a time. A lost executor costs a re-read of its pages.

Edge cases: null and empty pages, and pages without text, give an empty text; unclosed elements end with
their parent, an unclosed script or comment at the page's end; a reference that HTML doesn't define
stays as written; white space is Unicode's (a no-break space counts); repeated pages each give a row;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices_of

# HTML's element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template svg math object canvas audio video select".split())
#: Of these, the ones that a slash doesn't close.
ENDLESS = set("script style title textarea xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = set("main article section div td th".split())
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that end an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are no article text, whatever they say.
OTHER = set("nav footer aside form dialog menu head button fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
#: Words in names of classes and ids of other parts of a page.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner comment comments commentlist disqus respond replies reply "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended recommendations recirculation widget widgets toolbar pagination pager copyright disclaimer hidden".split()
)
#: A name with one of these speaks about another part of the page.
ABOUT = set("has with no not without is open opened closed enabled show hide layout".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|</?([A-Za-z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*\Z", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?…¿¡·،؛؟।。、，；：！？]")
_TOKEN = re.compile(r"[a-z0-9]+")
_ROOT = 0


def _named_other(tag: str, attributes: str) -> bool:
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").strip().lower()
    if role in ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if tag in ("html", "body"):
        return False
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        tokens = _TOKEN.findall(name)
        if not ABOUT & set(tokens) and NAMES & set(tokens[:1] if tag in ("article", "main") else tokens):
            return True
    return False


class _Page:
    """The nodes of one page: (path, container, landmark, heading, chars, link chars, punctuation, text)."""

    def __init__(self, paths: dict[tuple[int, str], int]):
        self.paths, self.nodes, self.parts = paths, [], []
        #: open elements: tag, path, container (0 is the page), landmark (2 article, 1 main), other part
        self.open = [("", _ROOT, 0, 0, False)]
        self.count: dict[str, int] = {}
        self.link, self.containers = False, 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text and not self.open[-1][4]:
            tag, path, container, landmark, _ = self.open[-1]
            linked = len(" ".join("".join(x for x, link in self.parts if link).split()))
            self.nodes.append((path, container, landmark, tag in HEADINGS, len(text), linked, len(_PUNCTUATION.findall(text)), text))
        self.parts = []

    def add(self, raw: str) -> None:
        if raw and not self.open[-1][4]:
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.link))

    def push(self, tag: str, attributes: str, void: bool) -> None:
        if tag in ENDS_P and self.count.get("p"):
            self.pop("p")
        scope = LISTS.get(tag)
        if scope and self.count.get(tag):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in scope:
                    break
                if self.open[k][0] == tag:
                    self.pop(tag)
                    break
        _, path, container, landmark, inside = self.open[-1]
        other = inside or tag in OTHER or (tag == "header" and not landmark) or _named_other(tag, attributes)
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        if not other:
            landmark = 2 if tag == "article" else max(landmark, 1) if tag == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", attributes) else landmark
        path = self.paths.setdefault((path, tag), len(self.paths) + 1)
        if not void:
            self.open.append((tag, path, container, landmark, other))
            self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self, tag: str) -> None:
        if self.count.get(tag):
            while True:
                last = self.open.pop()[0]
                self.count[last] -= 1
                if last == tag:
                    break
            self.link = False


def nodes(page: str | None, paths: dict[tuple[int, str], int]) -> list[tuple]:
    """The text nodes of a page outside the parts that its markup names as something else. `paths` numbers
    (number of the parent's path, tag) and is shared by pages."""
    page = page or ""
    out, at = _Page(paths), 0
    last = page.rfind(">") + 1  # no tag ends behind it
    hidden, depth = "", 0  # an inline element that names another part, and how many of its tag are open
    while found := _TAG.search(page, at, last):
        if not depth:
            out.add(page[at : found.start()])
        at = found.end()
        tag, attributes, end = (found[1] or "").lower(), found[2] or "", page[found.start() + 1] == "/"
        if page.startswith("<!--", found.start()) and page[at - 3 : at] not in ("-->", "-!>"):
            at = len(page)  # a comment that isn't closed
        elif tag in RAW and not end:
            if tag not in INLINE:
                out.flush()
            if not attributes.endswith("/") or tag in ENDLESS:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at, last)
                at = close.end() if close else len(page)
        elif tag in INLINE:
            if depth:
                depth += (tag == hidden) * (-1 if end else 1)
            elif tag == "a":
                out.link = not end
            if not depth and not end and tag not in VOID and attributes and _named_other(tag, attributes):
                hidden, depth = tag, 1
        elif tag:
            depth = 0
            out.flush()
            if not end:
                out.push(tag, attributes, tag in VOID)
            elif tag != "br":
                out.pop(tag)
    if not depth:
        out.add(_CUT_TAG.sub("", page[at:]))
    out.flush()
    return out.nodes


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def _smoothed(values: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Means of every node and its neighbours on the same page, with weights 1, 2, 1."""
    total, weight = 2.0 * values, np.full(len(values), 2.0)
    same = page[1:] == page[:-1]
    for here, there in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
        total[here] += np.where(same, values[there], 0)
        weight[here] += same
    return total / weight


def chosen(page: np.ndarray, found: list[tuple], share: float = 0.3) -> np.ndarray:
    """Which nodes are main text. page: the number of each node's page, ascending."""
    n = len(found)
    if not n:
        return np.zeros(0, bool)
    path, container, landmark, heading, chars, linked, marks = (np.array([x[k] for x in found]) for k in range(7))
    n_pages = int(page[-1]) + 1
    marked = np.zeros(n_pages, landmark.dtype)
    np.maximum.at(marked, page, landmark)
    eligible = landmark == marked[page]
    _, group = np.unique(np.stack([page, path, eligible]), axis=1, return_inverse=True)
    group = group.ravel()
    free, size = np.where(eligible, chars - linked, 0), np.bincount(group)
    length, dots = _sums(group, free, len(size)) / size, _sums(group, np.where(linked >= chars, 0, marks), len(size)) / size
    length, dots = (_sums(group, _smoothed(x[group], page), len(size)) / size for x in (length, dots))
    score = (length * (1 + dots))[group]
    weight = np.maximum(_sums(page, free, n_pages), 1)
    least = share * _sums(page, free * score, n_pages) / weight
    links = (_sums(group, linked, len(size)) > 0.8 * _sums(group, chars, len(size)))[group]
    inside = marked[page] > 0
    take = eligible & np.where(inside, ~links, (score >= least[page]) & (free > 0))
    _, box = np.unique(np.stack([page, container]), axis=1, return_inverse=True)
    box = box.ravel()
    part = _sums(box, free * take, box.max() + 1) / np.maximum(_sums(box, free, box.max() + 1), 1)
    take |= eligible & ~links & (container > 0) & (part[box] >= 0.5)
    for _ in range(2):  # a heading and one above it
        after = np.append(take[1:] & (page[1:] == page[:-1]), False)
        take |= eligible & heading & ~links & after
    lost = np.bincount(page, take, n_pages) == 0
    return take | (lost[page] & inside & eligible)


def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) to (page_id, url, text, n_chars)."""
    for batch in slices_of(2, batches):
        paths: dict[tuple[int, str], int] = {}
        per_page = [nodes(x, paths) for x in batch.column(2).to_pylist()]
        page = np.repeat(np.arange(len(per_page)), [len(x) for x in per_page])
        found = [x for one in per_page for x in one]
        take = chosen(page, found)
        texts: list[list[str]] = [[] for _ in per_page]
        for k in np.flatnonzero(take):
            texts[page[k]].append(found[k][7])
        joined = [" ".join(x) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array([len(x) for x in joined], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points, for every page."""
    kind = {c.lower(): t for c, t in pages.dtypes}
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extract, f"page_id {kind['page_id']}, url string, text string, n_chars long")
