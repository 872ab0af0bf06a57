"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser yields events; every block-level boundary ends a line. Each line has a ratio of
text characters outside links to tags; the ratios are smoothed by a Gaussian and cut by a threshold (a share of their
standard deviation). The lines above it are the content lines, and they select everything:

* They vote, by length, for the elements they stand in; the deepest element with most of the votes is the region (an
  article or main element, which names its content itself, isn't split).
* A region that isn't in such an element is cut to clusters: a container (section, div, list, table, ...) stays if a content
  line stands in it, with all its lines that aren't mostly links; containers without one go.

Before that, elements that markup says are no article text (scripts, styles, navigation, page headers and footers, asides,
forms, by tag or role; adverts, cookie notices, sidebars, menus, reader comments, by a word of their class or id) are left
out as they stream by. Words that articles use of their own parts (related, discussion, alert) count outside of named
articles alone, others (warning, note) not at all.

A page is handled by itself: no shuffle, no state, whatever the table's size. Each event costs the same whatever the depth
of the page: open elements are found by tag, votes are summed upwards once.

Defined results: null or empty html gives the empty text; text without any tag is one block; unclosed elements end with
the element that holds them; repeated pages give repeated results; an empty table gives an empty result; further
columns are ignored. Nothing is cut from long pages.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
#: A start of one of these ends an open p.
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "option", "legend", "summary"}
#: Elements that end an open one of the same family, unless one of HOLDS is open in between.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea svg math iframe object canvas audio video dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id: menus, page heads, footers, sidebars, notices, adverts, and what asks readers to do something.
OUT_WORDS = frozenset(
    """nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toc masthead topbar toolbar footer colophon copyright sidebar sidebars sidenav
    cookie cookies consent gdpr notice notices popup modal overlay paywall banner ad ads adv advert adverts advertisement advertisements advertising adsense adslot billboard
    sponsor sponsored sponsors promo promos promotion share sharing social subscribe subscription newsletter signup login hidden""".split()
)
#: Words that are left out too where no article or main element is open; within one they may name parts of the article.
OUTSIDE_WORDS = frozenset(
    """discussion reply replies reactions feedback related recommended recommendations trending popular widget widgets rail aside alert alerts
    notification notifications disclaimer register search searchbox form follow lightbox""".split()
)
#: Of these even headings and paragraphs are left out.
ALWAYS_OUT = frozenset("ad ads advert advertisement sponsored comment comments notice cookie promo".split())
#: Told within longer words too (leftsidebar, pagefooter).
OUT_PARTS = re.compile("sidebar|footer|comments|cookie|advert|newsletter|breadcrumb|navbar|navigation|sponsor|masthead|disqus")
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
KEPT_TAGS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = frozenset("html body main article section div td center blockquote".split())
CONTAINERS = REGIONS | {"ul", "ol", "dl", "table"}
WORDS = re.compile(r"[a-z]+")


def words_of(at: dict[str, str | None]) -> set[str]:
    if "class" not in at and "id" not in at:
        return set()
    return set(WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{at.get('class') or ''} {at.get('id') or ''}").lower()))


class Lines(HTMLParser):
    """Collects (text, tags, link characters, number of the block element it stands in) of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, number of the nearest block element, places of the nearest block and of a p that isn't behind a block.
        self.stack: list[tuple[str, int, int, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements with a tag
        self.out_from: int | None = None  # place of the element that is left out
        self.out_comments = False
        self.lines: list[tuple[str, int, int, int]] = []
        self.kinds: list[str] = []  # of each block element, by number
        self.parents: list[int] = []
        self.text: list[str] = []
        self.tags = self.links = 0

    def nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def end_line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append((text, self.tags, self.links, self.stack[-1][1] if self.stack else -1))
            self.text = []
        self.tags = self.links = 0

    def left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        at = dict(attrs)
        if tag in OUT_TAGS:
            return True
        words = words_of(at)
        if tag in KEPT_TAGS:
            return tag == "article" and bool(words & COMMENT_WORDS)
        outside = not self.places["article"] and not self.places["main"]
        if tag == "header" or words & {"header", "masthead"}:  # of the page; an article's own has its title
            return tag not in HEADINGS and outside
        if words & ALWAYS_OUT or words & COMMENT_WORDS or any(map(OUT_PARTS.search, words)):
            return True
        if (words & OUT_WORDS or outside and words & OUTSIDE_WORDS) and tag not in HEADINGS and tag not in ("p", "b", "i", "em", "strong", "a"):
            return True
        return (at.get("role") or "").lower() in OUT_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in (at.get("style") or "").replace(" ", "").lower()

    def pop_to(self, place: int) -> None:
        """Closes the elements from this place on."""
        if any(tag in BLOCK for tag, *_ in self.stack[place:]):
            self.end_line()
        for tag, *_ in self.stack[place:]:
            self.places[tag].pop()
        del self.stack[place:]
        if self.out_from is not None and self.out_from >= place:
            self.out_from = None

    def push(self, tag: str) -> None:
        place = len(self.stack)
        _, number, block, p = self.stack[-1] if self.stack else ("", -1, -1, -1)
        if tag in BLOCK:
            block, p = place, -1
            if self.out_from is None:
                self.kinds.append(tag)
                self.parents.append(number)
                number = len(self.kinds) - 1
        self.stack.append((tag, number, block, place if tag == "p" else p))
        self.places[tag].append(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in ENDS_P and self.stack and (p := self.stack[-1][3]) >= 0:
            self.pop_to(p)
        if tag in ENDS_SAME and (place := self.nearest(ENDS_SAME[tag])) > self.nearest(HOLDS[tag]):
            self.pop_to(place)
        if tag in ("article", "main") and self.out_from is not None and not self.out_comments and self.stack[self.out_from][0] in ("div", "p", "section", "span", "header", "head"):
            self.pop_to(self.out_from)  # what was left out was never closed
        if tag == "body" and self.out_from is not None and self.stack[self.out_from][0] == "head":
            self.pop_to(self.out_from)
        if self.out_from is None and self.left_out(tag, attrs):
            self.end_line()
            self.out_from = len(self.stack)
            self.out_comments = tag != "head" and bool(words_of(dict(attrs)) & COMMENT_WORDS)
        self.push(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag in ("svg", "iframe", "object", "canvas"):
            self.pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        place = self.nearest((tag,))
        # The end of an inline element or a paragraph doesn't close blocks.
        if place >= 0 and (tag in BLOCK and tag != "p" or self.stack[-1][2] <= place):
            self.pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.out_from is None:
            self.text.append(data)
            if self.places["a"]:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def main_text(html: str | None, sigma: float = 1.0, share_of_std: float = 0.25, most: float = 0.7, ratio=lambda chars, tags: chars / np.maximum(1.0, tags)) -> str:
    """The main text; ratio: of a line's characters outside links and its tags."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    kinds, parents, n = parser.kinds, parser.parents, len(parser.lines)
    if not n:
        return ""
    texts, tags, links, owner = zip(*parser.lines)
    chars, owner = np.array([len(t) for t in texts], dtype=float), np.array(owner)
    links = np.minimum(np.array(links, dtype=float), chars)
    ratios = smoothed(ratio(chars - links, np.array(tags, dtype=float)), sigma)
    content = ratios >= share_of_std * ratios.std()

    def below(is_top) -> np.ndarray:
        """Which lines stand in an element that is_top tells, or in one under it."""
        known = np.zeros(len(kinds) + 1, bool)  # the last: of lines outside all elements
        for e, parent in enumerate(parents):  # an element's number is above its parent's
            known[e] = is_top(e) or known[parent]
        return known[owner]

    inside = below(lambda e: kinds[e] in ("article", "main"))
    if inside.any() and chars[inside].sum() >= 0.2 * (chars * content).sum():
        content &= inside  # a page that names its article
        if not content.any():
            content = inside.copy()
    votes = np.zeros(len(kinds) + 1)
    np.add.at(votes, owner, np.where(content, chars, 0.0))
    for e in range(len(kinds) - 1, -1, -1):
        votes[parents[e]] += votes[e]
    total, region = float((chars * content).sum()), -1
    for e, kind in enumerate(kinds):
        if kind in REGIONS and votes[e] >= most * total:
            region = e
            if kind == "article":
                break
    kept = np.ones(n, bool) if region < 0 else below(lambda e: e == region)
    if not (kept & inside).any():  # nothing names the article: clusters around content lines
        near = [*range(len(kinds)), -1]
        for e, parent in enumerate(parents):
            near[e] = e if kinds[e] in CONTAINERS else near[parent]
        container = [near[parents[e]] if e >= 0 and kinds[e] == "td" else near[e] for e in owner.tolist()]  # a cell's own text is its table's
        held = {c for c, x in zip(container, content & kept) if x}
        kept &= np.array([c in held for c in container]) & (links <= 0.6 * chars)
    return "\n".join(t for t, k in zip(texts, kept) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
