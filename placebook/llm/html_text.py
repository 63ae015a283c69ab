"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams start tags, end tags and text. Text gathers in
blocks; every block is a line with a ratio of its characters to the tags met since the
block before. Elements that never hold article text (menus, headers, footers, sidebars,
forms, scripts) and those whose class or id says so (adverts, notices, comments) are left
out with all they hold. The ratios of the other lines, set in the page's sequence with the
left-out lines at zero, are smoothed by a Gaussian; lines above the threshold are content.
The region is the ``article`` or ``main`` elements with content lines; without such, the
innermost element with all content lines, and where that is the whole body the stretch
from the first to the last of them with headings before it. All blocks of the region are
text: no line of it is dropped for being short.

Character references are decoded, white space in a block becomes one blank, blocks are
joined by two line feeds in page order. The parser reads the whole page; an unfinished tag
or comment is markup only where it still stands unparsed at the end.

* Null or empty html, or no content line: empty text, 0 characters.
* Repeated rows, null ids or urls: every row comes back as it is. Empty table: no rows.
* Columns other than ``page_id``, ``url``, ``html`` are ignored. Very long pages: memory
  follows the longest page of a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import within_arrow

BATCH_BYTES = 2_000_000
SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
APART = frozenset(["br", "td", "th", "img"])
NEVER = frozenset(
    "audio button canvas datalist dialog embed footer form aside head iframe input menu nav noscript object script select style svg "
    "template textarea title video".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pagination popup promo promoted recommended related respond share sharing sidebar sidenav social sponsor sponsored subscribe "
    "toolbar widget".split()
)
# Marks that as the last part of a word (``elementor-widget``, ``post-share``) name wrappers too.
WRAPPERS = frozenset(["related", "share", "widget"])
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--(?:!|\s*)>")
_OPEN_END = re.compile(r"<(?:[A-Za-z/!?]|\Z)")


def _marked(attributes: list[tuple[str, str | None]]) -> bool:
    for name, value in attributes:
        if not value:
            continue
        if name in ("class", "id"):
            for word in value.lower().split():
                parts = [x for x in re.split(r"[^a-z]+", word) if x]
                if parts and parts[0] not in ("has", "no", "with") and (parts[0] in MARKS or parts[-1] in MARKS - WRAPPERS):
                    return True
        elif name == "role" and value.lower() in ROLES or name == "hidden":
            return True
    return False


class _Lines(HTMLParser):
    """Blocks in page order: text, tags before, whether left out, open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.out_from: int | None = None  # depth of the element left out
        self.count = self.tags = 0
        self.held: list[str] = []
        self.heading = False
        self.ending = False  # the page has no more text
        self.lines: list[tuple[str, int, bool, tuple[tuple[str, int], ...], bool]] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                self.lines.append((text, self.tags, self.out_from is not None, tuple(self.open), self.heading))
                self.tags = 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BREAKS:
            self.flush()
            self.heading = tag in HEADINGS
        elif tag in APART:
            self.held.append(" ")
        if tag in VOID:
            return
        out = tag in NEVER or _marked(attrs) and tag not in ("html", "body", "article", "main")
        if tag == "header" and not any(x in ("article", "main") for x, _ in self.open):
            out = True
        if out and self.out_from is None:
            self.flush()
            self.out_from = len(self.open)
        self.count += 1
        self.open.append((tag, self.count))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BREAKS:
            self.flush()
        elif tag in APART:
            self.held.append(" ")
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if self.out_from is not None and at <= self.out_from:
                    self.flush()
                    self.out_from = None
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        if self.cdata_elem is None:
            self.held.append(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata) if self.ending else -1


def page_lines(html: str) -> list[tuple]:
    parser = _Lines()
    parser.feed(html)
    rest = parser.rawdata
    last = rest.rfind("<")
    if parser.cdata_elem is None and not rest.startswith("<!--") and last > rest.rfind(">") and _OPEN_END.match(rest, last):
        parser.rawdata = rest[:last]
    parser.ending = True
    parser.close()
    parser.flush()
    return parser.lines


def content_lines(lines: list[tuple]) -> np.ndarray:
    """Which lines are content: smoothed ratio above the cluster threshold."""
    ratio = np.array([0.0 if out else len(text) / max(tags, 1) for text, tags, out, _, _ in lines])
    reach = min(int(3 * SIGMA), (len(ratio) - 1) // 2)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratio, kernel / kernel.sum(), "same") if reach else ratio
    threshold = min(smooth.std(), smooth.max() / 2)
    return (smooth >= threshold) & (ratio > 0)


def main_text(html: str | None) -> str:
    lines = page_lines(html) if html else []
    usable = [i for i, x in enumerate(lines) if not x[2]]
    if not usable:
        return ""
    content = np.flatnonzero(content_lines(lines)).tolist()
    homes = {e for i in content for e in lines[i][3] if e[0] in ("article", "main")}
    if homes:
        return "\n\n".join(lines[i][0] for i in usable if homes & set(lines[i][3]))
    shared = lines[content[0]][3]
    for i in content[1:]:
        n = 0
        for x, y in zip(shared, lines[i][3], strict=False):
            if x != y:
                break
            n += 1
        shared = shared[:n]
    home = next((e for e in reversed(shared) if e[0] not in ("p", "b", "i", "em", "strong", "span", "a", *HEADINGS)), None)
    if home and home[0] not in ("html", "body"):
        return "\n\n".join(lines[i][0] for i in usable if home in lines[i][3])
    first, last = content[0], content[-1]
    while first and not lines[first - 1][2] and lines[first - 1][4]:
        first -= 1
    return "\n\n".join(lines[i][0] for i in usable if first <= i <= last)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

        yield from within_arrow(batches, make, "html", BATCH_BYTES)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, schema)
