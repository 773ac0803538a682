"""Main text of web pages by text-to-tag ratios (CETR; Weninger, Hsu and Han 2010).

The events of the standard library's streaming parser are gathered into lines,
one per block of the page.  Each line has a ratio: characters of text per tag.
Ratios are smoothed along the page with a Gaussian kernel, and lines above the
threshold (a share of the standard deviation) cluster into content.  The
content region is the article (or main element, else the stretch of the page)
that holds most of the clustered text; within it every line stays, however
short, except those of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, which are told by element, role and class and count
as ratio 0.

Defined results: NULL, empty and text-free pages have the text ''; a page
without tags is its own text; unclosed elements end with their parent; repeated
pages keep their rows; an empty table gives an empty table.  Pages are parsed
one by one where they lie: no shuffle, memory of one page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.storage import table

#: Kernel width in lines and share of the standard deviation that content lies above.
SIGMA, LAMBDA = 1.0, 0.5
#: Pages parsed before their rows are handed on.
SLICE_ROWS = 256

# Elements and words of class, id and role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
STRUCTURE = frozenset("article aside body details div dl fieldset figure footer form header main menu nav ol section "
                      "table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button "
                   "head title".split())
BOILERPLATE = frozenset("nav menu aside footer form dialog".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                  "consent cookie cookies disclaimer discussion footer form gdpr header login masthead menu modal nav "
                  "navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
                  "promoted promotion related replies respond search share sharing sidebar signup social sponsor "
                  "sponsored subscribe toolbar topbar widget widgets".split())
#: Hints that a heading area inside an article may carry without being boilerplate.
INSIDE_ARTICLE = frozenset("header banner".split())
_WORDS = re.compile("[^a-zA-Z0-9]+")


class PageLines(HTMLParser):
    """Lines of a page: ``text``, ``tags``, ``drop`` (boilerplate) and ``region`` (its article, or 0)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # structural elements: name, boilerplate, region
        self.silent: list[str] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            drop, region = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
            self.lines.append((text, self.tags, drop, region))
        self.parts, self.tags = [], 0

    def _boilerplate(self, tag: str, attrs, in_article: bool) -> bool:
        if tag in BOILERPLATE or (tag == "header" and not in_article):
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and name == "role" and value.lower() in ROLES:
                return True
            if value and name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = HINTS.intersection(_WORDS.split(value.lower()))
                if words and not (in_article and words <= INSIDE_ARTICLE):
                    return True
            if value and name in ("class", "id") and tag == "article" and {"comment", "comments", "ad", "advert", "sponsored", "related"}.intersection(_WORDS.split(value.lower())):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
            self.tags += 1
            return
        if self.silent:
            if tag not in ("body", "article", "main"):
                return
            self.silent = []  # an unclosed head or button
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in STRUCTURE or tag in BLOCKS and attrs:
            drop, region = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
            own = self._boilerplate(tag, attrs, region > 0)
            if tag in ("article", "main") and not own:
                if drop and not any(name in ("article", "main") for name, _, _ in self.open):
                    drop = False  # the menu or header before the article was never closed
                if tag == "article" or region == 0:
                    self.regions += 1
                    region = self.regions
            if tag in STRUCTURE or own:
                self.open.append((tag, drop or own, region))

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent and self.silent.pop() != tag:
                    pass
            return
        if tag in BLOCKS:
            self.tags += 1
            self.flush()
        else:
            self.tags += 1
        if any(name == tag for name, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        if tag in SILENT:
            return
        self.handle_starttag(tag, attrs)
        if tag in STRUCTURE:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page; the kernel is renormalised at the ends."""
    radius = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[radius: radius + len(ratios)]
    return np.convolve(ratios, kernel, mode="full")[radius: radius + len(ratios)] / weight


def main_text(html: str | None) -> str:
    """The text of the content region, one line per block."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    lines = page.lines
    if not lines:
        return ""
    ratio = np.array([0.0 if drop else len(text) / max(tags, 1) for text, tags, drop, _ in lines])
    even = smoothed(ratio)
    content = (even > LAMBDA * even.std()) & (ratio > 0)
    if not content.any():
        content = ratio > 0
    mass: dict[int, int] = {}
    for i in np.flatnonzero(content):
        mass[lines[i][3]] = mass.get(lines[i][3], 0) + len(lines[i][0])
    if not mass:
        return ""
    articles = {r: m for r, m in mass.items() if r > 0}
    if articles:
        best = max(articles, key=lambda r: (articles[r], -r))
        chosen = [text for text, _, drop, region in lines if region == best and not drop]
    else:
        at = np.flatnonzero(content)
        chosen = [text for text, _, drop, _ in lines[at[0]: at[-1] + 1] if not drop]
    return "\n".join(t for t in chosen if t)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page; other columns (but one named ``out``) stay."""
    keep = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower())]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html).cast("string").alias("html"))

    def extract(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(extract, f"row {kind}, text string").select("row.*", F.col("text").alias(out))


def op8_tag_ratio_text(spark, sf_dir):
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
