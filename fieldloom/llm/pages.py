"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clusters.

The standard library's parser streams events over a page. Each block of text is
a line of its own with its tag count; its text-to-tag ratio, smoothed over the
neighbouring lines, is compared with a threshold, and runs of lines above it are
the content regions. Where most of their text lies in article elements, these are
the article; otherwise, as where articles are only cards beside the text, it is the
element that holds all of the regions, with what stands around it and isn't mostly
links. Elements widen the regions to the whole article, so that its short lines
stay, and veto menus, asides, forms and the like, and lists of links at its edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Names of HTML elements, by the part that they play in a page.
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button option title".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
CELLS = frozenset("td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div body aside nav footer header form blockquote".split())
# Words of class and id, and values of role, that mark a part as no article text.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus replies responses share sharing social related recommended recommendations trending pagination pager toolbar widget skip legal copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHUNK = 1 << 16


class Lines(HTMLParser):
    """Blocks of text, in page order, each with its tags, link characters and the elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, element number, left out, in an article
        self.parents: list[int] = [-1]  # of each element; 0 is the page
        self.names: list[str] = [""]
        self.semantic: list[int] = []  # numbers of article and main elements
        self.held: list[str] = []
        self.head = 0  # where the last head stood
        self.tags = self.link_chars = self.links = 0
        self.blocks: list[tuple[str, int, int, int, bool]] = []  # text, tags, link characters, element, left out

    def end_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            _, element, out, _ = self.open[-1] if self.open else ("", 0, False, False)
            self.blocks.append((text, self.tags, self.link_chars, element, out))
            self.tags = self.link_chars = 0
        self.held.clear()

    def close_to(self, depth: int) -> None:
        """Ends the elements from ``depth`` on."""
        while len(self.open) > depth:
            tag = self.open[-1][0]
            if tag == "a":
                self.links = max(0, self.links - 1)
            if tag not in INLINE and tag not in CELLS:
                self.end_block()
            self.open.pop()

    def end_head(self, tag: str) -> None:
        """Ends an open head, whose end tag may be left out, before what can't stand in it; ``tag`` is empty for text."""
        depth = self.head
        if depth >= len(self.open) or self.open[depth][0] != "head" or tag in HEAD or tag in ("html", "head"):
            return
        within = {e[0] for e in self.open[depth + 1 :]}  # what a noscript or template holds is no body
        if tag == "body" or not within or tag and within == {"title"}:
            self.close_to(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_head(tag)
        self.tags += 1
        if tag in VOID or tag in CELLS:
            self.held.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P or tag in SIBLINGS:
            closes = SIBLINGS.get(tag, {"p"})
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] in closes:
                    self.close_to(depth)
                    break
                if self.open[depth][0] in SCOPES:
                    break
        if tag not in INLINE and tag not in CELLS:
            self.end_block()
        _, _, out, inside = self.open[-1] if self.open else ("", 0, False, False)
        own = self.left_out(tag, attrs, inside)
        article = tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs)
        element = len(self.parents)
        self.parents.append(self.open[-1][1] if self.open else 0)
        self.names.append(tag)
        if article and not out and not own:
            self.semantic.append(element)
        self.links += tag == "a"
        if tag == "head":
            self.head = len(self.open)
        self.open.append((tag, element, out or own, inside or article))

    @staticmethod
    def left_out(tag: str, attrs: list, inside: bool) -> bool:
        if tag in NEVER or tag in APART or tag == "header" and not inside:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if value and (key == "role" and value.lower() in ROLES or key in ("class", "id") and not WORDS.isdisjoint(re.split(r"[^a-z]+", value.lower()))):
                return True
            if value and key == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash in a start tag means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                return
            if tag in INLINE and self.open[depth][0] in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head("")
        self.held.append(data)
        if self.links:
            self.link_chars += len(data)


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """``values`` smoothed by a normal kernel, the edge values carried on."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def regions(ratios: np.ndarray, sigma: float, share: float) -> np.ndarray:
    """Whether each line is in a cluster above the threshold, ``share`` of the smoothed ratios' standard deviation."""
    smooth = gaussian(ratios, sigma)
    return smooth >= share * smooth.std()


def main_text(html: str, sigma: float = 1.0, share: float = 1.0) -> str:
    """The article of one page: blocks in page order, joined by a line end."""
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser.close_to(0)
    parser.end_block()
    blocks = [b for b in parser.blocks if not b[4]]
    if not blocks:
        return ""
    chars = np.array([len(b[0]) for b in blocks], dtype=float)
    ratios = chars / np.maximum(1, [b[1] for b in blocks])
    links = np.array([b[2] for b in blocks]) / chars
    inside = regions(ratios, sigma, share)

    def around(element: int) -> list[int]:
        path = []
        while element >= 0:
            path.append(element)
            element = parser.parents[element]
        return path

    paths = [around(b[3]) for b in blocks]
    semantic = set(parser.semantic)
    plain = links < 0.5
    content = inside & plain if (inside & plain).any() else plain
    roots = [next((e for e in reversed(p) if e in semantic), None) for p in paths]  # the outermost article elements
    told = {root for root, own in zip(roots, plain, strict=True) if own} - {None} or set(roots) - {None}  # but those of links alone
    in_article = np.array([root in told for root in roots])
    if told and chars[content & in_article].sum() >= 0.5 * chars[content].sum():
        return "\n".join(b[0] for b, own in zip(blocks, in_article, strict=True) if own)
    if not plain.any():
        return ""
    held = article_element(parser, blocks, paths, content, plain)
    within = np.array([held in p for p in paths])
    own = np.flatnonzero(within & plain)
    # links between kept blocks stay, and lines of links beside one
    holders = [block_of(parser, p) for p in paths]
    beside = {parser.parents[holders[i]] for i in own}
    keep = [w and (own[0] <= i <= own[-1] or parser.names[h] in LINES and parser.parents[h] in beside) for i, (w, h) in enumerate(zip(within, holders, strict=True))]
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def block_of(parser: Lines, path: list[int]) -> int:
    """The innermost element of ``path`` that isn't inline."""
    return next(e for e in path if parser.names[e] not in INLINE)


def article_element(parser: Lines, blocks: list, paths: list[list[int]], content: np.ndarray, plain: np.ndarray) -> int:
    """The deepest element with all ``content`` blocks and more than one block of text, and what is around it while that isn't mostly links."""
    regions_in: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}  # characters, link characters, blocks of text, main titles
    for b, p, hit, own in zip(blocks, paths, content, plain, strict=True):
        here = np.array([len(b[0]), b[2], own, own and parser.names[block_of(parser, p)] == "h1"], dtype=float)
        for e in p:
            sums[e] = sums[e] + here if e in sums else here
            regions_in[e] = regions_in.get(e, 0) + bool(hit)
    first = paths[int(np.flatnonzero(content)[0])]
    held = next(e for e in first if regions_in[e] == content.sum())
    while held:
        around = parser.parents[held]
        chars, linked, _, titles = sums[around] - sums[held]
        if sums[held][2] > 1 and linked >= 0.5 * chars > 0 and not titles:
            break
        held = around
    return held


def extract_text(pages: DataFrame, sigma: float = 1.0, share: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html), one row for each row.

    The whole page is read; null html is empty, and a page without article text
    gives the empty text. Ids and urls, null or repeated, are passed on; other
    columns are not read. An empty table gives no rows. Each page stands alone, so
    nothing is exchanged.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma, share) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")
