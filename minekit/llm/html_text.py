"""Main text of web pages: flat text blocks, told apart by a decision tree over their neighbourhood.

A page is read into its text blocks in order. Each block is described by its words, the share of them
inside links, both for the block before and the block behind, and by the regions it stands in. A
decision tree, trained here on a small labelled table of page layouts, says which blocks are main text.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of

# Elements of HTML by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby "
    "s samp small source span strike strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw text, never markup, and no text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Nothing inside is text to read.
UNSEEN = frozenset("noscript template svg math object canvas audio video select button datalist map head".split())
IN_HEAD = frozenset("title style script noscript template meta link base".split())
BESIDE = frozenset("nav aside footer form dialog menu".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new block ends an open paragraph; a new one of these ends an open one of the same kind.
ITEMS = frozenset("li dt dd tr td th option".split())
# Words in class, id and role that name regions beside the main text, and main text itself.
BESIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr legal login
    masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo
    promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription toc toolbar topbar widget widgets alert footnav""".split()
)
HEADER_WORDS = frozenset(["header", "site-header", "page-header", "top-header", "global-header", "main-header"])
MAIN_WORDS = frozenset("article articlebody entry main story content maincontent storybody".split())
#: Classes of the whole page name no region.
_WHOLE_PAGE = frozenset("html body".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_HINTS = re.compile(r"class|\bid\b|role|hidden|style", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Bits of the regions that a block stands in.
LINK, SIDE, INSIDE, HIDDEN, HEAD, LISTED = 1, 2, 4, 8, 16, 32


# --- blocks ---------------------------------------------------------------------------------


@lru_cache(maxsize=65_536)
def _region(name: str, attributes: str) -> int:
    """The bits that an element of this name with these attributes adds to what is inside."""
    bits = 0
    if name == "a":
        bits |= LINK
    if name in BESIDE:
        bits |= SIDE
    if name in MAIN:
        bits |= INSIDE
    if name in UNSEEN:
        bits |= HIDDEN
    if name in HEADINGS:
        bits |= HEAD
    if name in ("ul", "ol", "dl"):
        bits |= LISTED
    if name in _WHOLE_PAGE or not _HINTS.search(attributes):
        return bits
    words: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and _INVISIBLE.search(value):
            bits |= HIDDEN
        elif key in ("class", "id", "role"):
            for token in references.unescape(value).split():
                words.add(token.lower())
                words.update(p.lower() for p in _NAME_PARTS.findall(token))
    if name not in INLINE:
        main = words & MAIN_WORDS
        if main and not words & BESIDE_WORDS:
            bits |= INSIDE
        if not main and name not in MAIN and (words & BESIDE_WORDS or words & HEADER_WORDS):
            bits |= SIDE
    elif words & BESIDE_WORDS and not words & MAIN_WORDS:
        bits |= HIDDEN if {"sr", "skip"} & words else 0
    return bits


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """``(text, words, linked words, regions)`` of the blocks with text, in page order.

    Unclosed, stray and wrongly nested tags are taken as browsers take them, roughly: an end tag closes
    the nearest open element of its name and all inside it, and is ignored if there is none.
    """
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    open_names: Counter[str] = Counter()
    parts: list[str] = []  # texts of the block so far
    linked = 0
    block_bits = 0
    tag = _TAG
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), block_bits))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked, block_bits
        bits = stack[-1][1]
        if bits & HIDDEN:
            return
        text = references.unescape(text) if "&" in text else text
        if not parts:
            if not text.strip():
                return
            block_bits = bits & ~LINK
        parts.append(text)
        if bits & LINK:
            linked += len(text.split())

    def leave(name: str) -> None:
        """Close the nearest open element of the name, which there is."""
        while True:
            top = stack.pop()[0]
            open_names[top] -= 1
            if top == name:
                return

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            say(page[at:])
            break
        if mark > at:
            say(page[at:mark])
        at = mark
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        found = tag.match(page, at)
        if not found and tag is _TAG and page[at + 1 : at + 2].isalpha():
            tag = _PLAIN_TAG  # a quote is left open: from here on quotes mean nothing
            found = tag.match(page, at)
        if not found:
            if page.startswith("</", at) or page[at + 1 : at + 2].isalpha():
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1  # no tag at all, or one that the page's end cuts
            else:
                say("<")
                at += 1
            continue
        closing, name, attributes = found.groups()
        name, at = name.lower(), found.end()
        inline = name in INLINE
        if not inline:
            flush()
        if closing:
            if name == "p" and not open_names["p"]:
                continue
            if open_names[name] > 0:
                leave(name)
            continue
        if name == "br" or name == "wbr":
            say(" " if name == "br" else "")
            continue
        if name in VOID:
            continue
        if name in RAW:
            if attributes.endswith("/") and name == "script":
                continue
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end if not stop else stop.start()
            if stop:
                close = page.find(">", at)
                at = end if close < 0 else close + 1
            continue
        if not inline and stack[-1][0] == "p" or name == "a" and stack[-1][0] == "a":
            leave(stack[-1][0])
        elif not inline and open_names["p"] > 0 and _only_inline_above(stack):
            leave("p")
        elif name in ITEMS and stack[-1][0] == name:
            leave(name)
        if name not in IN_HEAD and open_names["head"] > 0:
            leave("head")
        bits = stack[-1][1] | _region(name, attributes[:2000])
        if name in MAIN and not stack[-1][1] & SIDE:
            bits &= ~SIDE
        if name == "header" and not bits & INSIDE:
            bits |= SIDE  # of the page; an article's own holds its title
        stack.append((name, bits))
        open_names[name] += 1
    flush()
    return out


def _only_inline_above(stack: list[tuple[str, int]]) -> bool:
    """Whether the nearest element that is not inline is a paragraph: unclosed bold text inside, for example."""
    for name, _ in reversed(stack):
        if name == "p":
            return True
        if name not in INLINE:
            return False
    return False


# --- features and the tree ------------------------------------------------------------------

FEATURES = (
    "inside", "page_has_inside", "side", "words", "words_before", "words_behind", "links", "links_before",
    "links_behind", "heading", "listed",
)


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    n = len(found)
    table = np.zeros((n, len(FEATURES)))
    if not n:
        return table
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found]) / np.maximum(words, 1)
    bits = np.array([b[3] for b in found])
    table[:, 0] = (bits & INSIDE > 0) & (bits & SIDE == 0)
    table[:, 1] = table[:, 0].any()
    table[:, 2] = bits & SIDE > 0
    for column, values in ((3, words), (6, links)):
        table[:, column] = values
        table[1:, column + 1] = values[:-1]
        table[:-1, column + 2] = values[1:]
    table[:, 9] = bits & HEAD > 0
    table[:, 10] = bits & LISTED > 0
    return table


# The labelled table. A line is a layout; its blocks are written as
# regions:words/linked words, "+" behind those that are main text. Regions: s beside, i inside the main
# element, h heading, l list.
LAYOUTS = """
s:1/1 s:1/1 s:2/2 s:12/0 ih:9/0+ i:40/0+ i:120/0+ i:3/0+ i:60/2+ s:9/0
sl:1/1 sl:1/1 sl:1/1 s:8/0 ih:7/0+ i:1/0+ i:2/0+ i:1/0+ s:14/0
sl:1/1 sl:2/2 ih:11/0+ i:200/10+ il:12/0+ il:9/1+ il:14/0+ i:80/0+ s:30/0 s:45/3 s:60/0
s:5/5 ih:6/6+ i:30/1+ i:25/25+ i:90/0+ il:4/4 il:5/5 il:3/3 s:3/3
sl:2/2 s:80/0 s:70/0 i:1/0+ s:55/4 s:120/0 s:6/6 s:7/7
ih:8/0+ i:4/0+ i:15/15+ i:6/0+ s:90/0 s:40/0
ih:5/0+ i:70/0+ i:1/0+
ih:12/0+ i:300/0+ i:8/0+ i:2/0+
i:3/0+
ih:6/0+ i:20/0+ s:8/8 s:50/0 i:7/0+ i:11/0+ s:35/0 i:110/0+ s:4/0
sl:1/1 sl:1/1 ih:10/0+ i:1/0+ ih:2/0+ i:6/0+ ih:3/0+ i:9/0+ i:5/0+
sl:1/1 ih:3/0+ ih:5/0+ i:70/0+ ih:2/0+ i:50/5+ i:110/0+ 5/0 30/2 4/4 60/0
20/0 45/0 ih:7/0+ i:33/0+ i:64/0+ 50/0 8/0
6/0 14/0 ih:9/0+ i:12/0+ i:18/0+ 35/0 90/0 12/1
28/0 i:14/0+ i:22/0+ 75/0 3/0 2/0
il:1/1 il:2/2 il:1/1 il:2/2 il:1/1 ih:5/0+ i:75/0+ i:85/3+ i:2/0+
ih:4/0+ i:55/0+ il:6/6 il:5/5 il:7/7 il:4/4 i:41/0+ il:3/3 il:5/5
1/1 1/1 2/2 h:6/0+ 60/0+ 90/3+ 45/0+ 80/0+ 3/3 2/2 4/2
l:1/1 l:1/1 l:1/1 l:2/2 h:8/0+ 35/0+ 70/1+ h:4/0+ 150/0+ 12/0+ 55/0+ 6/3 l:2/2 l:2/2
2/2 3/3 h:10/0+ 25/0+ 40/2+ 18/0+ 30/0+ 5/5 1/1
4/4 4/4 h:5/0+ 100/0+ 5/0+ 95/0+ 4/0+ 130/5+ 2/1 3/3 8/8
h:7/0+ 44/0+ 61/0+ 3/0+ 52/0+ 27/1+
h:5/0+ 16/0+ 33/0+ 21/0+
1/1 2/2 1/1 5/5 6/6 7/7 3/3 4/4 2/2
h:4/4 10/10 h:5/5 12/12 h:6/6 9/9 2/2
3/1 2/2 4/4 1/0 2/0 3/3 2/2
l:3/3 l:4/4 h:9/0+ 22/0+ l:15/0+ l:20/1+ l:11/0+ 44/0+ s:33/0 s:50/0
s:25/0 s:4/4 h:7/0+ 65/0+ 48/0+ 72/2+ s:100/0 s:85/2 s:90/0 s:3/3
s:3/3 s:200/0 60/0+ 70/0+ 40/0+ s:9/9 s:11/0
s:2/2 h:9/0+ 7/0+ 5/0+ 12/0+ s:6/0 s:18/0
1/1 2/2 h:3/0+ 50/0+ h:2/0+ 60/0+ h:1/0+ 44/0+ 2/0 1/0 3/3
h:3/0+ 70/0+ h:2/0+ 55/0+ 2/2 1/0
h:2/0 3/3 h:1/0 4/4 5/5 h:2/0 6/6
ih:6/0+ i:8/2+ i:4/1+ i:90/0+ i:10/4+ i:5/5+ i:40/0+ i:7/1+ s:9/9
ih:5/0+ il:6/2+ il:9/1+ il:4/1+ i:30/0+ i:3/1+ i:2/2+ i:6/3+
""".strip()


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LAYOUTS``."""
    rows, labels = [], []
    bits = {"s": SIDE, "i": INSIDE, "h": HEAD, "l": LISTED}
    for line in LAYOUTS.splitlines():
        found = []
        for entry in line.split():
            labels.append(entry.endswith("+"))
            regions, _, counts = entry.rstrip("+").rpartition(":")
            words, linked = map(int, counts.split("/"))
            found.append(("", words, linked, sum(bits[r] for r in regions)))
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels)


Tree = tuple  # (share of main text,) or (feature, threshold, tree up to it, tree above it)


def grown(table: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A tree by Gini impurity; ties go to the first feature, then to the lowest threshold."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return (float(share),)
    best = None
    for feature in range(table.shape[1]):
        values = np.unique(table[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = table[:, feature] <= threshold
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(len(x) * x.mean() * (1 - x.mean()) for x in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, float(threshold)
    if best is None:
        return (float(share),)
    _, feature, threshold = best
    low = table[:, feature] <= threshold
    return (
        feature,
        threshold,
        grown(table[low], labels[low], depth - 1, least),
        grown(table[~low], labels[~low], depth - 1, least),
    )


def trained() -> Tree:
    return grown(*labelled())


def judged(tree: Tree, table: np.ndarray) -> np.ndarray:
    """The share of main text in the leaf of each row."""
    if len(tree) == 1:
        return np.full(len(table), tree[0])
    feature, threshold, below, above = tree
    low = table[:, feature] <= threshold
    out = np.empty(len(table))
    out[low], out[~low] = judged(below, table[low]), judged(above, table[~low])
    return out


def main_text(page: str, tree: Tree) -> list[str]:
    """The texts of the blocks that the tree takes for main text."""
    found = blocks(page)
    stays = judged(tree, features(found)) > 0.5
    return [b[0] for b, keep in zip(found, stays) if keep]


# --- the operator ---------------------------------------------------------------------------


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_blocks`` and ``n_main`` (blocks read, blocks kept) of every row.

    ``text`` is the main text: character references decoded, white space inside a block one blank, blocks
    in page order joined by a newline. A missing or empty page, and one without main text, has an empty
    text. Rows that repeat and rows without an id stay, each by itself; an empty table gives an empty one;
    other columns are not looked at. No shuffle: a task holds one batch of pages.
    """
    tree = tree or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["html"]:
                found = blocks(page)
                stays = judged(tree, features(found)) > 0.5
                texts = [b[0] for b, keep in zip(found, stays) if keep]
                rows.append(("\n".join(texts), len(found), len(texts)))
            out = pd.DataFrame(rows, columns=["text", "n_blocks", "n_main"])
            yield out.assign(page_id=batch["page_id"].array, url=batch["url"].array)

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    importable(df.sparkSession)
    schema = f"text string, n_blocks bigint, n_main bigint, page_id {kinds[0]}, url {kinds[1]}"
    return rows.mapInPandas(run, schema).select("page_id", "url", "text", "n_blocks", "n_main")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
