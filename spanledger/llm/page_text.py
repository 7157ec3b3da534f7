"""The main text of web pages by two passes of block rules.

The project stores no web pages, so this works on any table of page_id, url and html.

A page is cut into blocks at its block elements. The first pass decides a block by
where it stands and by three measures of its text: the share of its characters in
links, its length, and the share of its words that are stop words of some language.
Blocks that are short or in between stay open; the second pass gives them the label
of the nearest decided neighbour in their section of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches

GOOD, BAD, OPEN = "good", "bad", "open"
#: Characters of a short block; shares of links and of stop words.
SHORT, MAX_LINKS, STOP_SHARE = 70, 0.33, 0.25

# Elements by their role on a page.
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
SECTIONS = set(
    "article aside body button details dialog div fieldset figure footer form head header li main nav ol p search "
    "section select table textarea title ul h1 h2 h3 h4 h5 h6 td".split()
)
APART = set("aside button dialog footer form head header menu nav search select textarea title".split())
DROPPED = "script style noscript template svg iframe object canvas math"
MARKS = set(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = set("banner complementary contentinfo dialog form menu menubar navigation search alert".split())
#: Frequent words without content, of several languages.
STOP_WORDS = set(
    """
    a an and are as at be by for from has have in is it of on or that the this to was were which will with
    auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht sich sie und von wird zu zum
    au aux ce cette dans de des du elle en est et il la le les ne pas pour qui que se sont sur un une
    al como con de del el ella en es esta la las lo los no para por que se son su un una y
    """.split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(DROPPED.split())})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


#: How an element is set apart: not, by its names, by what it is.
NOT, NAMED, KIND = 0, 1, 2


def _set_apart(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element holds menus, adverts, notices, forms or comments.

    The header of a main section is its title, and a page's body is never set apart.
    """
    if tag == "body":
        return NOT
    if tag in APART and not (tag == "header" and in_main):
        return KIND
    for name, value in _NAMES.findall(attributes) if attributes else ():
        words = set(re.split(r"[^a-z]+", value.lower()))
        if words & (ROLES if name.lower() == "role" else MARKS - {"header"} if in_main else MARKS):
            return NAMED
    hidden = "hidden" in attributes and re.search(r"""(?<![\w"'=-])hidden(?![\w-])""", attributes)
    return KIND if hidden else NOT


class Block:
    """Text between two block elements, and where it stands."""

    __slots__ = ("text", "linked", "apart", "around", "main", "heading", "label")

    def __init__(self, text: str, linked: int, apart: bool, around: bool, main: int, heading: bool):
        self.text, self.linked, self.apart, self.around = text, linked, apart, around
        self.main, self.heading = main, heading
        self.label = OPEN


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that have text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # element, set apart, number of the main section
    in_link, sections, at = 0, 0, 0

    def close() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            inside = _SPACE.sub(" ", html.unescape("".join(linked))).strip()
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][2]), None)
            main = stack[inner][2] if inner is not None else 0
            apart = any(x == KIND or x and k >= (inner or 0) for k, (_, x, _) in enumerate(stack))
            around = any(x == NAMED for _, x, _ in stack[: inner or 0])
            heading = bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            out.append(Block(text, len(inside), apart, around, main, heading))
        parts, linked = [], []

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if tag == "a":
            in_link = max(0, in_link + (-1 if token[2] else 1))
        if tag in BLOCKS:
            close()
        if tag in SECTIONS:
            if not token[2]:
                if tag == "p" or stack and stack[-1][0] == "p":
                    while stack and stack[-1][0] == "p":
                        stack.pop()
                main = 0
                if tag in ("article", "main"):
                    sections += 1
                    main = sections
                if not token[4].endswith("/"):
                    stack.append((tag, _set_apart(tag, token[4], any(x[2] for x in stack)), main))
            elif any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
                in_link = 0 if tag not in ("p", "li", "td") else in_link
    if at < len(page):
        add(page[at:])
    close()
    return out


def classify(blocks: list[Block]) -> None:
    """Label every block good or bad, in place."""
    has_main = any(b.main and not b.apart for b in blocks)
    # Names of elements around a main section count only if another one has none around it.
    if any(b.main and not b.apart and not b.around for b in blocks):
        for b in blocks:
            b.apart = b.apart or b.around
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words)
        if b.apart or has_main and not b.main or b.linked > MAX_LINKS * len(b.text):
            b.label = BAD
        elif len(b.text) >= SHORT and stops >= STOP_SHARE * len(words):
            b.label = GOOD
    decided = [b.label for b in blocks]
    for k, b in enumerate(blocks):
        if decided[k] == OPEN:
            b.label = _inherited(blocks, decided, k)


def _inherited(blocks: list[Block], decided: list[str], k: int) -> str:
    """The label of the nearest decided block of the same section, a later one on a tie of a heading.

    Text of a main section without any decided block is good; elsewhere bad.
    """
    own = blocks[k].main
    near = {}
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(blocks) and blocks[j].main == own:
            # What is set apart says nothing about the text around it.
            if decided[j] != OPEN and not blocks[j].apart:
                near[step] = (abs(j - k), decided[j])
                break
            j += step
    if not near:
        return GOOD if own else BAD
    if blocks[k].heading and 1 in near:
        return near[1][1]
    if len(near) == 2 and near[-1][0] == near[1][0]:
        return GOOD if GOOD in (near[-1][1], near[1][1]) else BAD
    return min(near.values())[1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The good blocks joined by blanks, their number, and that of all blocks."""
    blocks = blocks_of(page or "")
    classify(blocks)
    good = [b.text for b in blocks if b.label == GOOD]
    return " ".join(good), len(good), len(blocks)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [main_text(x) for x in frame["html"]]
        out = frame[["page_id", "url"]].copy()
        out["page_id"] = out["page_id"].astype("Int64")
        out["text"] = [x[0] for x in found]
        out["n_chars"] = [len(x[0]) for x in found]
        out["n_good"], out["n_blocks"] = [x[1] for x in found], [x[2] for x in found]
        yield out


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_good and n_blocks of each page, from its whole html.

    Character references are decoded, white space in a block becomes one blank, and
    the kept blocks are joined by one blank. A null or empty page, or one without
    main text, has an empty text; null ids and urls are passed on; repeated rows stay.
    """
    rows = in_small_batches(pages).select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(source).cast("string").alias("html"),
    )
    return rows.mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long, n_good long, n_blocks long"
    )
