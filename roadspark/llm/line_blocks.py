"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element becomes one line. What the format itself marks as no
text of the page (scripts, styles, forms, ``nav``, ``footer``, ``aside``, ARIA roles such as banner, hidden elements, and, where a page
marks its article, all outside it) gives no lines. An element whose class or id names an advert, a comment, a
menu and so on makes a region of its own, under suspicion, but is not dropped for its name.

A line's measure is the number of its characters outside links (in a marked article, with links, which are part of
it). Measures are summed over sliding windows of ``WINDOW`` lines of a region. A surge point is where the sum over a line
and the ones after it rises above the region's threshold; a dive point is where the sum over a line and the ones before it falls
back to it; the lines from a surge to its dive are kept whole.

The threshold of what is under no suspicion is 0, so in a marked article every line stays, and elsewhere every
stretch from its first line with text outside links to its last one, whatever its length; a longer run of links alone goes, whole. The threshold of a region
under suspicion is fitted to the page: ``DOUBT`` times the window sum in which the middle character of the text under no suspicion lies
(``LEAST`` characters at least). So an advert or a comment goes, and long text stays whatever its section is called.

A null or empty page gives an empty text; broken and unclosed markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 3

# Kinds of elements.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
BLOCKS = frozenset(
    ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3"]
    + ["h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"]
)
SPACED = frozenset(["br", "td", "th", "img", "input"])
CONTAINERS = BLOCKS - frozenset(["p", "li", "dt", "dd", "tr", "hr", "h1", "h2", "h3", "h4", "h5", "h6"]) | frozenset(["a", "button", "select", "svg", "label", "span"])
LEFT_OUT = frozenset(["head", "nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "search", "object", "canvas", "audio", "video"])
LEFT_OUT_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"])
# Names of parts that are seldom text of the page, by how much text must speak for them, and words that go with such names.
NAMED = {
    2.0: frozenset(
        ["ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies"]
        + ["copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "overlay", "pagination", "popup", "promo", "promotion"]
        + ["sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"]
    ),
    0.25: frozenset(["discussion", "notice", "recommended", "related", "replies", "respond", "share", "sharing", "skip"]),
}
WITH_NAMES = frozenset(["area", "bar", "block", "bottom", "box", "buttons", "container", "icons", "inner", "items", "left", "links", "list", "main", "outer", "posts", "right", "section", "site", "slot", "thread", "top", "unit", "wrapper"])
LEAST = 200

ABOUT_PAGE = frozenset(["with", "has", "no", "without", "is", "content", "main", "article", "body", "page"])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ROLE = re.compile(r"""\brole\s*=\s*["']?([\w-]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def is_left_out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the format marks an element as no text of the page."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    m = ROLE.search(attributes)
    return bool(m and m[1].lower() in LEFT_OUT_ROLES)


def doubt(tag: str, attributes: str) -> float:
    """How much text must speak for an element with such names, in windows of usual text; 0 without suspicion."""
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0.0
    most = 0.0
    for a, b, c in NAMES.findall(attributes):
        for name in (a or b or c).lower().split():
            parts = PART.findall(name)
            # a name of such words alone: "ad-box", but not "market-share"; "with-sidebar" tells about the page, and is no sidebar itself
            if ABOUT_PAGE.intersection(parts) - WITH_NAMES:
                continue
            for much, names in NAMED.items():
                if names.intersection(parts) and all(p in WITH_NAMES or any(p in x for x in NAMED.values()) for p in parts):
                    most = max(most, much)
    return most


def lines_of(page: str) -> list[tuple[str, int, int, int, float]]:
    """(text, length outside links, article, region, doubt): a line for each block; article and region number the enclosing ones, 0 for none.

    Parts that the format leaves out give no lines.
    """
    out: list[tuple[str, int, int, int, float]] = []
    stack: list[str] = []
    text: list[tuple[str, bool]] = []  # pieces, and whether they are links
    skip_from = articles = regions = 0
    inside: list[tuple[int, int]] = []  # (stack depth, number) of open articles
    suspects: list[list] = []  # [stack depth, number, doubt, begin in ``text`` or None] of open regions; inline ones have a begin
    once: tuple[int, float] | None = None  # a paragraph's own region
    at, end = 0, len(page)

    def put(pieces: list[tuple[str, bool]], region: tuple[int, float]) -> None:
        line = SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
        if line:  # never of a part that is left out: its text is not gathered
            linked = sum(len(p) for p, is_link in pieces if is_link)
            out.append((line, max(0, len(line) - linked), inside[-1][1] if inside else 0, *region))

    def close_line() -> None:
        nonlocal once
        cut, outer, parts = len(text), None, []
        for x in reversed(suspects):  # a line may break off inside inline regions
            if x[3] is None:
                outer = x
                break
            parts.append((text[x[3] : cut], (x[1], x[2])))
            cut, x[3] = x[3], None
        parts.append((text[:cut], once or ((outer[1], outer[2]) if outer else (0, 0.0))))
        for pieces, region in reversed(parts):
            put(pieces, region)
        text.clear()
        once = None

    def close_region() -> None:
        _, _, much, begin = suspects[-1]
        if begin is None:
            close_line()
        elif sum(len(p) for p, is_link in text[begin:] if not is_link) <= much * LEAST:
            del text[begin:]  # inside a line, its text is its window
        suspects.pop()

    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not skip_from:
            text.append((piece, "a" in stack))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            close_line()
        elif tag in SPACED:
            text.append((" ", False))
        if m[1]:
            if tag in CONTAINERS and tag in stack:
                while stack:
                    top = stack.pop()
                    if skip_from > len(stack):
                        skip_from = 0
                    if suspects and suspects[-1][0] > len(stack):
                        close_region()
                    if inside and inside[-1][0] > len(stack):
                        inside.pop()
                    if top == tag:
                        break
            continue
        if tag in RAW:  # nothing in it is markup, up to its own end tag
            stop = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in CONTAINERS:
            stack.append(tag)
            if tag in ("article", "main") and not skip_from:
                articles += 1
                inside.append((len(stack), articles))
        if skip_from:
            continue
        if is_left_out(tag, m[3], bool(inside)):
            if tag in CONTAINERS:
                skip_from = len(stack)
            else:  # a lone paragraph or item: left out up to the next block
                stop = re.compile(r"</?(?:%s)\b" % "|".join(sorted(BLOCKS)), re.I).search(page, at)
                at = stop.start() if stop else end
        elif much := doubt(tag, m[3]):
            regions += 1
            much = max(much, suspects[-1][2] if suspects else 0.0)
            if tag in CONTAINERS:
                suspects.append([len(stack), regions, much, None if tag in BLOCKS else len(text)])
            elif tag in BLOCKS:
                once = regions, much
    close_line()
    return out


def window_sums(measures: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each line and the ``window`` - 1 lines after it, and before it."""
    sums = np.convolve(measures, np.ones(window, np.int64))
    return sums[window - 1 :], sums[: len(measures)]


def stretches(measures: np.ndarray, window: int = WINDOW, margin: bool = True, threshold: float = 0) -> list[tuple[int, int]]:
    """[surge, dive) line ranges, in order; they may touch and overlap.

    Without ``margin`` a range begins at its first line that measures something, and ends after its last one.
    """
    if not measures.any():
        return []
    after, before = window_sums(measures, window)
    rise = after if margin else before
    surges = np.flatnonzero((rise > threshold) & (np.append(0, rise[:-1]) <= threshold))
    dives = np.flatnonzero((np.append(before, 0) <= threshold) & (np.append(0, before) > threshold))
    if not margin:
        last = np.flatnonzero(measures)
        dives = last[np.searchsorted(last, dives) - 1] + 1
    return list(zip(surges.tolist(), dives.tolist()))


def usual(measures: np.ndarray, window: int = WINDOW) -> float:
    """The window sum in which the middle character of these lines lies, and ``LEAST`` at least."""
    if not measures.any():
        return float(LEAST)
    sums = window_sums(measures, window)[0]
    order = np.argsort(sums, kind="stable")
    run = np.cumsum(measures[order])
    return max(float(LEAST), float(sums[order[np.searchsorted(run, run[-1] / 2)]]))


def chosen(lines: list[tuple[str, int, int, int, float]]) -> list[int]:
    """Numbers of the lines between surge and dive points, region by region."""
    marked = any(x[2] and not x[3] for x in lines)
    pool = [k for k, x in enumerate(lines) if x[2] or not marked]
    trusted = np.array([lines[k][1] for k in pool if not lines[k][3]], np.int64)
    typical = usual(trusted)
    regions: dict[int, list[int]] = {}
    for k in pool:
        regions.setdefault(lines[k][3], []).append(k)
    keep: list[int] = []
    for number, own in regions.items():
        # in a marked article, links are part of the text
        measures = np.array([len(lines[k][0]) if marked and not number else lines[k][1] for k in own], np.int64)
        threshold = lines[own[0]][4] * typical
        keep += {own[i] for a, b in stretches(measures, margin=threshold > 0 or marked, threshold=threshold) for i in range(a, b)}
    return sorted(keep)


def main_text(page: str) -> str:
    """The chosen lines, one a block, joined by newlines; those of the article where one is marked."""
    lines = lines_of(page)
    return "\n".join(lines[k][0] for k in chosen(lines))


def extract(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """Columns ``keep`` with text and n_chars (code points) for every row of ``pages``."""

    def make() -> C.Kernel:
        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            texts = [main_text(data[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(offsets[:-1], offsets[1:])]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return kernel

    return C.map_texts(pages, keep, "text string, n_chars long", make, html_column)


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
