"""Main text of web pages by tag-path ratios.

Every run of text has a root-to-leaf tag path (block elements with their first class; inline
elements add nothing). For each path the text length and the punctuation of its runs are summed and
divided by their number; both ratios are smoothed over the runs in page order and fused into one
score. The same is done for the page's content region as a whole: its article or main elements, or
else the deepest element that holds most of the text. A path's score is its own or, inside the
region, the region's, whichever is higher, and small outside; paths of menus, forms and the like
score nothing. Paths whose score reaches a share of the page's mean are content, and all their text
is the result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from veritide.llm.common import emit, id_types
from veritide.session import ship_package

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
FURNITURE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "noscript", "template", "svg", "dialog", "menu", "object", "canvas", "audio", "video"}
FURNITURE_NAMES = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "topbar", "widget", "alert", "toolbar", "contentinfo", "complementary",
}
#: Words that say a class is of content, and beginnings and ends of a class that deny what it names.
CONTENT_NAMES = {"content", "main", "article", "post", "entry", "story", "body", "text"}
DENIED = re.compile(r"(?:^|[-_])(?:no|non|not|has|with|without|hide)[-_]|[-_](?:free|less|off)$")
CONTAINERS = {"article", "main"}
#: Blocks of text: names count for them only if they say nothing else.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption"}
#: Opening one of these ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}
#: Runs on either side that smoothing looks at, the share of the mean score that content reaches, the
#: factor of what lies outside the region, the share of the text that a region has, and the share
#: from which on an element's text is the page's whatever its name.
REACH, SHARE, OUTSIDE, REGION, WHOLE = 2, 0.35, 0.1, 0.6, 0.9


class Run(NamedTuple):
    """A run of text: its path, its block, the text."""

    path: int
    block: int
    text: str


class Paths:
    """The tag paths of a page as a tree: each with its parent, tag and what speaks against it."""

    def __init__(self) -> None:
        self.parent, self.tag, self.dropped, self.named, self.inside = [0], ["#root"], [False], [False], [False]
        self.known: dict[tuple, int] = {}

    def child(self, parent: int, tag: str, label: str, dropped: bool, named: bool) -> int:
        key = (parent, tag, label, dropped, named)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.dropped.append(dropped or self.dropped[parent])
            self.named.append(named)
            self.inside.append(tag in CONTAINERS or self.inside[parent])
        return self.known[key]


def names_of(attrs: str) -> list[str]:
    return [token for found in _NAMES.finditer(attrs) for token in (found[1] or found[2] or found[3] or "").lower().split()]


def furniture_name(tag: str, tokens: list[str]) -> bool:
    """Whether the classes, ids and roles of an element say that it is furniture."""
    words = [re.split(r"[^a-z0-9]+", t) for t in tokens]
    if not any(FURNITURE_NAMES.intersection(w) for w in words):
        return False
    if tag in TEXT_BLOCKS:
        return all(x in FURNITURE_NAMES for w in words for x in w if x)
    return not CONTENT_NAMES.intersection(tokens) and any(FURNITURE_NAMES.intersection(w) and not DENIED.search(t) for t, w in zip(tokens, words, strict=True))


def parse(page: str) -> tuple[list[Run], Paths]:
    """Runs of text in page order, and the tree of their paths. The work grows with the page, however it nests."""
    runs: list[Run] = []
    paths = Paths()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: blocks, and inline ones with a path of their own
    open_tags: Counter = Counter()
    block, at, n, body = 0, 0, page.rfind(">") + 1, False

    def text(raw: str) -> None:
        if raw:
            runs.append(Run(stack[-1][1], block, html.unescape(raw)))

    def close(depth: int) -> None:
        for tag, _ in stack[depth:]:
            open_tags[tag] -= 1
        del stack[depth:]

    def nearest(tags: set[str], stop: set[str] = frozenset()) -> int:
        """The place of the nearest open element of ``tags``, 0 if there is none or one of ``stop`` is nearer."""
        if not any(open_tags[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in stop:
                return 0
            if stack[i][0] in tags:
                return i
        return 0

    while at < n:
        m = _TAG.search(page, at, n)
        if m is None:
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if tag in INLINE:
                if stack[-1][0] == tag:
                    close(len(stack) - 1)
                continue
            if depth := nearest({tag}):
                close(depth)
            block += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else (page.find(">", end.start()) + 1 or len(page))
            continue
        if tag in ENDS_P and (depth := nearest({"p"})):
            close(depth)
        if tag in SELF_CLOSING and (depth := nearest(SELF_CLOSING[tag], SCOPES)):
            close(depth)
        if tag == "br":
            text(" ")
        elif tag not in INLINE:
            block += 1
        if tag in VOID or (tag == "body" and body):
            continue
        if tag == "body":
            body = True
            close(2 if len(stack) > 1 and stack[1][0] == "html" else 1)
        tokens = names_of(attrs) if attrs else []
        within = stack[-1][1]
        dropped = tag not in {"html", "body"} and (tag in FURNITURE_TAGS or bool(attrs and _HIDDEN.search(attrs)) or (tag == "header" and not paths.inside[within]))
        named = tag not in {"html", "body"} and furniture_name(tag, tokens)
        if tag in INLINE and not dropped and not named:
            continue
        label = re.sub(r"\d+", "", tokens[0]) if tokens and tag not in TEXT_BLOCKS else ""
        stack.append((tag, paths.child(within, tag, label, dropped, named)))
        open_tags[tag] += 1
    text(page[at:])
    return runs, paths


def fused(length: float, marks: float) -> float:
    return math.sqrt(length * (1 + marks))


def content_paths(runs: list[Run], paths: Paths) -> set[int]:
    """The paths whose fused ratio of text and punctuation to runs reaches the threshold."""
    size = len(paths.parent)
    length, marks, count, below = [0.0] * size, [0.0] * size, [0] * size, [0.0] * size
    for x in runs:
        if not paths.dropped[x.path]:
            length[x.path] += len(x.text.strip())
            marks[x.path] += len(_PUNCTUATION.findall(x.text))
            count[x.path] += 1
    below = length[:]
    for p in range(size - 1, 0, -1):  # children come after their parents
        below[paths.parent[p]] += below[p]
    total = below[0]
    if not total:
        return set()
    off = paths.dropped[:]
    for p in range(1, size):
        off[p] = off[p] or off[paths.parent[p]] or (paths.named[p] and below[p] < WHOLE * total)
    shown = [x for x in runs if not off[x.path]]
    if not shown:
        return set()
    text = [0.0] * size
    for p in {x.path for x in shown}:
        text[p] = length[p]
    under = text[:]
    for p in range(size - 1, 0, -1):
        under[paths.parent[p]] += under[p]
    # The region: articles or main elements, or else the deepest element with most of the text.
    articles = any(paths.tag[p] in CONTAINERS and under[p] > 0 for p in range(size))
    if articles:
        region = [i and not o for i, o in zip(paths.inside, off, strict=True)]
    else:
        top = max((p for p in range(size) if under[p] >= REGION * under[0] and paths.tag[p] not in TEXT_BLOCKS and paths.tag[p] not in INLINE), default=0)
        region = [False] * size
        for p in range(size):
            region[p] = not off[p] and (p == top or (p > 0 and region[paths.parent[p]]))
        if paths.tag[top] in {"#root", "html", "body"}:  # nothing but the page holds most of it: there is no region
            region = [False] * size
    own = {p: (length[p] / count[p], marks[p] / count[p]) for p in {x.path for x in shown}}
    smooth: dict[int, list[float]] = {}
    for i, x in enumerate(shown):
        near = [own[y.path] for y in shown[max(0, i - REACH) : i + REACH + 1]]
        got = smooth.setdefault(x.path, [0.0, 0.0, 0.0])
        got[0] += (own[x.path][0] + sum(r[0] for r in near) / len(near)) / 2
        got[1] += (own[x.path][1] + sum(r[1] for r in near) / len(near)) / 2
        got[2] += 1
    score = {p: fused(s[0] / s[2], s[1] / s[2]) for p, s in smooth.items()}
    inner = [p for p in score if region[p]]
    if inner:
        runs_in = sum(count[p] for p in inner)
        whole = fused(sum(length[p] for p in inner) / runs_in, sum(marks[p] for p in inner) / runs_in)
        score = {p: max(v, whole) if region[p] else v * (OUTSIDE if articles else 1.0) for p, v in score.items()}
    least = SHARE * sum(score[p] * length[p] for p in score) / max(1.0, sum(length[p] for p in score))
    return {p for p, v in score.items() if v >= least}


def main_text(page: str) -> str:
    runs, paths = parse(page)
    chosen = content_paths([x for x in runs if x.text.strip()], paths)
    blocks: list[list[str]] = []
    last = None
    for x in runs:
        if x.path in chosen:
            if x.block != last:
                blocks.append([])
                last = x.block
            blocks[-1].append(x.text)
    return "\n".join(b for b in (" ".join("".join(b).split()) for b in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) for every row.

    A null, empty or textless page gives an empty text; repeated rows each get a row; a null id
    stays null; an empty table gives an empty result; other columns are ignored. Time and memory
    grow with the length of a page, however long it is or deep its elements nest.
    """
    ship_package(pages.sparkSession)
    kind, sql = id_types(pages, id_col)
    schema = pa.schema([("id", kind), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    text = main_text(page.as_py() or "")
                    yield key, url, text, len(text)

        return emit(rows(), schema, lambda r: 4 * len(r[2]))

    out = pages.selectExpr(f"`{id_col}` id", f"cast(`{url_col}` as string) url", f"cast(`{html_col}` as string) html")
    return out.mapInArrow(run, f"id {sql}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
