"""Main text of web pages by tag-path ratios.

Every run of text is a leaf under a path of tags.  For each path of a page the text that
isn't in links and its punctuation are added up and divided by the number of leaves; the
two ratios are smoothed over the paths in page order, fused and held against a threshold.
The leaves of chosen paths name the part of the page that holds the content, and what
stands in that part is kept: headings, lists and captions share the article's place but
not its path.  Elements that are no content by their tag, role or state go first; a class
or id that speaks against an element only lowers the ratio of the paths under it, and not
even that if the page's best path is there.

A page is read in one pass: tags are found by their ends, paths and parents are numbers,
and what is open is counted, so the time and memory grow with the page and no more.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Share of the best path's ratio that content has to reach.
THRESHOLD = 0.25
#: What is left of the ratio of a path under an element whose class or id speaks against it.
NAMED = 0.05
# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title iframe svg math select canvas object xmp noembed noframes".split()
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset datalist audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
KEPT_WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words that name a part which is no content, in its class or id.
NO_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail aside "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs crumbs footer foot cookie cookies consent gdpr notice notices alert popup popups modal overlay "
    "newsletter subscribe subscription signup login signin share shares sharing social related recommended recommendations more-like trending popular tags "
    "comment comments commentlist discussion disqus replies reply respond responses pagination pager toolbar widget widgets copyright disclaimer masthead topbar skip hidden teaser teasers".split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟«»\"()]")
_CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
_SCOPES = frozenset("ul ol dl table".split())
_WALLS = frozenset("article main body td".split())
_STRAY = frozenset("p li div".split())


def _judged(tag: str, rest: str, inside_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is no content, whether its class or id speaks against it, and its class for the path."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True, False, ""
    label, names = "", []
    if rest and not rest.isspace():
        for found in _ATTRIBUTE.finditer(rest):
            key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return tag not in KEPT_WHOLE, False, ""
            if key == "role" and value in DROPPED_ROLES:
                return tag not in KEPT_WHOLE, False, ""
            if key in ("class", "id"):
                names += value.split()
                label = label or value.split(" ")[0]
    return False, tag not in KEPT_WHOLE and any(_speaks_against(x) for x in names), label


def _speaks_against(name: str) -> bool:
    parts = _NAME.findall(name)
    return not {"has", "with", "no", "without"} & set(parts) and (name in NO_CONTENT or not NO_CONTENT.isdisjoint(parts))


class _Leaf:
    __slots__ = ("text", "path", "node", "linked", "named")

    def __init__(self, path: int, node: int, named: int):
        self.text, self.path, self.node, self.linked, self.named = [], path, node, 0, named


class Page:
    """The leaves of a page in its order, and its elements by number: ``parent``, ``tag`` and ``last``, the last element inside.

    Number 0 is the page itself.  A leaf's ``named`` is the outermost element around it whose
    name speaks against it, or 0.
    """

    def __init__(self, html: str):
        self.leaves: list[_Leaf] = []
        self.parent, self.tag, self.last = [0], [""], [0]
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]  # tag, path, number, dropped, named
        self._open = Counter()  # by tag
        self._reach = [Counter()]  # p, li and div that a stray end may close, by what they stand in
        self._muted: list[str] = []  # open inline elements that are no content
        self._first_muted: dict[str, int] = {}
        self._leaf: _Leaf | None = None
        self._links = 0
        self._read(html)
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.parent) - 1

    def _say(self, text: str) -> None:
        tag, path, node, dropped, named = self._stack[-1]
        if self._muted or dropped:
            return
        if "&" in text:
            text = unescape(text)
        if self._leaf is None:
            if not text or text.isspace():
                return
            self._leaf = _Leaf(path, node, named)
            self.leaves.append(self._leaf)
        self._leaf.text.append(text)
        if self._links:
            self._leaf.linked += len(text)

    def _pop(self) -> None:
        tag, _, number, *_ = self._stack.pop()
        self.last[number] = len(self.parent) - 1
        self._open[tag] -= 1
        if tag in _WALLS:
            self._reach.pop()
        elif tag in _STRAY:
            self._reach[-1][tag] -= 1

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        quotes = {q: html.rfind(q) for q in "\"'"}
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._say(html[at:])
                return
            if lt > at:
                self._say(html[at:lt])
            found = _TAG.match(html, lt)
            if found is None:
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    at = size if end < 0 else end + 3
                elif html.startswith("<![CDATA[", lt):
                    end = html.find("]]>", lt)
                    at = size if end < 0 else end + 3
                elif html[lt + 1 : lt + 2] in ("!", "?"):
                    end = html.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    self._say("<")
                    at = lt + 1
                continue
            end = at = found.end()
            while (stop := _STOP.search(html, at)) is not None and stop[0] != ">":
                at = stop.end()
                if stop.start() < quotes[stop[0]]:
                    at = html.find(stop[0], at) + 1
            if stop is None:
                return  # a tag that never ends
            at = stop.end()
            tag, given = found[2].lower(), html[end : stop.start()]
            if found[1]:
                self._close(tag)
            elif tag in _RAW_END:
                close = _RAW_END[tag].search(html, at)
                if tag not in INLINE:
                    self._leaf, self._links = None, 0
                if close is None:
                    return
                at = html.find(">", close.end()) + 1 or size
            else:
                self._element(tag, given)

    def _inline(self, tag: str, rest: str, end: bool) -> None:
        if tag == "a":
            self._links = max(0, self._links + (-1 if end else 1))
        elif tag == "br" and self._leaf is not None:
            self._leaf.text.append(" ")
        if end:
            if (i := self._first_muted.get(tag)) is not None:
                for x in self._muted[i:]:
                    if self._first_muted.get(x, -1) >= i:
                        del self._first_muted[x]
                del self._muted[i:]
        elif (self._muted and tag == self._muted[-1]) or (rest and _judged(tag, rest, True)[0]):
            self._first_muted.setdefault(tag, len(self._muted))
            self._muted.append(tag)
            if self._leaf is not None:
                self._leaf.text.append(" ")

    def _block(self) -> None:
        self._leaf, self._links = None, 0
        self._muted.clear()
        self._first_muted.clear()

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            return self._inline(tag, "", True)
        self._block()
        # A stray end doesn't close what stands around it.
        if (self._reach[-1][tag] if tag in _STRAY else self._open[tag]) > 0:
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _element(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            return self._inline(tag, rest, False)
        self._block()
        if tag in VOID:
            return
        closes = _CLOSED_BY.get(tag, _CLOSED_BY["p"])
        while self._stack[-1][0] in closes and self._stack[-1][0] not in _SCOPES:
            self._pop()
        _, above, parent, dropped, named = self._stack[-1]
        gone, against, label = (True, False, "") if dropped else _judged(tag, rest, self._open["article"] + self._open["main"] > 0)
        number = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.last.append(number)
        path = self._paths.setdefault((above, f"{tag}.{label}" if label else tag), len(self._paths) + 1)
        self._stack.append((tag, path, number, gone, named or (number if against else 0)))
        self._open[tag] += 1
        if tag in _WALLS:
            self._reach.append(Counter())
        elif tag in _STRAY:
            self._reach[-1][tag] += 1
        if rest.endswith("/") and tag not in ("p", "div", "li"):
            self._pop()


def path_ratios(paths: list, letters: list[int], marks: list[int]) -> dict:
    """The fused ratio of each path from its leaves' unlinked letters and punctuation, in page order."""
    sums: dict = defaultdict(lambda: [0, 0, 0])
    for path, n, m in zip(paths, letters, marks, strict=True):
        own = sums[path]
        own[0] += n
        own[1] += m
        own[2] += 1
    volume, points, leaves = np.array(list(sums.values()), np.float64).reshape(-1, 3).T
    # A path that holds most of the text is content even if its single leaves are short.
    fused = _smooth(volume / leaves) * (1 + _smooth(points / leaves)) * (1 + volume / max(1.0, volume.sum()))
    return dict(zip(sums, fused.tolist(), strict=True))


def main_text(html: str | None) -> str:
    """Text of the page's content; blocks are trimmed, white space inside is one space, one space joins them."""
    if not html:
        return ""
    page = Page(html)
    texts = [" ".join("".join(x.text).split()) for x in page.leaves]
    leaves = [x for x, text in zip(page.leaves, texts, strict=True) if text]
    texts = [text for text in texts if text]
    if not leaves:
        return ""
    letters = [max(0, len(text) - x.linked) for x, text in zip(leaves, texts, strict=True)]
    marks = [len(_PUNCTUATION.findall(text)) if x.linked < len(text) else 0 for x, text in zip(leaves, texts, strict=True)]
    cleared = 0  # an element that is content whatever it is called
    for _ in range(2):
        paths = [(x.path, x.named != 0 and x.named != cleared) for x in leaves]
        fused = {p: r * NAMED if p[1] else r for p, r in path_ratios(paths, letters, marks).items()}
        best = max(fused, key=fused.get)
        if not fused[best]:
            return ""
        if not best[1]:
            break
        held = Counter()
        for x, path, n in zip(leaves, paths, letters, strict=True):
            if path == best:
                held[x.named] += n
        cleared = max(held, key=lambda k: (held[k], -k))
    chosen = [not p[1] and fused[p] >= THRESHOLD * fused[best] for p in paths]
    part = _holder(page, [x for x, good in zip(leaves, chosen, strict=True) if good])
    kept = []
    for leaf, path, text, good in zip(leaves, paths, texts, chosen, strict=True):
        if not good:
            inside = part <= leaf.node <= page.last[part] if part else page.tag[leaf.node] in HEADINGS
            good = inside and not path[1] and leaf.linked <= 0.6 * len(text)
        if good:
            kept.append(text)
    return " ".join(kept)


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate([x[:1], x, x[-1:]])
    return np.maximum(x, 0.25 * padded[:-2] + 0.5 * x + 0.25 * padded[2:])


def _holder(page: Page, content: list[_Leaf]) -> int:
    """The deepest element around all of the content that isn't a single block of it; 0 if that is the whole page."""
    node, last = content[0].node, content[-1].node
    while not node <= last <= page.last[node]:
        node = page.parent[node]
    if node and len(content) == 1:
        node = page.parent[node]
    return 0 if page.tag[node] in ("html", "body") else node


def _extract(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns ``row`` (the columns of ``pages`` but for the html), ``text`` and ``n_chars``,
    its code points.

    * null or empty html, or no text in it: an empty text;
    * broken markup: read as far as it goes; an unclosed comment, script or tag ends with the page;
    * very long pages: read in one pass, held by one task at a time;
    * ties between paths: the earlier one in the page is the best;
    * other columns keep their names inside ``row``, so none can clash;
    * repeated rows give repeated results; an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col])
    given = pages.select(row.alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = StructType().add("row", given.schema["row"].dataType).add("text", StringType()).add("n_chars", LongType())
    return given.mapInArrow(_extract, out)
