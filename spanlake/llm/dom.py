"""A tolerant reader of HTML: blocks of text below block elements, and the features of both, for many pages at once."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript select option button datalist template svg math object canvas audio video".split())
CONTROLS = frozenset("input select textarea button label fieldset".split())
# An opened element ends these, up to the given ancestors.
ENDS = {**{t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()},
        "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
        "tbody": ("thead", "tbody", "tr", "td", "th", "p"), "tfoot": ("thead", "tbody", "tr", "td", "th", "p"), "option": ("option",)}
WALLS = frozenset("ul ol menu dl table td th tr div article section aside main body html form blockquote header footer nav".split())

TABLE_PARTS = frozenset("thead tbody tfoot tr td th".split())
HEAD = frozenset("base link meta title style script noscript template".split())

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|data-role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}


@dataclass
class Page:
    """Nodes of a page in page order, the root first: elements, and blocks of text (tag ``#text``)."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", links: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.tokens.append(attribute_tokens(attributes) if attributes else ())
        self.hidden.append(bool(attributes) and _HIDDEN.search(attributes) is not None)
        self.controls.append(0)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the naming attributes (class, id, role ..), split at signs and capitals."""
    return tuple(dict.fromkeys(t.lower() for m in _NAMED.finditer(attributes) for t in _TOKEN.findall(unescape(m[2]))))


def parse(html: str | None) -> Page:
    """The nodes of a page.

    White space inside a block becomes one space, a line break too; character references are decoded.  Unclosed and stray tags are taken
    as browsers mostly do: a new paragraph or item ends the one before, an end tag without its start says nothing.
    """
    page = Page()
    stack, opened = [page.add(-1, "#root")], Counter()
    tags = page.tag
    pieces: list[str] = []
    unseen = anchors = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            block = " ".join("".join(pieces).split())
            if block:
                page.add(stack[-1], "#text", text=block, links=min(len(block), linked))
            pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal unseen
        while True:
            gone = tags[stack.pop()]
            opened[gone] -= 1
            unseen -= gone in UNSEEN
            if gone == tag:
                return

    at, html = 0, (html or "").replace("\0", "")
    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        start = m.start() if m else size
        if start > at and not unseen:
            piece = html[at:start]
            pieces.append(unescape(piece) if "&" in piece else piece)
            if anchors:
                linked += len(pieces[-1])
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "a":
                anchors = 0
            elif tag not in INLINE and opened[tag] > 0:
                flush()
                close(tag)
            continue
        if tag in CONTROLS:
            page.controls[stack[-1]] += 1
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID or tag in INLINE:
            if tag == "a":
                anchors = 1
            elif tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if opened["head"] > 0 and tag not in HEAD:
            close("head")
        for ended in ENDS.get(tag, ()):
            if opened[ended] > 0:
                for up in reversed(stack):
                    if tags[up] == ended:
                        close(ended)
                        break
                    if tags[up] in (("table",) if ended in TABLE_PARTS else WALLS):
                        break
        if attributes.endswith("/") and tag in UNSEEN:  # <svg ... />
            continue
        stack.append(page.add(stack[-1], tag, attributes))
        opened[tag] += 1
        unseen += tag in UNSEEN
    flush()
    return page


#: Tags with a column of their own.
MARKED = (("#text",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("p",), ("li", "dd", "dt"), ("td", "th", "tr", "table"), ("div", "section"))
#: Sums over a subtree.
_SUMS = CHARS, LINKS, WORDS, STOPS, COMMAS, DIGITS, BLOCKS, ELEMENTS, CONTROL, ITEMS = range(10)


class Forest:
    """The nodes of many pages that have text below them, as arrays."""

    def __init__(self, pages: list[Page]):
        import numpy as np
        sizes = [len(p.parent) for p in pages]
        first = np.cumsum([0, *sizes[:-1]]) if pages else np.zeros(0, np.int64)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        parent = np.where(parent < 0, -1, parent + np.repeat(first, sizes))
        depth = np.array([x for p in pages for x in p.depth], np.int64)
        text = [x for p in pages for x in p.text]
        tag = [x for p in pages for x in p.tag]
        sums, longest = np.zeros((len(tag), len(_SUMS))), np.zeros(len(tag))
        blocks = [i for i, x in enumerate(text) if x]
        sums[blocks] = [(len(x), 0, x.count(" ") + 1, sum(map(x.count, ".!?…。")), sum(map(x.count, ",;:")), sum(map(x[:100].count, "0123456789")), 1, 0, 0, 0) for x in (text[i] for i in blocks)] or 0
        sums[:, LINKS] = [x for p in pages for x in p.links]
        sums[:, CONTROL] = [x for p in pages for x in p.controls]
        sums[:, ELEMENTS] = [x != "#text" for x in tag]
        sums[:, ITEMS] = [x == "li" for x in tag]
        own = sums[:, CHARS].copy()
        longest[:] = own
        for level in self._levels(depth)[:0:-1]:
            np.add.at(sums, parent[level], sums[level])
            np.maximum.at(longest, parent[level], longest[level])
        kept = np.flatnonzero((sums[:, CHARS] > 0) | (parent < 0))
        number = np.cumsum(np.isin(np.arange(len(tag)), kept)) - 1
        before = np.cumsum(own) - own
        self.sums, self.longest, self.depth = sums[kept], longest[kept], depth[kept]
        self.parent = np.where(parent[kept] < 0, -1, number[parent[kept]])
        self.page = np.repeat(np.arange(len(pages)), sizes)[kept]
        self.before = before[kept] - (before[first] if len(pages) else 0)[self.page] if len(kept) else before[kept]
        self.text, self.tag = [text[i] for i in kept], [tag[i] for i in kept]
        tokens, hidden = [x for p in pages for x in p.tokens], [x for p in pages for x in p.hidden]
        self.tokens, self.hidden = [tokens[i] for i in kept], np.array([hidden[i] for i in kept], float)
        self.levels = self._levels(self.depth)

    @staticmethod
    def _levels(depth) -> list:
        """Node numbers by depth, the roots first."""
        import numpy as np
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []

    def features(self, token_scores: dict[str, float], tag_scores: dict[str, float]):
        """One row a node: size and density of its subtree, tokens, depth, siblings, place on the page."""
        import numpy as np
        n, parent = len(self.parent), self.parent
        root = parent < 0
        up = np.where(root, np.arange(n), parent)
        sums, log = self.sums, np.log1p
        chars = np.maximum(1.0, sums[:, CHARS])
        words, blocks = np.maximum(1.0, sums[:, WORDS]), np.maximum(1.0, sums[:, BLOCKS])
        total = chars[np.flatnonzero(root)][self.page]
        dense, size = sums[:, LINKS] / chars, log(sums[:, CHARS])
        # Siblings: a node's place among its parent's children, the one before and the one after.
        order = np.lexsort((np.arange(n), np.where(root, -1 - self.page, parent)))
        family = np.where(root, n + self.page, parent)
        many = np.bincount(family, minlength=1)[family].astype(float)
        follows = np.append(False, family[order][1:] == family[order][:-1])
        previous, following, place = np.full(n, -1), np.full(n, -1), np.zeros(n)
        previous[order[follows]] = order[np.flatnonzero(follows) - 1]
        following[previous[previous >= 0]] = np.flatnonzero(previous >= 0)
        runs = np.flatnonzero(~follows)
        place[order] = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        beside = lambda at, values, none: np.where(at >= 0, values[at], none)
        kinds, tag_of = np.unique(np.array(self.tag), return_inverse=True)
        _, pair, times = np.unique(family * len(kinds) + tag_of, return_inverse=True, return_counts=True)
        others = np.bincount(family, size, minlength=1)[family] - size
        # Scores of names, and of all ancestors' names, handed down level by level.
        low = np.array([min((token_scores.get(t, 0.0) for t in ts), default=0.0) if ts else 0.0 for ts in self.tokens])
        high = np.array([max((token_scores.get(t, 0.0) for t in ts), default=0.0) if ts else 0.0 for ts in self.tokens])
        tag = np.array([tag_scores.get(k, 0.0) for k in kinds])[tag_of]
        down = np.stack([np.minimum(low, 0), -np.maximum(high, 0), np.minimum(tag, 0), -np.maximum(tag, 0), -self.hidden], axis=1)
        for level in self.levels[1:]:
            down[level] = np.minimum(down[level], down[parent[level]])
        above = np.where(root[:, None], 0.0, down[up])
        named = np.stack([np.isin(kinds, group)[tag_of] for group in MARKED], axis=1)
        return np.column_stack([
            size, dense, log(sums[:, WORDS]), log(sums[:, CHARS] / np.maximum(1, sums[:, ELEMENTS])), log(sums[:, BLOCKS]), log(sums[:, CHARS] / blocks),
            sums[:, STOPS] / words, sums[:, COMMAS] / words, sums[:, DIGITS] / chars, sums[:, CHARS] / total, self.before / total, (self.before + sums[:, CHARS]) / total,
            self.depth, np.where(many > 1, place / np.maximum(1, many - 1), 0.5), log(many), sums[:, CHARS] / chars[up],
            beside(previous, size, -1), beside(following, size, -1), beside(previous, dense, 0), beside(following, dense, 0), times[pair] / many,
            np.where(many > 1, others / np.maximum(1, many - 1), -1), dense[up], log(self.longest), log(sums[:, CONTROL]), log(sums[:, ITEMS]),
            low, high, above[:, 0], -above[:, 1], tag, above[:, 2], -above[:, 3], -down[:, 4], named, beside(previous, tag, 0), beside(previous, low, 0)])

    def decode(self, odds):
        """Which nodes are kept: the choice of largest total log odds among those without contradictions.

        A kept node's ancestors are kept, and a kept element keeps at least one child (of equal ones the first); a page may keep none.
        """
        import numpy as np
        n, parent = len(self.parent), self.parent
        gain, good, best = np.array(odds, float), np.zeros(n), np.full(n, -np.inf)
        for level in self.levels[:0:-1]:
            inner = level[np.isfinite(best[level])]  # children are one level deeper: all of them are done
            gain[inner] += np.where(good[inner] > 0, good[inner], best[inner])
            np.add.at(good, parent[level], np.maximum(gain[level], 0))
            np.maximum.at(best, parent[level], gain[level])
        keep, taken = np.zeros(n, bool), np.zeros(n, bool)
        keep[parent < 0] = True
        for depth, level in enumerate(self.levels[1:]):
            up = parent[level]
            plain = keep[up] & (gain[level] > 0)
            only = level[keep[up] & ~(good[up] > 0) & (gain[level] == best[up]) & (depth > 0)]
            keep[level] = plain
            for i in only:  # few: an element kept for itself, whose children all speak against it
                if not taken[parent[i]]:
                    taken[parent[i]] = keep[i] = True
        return keep
