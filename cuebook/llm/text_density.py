"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. What is never article text goes first: elements whose name or role
says menu, header, footer, notice, form, script or style. A class or id that is a plain name for such
a thing (``ad``, ``site-footer``, ``comment-list``, but neither ``has-sidebar`` nor ``search-result``)
drops its element too, unless that holds an article or main element with unlinked text. A hint word
does not count on a page where the elements it names hold the larger part of the unlinked characters
and no article or main element stands apart from them; for comments that takes all of them.
For every node left, with C characters and T tags below it, of which LC and LT in links,

    density = C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

so text without links is dense and lists of links are thin. The node whose children's densities
sum highest is the core. The least density on the path from the core to the body is the threshold,
and the core, with those subtrees and bare blocks beside the path that reach the threshold, is the
text. Article and main elements only add: inside the nearest one that holds the core, what stands
beside the path is text too unless most of its characters are linked; and another article or main
element is text, as the density of a short one is low, where it has at least half as many unlinked
characters a tag as some node of the path, and most of its characters are unlinked.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by a blank line; a line break inside a block is white space.
Null and empty pages give an empty text; a page without tags is one block. Unclosed and stray tags
are tolerated. Repeated rows each get a row, extra columns are ignored, an empty table gives
an empty result. One Arrow pass, no shuffle; a page's tree is the only state.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names by what they do in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("applet aside audio button canvas datalist dialog embed footer form frame frameset head header iframe input "
                  "label legend link menu meta meter nav noembed noframes noscript optgroup option output progress "
                  "script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog directory form menu menubar navigation search status "
                  "tablist toolbar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-share comment comments "
                  "commentlist consent cookie cookies copyright dialog discussion disqus footer header login masthead menu modal nav navbar "
                  "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
                  "recommended related reply replies respond responses search share sharing sidebar signin signup skip social sponsor "
                  "sponsored subscribe subscription toolbar topbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus reply replies respond responses".split())
# Words that make a name tell what a page has or lacks, and words that add nothing to one.
ABOUT = frozenset("has have having with without no non not hide hides show shows".split())
PLAIN = frozenset("area articles author bar block body bottom box button buttons col column container content desktop entries form group "
                  "holder home icon icons inner item items left link links list main meta mobile outer pages panel posts primary right row "
                  "secondary section slot stories text thread title toggle top trail unit wrap wrapper".split())
KEEP = frozenset("html body article main".split())
# An open element (key) ends where one of these starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
          "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "p": BLOCK - {"html", "body", "head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORD = re.compile(r"[a-z0-9]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``text``, ``open`` and ``close`` in page order, without comments."""
    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        yield ("close" if m[1] else "open"), name, m[3]
        if name in RAW and not m[1]:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        yield "text", "", page[at:]


def _given(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(rest)} if "=" in rest else {}


def _never(name: str, given: dict[str, str]) -> bool:
    return name in NEVER or name not in KEEP and given.get("role", "") in ROLES


def _named(given: dict[str, str]) -> set[str]:
    """The hint words that a class or id is a plain name for: its last word that says something, in names without has-, with-, no-."""
    found = set()
    for token in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = WORD.findall(token.split("--")[0])
        while len(words) > 1 and (words[-1] in PLAIN or words[-1][0].isdigit() or len(words[-1]) == 1):
            words.pop()
        if words and words[-1] in HINTS and not ABOUT & set(words):
            found.add(words[-1])
    return found


# Open elements that the start of another may end, or must not look past; it passes by all others.
HALTS = BLOCK | CLOSES.keys() | frozenset().union(*SCOPES.values())


class Page:
    """Nodes in page order: name, parent, the node after the subtree; text pieces (node, text) in order."""

    def __init__(self, page: str):
        self.name, self.parent, self.end, self.texts = ["#root"], [0], [0], []
        self.marks: list[tuple[int, str]] = []  # (node, text), or (node, "") where a block begins or ends
        self.hints: dict[int, set[str]] = {}  # hint words that name a node
        stack, dropped = [0], 0
        # Places on the stack: of each name, of blocks, of elements that a start tag may end or must not look past. With
        # these a tag costs what it ends, however deep the page is.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.halts: list[int] = []
        self.skipped: dict[str, int] = {}  # names open inside an element that goes
        for kind, name, rest in tokens(page):
            if kind == "text":
                if not dropped:
                    self.marks.append((stack[-1], html.unescape(rest)))
            elif kind == "open":
                if not dropped:
                    self._finish(stack, name)
                given = {} if dropped or name in VOID else _given(rest)
                if dropped or (name not in VOID and _never(name, given)):
                    dropped = self._skip(stack, name, dropped)
                elif name == "br":
                    self.marks.append((stack[-1], " "))
                else:
                    if words := _named(given):
                        self.hints[len(self.name)] = words
                    self._open(stack, name)
            elif name in VOID:
                continue
            elif dropped:
                dropped = self._unskip(stack, name, dropped)
            else:
                self._close(stack, name)
        while len(stack) > 1:
            self._pop(stack) if isinstance(stack[-1], int) else stack.pop()
        self.end[0] = len(self.name)
        self.gone = self._gone()
        self.marks = [m for m in self.marks if not self.gone[m[0]]]

    def _open(self, stack: list, name: str) -> None:
        node = len(self.name)
        self.name.append(name)
        self.parent.append(stack[-1])
        self.end.append(0)
        if name in BLOCK:
            self.marks.append((stack[-1], ""))
        if name in VOID:
            self.end[node] = node + 1
        else:
            place = len(stack)
            self.places.setdefault(name, []).append(place)
            if name in BLOCK:
                self.blocks.append(place)
            if name in HALTS:
                self.halts.append(place)
            stack.append(node)

    def _pop(self, stack: list) -> None:
        node = stack.pop()
        self.places[self.name[node]].pop()
        for places in (self.blocks, self.halts):
            if places and places[-1] == len(stack):
                places.pop()
        self.end[node] = len(self.name)
        if self.name[node] in BLOCK:
            self.marks.append((self.parent[node], ""))

    def _finish(self, stack: list, name: str) -> None:
        """End the open elements that the start of ``name`` ends: a row its cell and the row before, too."""
        i = len(self.halts) - 1
        while i >= 0:  # few steps: of each name at most one before a scope
            k = self.halts[i]
            open_ = self.name[stack[k]]
            if name in CLOSES.get(open_, ()):
                while len(stack) > k:
                    self._pop(stack)
                i = len(self.halts)
            elif open_ in BLOCK and open_ not in CLOSES or any(open_ in SCOPES[c] for c in SCOPES if name in CLOSES[c]):
                return
            i -= 1

    def _close(self, stack: list, name: str) -> None:
        places = self.places.get(name)
        if places and (name in BLOCK or not self.blocks or places[-1] > self.blocks[-1]):
            k = places[-1]
            while len(stack) > k:
                self._pop(stack)

    def _skip(self, stack: list, name: str, dropped: int) -> int:
        """Inside an element that goes: only its own nesting is followed, on the stack as names."""
        if not dropped and name in BLOCK:
            self.marks.append((stack[-1], ""))
        if name in VOID:
            return dropped
        stack.append(name)
        self.skipped[name] = self.skipped.get(name, 0) + 1
        return dropped + 1

    def _unskip(self, stack: list, name: str, dropped: int) -> int:
        if self.skipped.get(name):
            ended = ""
            while ended != name:
                ended = stack.pop()
                self.skipped[ended] -= 1
                dropped -= 1
            return dropped
        if name in KEEP and self.places.get(name):
            del stack[len(stack) - dropped:]  # an element that goes was never closed
            self.skipped.clear()
            self._close(stack, name)
            return 0
        return dropped

    def unlinked(self) -> list[int]:
        """Characters below each node outside links."""
        n = len(self.name)
        chars, linked = [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.name[i] == "a"
        for node, text in self.marks:
            chars[node] += 0 if linked[node] else len(text.strip())
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        return chars

    def _gone(self) -> list[bool]:
        """For each node: whether it lies in an element that a hint word drops."""
        gone = [False] * len(self.name)
        if not self.hints:
            return gone
        chars = self.unlinked()
        articles = [i for i, name in enumerate(self.name) if name in ("article", "main") and chars[i] and i not in self.hints]

        def holds(i: int, sorted_nodes: list[int]) -> bool:
            at = bisect_right(sorted_nodes, i)
            return at < len(sorted_nodes) and sorted_nodes[at] < self.end[i]

        named = {i: words for i, words in self.hints.items() if self.name[i] not in KEEP and not holds(i, articles)}

        def outermost(words: Set[str]) -> list[int]:
            found, end = [], 0
            for i in named:
                if i >= end and named[i] & words:
                    found.append(i)
                    end = self.end[i]
            return found

        said = sum(chars[i] for i in outermost(COMMENTS))
        void = set()
        for word in set().union(*named.values()):
            mine = outermost({word})
            held = sum(chars[i] for i in mine)
            larger = held == chars[0] if word in COMMENTS else 2 * held > chars[0] - said
            if larger and all(holds(a, mine) for a in articles):
                void.add(word)
        for i in named:
            if named[i] - void:
                gone[i:self.end[i]] = [True] * (self.end[i] - i)
        return gone

    def _densities(self) -> None:
        """Characters, tags, and those of them in links, below each node; densities."""
        n = len(self.name)
        chars, links, tags, anchors = self.counts = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.marks:
            chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if self.name[i] == "a":
                links[i], anchors[i] = chars[i], anchors[i] + (not self.gone[i])
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + (not self.gone[i])
            anchors[p] += anchors[i]
        self.ratio = links[0] / max(chars[0], 1)
        self.density = [self._dense(*x) for x in zip(*self.counts, strict=True)]

    def _dense(self, c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + self.ratio * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(base), 0.1)

    def _blocks(self) -> Iterator[list[int]]:
        """The marks of each block, by their places."""
        now: list[int] = []
        for k, (_, text) in enumerate(self.marks):
            if text:
                now.append(k)
            else:
                yield now
                now = []
        yield now

    def selected(self) -> list[bool]:
        """For each mark: whether it is the text."""
        self._densities()
        density, (chars, links, tags, _) = self.density, self.counts
        sums = [0.0] * len(density)
        for i in range(1, len(density)):
            sums[self.parent[i]] += density[i]
        core = max(range(len(sums)), key=lambda i: (sums[i], -i))
        if not core:
            return [True] * len(self.marks)
        path = [core]
        while path[-1]:
            path.append(self.parent[path[-1]])
        measured = [i for i in path if self.name[i] not in ("#root", "html")] if len(path) > 2 else path
        floor = min(density[i] for i in measured)
        article = [i for i, name in enumerate(self.name) if name in ("article", "main") and i not in self.hints]
        evidence = set(article)
        home = next((k for k, i in enumerate(path) if i in evidence), 0)
        within, above = set(path[1:home + 1]), set(path[1:])

        inside = [False] * len(density)

        def take(i: int) -> None:
            inside[i:self.end[i]] = [True] * (self.end[i] - i)

        take(core)
        for i in range(1, len(density)):
            p = self.parent[i]
            if p in above and i not in above and chars[i] and (density[i] >= floor or p in within and 2 * links[i] <= chars[i]):
                take(i)
        rate = min((chars[i] - links[i]) / max(tags[i], 1) for i in measured)
        for i in article:
            if i not in above and not inside[i] and chars[i] and 2 * links[i] <= chars[i] and 2 * (chars[i] - links[i]) / max(tags[i], 1) >= rate:
                take(i)

        kept = [inside[node] for node, _ in self.marks]
        for block in self._blocks():
            if bare := [self.marks[k][0] for k in block if self.marks[k][0] in above]:
                nodes = {self.marks[k][0] for k in block} - above
                anchors = {i for i in nodes if self.name[i] == "a"}
                size = {k: len(self.marks[k][1].strip()) for k in block}
                c, lc = sum(size.values()), sum(size[k] for k in block if self.marks[k][0] in anchors)
                if c and (self._dense(c, lc, len(nodes), len(anchors)) >= floor or within.issuperset(bare) and 2 * lc <= c):
                    for k in block:
                        kept[k] = True
        return kept

    def text(self) -> str:
        kept = self.selected()
        blocks = []
        for marks in self._blocks():
            if block := " ".join("".join(self.marks[k][1] for k in marks if kept[k]).split()):
                blocks.append(block)
        return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extracted(page: Column) -> Column:
    @F.arrow_udf("string")
    def made(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return made(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page."""
    return pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), extracted(pages[html_col]).alias("text")) \
        .withColumn("n_chars", F.length("text").cast("long"))
