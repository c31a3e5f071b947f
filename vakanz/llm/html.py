"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements. Each block of text gives points, for its length and commas, to
the elements above it; an element's points are discounted by the share of its text that is link
text. The best element, widened to the article or main element around it, is kept with those
siblings that score well too or belong to it: other articles, lists, tables and quotations beside
paragraphs. Elements that are never article text (scripts, controls, hidden elements) are left out
beforehand. Others (menus, forms, asides, footers, notices, comments and the like, by element,
role, class or id) are left out as a suggestion only: what holds the article or main element with
most text stays, and where forms or elements with such a class or id hold more paragraph text than
the rest of the page, or any of these all of its text, those with most of it are read again. The
same holds for a menu, aside or the like that is never closed.

Null and empty pages give an empty text, as do pages without text outside hidden elements; repeated
pages give repeated rows; an empty table gives an empty result. Whole pages are read. Other columns
are kept by ``with_main_text``, which refuses a name that is taken.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vakanz.llm.common import ready, refuse_taken, words_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
#: One attribute; read from left to right, so that names are whole and values are passed over.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = {n: re.compile(rf"</{n}\b[^>]*(?:>|\Z)", re.I) for n in "script style title textarea xmp iframe noembed noframes".split()}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - set("body head html legend optgroup option tbody td tfoot th thead tr".split())
SCOPE = set("html table td th caption button object template".split())
#: An element of the key ends an open element of the value that is not further up than its list.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# What is not article text.
ASIDE_TAGS = set(
    "head script style title noscript iframe template select button textarea svg canvas "
    "object xmp noembed noframes audio video map input datalist".split()
)
#: Elements that are, where they do not hold what the page is about.
SUGGESTED_TAGS = set("nav footer aside form dialog menu".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager paging footer masthead "
    "comment comments commentlist disqus replies respond discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search toolbar widget copyright skip".split()
)
HEADER_NAMES = {"header", "topbar"}
#: Names of what is written in paragraphs and yet not the article.
COMMENT_NAMES = set(
    "comment comments commentlist disqus replies respond discussion reviews responses reactions opinions guestbook".split()
)
#: Elements beside a text that belong to it where they hold few links.
BELONGING = set("ul ol dl table pre blockquote figure".split())
#: Kinds of suggested elements: by class or id, as comments, forms, and by element or role.
NAMED, COMMENTS, FORM, HARD = "named", "comments", "form", "hard"
#: Beside them, parts of names that tell of what an element has around or within.
HOLDER_NAMES = set("with has page layout".split())
#: Elements of paragraph text, and the unlinked characters from which text of another counts as such.
PARAGRAPH, LONG = {"p", "pre", "blockquote"}, 140
NEVER_ASIDE = {"html", "body", "article", "main"}
#: Parts of a block's points for the elements above it, from the nearest on.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)


def _is_aside(name: str, found: dict[str, str]) -> bool:
    if name in ASIDE_TAGS:
        return True
    if name in NEVER_ASIDE:
        return False
    return (
        "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    )


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name in lower case; of repeated names the first counts."""
    found: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attrs):
        found.setdefault(key.lower(), "".join(values))
    return found


def _names(found: dict[str, str]) -> set[str]:
    """The parts of an element's class and id."""
    return {p.lower() for key in ("class", "id") for p in NAME_PART.findall(found.get(key, ""))}


class Page:
    """Elements of a page in page order, and its blocks of text outside of asides."""

    def __init__(self, html: str):
        self._read(html, set())
        left_out = self._left_out()
        if all(self.name[i] in BLOCK for i in left_out):  # their text is in blocks of its own
            outside = bytearray(b"\1") * len(self.parent)
            for node in range(1, len(self.parent)):
                outside[node] = outside[self.parent[node]] and node not in left_out
            self.blocks = [b for b in self.blocks if outside[b[0]]]
        else:
            self._read(html, {self.named[i][0] for i in left_out})

    def _text(self, raw: str, node: int, in_link: bool) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if in_link:
            self._linked += len(" ".join(text.split()))

    def _flush(self, node: int) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._pieces, self._linked = [], 0

    def _left_out(self) -> set[int]:
        """The suggested elements that are left out."""
        n = len(self.parent)
        if not self.named:
            return set()
        plain, prose = [0] * n, [0] * n
        for node, text, links in self.blocks:
            own = len(text) - links
            plain[node] += own
            if self.name[node] in PARAGRAPH or own >= LONG:
                prose[node] += own
        for node in range(n - 1, 0, -1):
            plain[self.parent[node]] += plain[node]
            prose[self.parent[node]] += prose[node]
        around, within = [0] * n, {0: []}  # the next named element around each, and those next within
        for node in range(1, n):
            up = self.parent[node]
            around[node] = up if up in self.named else around[up]
            if node in self.named:
                within[node] = []
                within[around[node]].append(node)
        read = {0}  # what stays
        weight_of = lambda i: (prose[i], plain[i], -i)
        hard = [False] * n  # within elements that hold the page's text only if it stands nowhere else
        for node in range(1, n):
            hard[node] = hard[self.parent[node]] or node in self.named and self.named[node][1] in (COMMENTS, HARD)
        free = sum(len(text) - links for node, text, links in self.blocks if not hard[node])
        chief = max((i for i in self.articles if not hard[i] or plain[i] > free), key=weight_of, default=0)
        while chief:
            chief = around[chief]
            read.add(chief)
        out, opened = set(), [0]
        while opened:
            for node in within[opened.pop()]:
                (opened.append if node in read else out.add)(node)
        # First forms and named elements with more paragraph text than the rest, then whatever has text if
        # nothing else has; of elements that are asides by themselves only paragraph text counts.
        for kinds, loose in (((NAMED, FORM), ()), ((NAMED, COMMENTS, FORM, HARD), (NAMED, COMMENTS))):
            weigh = lambda i, loose=loose: (plain if self.named[i][1] in loose else prose)[i]
            base = plain if loose else prose
            kept = base[0] - sum(base[i] for i in out)
            order = [(-weigh(i), i) for i in out if self.named[i][1] in kinds]
            lost = -sum(w for w, _ in order)
            heapify(order)
            while order and (not kept and lost if loose else lost > kept):
                _, node = heappop(order)
                if not weigh(node):
                    continue
                out.remove(node)
                kept, lost = kept + base[node], lost - weigh(node)
                for inner in within[node]:
                    out.add(inner)
                    kept -= base[inner]
                    if self.named[inner][1] in kinds:
                        lost += weigh(inner)
                        heappush(order, (-weigh(inner), inner))
        return out

    def _read(self, html: str, left_out: set[int]) -> None:
        self.parent, self.name = [-1], ["#page"]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links in it
        self.named: dict[int, tuple[int, str]] = {}  # suggested elements: begin, kind
        self.articles: list[int] = []  # article and main elements that are not comments
        self._pieces: list[str] = []
        self._linked = 0
        stack: list[tuple[str, int]] = [("#page", 0)]
        containers = [0]  # block elements that are open, innermost last
        opened: dict[str, int] = {}
        unclosed: set[int] = set()  # suggested by tag: without an end tag of their own they suggest less
        aside_from = 0  # stack height at which an aside began, 0 outside
        at, end = 0, len(html)

        def pop_to(height: int, closing: str = "") -> None:
            nonlocal aside_from
            while len(stack) > height:
                name, node = stack.pop()
                if node in unclosed and (name != closing or len(stack) > height):
                    self.named[node] = self.named[node][0], NAMED
                opened[name] -= 1
                if aside_from and len(stack) < aside_from:
                    aside_from = 0
                if name in BLOCK:
                    self._flush(node)
                    if containers[-1] == node:
                        containers.pop()

        def ends(targets: set[str], limits: set[str]) -> None:
            if any(opened.get(t) for t in targets):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in targets:
                        pop_to(i)
                        return
                    if stack[i][0] in limits:
                        return

        while at < end:
            found = TOKEN.search(html, at)
            raw = html[at : found.start()] if found else html[at:]
            if raw and not aside_from:
                self._text(raw, containers[-1], bool(opened.get("a")))
            if not found:
                break
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            if found["close"] or found["close2"]:
                if name == "br" and not aside_from:
                    self._pieces.append(" ")
                elif opened.get(name):
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    pop_to(i, name)
                continue
            if name in RAW:
                close = RAW[name].search(html, at)
                at = close.end() if close else end
                continue
            if name in ENDS_PARAGRAPH:
                ends({"p"}, SCOPE)
            if name in IMPLIED:
                ends(*IMPLIED[name])
            if name == "a":
                ends({"a"}, SCOPE)
            if name in VOID:
                if not aside_from:
                    if name == "hr":
                        self._flush(containers[-1])
                    elif name == "br":
                        self._pieces.append(" ")
                continue
            attrs = found["attrs"] or found["attrs2"] or ""
            if name in BLOCK and not aside_from:
                self._flush(containers[-1])
            if aside_from:
                node = -1
            else:
                node = len(self.parent)
                self.parent.append(stack[-1][1])
                self.name.append(name)
            stack.append((name, node))
            opened[name] = opened.get(name, 0) + 1
            if not aside_from:
                in_article = bool(opened.get("article") or opened.get("main"))
                values = _attributes(attrs) if attrs else {}
                if found.start() in left_out or _is_aside(name, values):
                    aside_from = len(stack)
                    continue
                if name in BLOCK:
                    containers.append(node)
                names = _names(values)
                if name in ("article", "main"):
                    if not names & COMMENT_NAMES:
                        self.articles.append(node)
                elif name in SUGGESTED_TAGS or name == "header" and not in_article:
                    self.named[node] = found.start(), FORM if name == "form" else HARD
                    if name != "form":
                        unclosed.add(node)
                elif name not in NEVER_ASIDE:
                    role = values.get("role", "").lower() in ASIDE_ROLES - {"form"}
                    comments = bool(names & COMMENT_NAMES) and not names & HOLDER_NAMES
                    if role or comments or names & ASIDE_NAMES or not in_article and names & HEADER_NAMES:
                        self.named[node] = found.start(), HARD if role else COMMENTS if comments else NAMED
        pop_to(1)
        self._flush(0)

    def main_blocks(self) -> list[str]:
        """The blocks of the best element and its good siblings, in page order."""
        if not self.blocks:
            return []
        n = len(self.parent)
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, links in self.blocks:
            size[node] += len(text)
            linked[node] += links
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            # A paragraph's text counts for what holds the paragraph; loose text for its own element.
            above = self.parent[node] if self.name[node] != "div" and self.parent[node] >= 0 else node
            for share in SHARES:
                points[above] += worth * share
                above = self.parent[above]
                if above < 0:
                    break
        for node in range(n - 1, 0, -1):
            size[self.parent[node]] += size[node]
            linked[self.parent[node]] += linked[node]
        score = [p * (1 - k / s) if s else 0.0 for p, s, k in zip(points, size, linked, strict=True)]
        best = max(range(n), key=lambda i: (score[i], -i))
        top, up = best, best
        while up > 0:
            if self.name[up] in ("article", "main"):
                top = up
            up = self.parent[up]
        enough = max(10.0, score[best] / 5)
        keeps = bytearray(n)
        keeps[top] = 1
        around = self.parent[top]
        texts = {}
        for node, text, _ in self.blocks:
            texts.setdefault(node, []).append(text)
        for node in range(1, n):
            if node != top and self.parent[node] == around and size[node]:
                density = linked[node] / size[node]
                ended = any(t.endswith((".", "!", "?")) for t in texts.get(node, ()))
                paragraph = self.name[node] == "p" and (density < 0.25 and size[node] > 80 or density == 0 and ended)
                article = self.name[node] == self.name[top] == "article" and score[node] >= score[best] / 5 and density < 0.5
                belongs = self.name[node] in BELONGING and density < 0.25
                if score[node] >= enough and density < 0.5 or paragraph or article or belongs:
                    keeps[node] = 1
        for node in range(1, n):
            if keeps[self.parent[node]] and node != top:
                keeps[node] = 1
        return [text for node, text, _ in self.blocks if keeps[node]]


def main_text(html: str | None) -> str:
    """The main text of one page, a line a block."""
    return "\n".join(Page(html).main_blocks()) if html else ""


def with_main_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    refuse_taken(pages, into)
    ready(pages.sparkSession)

    @F.arrow_udf(StringType())
    def extract(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py()) for h in batch], pa.string())

    return pages.withColumn(into, extract(words_of(html_col)))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    rows = with_main_text(pages.select("page_id", "url", "html"), into="main_text")
    text = F.col("main_text").alias("text")
    return rows.select("page_id", "url", text, F.length("main_text").cast("long").alias("n_chars"))
