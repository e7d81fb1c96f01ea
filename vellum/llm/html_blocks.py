"""Main text of web pages from flat text blocks, classified by a decision tree.

One pass over the tags makes a flat list of blocks: runs of text between tags that start a line. A block has its number of words, the share
of them in links, the same two figures of the blocks before and after it, and its place: in a part that is no article by its element, role or
name (menus, footers, sidebars, notices, adverts, forms, comments), in a part whose name only hints at that, outside of the page's article, on
a page without an article element, or in the article. A decision tree fitted to the blocks of the small labelled pages in ``PAGES`` tells content from the rest.
Neighbours decide wherever the place doesn't: a link in running text is content and one in a menu isn't, a short line is a heading beside a
long paragraph and furniture between links, a long paragraph outside of the article is content beside another.

Scripts, styles, comments in the markup and what is hidden make no block. Character references are decoded after the tags are taken
out; white space in a block becomes one space; content blocks are joined by a line feed. Unclosed and misplaced end tags do no harm: an
end tag closes what it matches or nothing, a tag that is cut off or has odd quotes is left out, and an article opened in a part that was
never closed, or that only its class names, is an article. Elements that are open are kept by name, so work grows with the page and not with its square.

Defined results: null and empty pages, and pages without content, have an empty text. Rows that repeat an id are worked on one by one;
copies have equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import map_text, texts

# Elements and names.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
PARTS = frozenset("nav header footer aside form menu select button dialog fieldset head".split())
HOLDERS = frozenset("div section article main ul ol dl table tbody tr td th figure p li span body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs
    sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup login share sharing social related recommended recommendations pagination pager comment comments
    disqus reply replies respond copyright disclaimer hidden""".split()
)
HINTS = frozenset("search form skip widget widgets result results".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/a-zA-Z][^>]*(?:>|$)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-zA-Z]+")

APART, HINTED, OUTSIDE, NO_ARTICLE, INSIDE = range(5)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")
#: Labelled pages, a block after the other: place (Apart, Hinted, Outside, No article, Inside), words, percent of them in links, and whether it
#: is content; features of neighbours come from the order. What the labels say: parts that are none of the article's stay out, whatever they hold. Text in
#: the article is content, and so is a link there between lines of text, not one beside another. Without an article, paragraphs are content, short lines
#: beside paragraphs and links between paragraphs; other short lines and links are furniture. Outside of the article, and in parts whose
#: names only hint, long text beside long text is content.
PAGES = (
    "A5:0- A1:100- A27:5- I24:10+ I6:0+ I46:20+ H22:100- H1:90- H6:100- H5:100- H2:100- I8:90- I10:0+",
    "A1:100- A126:0- A4:0- A14:10- O1:90- O21:0- O50:0+ O62:20+ I85:5+ I2:0+ I3:100- I26:10+",
    "N48:0+ N2:0+ N1:90- H321:5- H14:0- H5:100- H14:0- H3:100- H15:10- N6:0- N2:100- N248:0+",
    "N142:0+ N34:0+ N85:0+ H57:5- H20:10- H50:0- H28:0+ H234:0+ H291:0+ N35:0+ N4:0+ N49:0+",
    "N23:10+ N47:5+ N64:5+ N1:100+ N27:0+ N2:0+ N28:5+ N2:100- N22:80- N8:100- N5:100- N6:90-",
    "N164:0+ N167:0+ N253:0+ H208:5+ H98:0+ H104:0+ H87:5+ H291:0+ H25:5+ N32:0+ N192:0+ N2:0+",
    "A41:0- A19:0- A12:10- A1:90- O4:90- O34:20- O14:0- O16:0- I3:100+ I243:5+ I11:0+ I3:100-",
    "I170:5+ I196:5+ I44:0+ O38:0- O26:5- O112:0- O20:10- O297:5+ O54:5+ A39:0- A167:0- A38:0- A121:0-",
    "N4:100- N98:0+ N14:0+ N30:20+ N181:0+ N23:0+ N4:100- N4:0- N12:0- N1:100- N1:90- N16:60-",
    "N67:5+ N106:0+ N3:100+ N269:0+ N196:5+ N49:5+ N87:0+ N37:0+ N297:0+ N19:80+ N243:5+ N2:90-",
    "N9:0+ N67:0+ N2:100- N8:90- N8:90- N2:0- N1:100- N4:0+ N36:0+ N199:0+ N36:95- N12:0-",
    "I9:0+ I274:5+ I72:0+ O42:0+ O321:0+ O37:0- O238:5+ O47:5+ O269:0+ A43:0- A174:5- A8:100- A87:0-",
    "A25:0- A3:100- A253:0- A3:100- O18:0- O119:0- O4:90- O6:100- I5:90- I7:0+ I1:100+ I21:0+",
    "I140:5+ I59:0+ I74:5+ O225:0+ O90:5+ O124:0+ O17:10- O40:5+ O315:0+ A38:0- A33:0- A49:0- A39:0-",
    "A96:0- A12:0- A96:0- A1:90- O1:100- O47:20- O33:80- O238:0- I2:100+ I174:5+ I18:10+ I33:0+",
)


def table(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks."""
    x, y = [], []
    for page in pages:
        found = [("AHONI".index(p), int(words), int(links) / 100, label == "+") for p, words, links, label in re.findall(r"([AHONI])(\d+):(\d+)([+-])", page)]
        x += list(features([(None, words, links, place) for place, words, links, _ in found]))
        y += [label for *_, label in found]
    return np.array(x, float), np.array(y, float)


def features(found: list[tuple]):
    """The features of each of (text, words, share of words in links, place)."""
    none = ("", 0, 0.0, APART)
    for i, (_, words, links, place) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        yield words, links, before[1], before[2], after[1], after[2], place


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
    """A binary tree by Gini impurity: a class, or (feature, limit, tree up to the limit, tree beyond it). Ties go to the first feature and the lowest limit."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[:-1] + values[1:]) / 2:
            low = y[x[:, k] <= limit]
            high = y[x[:, k] > limit]
            if min(len(low), len(high)) < least:
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (low, high))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(limit))
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, k, limit = best
    low = x[:, k] <= limit
    return k, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(1)
def tree() -> dict:
    return by_place(*table())


def by_place(x: np.ndarray, y: np.ndarray) -> dict:
    """The whole tree: its root divides by place, for places have no order, and the rest by limits."""
    return {place: grow(x[x[:, -1] == place], y[x[:, -1] == place]) for place in np.unique(x[:, -1]).astype(int)}


def classify(features: tuple, node) -> bool:
    node = node[features[-1]]
    while isinstance(node, tuple):
        k, limit, low, high = node
        node = low if features[k] <= limit else high
    return bool(node)


def _part(tag: str, more: str, inside: bool) -> str | None:
    """Why an element is no part of the article, if so: 'comments' or 'part'; 'hint' if its name only hints at that."""
    found = None
    if more:
        for key, value in _ATTRIBUTE.findall(more):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names = set(_NAME.findall(value))
                if names & COMMENTS:
                    return "comments"
                if tag not in ("body", "html", "article", "main"):
                    found = "part" if names & NAMES else found or ("hint" if names & HINTS else None)
            elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found = "part"
    if tag in PARTS and not (tag == "header" and inside):
        return "part"
    return found


class Open:
    """The elements that are open, outermost first; an end tag finds its element by name."""

    def __init__(self):
        self.rows: list[tuple[str, str | None, bool, int]] = []  # element, why apart, whether it is an article, number of its tag
        self.by_name: dict[str, list[int]] = {}
        self.count = {"part": 0, "comments": 0, "hint": 0, "article": 0}
        self.ended: set[int] = set()  # numbers of the tags of parts that an end tag closes later
        self.in_ended = 0

    def push(self, tag: str, why: str | None, article: bool, number: int) -> None:
        self.by_name.setdefault(tag, []).append(len(self.rows))
        self.rows.append((tag, why, article, number))
        if why:
            self.count[why] += 1
        self.count["article"] += article
        self.in_ended += number in self.ended

    def know(self, ended: set[int]) -> None:
        self.ended = ended
        self.in_ended = sum(number in ended for *_, number in self.rows)

    def close(self, tag: str) -> int | None:
        """Closes the innermost element of that name and all in it; its tag's number, or None if there is none."""
        if not self.by_name.get(tag):
            return None
        at = self.by_name[tag][-1]
        number = self.rows[at][3]
        self.cut(at)
        return number

    def cut(self, at: int = 0) -> None:
        """Closes all elements from place ``at`` on."""
        while len(self.rows) > at:
            tag, why, article, number = self.rows.pop()
            self.by_name[tag].pop()
            self.in_ended -= number in self.ended
            if why:
                self.count[why] -= 1
            self.count["article"] -= article

    def place(self) -> int:
        if self.count["part"] or self.count["comments"]:
            return APART
        return HINTED if self.count["hint"] else INSIDE if self.count["article"] else OUTSIDE


def closed(tokens: list[re.Match]) -> set[int]:
    """Numbers of the tags of parts (menus, asides and the like) that an end tag closes."""
    waiting: dict[str, list[int]] = {}
    found = set()
    for i, m in enumerate(tokens):
        tag = m["tag"] and m["tag"].lower()
        if tag in PARTS:
            if not m["end"]:
                waiting.setdefault(tag, []).append(i)
            elif waiting.get(tag):
                found.add(waiting[tag].pop())
    return found


def blocks(page: str | None) -> list[tuple[str, int, float, int]]:
    """(text, words, share of words in links, place) of each block in page order."""
    out: list[list] = []
    open_ = Open()
    anchors, some_article = 0, False
    held: list[tuple[str, bool]] = []
    tokens = list(_TOKEN.finditer(page or ""))
    known = False

    def flush() -> None:
        if held:
            words = links = 0
            for text, linked in held:
                n = len(text.split())
                words, links = words + n, links + n * linked
            if text := " ".join("".join(t for t, _ in held).split()):
                words = max(1, len(text.split()))
                out.append([text, words, min(1.0, links / words), open_.place()])
            held.clear()

    for number, m in enumerate(tokens):
        text, tag = m["text"], m["tag"]
        if text is not None:
            held.append((html.unescape(text) if "&" in text else text, anchors > 0))
            continue
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("svg", "math", "canvas", "object", "iframe"):
                flush()
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if m["end"] else 1
            continue
        if tag == "br":
            held.append((" ", False))
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            anchors = 0
        if m["end"]:
            if inline and open_.by_name.get(tag):
                flush()
            open_.close(tag)
            continue
        more = m["more"]
        if more.endswith("/") and tag not in PARTS and tag not in HOLDERS:
            continue
        why = _part(tag, more, open_.count["article"] > 0)
        article = tag in ("article", "main") and why is None and not open_.count["comments"]
        if article and open_.count["part"]:
            # Parts that an end tag closes later are parts, and an article in one is a teaser. What else stands open was never closed.
            if not known:
                open_.know(closed(tokens))
                known = True
            article = not open_.in_ended
            if article:
                open_.cut()
        elif tag == "body":
            open_.cut()
        if why is not None or article or tag in PARTS or tag in HOLDERS and not inline and tag not in ("p", "li"):
            if inline:
                flush()
            open_.push(tag, why, article, number)
            some_article |= article
    flush()
    if not some_article:
        for block in out:
            if block[3] == OUTSIDE:
                block[3] = NO_ARTICLE
    return [tuple(x) for x in out]


def main_text(page: str | None) -> str:
    found, node = blocks(page), tree()
    return "\n".join(text for (text, *_), x in zip(found, features(found)) if classify(x, node))


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the columns in ``keep``, text, n_chars) for each row of ``pages``."""
    fields = [f for f in pages.schema.fields if f.name in (id_column, *keep)]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in texts(part, "__html")]
        columns = [part.column(part.schema.get_field_index(f.name)) for f in fields]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"
    return map_text(pages.select(*(f.name for f in fields), pages[html_column].alias("__html")), "__html", work, schema)
