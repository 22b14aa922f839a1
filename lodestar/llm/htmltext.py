"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbourhood."""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import mapped

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: From a tag's name to its end; nothing is tried twice, so a stray quote costs one pass.
TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content is never text of the page.
UNSEEN = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "select", "svg", "math", "object",
          "noembed", "noframes", "xmp", "video", "audio", "canvas", "datalist", "button"}
#: Of these, what may close itself, and what holds no markup.
FOREIGN = {"svg", "math"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements that part text without any effect on it; all others part blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input",
          "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd"}
CONTENT = {"article", "main"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words of class, id or role names that mark what surrounds a text.
AROUND = {"ad", "ads", "adbox", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie",
          "cookies", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
          "overlay", "pager", "pagination", "popup", "promo", "promotion", "related", "recommended", "search", "share", "sharing", "sidebar",
          "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}
REMARKS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
#: Words that name a place or a form of what such a word names.
PLACES = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "content", "desktop", "fixed", "form", "icons", "inner",
          "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary",
          "section", "site", "slot", "sticky", "thread", "top", "unit", "wrap", "wrapper"}


@dataclass
class Block:
    """A run of text between block borders."""

    text: str
    words: int
    link_density: float
    inside: bool  # in an article or main element
    boiler: bool  # in a boilerplate element inside the innermost article, or outside any
    around: int  # named as what surrounds a text: 2, or 1 if the name has other words too
    remark: int  # reader comments, likewise
    heading: bool
    paragraph: bool


@cache
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)


def named(attributes: str, words: set[str]) -> int:
    """2 if a class, id, role or label is one of ``words``, alone or with words for places; 1 if it has one among others."""
    most = 0
    for groups in NAMES.findall(attributes):
        for token in "".join(groups).split():
            parts = WORD.findall(CAMEL.sub(" ", token).lower())
            if not words.isdisjoint(parts):
                most = max(most, 2 if all(p in words or p in AROUND or p in PLACES for p in parts) else 1)
    return most


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag, attributes) in page order; a tag is its lower-case name, led by / if it closes.

    One pass: every search starts behind the last, and what was not found once is not looked
    for again. Comments and declarations without an end stop at the next >, a cut-off tag
    at the end of the page. Elements without text of the page are passed over up to their
    closing tag; one without it loses no more than the text up to the next tag.
    """
    begin = at = 0
    missing: set[str] = set()
    parts: list[str] = []

    def end_of(mark: str, start: int) -> int:
        if mark not in missing:
            found = page.find(mark, start)
            if found >= 0:
                return found + len(mark)
            missing.add(mark)
        return -1

    while (at := page.find("<", at)) >= 0:
        close = page.startswith("/", at + 1)
        name = NAME.match(page, at + 1 + close)
        if not name:
            if page.startswith("<![CDATA[", at) and (stop := end_of("]]>", at)) > 0:
                parts += [page[begin:at], page[at + 9: stop - 3].replace("&", "&amp;")]
            elif page.startswith("<!", at) or page.startswith("<?", at) or close:
                stop = end_of("-->", at + 4) if page.startswith("<!--", at) else -1
                stop = stop if stop > 0 else end_of(">", at) if end_of(">", at) > 0 else len(page)
                parts.append(page[begin:at])
            else:
                at += 1  # a sign, not a tag
                continue
            begin = at = stop
            continue
        tag, start = name[0].lower(), name.end()
        whole = TAG_END.match(page, start)
        stop = whole.end() if whole else end_of(">", start)
        stop = stop if stop > 0 else len(page)
        attributes = page[start: stop - 1]
        parts.append(page[begin:at])
        if tag in UNSEEN and not close:
            if attributes.endswith("/") and tag in FOREIGN:
                parts.append(" ")
            elif f"</{tag}" not in missing and (over := closing(tag).search(page, stop)):
                stop = over.end()
                parts.append(" ")
            else:
                missing.add(f"</{tag}")
                parts.append(" ")
                if tag in RAW:
                    over = page.find("<", stop)
                    stop = over if over >= 0 else len(page)
            begin = at = stop
            continue
        yield "".join(parts), "/" + tag if close else tag, attributes
        parts.clear()
        begin = at = stop
    parts.append(page[begin:])
    yield "".join(parts), "", ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, markup resolved as far as open tags allow."""
    found: list[Block] = []
    stack: list[tuple] = [("", False, False, 0, 0)]  # name, inside, boiler, around, remark
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    plain = (0, 0, False, False)
    leaf = plain  # around, remark, heading and paragraph of the open leaf

    def flush() -> None:
        if text:
            raw = "".join(text)
            words = (entities.unescape(raw) if "&" in raw else raw).split()
            if words:
                n_linked = len("".join(linked).split()) if linked else 0
                _, inside, boiler, around, remark = stack[-1]
                found.append(Block(" ".join(words), len(words), min(1.0, n_linked / len(words)),
                                   inside, boiler, max(around, leaf[0]), max(remark, leaf[1]), leaf[2], leaf[3]))
            text.clear()
            linked.clear()

    for before, tag, attributes in markup(page):
        if before:
            text.append(before)
            if in_link:
                linked.append(before)
        name = tag.removeprefix("/")
        if name in INLINE:
            if name == "a":
                in_link = tag == "a"
            elif name == "br":
                text.append(" ")
            continue
        flush()
        in_link, leaf = False, plain
        if tag.startswith("/"):
            while opened[name]:  # an element that is not open closes nothing
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    break
            continue
        around, remark = (named(attributes, AROUND), named(attributes, REMARKS)) if attributes else (0, 0)
        if name in LEAVES:
            leaf = (around, remark, name in HEADINGS, name not in HEADINGS)
        elif name not in VOID and name not in ("", "html", "body", "head"):
            _, p_inside, p_boiler, p_around, p_remark = stack[-1]
            if name in CONTENT:
                stack.append((name, True, False, p_around // 2, max(remark, p_remark)))
            else:
                stack.append((name, p_inside, p_boiler or name in BOILER, max(around, p_around), max(remark, p_remark)))
            opened[name] += 1
    return found


#: The labelled table: words, link density, words and link density of the block before and of the
#: one after, where (2 inside the page's article, 1 the page has none, 0 outside it), boilerplate
#: element, surrounding name, reader comment, heading, paragraph; then 1 for main text.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "where", "boiler", "around", "remark",
            "heading", "paragraph")
LABELLED = """
60 0.00   9 0.00  45 0.00  2 0 0 0 0 1  1
45 0.05  60 0.00  80 0.10  2 0 0 0 0 1  1
 1 0.00  30 0.00  52 0.00  2 0 0 0 0 1  1
 2 0.00   1 0.00   1 0.00  2 0 0 0 0 1  1
 1 0.00   1 0.00   6 0.00  2 0 0 0 0 1  1
 9 0.00   6 0.00  60 0.00  2 0 0 0 1 0  1
11 0.00   1 1.00  24 0.00  2 0 0 0 1 0  1
 5 1.00  40 0.00  38 0.00  2 0 0 0 0 1  1
 7 0.60  25 0.10   0 0.00  2 0 0 0 0 1  1
30 0.30  12 0.00   5 0.00  2 0 0 0 0 1  1
55 0.00  20 0.00   2 1.00  2 0 0 0 0 1  1
14 0.00   3 1.00   4 1.00  2 0 0 0 0 1  1
 2 0.00   1 1.00   1 1.00  2 0 0 0 0 1  1
 4 0.00  20 0.00   3 1.00  2 0 0 0 0 1  1
90 0.01   2 1.00   1 1.00  2 0 0 0 0 1  1
 6 0.00   1 1.00   2 1.00  2 0 0 0 1 0  1
 1 0.00  22 0.00   6 0.80  2 0 0 0 0 1  1
 3 1.00   2 1.00   2 1.00  2 0 0 0 0 1  0
11 0.00  30 0.00   1 1.00  2 0 0 0 0 1  1
 4 0.00  70 0.00   6 0.00  2 0 0 0 0 1  1
 8 0.00   3 1.00  90 0.00  2 1 0 0 1 0  1
 3 0.00   1 1.00  12 0.00  2 1 0 0 1 0  1
 1 0.00  20 0.00   4 0.00  2 1 0 0 1 0  1
15 0.00   2 1.00   3 1.00  2 1 0 0 1 0  1
 3 0.00   8 0.00  90 0.00  2 1 0 0 0 1  0
 6 1.00  40 0.00   6 1.00  2 1 0 0 0 1  0
22 0.00  44 0.00   2 0.00  2 1 0 0 0 1  0
12 0.00  50 0.00  61 0.00  2 0 2 0 0 1  0
 5 0.00  33 0.00  47 0.00  2 0 2 0 0 1  0
40 0.10  33 0.00  47 0.00  2 0 2 0 0 1  0
 3 0.00  33 0.00  20 0.00  2 0 2 0 1 0  0
25 0.00  70 0.00  31 0.00  2 0 0 2 0 1  0
80 0.00  25 0.00   9 0.00  2 0 0 2 0 1  0
 2 0.00  60 0.00  25 0.00  2 0 0 2 1 0  0
 1 1.00   0 0.00   1 1.00  0 1 0 0 0 1  0
 2 1.00   1 1.00   8 0.00  0 1 0 0 0 1  0
 8 0.00   1 1.00   9 0.00  0 0 2 0 0 1  0
30 0.00   9 0.00  11 0.00  0 0 2 0 0 1  0
12 0.00  55 0.00   0 0.00  0 1 0 0 0 1  0
65 0.02  55 0.00   0 0.00  0 1 0 0 0 1  0
 6 0.00  55 0.00   0 0.00  0 0 0 0 0 1  0
50 0.00   4 0.00  70 0.00  0 0 0 0 0 1  0
 9 0.00   2 1.00  30 0.00  0 0 0 0 1 0  0
40 0.00  30 0.00   9 0.00  0 0 0 2 0 1  0
75 0.00  10 0.00  64 0.00  1 0 0 0 0 1  1
40 0.10  75 0.00  20 0.00  1 0 0 0 0 1  1
25 0.05  40 0.00   3 0.00  1 0 0 0 0 1  1
 9 0.00  60 0.00  48 0.00  1 0 0 0 0 1  1
 3 0.00  45 0.00  33 0.00  1 0 0 0 0 1  1
 8 0.00   1 1.00  70 0.00  1 0 0 0 1 0  1
14 0.00   8 0.00  33 0.00  1 0 0 0 0 1  1
18 0.00  14 0.00  12 0.00  1 0 0 0 0 1  1
50 0.00  30 0.00   2 1.00  1 0 0 0 0 1  1
35 0.00   2 1.00   3 1.00  1 0 0 0 0 1  1
16 0.05  40 0.00   1 1.00  1 0 0 0 0 1  1
 4 1.00   4 1.00   3 1.00  1 0 0 0 0 1  0
 3 1.00  50 0.00   4 1.00  1 0 0 0 0 1  0
12 0.90   4 1.00   9 0.80  1 0 0 0 0 1  0
 6 0.00   4 1.00   3 1.00  1 0 0 0 0 0  0
 3 0.00   2 1.00   2 0.00  1 0 0 0 0 0  0
 5 0.00   3 1.00   0 0.00  1 0 0 0 0 0  0
 7 0.50   5 0.50   0 0.00  1 0 0 0 0 1  0
30 0.00  50 0.00  12 0.00  1 1 0 0 0 1  0
 2 1.00   2 1.00   2 1.00  1 1 0 0 0 1  0
 9 0.00   2 1.00  44 0.00  1 1 0 0 1 0  0
28 0.00  60 0.00  40 0.00  1 0 2 0 0 1  0
 6 0.00  60 0.00  40 0.00  1 0 2 0 1 0  0
45 0.00  60 0.00  40 0.00  1 0 0 2 0 1  0
 4 0.00  50 0.00  45 0.00  1 0 0 2 1 0  0
30 0.00  20 0.00  40 0.00  2 0 1 0 0 1  1
12 0.00  40 0.00  12 0.00  2 0 1 0 0 1  1
25 0.10   6 0.00   8 0.00  2 0 1 0 0 0  1
 5 0.00  40 0.00  33 0.00  2 0 1 0 0 0  0
 3 1.00   3 1.00   4 1.00  2 0 1 0 0 1  0
 9 0.90  30 0.00  25 0.00  2 0 1 0 0 1  0
28 0.00  35 0.00  22 0.00  2 0 0 1 0 1  1
 4 0.00  50 0.00  18 0.00  2 0 0 1 0 0  0
30 0.00  20 0.00  40 0.00  1 0 1 0 0 1  1
 4 0.00  20 0.00  40 0.00  1 0 1 0 0 0  0
 5 0.90  20 0.00   6 0.90  1 0 1 0 0 1  0
 4 0.00   0 0.00   3 0.00  1 0 0 0 0 1  1
 3 0.00   4 0.00   5 0.00  1 0 0 0 0 1  1
 5 0.00   3 0.00   0 0.00  1 0 0 0 0 1  1
 2 0.00   5 0.00   4 0.00  1 0 0 0 0 1  1
 2 0.00   3 1.00   4 1.00  1 0 0 0 0 1  0
 4 0.00   2 1.00   2 1.00  1 0 0 0 0 1  0
 3 0.00   2 1.00   0 0.00  1 0 0 0 0 0  0
 4 1.00  40 0.00   3 1.00  2 0 0 0 0 1  0
 4 1.00   3 1.00  40 0.00  2 0 0 0 0 1  0
 2 1.00   4 1.00   5 1.00  2 0 0 0 0 1  0
 4 1.00  40 0.00  12 0.00  2 0 0 0 0 1  1
 8 0.40   3 1.00  30 0.00  2 0 0 0 0 1  1
"""

#: Blocks of every length and link density beside every kind of neighbour: (words, link density).
LENGTHS, DENSITIES, NEIGHBOURS = (1, 4, 12, 60), (0.0, 0.4, 1.0), ((0, 0.0), (2, 1.0), (5, 0.0), (40, 0.0))


def labelled() -> list[tuple[list[float], int]]:
    """The table, and unnamed blocks in all combinations of lengths and link densities.

    Inside an article a linked block next to another one belongs to a list of links, any
    other is main text; of a vague surrounding name, just what is long and not linked. In a
    page without an article paragraphs are main text unless linked or among links, other
    blocks if they are long or next to a long one. Nothing is outside of an article, or in
    boilerplate elements, or of a plainly surrounding name.
    """
    rows = [[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()]
    table = [(r[:-1], int(r[-1])) for r in rows]
    for words, density, before, after, paragraph in itertools.product(LENGTHS, DENSITIES, NEIGHBOURS, NEIGHBOURS, (0, 1)):
        x, linked = [words, density, *before, *after], [d == 1.0 for d in (density, before[1], after[1])]
        longest = max(w for w, d in ((words, density), before, after) if d < 1.0) if not all(linked) else 0
        table.append((x + [2, 0, 0, 0, 0, paragraph], int(not (linked[0] and (linked[1] or linked[2])))))
        table.append((x + [0, 0, 0, 0, 0, paragraph], 0))
        table += [(x + [2, 0, *flag, 0, paragraph], int(words >= 12 and density < 1.0)) for flag in ((1, 0), (0, 1))]
        table += [(x + [where, *flags, 0, paragraph], 0) for where in (1, 2) for flags in ((1, 0, 0), (0, 2, 0), (0, 0, 2))]
        table.append((x + [1, 0, 0, 0, 0, paragraph], int(not linked[0] and (longest >= 12 or bool(paragraph) and not (linked[1] or linked[2])))))
    return table


def grow(rows: list[tuple[list[float], int]], depth: int = 14):
    """A decision tree by Gini impurity: a label, or (feature, threshold, at most, above)."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part):
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for k in range(len(rows[0][0])):
        values = sorted({x[k] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[0][k] <= cut], [r for r in rows if r[0][k] > cut]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = cost, k, cut, low, high
    if best is None:
        return int(2 * ones >= len(rows))
    _, k, cut, low, high = best
    return k, cut, grow(low, depth - 1), grow(high, depth - 1)


@cache
def tree():
    return grow(labelled())


def judge(node, x: list[float]) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for main text, one per line."""
    found = blocks(page or "")
    has = any(b.inside for b in found)
    model = tree()
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        x = [b.words, b.link_density, before.words if before else 0, before.link_density if before else 0.0,
             after.words if after else 0, after.link_density if after else 0.0,
             2 if b.inside else 0 if has else 1, b.boiler, b.around, b.remark, b.heading, b.paragraph]
        if judge(model, x):
            kept.append(b.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Null or empty html, or a page without main text: an empty text. Pages cut off inside
    a tag, a comment or an entity give what stands before. Each page is read on its own:
    no shuffle, and memory for one Arrow batch.
    """

    def read(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b["html"]]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"].cast(pa.int64()), b["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), read, "page_id long, url string, text string, n_chars long")
