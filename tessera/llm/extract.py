"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Words score positive and tags negative. The weights are log odds, counted on pages whose own markup names their content
(article, main, role=main, itemprop=articleBody): what lies inside against what lies outside. Class names and ids are
counted too: one that stands almost only outside marks a zone, one that stands mostly inside doesn't, whatever it is
called; ZONE_WORDS tell of names that weren't seen. Zones (menus, footers, asides, forms, adverts, notices, reader
comments) count as one tag. A linear scan finds the best contiguous region; it then grows to the named element around
it, or, where no markup names content, over its neighbours in the element that holds it. A container that holds the
page's content is no zone, whatever it is called: neither one around the largest named element, nor, where no markup
names content, one around most words.

Defined results: a null or empty page, or one without words outside such zones, has the empty text; an unclosed comment,
script or style runs to the page's end, an unclosed tag is text up to the next one; equal rows give equal results; a
null page_id is given back; an empty table gives no rows; other columns are ignored. Time is linear in a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
SPACED = frozenset("br td th option wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes object canvas".split())
ZONES = frozenset("nav footer aside form menu head button select dialog".split())
HOLDERS = frozenset("article main section div header footer nav aside form ul ol dl table menu figure fieldset details dialog head body html button select blockquote span p li a td th".split())
# Zones by their meaning in HTML, which hold a page's content only if a named element lies in them.
NEVER = frozenset("nav footer menu head button select".split())
# Containers whose class, id or role may mark a zone; headings, paragraphs, list items and inline elements don't.
BOXES = frozenset("div section header ul ol dl fieldset details center".split())
#: Elements that don't end what is told in an element: they weigh nothing.
TABLES = frozenset("table caption thead tbody tfoot tr td th figure figcaption".split())
# Elements that hold blocks.
CONTAINERS = frozenset("div section article main body html td th form aside header footer nav fieldset details center".split()) | {""}
# Words of a class, id or role that mark a zone.
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip complementary contentinfo".split()
)
# Words that a zone's name may have beside one of those, such as related-posts; in others (has-sidebar,
# no-comments, related-work) the word says something else.
BESIDE = frozenset("area bar block blocks bottom box buttons col column container entry form global inner item items left links list main message outer page panel post posts primary right row secondary section site slot space top unit user wrap wrapper".split())

# Of those, words that inside an article mark a zone only if most of its words are links.
SOFT_WORDS = frozenset("banner notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead related recommended login signup search pagination pager widget toolbar skip complementary contentinfo popup modal overlay".split())

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
# How a notice of rights begins or ends.
_RIGHTS = re.compile(r"\s*(?:\u00a9|\(c\)\s|copyright\s+(?:\u00a9|\(c\)|\d{4}))|all rights reserved\W*$", re.I)
#: Words of a notice at most.
RIGHTS_WORDS = 40
_MARKS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Weights where no page names its content; learned ones replace those that were seen.
PRIOR = {"w:p": 1.0, "w:h": 1.0, "w:other": 0.5, "w:link": 0.05, "t:p": -0.2, "t:h": -0.2, "t:inline": -0.1, "t:link": -1.5, "t:list": -0.4, "t:box": -1.0, "t:zone": -1.0, "t:other": -0.5, "t:none": 0.0, "w:out": -1.0, "w:rights": -1.0}
#: Features whose weight is fixed.
FIXED = frozenset(("t:none", "w:out", "w:rights"))
#: Times that a class name or id must be seen to tell a zone, and its log odds then.
LEAST_SEEN, ZONE_ODDS = 20, -3.0
#: Pages (of least hash) whose markup is counted for the weights.
SAMPLE_PAGES = 2000


def _kind(tag: str) -> str:
    if tag in ("p", "blockquote", "pre"):
        return "p"
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "h"
    if tag == "a":
        return "link"
    if tag in VOID or tag in TABLES:
        return "none"
    if tag in ("li", "ul", "ol", "dl", "dt", "dd"):
        return "list"
    if tag in ("b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "code", "q", "cite", "font"):
        return "inline"
    return "box" if tag in ("div", "section", "article", "main") else "other"


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name or text, attributes, is closing) of a page; raw elements give their tag alone."""
    p, begun, n, last = 0, 0, len(page), page.rfind(">")
    while (m := _OPEN.search(page, p)) is not None:
        at, name = m.start(), ""
        if m.group() == "<!--":
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif m.group()[1] in "!?":
            end = page.find(">", at)
            end = n if end < 0 else end + 1
        elif at > last:  # no tag ends any more
            break
        else:
            found = _NAME.match(page, at)
            name, rest = found.group(1).lower(), found.end()
            quoted = _ATTRIBUTES.match(page, rest)
            end = quoted.end() if quoted else page.find(">", rest) + 1
            if not end:  # the last one was in the name's quotes
                break
            attributes = page[rest : end - 1]
        if at > begun:
            yield "text", page[begun:at], "", False
        p = begun = end
        if not name:
            continue
        closing = page[at + 1] == "/"
        yield "tag", name, attributes, closing
        if name in RAW and not closing:
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, p)
            p = begun = over.end() if over else n
            yield "tag", name, "", True
    if begun < n:
        yield "text", page[begun:], "", False


def _names(attributes: str) -> set[str]:
    return {x[:40] for m in _MARKS.finditer(attributes) for x in (m.group(1) or m.group(2) or m.group(3) or "").lower().split()}


def _marks_zone(name: str) -> bool:
    """Whether a whole class name, id or role is made of zone words and words that go with them."""
    parts = [x for x in _SPLIT.split(name) if x and not x[0].isdigit()]
    return not ZONE_WORDS.isdisjoint(parts) and all(x in ZONE_WORDS or x in BESIDE for x in parts)


def _zone(tag: str, names: set[str], inside: bool, weight: dict[str, float]) -> bool:
    if tag in ZONES or tag == "header" and not inside:
        return True
    if tag not in BOXES:
        return False
    return any(weight["c:" + x] <= ZONE_ODDS if "c:" + x in weight else _marks_zone(x) for x in names)


def _named(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", attributes, re.I))


class Element:
    """An open or closed element; `words` are those outside links and outside zones within it; lo and hi are the entries
    of the page that it spans."""

    __slots__ = ("parent", "tag", "at", "candidate", "named", "never", "zones", "inside", "article", "link", "holder", "paragraph", "words", "names", "lo", "hi")

    def __init__(self, parent: Element | None, tag: str, attributes: str, lo: int, weight: dict[str, float]):
        kind = _kind(tag)
        self.parent, self.tag, self.words, self.zones = parent, tag, 0, False
        self.lo, self.hi = lo, -1
        self.at = parent.at + 1 if parent else 0
        self.named = _named(tag, attributes)
        self.names = _names(attributes) if attributes and tag in BOXES else set()
        self.candidate = not self.named and _zone(tag, self.names, parent is not None and parent.inside, weight)
        self.never = tag in NEVER or parent is not None and parent.never
        self.inside = self.named or parent is not None and parent.inside
        self.article = self.named and tag != "main" or parent is not None and parent.article
        self.link = tag == "a" or parent is not None and parent.link
        self.holder = kind if kind in ("p", "h") else "other" if parent is None or tag in BLOCKS else parent.holder
        # the open paragraph that a block's start closes
        self.paragraph: Element | None = self if tag == "p" else None if parent is None or tag in ("button", "table") else parent.paragraph

    @property
    def soft(self) -> bool:
        """A zone inside an article by its name alone, and that name may well be content's."""
        return self.article and self.candidate and self.tag not in ZONES and all(x in SOFT_WORDS or x in BESIDE for n in self.names for x in _SPLIT.split(n) if x in ZONE_WORDS or x in BESIDE)

    def up(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


def _count(elements: list[Element], texts: list[tuple[Element, int]]) -> None:
    for e in elements:
        e.words = 0
    for e, n in texts:
        e.words += n
    for e in reversed(elements):
        if e.parent is not None and not e.candidate:
            e.parent.words += e.words


def _settle(elements: list[Element], texts: list[tuple[Element, int]]) -> None:
    """Take back zones that hold the page's content, then mark what lies in the others."""

    def mark() -> None:
        for e in elements:
            e.zones = e.candidate or e.parent is not None and e.parent.zones

    mark()
    if any(e.candidate for e in elements):
        _count(elements, texts)
        free = max((e.words for e in elements if e.named and not e.zones), default=0)
        held = [e for e in elements if e.named and e.zones and e.words > free]
        for e in held:
            while e is not None and e.zones:
                e.candidate, e.zones, e = False, False, e.parent
        if held:
            mark()
            _count(elements, texts)
        if not any(e.named and not e.zones and e.words for e in elements):
            most = max((e for e in elements if e.candidate), key=lambda e: e.words if not e.never else 0, default=None)
            if most is not None and not most.never and most.words > elements[0].words:
                for e in most.up():
                    e.candidate = False
                mark()


def _spare(elements: list[Element], out: list[tuple[str, str, Element, Element]]) -> None:
    """Soft zones whose words are mostly no links are content."""
    soft = [e for e in elements if e.soft]
    if not soft:
        return
    free, all_ = [0], [0]
    for kind, text, e, _ in out:
        n = len(text.split()) if kind == "text" else 0
        all_.append(all_[-1] + n)
        free.append(free[-1] + (0 if e.link else n))
    for e in soft:
        if 2 * (free[e.hi] - free[e.lo]) >= all_[e.hi] - all_[e.lo]:
            e.candidate = False


def parse(page: str, weight: dict[str, float] = PRIOR) -> tuple[list[tuple[str, str, Element, Element]], list[Element]]:
    """(kind, name or text, innermost element, element around it if it begins here, else the same) of a page in order,
    and its elements."""
    top = Element(None, "", "", 0, weight)
    elements, out, texts = [top], [], []
    stack, open_ = [top], Counter()

    def close(upto: int) -> None:
        for e in stack[upto:]:
            e.hi = len(out)
            open_[e.tag] -= 1
        del stack[upto:]

    for kind, name, attributes, closing in tokens(page):
        e = stack[-1]
        if kind == "text":
            text = html.unescape(name)
            if not e.link:
                texts.append((e, len(text.split())))
            out.append((kind, text, e, e))
            continue
        if name in VOID or name not in HOLDERS and name not in BLOCKS:
            out.append(("void", name, e, e))
            continue
        if closing:
            if open_[name]:
                i = len(stack) - 1
                while stack[i].tag != name:
                    i -= 1
                close(i)
            out.append(("tag", name, stack[-1], stack[-1]))
            continue
        if e.tag == "head" and name not in RAW:  # closed by what can't stand in it
            close(len(stack) - 1)
        elif name in BLOCKS and e.paragraph is not None:  # closed by any block
            close(e.paragraph.at)
        if name in ("td", "th", "tr") and stack[-1].tag in ("td", "th"):  # closed by its follower
            close(len(stack) - 1)
        if name in ("li", "dt", "dd", "tr") and stack[-1].tag == name:
            close(len(stack) - 1)
        around = stack[-1]
        stack.append(Element(around, name, attributes, len(out), weight))
        open_[name] += 1
        elements.append(stack[-1])
        out.append(("tag", name, stack[-1], around))
    close(0)
    _spare(elements, out)
    _settle(elements, texts)
    return out, elements


def items(out: list[tuple[str, str, Element, Element]], elements: list[Element]) -> list[tuple[str | None, int, str | None, bool]]:
    """(feature, words, text, inside named content) of each entry of a page; a block's break has text None; a zone counts
    as a single tag, however long, and its other entries have no feature."""
    found: list[tuple[str | None, int, str | None, bool]] = []
    named = any(e.named and not e.zones and e.words for e in elements)
    for kind, name, e, around in out:
        if e.zones:
            begins = e is not around and not around.zones
            found.append(("t:zone" if begins else None, 0, None, around.inside))
        elif kind == "text":
            words = name.split()
            rights = not e.inside and len(words) <= RIGHTS_WORDS and _RIGHTS.search(" ".join(words)) is not None
            where = "out" if named and not e.inside else "rights" if rights else "link" if e.link else e.holder
            found.append(("w:" + where, len(words), name, e.inside))
        elif kind == "void":
            found.append(("t:" + _kind(name), 0, "" if name not in SPACED and name not in BLOCKS else " " if name in SPACED else None, e.inside))
        else:
            found.append(("t:" + _kind(name), 0, "" if name in ("a", "span") else " " if name in ("td", "th") else None, e.inside))
    return found


def counts(page: str) -> Counter:
    """(feature, inside) -> words, tags or elements of that name, of a page whose markup names its content; else nothing."""
    found: Counter = Counter()
    out, elements = parse(page)
    for (kind, text, e, _), (feature, words, _, inside) in zip(out, items(out, elements)):
        if feature is not None and feature not in FIXED:
            found[feature, inside] += words if feature[0] == "w" else 1
        elif feature == "w:out":
            found["w:" + ("link" if e.link else e.holder), inside] += words
    if not any(i for _, i in found):
        return Counter()
    around = {up for e in elements if e.named for up in e.up()}
    for e in elements:
        if e.names and (e.inside or e not in around):
            for x in e.names:
                found["c:" + x, e.inside] += 1
    return found


def weights(found: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each feature, words at least 0.05 and at most 1, tags at least -4 and at most -0.1;
    a zone at least -1, since it may stand in the middle of an article."""
    out = dict(PRIOR)
    totals = {(k, i): sum(v for (f, j), v in found.items() if f[0] == k and j is i) for k in "wt" for i in (True, False)}
    for feature in {f for f, _ in found}:
        k, yes, no = feature[0], found.get((feature, True), 0), found.get((feature, False), 0)
        if k == "c":
            if yes + no >= LEAST_SEEN:
                out[feature] = math.log((yes + 0.5) / (no + 0.5))
        elif feature not in FIXED and totals[k, True] and totals[k, False]:
            odds = math.log((yes + 1) / (totals[k, True] + 1)) - math.log((no + 1) / (totals[k, False] + 1))
            out[feature] = min(1.0, max(0.05, odds)) if k == "w" else max(-1.0 if feature == "t:zone" else -4.0, min(-0.1, odds))
    return out


def best_region(scores: Sequence[float]) -> tuple[int, int]:
    """The contiguous part [a, b) of greatest sum, the first one that ends there; (0, 0) if no sum is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total > best:
            best, span = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    return span


def _grown(a: int, b: int, out: list[tuple[str, str, Element, Element]], row: list[tuple[str | None, int, str | None, bool]]) -> tuple[int, int]:
    """The region grown to the named element around it, or over its neighbours in the element that holds it."""
    holder, end = out[a][2], out[b - 1][2]
    while not (holder.lo <= a and b <= holder.hi and end.at >= holder.at):
        holder = holder.parent
    for e in holder.up():
        if e.named:
            return e.lo, e.hi
    while holder.parent is not None and holder.tag not in CONTAINERS:
        holder = holder.parent
    outer = holder.tag in ("", "html", "body")
    units: list[tuple[int, int, bool]] = []  # children of the holder: their entries, and whether they look like content
    i = holder.lo
    while i < holder.hi:
        e = out[i][2]
        while e is not holder and e.parent is not holder and e.at > holder.at:
            e = e.parent
        if e is holder or e.parent is not holder:
            f, words, text, _ = row[i]
            units.append((i, i + 1, f is None or f[0] == "t" and f != "t:zone" or f[0] == "w" and (not words or not outer and f != "w:rights")))
            i += 1
            continue
        link = sum(n for f, n, _, _ in row[e.lo : e.hi] if f == "w:link")
        rights = any(f == "w:rights" for f, _, _, _ in row[e.lo : e.hi])
        free = sum(n for f, n, _, _ in row[e.lo : e.hi] if f and f[0] == "w" and f != "w:link")
        fit = not e.zones and not rights and free >= link and not (outer and e.tag in CONTAINERS)
        units.append((e.lo, max(e.hi, e.lo + 1), fit or e.zones and holder.parent is not None and not outer))
        i = max(e.hi, e.lo + 1)
    for lo, _, fit in reversed([u for u in units if u[0] < a]):
        if not fit:
            break
        a = min(a, lo)
    for lo, hi, fit in units:
        if hi > b and lo >= a:
            if lo >= b and not fit:
                break
            b = max(b, hi)
    return a, b


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The blocks of the best region, joined by two newlines."""
    if not page:
        return ""
    out, elements = parse(page, weight)
    row = items(out, elements)
    a, b = best_region([0.0 if f is None else weight.get(f, -0.5) * (n if f[0] == "w" else 1) for f, n, _, _ in row])
    if a == b:
        return ""
    a, b = _grown(a, b, out, row)
    cell = lambda i: out[i][0] == "tag" and out[i][1] in ("td", "th")
    while a > 0 and row[a - 1][2] is not None and not cell(a - 1):
        a -= 1
    while b < len(row) and row[b][2] is not None and not cell(b):
        b += 1
    blocks, block = [], []
    for _, _, text, _ in [*row[a:b], ("", 0, None, False)]:
        if text is not None:
            block.append(text)
        elif block:
            if joined := " ".join("".join(block).split()):
                blocks.append(joined)
            block = []
    return "\n\n".join(blocks)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most sample_pages pages; counts of a fixed set of features reach the driver, no pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for page in batch.column(0).to_pylist():
                found.update(counts(page or ""))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found]), pa.array([i for _, i in found]), pa.array(list(found.values()), pa.int64())], ["feature", "inside", "n"])

    ids = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).distinct()
    rows = pages.join(F.broadcast(ids), "page_id", "left_semi").select("html").mapInArrow(run, "feature string, inside boolean, n long")
    # names are of the pages' own making; those too rare to count stay where they are
    found = rows.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("yes"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("no"))
    found = found.filter(~F.col("feature").startswith("c:") | (F.coalesce("yes", F.lit(0)) + F.coalesce("no", F.lit(0)) >= LEAST_SEEN)).collect()
    return weights({(r["feature"], i): r["yes" if i else "no"] for r in found for i in (True, False) if r["yes" if i else "no"] is not None})


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tune(pages.sparkSession, 500)
    weight = learn(pages, sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(page, weight) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
