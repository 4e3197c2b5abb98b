"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element begins a new line. Lines in elements that never hold the article (navigation, footers,
forms, asides, adverts, notices, comments) are set aside; where a class name leaves it open (social, share, side), lines that are no sentences are.
A line weighs as many characters as it has outside links, and nothing if most of it is links; the block at line i sums the weights of lines i to
i + WINDOW - 1. Tags are evidence, and change weights: a paragraph that ends as a sentence does weighs all its characters, links or
not; on a page that marks its article a line in it weighs SURGE at least, and other lines are no part of the distribution. A
stretch runs from a line with weight to where the sums dive to nothing. Text begins with the first stretch in which the sums surge above a
threshold and ends with the last: short stretches between belong to it, and lines that are mostly links where they stand within a stretch.
Stretches before and after are text if a line of theirs is the page's heading, ends as sentences do, or is a list item of some plain words;
there a line that only states a copyright isn't.

Tags are read as the HTML standard reads them. A tag that a quote leaves open to the page's end is taken to end at the next >.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import table

WINDOW, SURGE = 3, 40
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head noscript template svg math object iframe audio video canvas select button datalist".split())
VERBATIM = frozenset("script style textarea title xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside form menu dialog header".split())
WALLS = {
    "p": ("div", "article", "section", "td", "li", "blockquote", "main", "body"),
    "li": ("ul", "ol", "menu"),
    "tr": ("table",),
    "td": ("tr", "table"),
    "th": ("tr", "table"),
    "dt": ("dl",),
    "dd": ("dl",),
    "option": ("select",),
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A class or id sets its element aside if all its words, parted by hyphens, underscores or capitals, are of these two lists, and one of the first.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social comment comments commentlist discussion disqus feedback reply replies respond related recommended pagination pager toolbar skip copyright".split())
PLAIN_WORDS = frozenset("area article articles bar block body bottom box button buttons col column container content desktop fixed form global google group holder inner item items layer left legal link links list main mobile more outer page panel policy post posts primary right row secondary section site slot sticky text thread title to top unit us user wrap wrapper".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
SKIP, KEY, EQUALS, BARE, NAME = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*", r"[^\s/>]*"))
LEGAL = re.compile(r"\s*(?:©|\(c\)\s*\d{4}|copyright\s*(?:©|\(c\)|\d{4})|all rights reserved)", re.I)
#: Names that leave open whether an element holds text.
OPEN_WORDS = frozenset("social share sharing side".split())
#: Elements whose whole line counts if it ends as a sentence does.
PROSE = ("p", "blockquote", "pre", "dd")
CLOSE = {n: re.compile(rf"</{n}\s*(?:>|$)", re.I) for n in VERBATIM}


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    aside: bool
    unsure: bool  # in an element of an open name
    inside: bool  # the article
    head: bool  # the page's heading
    prose: bool
    item: bool  # of a list


def named(said: str) -> tuple[bool, bool]:
    """Whether one of the class names and ids in said sets its element aside, and whether one leaves it open."""
    unsure = False
    for token in said.split():
        words = {w.lower() for w in PARTS.findall(token)}
        if words & SIDE_WORDS and words <= SIDE_WORDS | PLAIN_WORDS:
            if words & SIDE_WORDS - OPEN_WORDS:
                return True, False
            unsure = True
    return False, unsure


def tag_at(page: str, at: int) -> tuple[int, str, dict[str, str], bool]:
    """Where the tag ends whose name begins at `at`, its name, its attributes, and whether it closes itself."""
    m = NAME.match(page, at)
    name, at, attributes, n = m[0].lower(), m.end(), {}, len(page)
    while True:
        begin, at = at, SKIP.match(page, at).end()
        if at >= n:
            return n, name, attributes, False
        if page[at] == ">":
            return at + 1, name, attributes, "/" in page[begin:at]
        m = KEY.match(page, at)
        key, at, value = m[0].lower(), m.end(), ""
        if e := EQUALS.match(page, at):
            at = e.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                stop = page.find(quote, at + 1)
                if stop < 0:
                    stop = page.find(">", at + 1)
                    if stop < 0:
                        return n, name, attributes, False
                    attributes.setdefault(key, page[at + 1 : stop])
                    return stop + 1, name, attributes, False
                value, at = page[at + 1 : stop], stop + 1
            else:
                m = BARE.match(page, at)
                value, at = m[0], m.end()
        attributes.setdefault(key, value)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, dict[str, str], bool]]:
    """(begin, end, whether it is an end tag, name, attributes, whether it closes itself) of each tag; comments and declarations have no name. A reader may send where to go on."""
    at = 0
    while (at := page.find("<", at)) >= 0:
        c = page[at + 1 : at + 2]
        close = c == "/"
        if c in ("!", "?") and c or close and not page[at + 2 : at + 3].isalpha():
            if page.startswith("<!--", at):
                short = next((e for e in ("<!-->", "<!--->") if page.startswith(e, at)), "")
                stop, size = (at, len(short)) if short else (page.find("-->", at + 4), 3)
            elif page.startswith("<![CDATA[", at):
                stop, size = page.find("]]>", at), 3
            elif close and at + 2 >= len(page):
                return
            else:
                stop, size = page.find(">", at), 1
            end = stop + size if stop >= 0 else len(page)
            sent = yield at, end, close, "", {}, False
        elif close or c.isalpha() and c.isascii():
            end, name, attributes, alone = tag_at(page, at + 1 + close)
            sent = yield at, end, close, name, attributes, alone
        else:
            at += 1
            continue
        at = sent or end


def lines(page: str) -> tuple[list[Line], bool]:
    """The lines of a page, and whether it marks an article."""
    out, parts, plain, at = [], [], 0, 0
    stack: list[tuple[str, bool, bool, bool]] = []  # element, set aside, unsure, in the article; of what is open
    there: Counter[str] = Counter()  # how often each element is open
    hidden = links = asides = unsures = articles = 0
    marked = False

    def end() -> None:
        nonlocal parts, plain
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, plain, asides > 0, unsures > 0, articles > 0, there["h1"] > 0, any(there[x] for x in PROSE), there["li"] > 0))
        parts, plain = [], 0

    def text(s: str) -> None:
        nonlocal plain
        if s and not hidden:
            s = html.unescape(s)
            parts.append(s)
            if not links:
                plain += sum(map(len, s.split()))

    def close(name: str) -> None:
        nonlocal hidden, links, asides, unsures, articles
        while there[name]:
            top, aside, unsure, article = stack.pop()
            there[top] -= 1
            hidden -= top in HIDDEN
            links -= top == "a"
            asides -= aside
            unsures -= unsure
            articles -= article
            if top == name:
                return

    reader, goto = tags(page), None
    while True:
        try:
            begin, stop, closing, name, attributes, alone = reader.send(goto)
        except StopIteration:
            break
        goto = None
        text(page[at:begin])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            end()
        if closing:
            close(name)
            continue
        if name in VERBATIM:
            m = CLOSE[name].search(page, at)
            at = goto = m.end() if m else len(page)
            continue
        if name in VOID:
            continue
        if name in WALLS and there[name]:  # an open one of its kind ends here
            for x, *_ in reversed(stack):
                if x == name:
                    close(name)
                if x == name or x in WALLS[name]:
                    break
        if name == "body":
            while there["head"]:
                close("head")
        said = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        by_name, unsure = (False, False) if name in ("html", "body", "article", "main") else named(said)
        aside = name in ASIDE and not (name == "header" and articles) or attributes.get("role", "").lower() in ROLES or by_name or name == "article" and bool(re.search(r"comment|repl(?:y|ies)", said, re.I))
        aside |= "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        article = name in ("article", "main") and not aside and not asides
        marked |= article
        stack.append((name, aside, unsure, article))
        there[name] += 1
        asides += aside
        unsures += unsure
        articles += article
        hidden += name in HIDDEN
        links += name == "a"
        if alone and name not in BLOCKS:
            close(name)
    text(page[at:])
    end()
    return out, marked


def sentence(x: Line) -> bool:
    return bool(SENTENCE.search(x.text))


def weight(x: Line, marked: bool) -> int:
    """Characters outside links, and what tags say for the line."""
    if marked:
        return max(len(x.text), SURGE)
    if x.prose and sentence(x):
        return len(x.text)
    return x.plain if 2 * x.plain >= len(x.text) else 0


def main_text(page: str | None) -> str:
    """The article of one page; empty for null, and for pages without text."""
    rows, marked = lines(page or "")
    rows = [x for x in rows if not x.aside and not (x.unsure and not (sentence(x) and 2 * x.plain >= len(x.text)))]
    marked = marked and any(x.plain and x.inside for x in rows)
    left = [x for x in rows if x.inside or not marked]
    weights = [weight(x, marked) for x in left]
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    block = [total[min(i + WINDOW, n)] - total[i] for i in range(n)]
    threshold = min(SURGE, max(block, default=0))
    found, i = [], 0  # stretches: first line, end, whether they surge
    while i < n:
        if not weights[i]:
            i += 1
            continue
        j = i
        while j < n and block[j]:  # until the dive
            j += 1
        found.append((i, j, any(weights[k] and block[k] >= threshold for k in range(i, j))))
        i = j
    surges = [k for k, x in enumerate(found) if x[2]]
    if not surges:
        return ""

    def kept(k: int) -> bool:
        """A line of an outer stretch."""
        return not LEGAL.match(left[k].text)

    def said(i: int, j: int) -> bool:
        return any(weights[k] and kept(k) and (left[k].head or sentence(left[k]) or left[k].item and left[k].text.count(" ") >= 2) for k in range(i, j))

    out = []
    for nth, (i, j, _) in enumerate(found):
        if nth == surges[-1] and not marked:  # what ends the page may state a copyright
            while j > i + 1 and LEGAL.match(left[j - 1].text):
                j -= 1
        if surges[0] <= nth <= surges[-1]:
            out += range(i, j)
        elif said(i, j):
            out += [k for k in range(i, j) if kept(k)]
    return " ".join(left[k].text for k in out)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. Null, empty and text-less html gives an empty text; rows that repeat a page_id have each a row; an empty table gives none; other columns are ignored."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
