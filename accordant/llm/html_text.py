"""Main text of web pages by text-to-tag ratios.

The standard library's parser is read as a stream of events. Block tags end a line, so a line is a block of the page
with its text, its number of tags and the section that it stands in. Its ratio is characters of text over tags; lines
of boilerplate have none. Ratios are smoothed with a Gaussian over neighbouring lines and clustered in two groups by the
threshold halfway between their means (two-means). The region is the lowest section around all lines above it, widened to
the next one around it as long as no line that it adds has less than half the mean ratio. If article or main elements hold
most of the lines of half the mean ratio and more, it is the lowest article or main around all of these there, else each
one's outermost. All lines of a region that are not boilerplate are the text, short ones too.
Tags and class words are a prior: on the given pages without them the ratios
find three articles of four to the letter, equal ratios none (`test_ratios_find_the_article_without_names`).

Boilerplate is named by tag (NOISE, and header outside an article), by `hidden`, or by a word of class, id or role (MARKS):
of any block outside an article or main, inside one only of containers (CONTAINER), never of words within a line. Outside
articles, lines that are links only count as menus, too.

Defined cases: null html is empty and gives an empty text; pages are independent rows, so repeats and ties have no
influence; unclosed tags end with their parents; broken declarations are comments, and an unfinished one at the end of a
page is dropped; pages of any length and depth are parsed whole; further columns are
ignored; an empty table gives no rows. Time grows with a page's length, whatever the depth of its tags.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import over_texts, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SECTION = frozenset("article main section div td body html blockquote".split())
NOISE = frozenset("nav footer aside form head title script style noscript template svg math button select textarea iframe object canvas dialog menu".split())
#: Blocks that hold other blocks: only these are boilerplate by class inside an article.
CONTAINER = frozenset("div section ul ol dl table figure details fieldset".split())
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus feedback "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
WHOLE = frozenset("html body article main".split())
PARTS = re.compile(r"[^a-z0-9]+")
SITE = re.compile(r"^(site|page)[-_]+")


class Lines(HTMLParser):
    """Collects lines as [texts, tags, section, boilerplate, characters inside links].

    Sections are numbered as they open, so those inside section s are s .. last[s].
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, section, boilerplate, in an article
        self.open: Counter = Counter()
        self.lines, self.links = [], 0
        self.parents, self.last = [0], [0]
        #: The innermost and the outermost article or main around a section, itself included; -1 if there is none.
        self.inner, self.outer = [-1], [-1]
        self.line()

    def line(self) -> None:
        _, section, noise, _ = self.stack[-1]
        if self.lines and not self.lines[-1][0]:
            self.lines.pop()
        self.lines.append([[], 0, section, noise, 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.lines[-1][1] += 1
            if tag == "hr":
                self.line()
            elif tag in ("br", "img"):
                self.lines[-1][0].append(" ")
            return
        if tag in BLOCK:
            # a paragraph ends where a block begins, a list item where the next one does
            for implied in ("p", tag if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else "p"):
                if any(t == implied for t, *_ in self.stack[-3:]):
                    self.close_to(implied)
        _, section, noise, inside = self.stack[-1]
        if not noise:
            named = tag in CONTAINER if inside else tag in BLOCK and tag not in WHOLE
            noise = tag in NOISE or tag == "header" and not inside or self.hidden(attrs) or named and self.marked(attrs)
        if tag in SECTION:
            new = len(self.parents)
            whole = tag in ("article", "main")
            self.parents.append(section), self.last.append(new)
            self.inner.append(new if whole else self.inner[section])
            self.outer.append(self.outer[section] if self.outer[section] >= 0 or not whole else new)
            section, inside = new, inside or whole
        self.stack.append((tag, section, noise, inside))
        self.open[tag] += 1
        self.links += tag == "a"
        if tag in BLOCK:
            self.line()
        else:
            self.lines[-1][3] |= noise and not self.lines[-1][0]
        self.lines[-1][1] += 1

    @staticmethod
    def hidden(attrs: list) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    @staticmethod
    def marked(attrs: list) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                # the whole token or its head, so that "has-sidebar" or "no-comments" marks nothing
                if any(t in MARKS or PARTS.split(SITE.sub("", t))[0] in MARKS for t in value.lower().split()) or value.lower() in ("header", "site-header", "page-header", "complementary", "contentinfo", "search"):
                    return True
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self.lines[-1][1] += 1
        if self.open[tag]:
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        block = False
        while len(self.stack) > 1:
            t, section, *_ = self.stack.pop()
            self.open[t] -= 1
            self.links -= t == "a"
            block |= t in BLOCK
            if t in SECTION:
                self.last[section] = len(self.parents) - 1
            if t == tag:
                break
        if block:
            self.line()

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        if self.stack[-1][2] and not line[3]:
            return  # boilerplate inside a line of text
        if data.strip() or line[0]:
            line[0].append(data)
        if self.links:
            line[4] += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A broken or unknown declaration is a comment, as browsers take it."""
        return self.parse_bogus_comment(i, report)

    def finish(self) -> None:
        if self.rawdata.startswith(("<!", "<?")):
            self.rawdata = ""
        self.close()
        while len(self.stack) > 1:
            self.close_to(self.stack[-1][0])


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    return np.convolve(x, kernel / kernel.sum(), "full")[2:-2]


def two_groups(x: np.ndarray) -> float:
    """The threshold between the two groups of values that two-means ends with; the value itself if all are equal."""
    low, high = float(x.min()), float(x.max())
    while low < high:
        above = x >= (low + high) / 2
        means = float(x[~above].mean()), float(x[above].mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def around(parser: Lines, sections: list[int]) -> int:
    """The lowest section that holds all of the sections."""
    low, high = min(sections), max(sections)
    while low and parser.last[low] < high:
        low = parser.parents[low]
    return low


def widened(parser: Lines, top: int, weak: list[int]) -> int:
    """The highest section around `top` that adds none of the weak lines' sections (in order) to it."""
    inside = bisect_right(weak, parser.last[top]) - bisect_left(weak, top)
    while top:
        up = parser.parents[top]
        if (bisect_right(weak, parser.last[up]) - bisect_left(weak, up) if up else len(weak)) > inside:
            break
        top = up
    return top


def regions(parser: Lines, content: list[tuple[int, int]], seeds: list[int], weak: list[int]) -> tuple[list[tuple[int, int]], bool]:
    """First and last sections of the regions that content (section, characters) selects, and whether they are articles; outside these, seeds do."""
    inside = [(s, n) for s, n in content if parser.inner[s] >= 0]
    if 2 * sum(n for _, n in inside) < sum(n for _, n in content) or not inside:
        top = widened(parser, around(parser, seeds), weak)
        return [(top, parser.last[top] if top else len(parser.last))], False
    top = parser.inner[around(parser, [s for s, _ in inside])]
    tops = [top] if top >= 0 else sorted({parser.outer[s] for s, _ in inside})
    return [(s, parser.last[s]) for s in tops], True


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    rows = []
    for texts, tags, section, noise, linked in parser.lines:
        text = " ".join("".join(texts).split())
        if text:
            rows.append((text, 0.0 if noise else len(text) / max(1, tags), section, noise, linked >= 0.9 * len(text) and tags >= 3))
    clean = [r for r in rows if not r[3]]
    if not clean:
        return ""
    ratio = smooth(np.array([r[1] for r in rows]))
    cut, half = two_groups(ratio), ratio.mean() / 2
    lines = [(section, len(text), x) for (text, _, section, noise, menu), x in zip(rows, ratio) if not noise and not menu and x >= half]
    content = [(s, n) for s, n, _ in lines] or [(r[2], len(r[0])) for r in clean]
    weak = sorted(r[2] for r, x in zip(rows, ratio) if not r[3] and x < half)
    found, article = regions(parser, content, [s for s, _, x in lines if x >= cut] or [s for s, _ in content], weak)
    begins = [b for b, _ in found]
    out = []
    for text, _, section, _, menu in clean:
        k = bisect_right(begins, section) - 1
        if k >= 0 and section <= found[k][1] and (article or not menu):
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""

    def run(pages: list[str | None]) -> dict:
        texts = [main_text(h) for h in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return over_texts(pages.select("page_id", "url", "html"), run, "text string, n_chars long", ["page_id", "url"], texts=("html",))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
