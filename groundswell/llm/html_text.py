"""Main text of HTML pages by the distribution of line-block lengths.

1. The markup is stripped: each block element starts a new line of text. Lines inside
   menus, headers, footers, sidebars, notices, adverts, forms and comments (by element,
   role, class or id), link lists and scripts keep their place but count as length 0.
2. Over windows of ``WINDOW`` lines the text lengths are summed (Chen, "cx-extractor").
3. A surge is where the sum leaves 0, a dive where it falls back to 0. Text between
   them is kept if its highest sum reaches a floor: ``SHARE`` of the page's middle sum,
   lines clipped so that a long block does not raise it, and ``ENOUGH`` at most.
4. Article and main elements are a signal beside that: where their lines make up most of
   the page's highest sum and of the text kept, all their lines stay and no others.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import per_batch

WINDOW = 3
SHARE = 0.1
ENOUGH = 86  # a sum that is text on any page, as in cx-extractor

# HTML element names and the usual class, id and role words.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol
    p pre section summary table tbody td tfoot th thead tr ul""".split()
)
SILENT = frozenset(
    """script style noscript template head title svg iframe object canvas audio video
    select option datalist textarea button""".split()
)
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr frame keygen".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo
    promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar
    aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login search share sharing social
    related recommended recommendations comment comments commentlist disqus respond reply replies
    widget widgets toolbar skip hidden responses discussion feedback disclaimer copyright""".split()
)
# Words that, with a mark of layout, name a part of the page's frame: "has-sidebar".
FRAME = frozenset("header footer sidebar nav menu banner".split())
NEGATIONS = frozenset("has with no without not".split())
WHOLE = frozenset("content main page layout post entry article".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


def _mark(word: str) -> bool:
    """Whether one class or id names something beside the article."""
    tokens = [token.lower() for token in _TOKENS.findall(word)]
    found = MARKS.intersection(tokens)
    if not found or tokens[0] in NEGATIONS:
        return False
    return not (found <= FRAME and WHOLE.intersection(tokens))


def _marked(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role say that an element is not part of the article."""
    for name, value in attributes:
        if name in ("class", "id") and value:
            if any(map(_mark, value.split())):
                return True
        elif name == "role" and value and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


class _Lines(HTMLParser):
    """The lines of a page: text, its length, whether it is inside an article, and whether it is links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # element, silent, aside, article
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0

    def parse_marked_section(self, i, report=1):
        """Sections of a kind the parser does not know are comments, as in a browser."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _state(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, False)

    def end_line(self) -> None:
        if self.parts:
            silent, aside, article = self._state()
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            length = 0 if aside else len(text)
            links = self.linked > 0 and self.linked >= 0.8 * max(len(text), 1)
            if text and not silent:
                self.lines.append((text, length, article, links))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            # A block ends an open paragraph, an item the item before it.
            if self.stack and self.stack[-1][0] in CLOSED_BY_BLOCK:
                self.stack.pop()
            elif self.stack and tag == self.stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.stack.pop()
        if tag in VOID:
            return
        silent, aside, article = self._state()
        inside = article or (tag in ("article", "main") and not aside)
        aside = aside or tag in ASIDE or (tag == "header" and not article)
        aside = aside or (tag not in ("html", "body", "article", "main") and _marked(attrs))
        aside = aside or (tag == "article" and article and _marked(attrs))
        if tag == "article" and not article and _marked(attrs) and self._comment(attrs):
            aside, inside = True, False
        if tag == "a":
            self.links += 1
        if tag in BLOCKS or tag in SILENT or tag == "a" or aside != self._state()[1]:
            self.stack.append((tag, silent or tag in SILENT, aside, inside))

    @staticmethod
    def _comment(attrs) -> bool:
        words = {t.lower() for n, v in attrs if n in ("class", "id") and v for t in _TOKENS.findall(v)}
        return bool(words & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related"})

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.links -= sum(entry[0] == "a" for entry in self.stack[depth:])
                del self.stack[depth:]
                return
            if self.stack[depth][0] in ("article", "main", "body") and tag not in ("html", "body"):
                return  # a stray end tag does not close the article

    def handle_data(self, data):
        if data and not self._state()[0]:
            self.parts.append(data)
            if self.links > 0:
                self.linked += len(data.strip())


def lines_of(html: str) -> list[tuple[str, int, bool, bool]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def window_sums(lengths: np.ndarray) -> np.ndarray:
    """The length of each line and those after it in its window."""
    return np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]


def floor_of(lengths: np.ndarray, share: float) -> float:
    """The sum that text between a surge and a dive must reach, whatever the longest line."""
    middle = lambda x: np.percentile(x[x > 0], 50, method="lower")
    return min(ENOUGH, share * middle(window_sums(np.minimum(lengths, WINDOW * middle(lengths)))))


def between(lengths: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Which lines lie between a surge and a dive high enough to be the main text."""
    keep = np.zeros(len(lengths), bool)
    if not len(lengths) or not lengths.any():
        return keep
    sums = window_sums(lengths)
    least = floor_of(lengths, share)
    surge = None
    for at, value in enumerate([*sums.tolist(), 0]):
        if value and surge is None:
            surge = at
        elif not value and surge is not None:
            if sums[surge:at].max() >= least:
                keep[surge:at] = True
            surge = None
    return keep & (lengths > 0)


def main_lines(lines: list[tuple[str, int, bool, bool]]) -> np.ndarray:
    """Which lines of a page are its main text."""
    whole = np.array([line[1] for line in lines], np.int64)
    article = np.array([line[2] for line in lines], bool)
    lengths = np.where(np.array([line[3] for line in lines], bool), 0, whole)
    inside = np.where(article, whole, 0)
    if not lengths.any():
        return inside > 0  # links only
    keep = between(lengths)
    held = np.where(article, lengths, 0)
    highest = window_sums(lengths).argmax()
    most = 2 * window_sums(held)[highest] > window_sums(lengths)[highest]
    if most and 2 * held[keep].sum() > lengths[keep].sum():
        return inside > 0
    return keep


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by an empty line; empty if there are none."""
    lines = lines_of(html or "")
    keep = main_lines(lines)
    return "\n\n".join(line[0] for line, good in zip(lines, keep) if good)


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(html) for html in batch.column(2).to_pylist()]
    columns = [
        batch.column(0),
        batch.column(1),
        pa.array(texts, pa.string()),
        pa.array([len(text) for text in texts], pa.int64()),
    ]
    return pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html, ...).

    A null or empty page, and one without main text, gives an empty text. Broken markup
    is read as far as it goes: unclosed elements end with the element around them.
    """
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")
    )
    return chosen.mapInArrow(
        per_batch(_extract), "page_id long, url string, text string, n_chars long"
    )
