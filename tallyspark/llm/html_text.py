"""Main text of web pages by the line-block distribution.

One pass over the markup gives the page's lines, one a block, each with its
length: that of its text without its links. Lines of menus, forms, adverts,
notices, comments and the like, told by their elements, have length zero and are
never kept. Lengths are summed over a sliding window of lines. Where the sums
rise over a share of the page's largest is a surge point, where they fall under
it a dive point, and what lies between is kept. Stretches close to each other are
joined, and a stretch takes in the rest of the article, or of the element around
its lines.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import lean, slices, with_columns

#: Lines of a window, and the part of the largest window's text that makes one full.
WINDOW, SHARE = 3, 8
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|[!?/])")
#: What follows a tag's name, up to its end: names, and values in quotes or without.
ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; those of the head; those that are no part of an article; those of lines inside a container.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
APART = frozenset("nav footer aside form button menu dialog fieldset select noscript template svg math object audio video canvas".split())
LINES = frozenset("p li ul ol dl dt dd tr td th tbody thead tfoot table option blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption address details summary caption center".split())
#: An element of these ends where the next of its kind begins.
IMPLIED = frozenset("p li dt dd tr td th option".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended subscribe subscription newsletter signup login search pagination pager toolbar complementary contentinfo".split()
)
#: Words that make a class name speak of the page around it (has-sidebar, no-ads), and those that make a header the article's.
STATES = frozenset("has with without no not is show shows enable enabled layout supports".split())
OWN = frozenset("article content entry main page post story text title".split())


@dataclass
class Line:
    text: str
    length: int  # without links; of a line of mostly links 0
    heading: bool
    article: int  # number from 1 of the outermost article or main element around it, 0: none
    box: int  # the element that holds it
    mark: int  # the innermost marked element around it, 0: none


@dataclass
class Mark:
    whole: bool  # a class name is a mark, not just a word of it
    around: int  # the marked element around it


def _marked(name: str, attributes: str) -> str:
    """What sets an element apart: "hidden", "whole" (a class name is a mark), "part" (a word of one), or ""."""
    if not TELLING.search(attributes) or name in ("html", "body"):
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if key in ("class", "id", "role"):
            for n in value.split():
                words = set(re.split(r"[^a-z0-9]+", n))
                if n in MARKS:
                    found = "whole"
                elif not found and (hit := words & MARKS) and not words & STATES and not (hit == {"header"} and words & OWN):
                    found = "part"
    return found


class Page:
    """The lines and marked elements of a page, in one pass that takes time in proportion to its length."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.marks = [Mark(False, 0)]
        self.piece: list[str] = []
        self.linked = self.links = self.article = self.articles = 0
        self.heading = False
        self.stack: list[tuple[str, int, int, bool]] = []  # open elements: name, box, mark, apart
        self.open: Counter[str] = Counter()
        self.boxes = 0
        self._read(page)

    @property
    def _top(self) -> tuple[str, int, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, 0, False)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.piece)).split()) if self.piece else ""
        self.piece.clear()
        if text:
            _, box, mark, _ = self._top
            length = len(text) if self.article else max(0, len(text) - self.linked) if self.linked * 2 <= len(text) else 0
            self.lines.append(Line(text, length, self.heading, self.articles if self.article else 0, box, mark))
        self.linked, self.heading = 0, False

    def _gap(self) -> None:
        _, box, mark, _ = self._top
        self.lines.append(Line("", 0, False, self.articles if self.article else 0, box, mark))

    def _pop(self) -> None:
        name, *_ = self.stack.pop()
        self.open[name] -= 1
        if name in ("article", "main"):
            self.article = max(0, self.article - 1)

    def _close(self, name: str) -> None:
        """Ends the innermost open element of that name, with all that is still open in it."""
        if self.open[name]:
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def _start(self, name: str, attributes: str) -> None:
        _, box, mark, apart = self._top
        if name in VOID:
            if name not in ("img", "wbr") and not apart:
                self._flush()
            return
        if name in IMPLIED and self._top[0] == name or name not in INLINE and self._top[0] == "p":
            self._flush() if not apart else None
            self._pop()
            _, box, mark, apart = self._top
        set_apart = _marked(name, attributes)
        if name in ("article", "main") and not set_apart and apart and not self.articles:
            self.stack = [(n, b, m, False) for n, b, m, _ in self.stack]  # what set it apart was never closed
            apart = False
        if name in INLINE and (not set_apart or apart):
            if name == "a":
                self.links += 1
            return
        if not apart:
            inline = name in INLINE or name in ("button", "select")
            if not inline:
                self._flush()
            else:
                self.piece.append(" ")
            apart = set_apart == "hidden" or name in APART or name == "header" and not self.article
            if apart:
                if not inline:
                    self._gap()
            elif set_apart:
                self._flush()
                self.marks.append(Mark(set_apart == "whole", mark))
                mark = len(self.marks) - 1
            self.heading |= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name not in LINES and name not in INLINE:
            self.boxes += 1
            box = self.boxes
        if name in ("article", "main") and not apart:
            self.articles += not self.article
            self.article += 1
        elif name in ("article", "main"):
            name = "/" + name  # set apart, so it isn't counted
        self.stack.append((name, box, mark, apart))
        self.open[name] += 1

    def _end(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name == "p" and not self.open["p"] or name == "br":
            self._flush() if not self._top[3] else None
            return
        if name in ("article", "main") and self.open["/" + name] and self._top[3]:
            name = "/" + name
        if name in INLINE and not self.open[name]:
            return
        if not self._top[3] and name not in INLINE:
            self._flush()
        elif not self._top[3] and self._top[0] == name:
            self._flush()  # a marked inline element is a line of its own
        self._close(name)

    def _read(self, page: str) -> None:
        at, last = 0, page.rfind(">")
        quotes, in_head = True, False
        unclosed: set[str] = set()
        lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]+", lambda m: m[0].lower(), page)

        def say(start: int, end: int) -> None:
            if end > start and not in_head and not self._top[3]:
                self.piece.append(page[start:end])
                self.linked += (end - start) * (self.links > 0)

        while m := MARKUP.search(page, at):
            begin, name = m.start(), (m[2] or "").lower()
            if name or page.startswith("<!--", begin):
                say(at, begin)
            if not name:
                if page.startswith("<!--", begin):
                    end = page.find("-->", begin + 2)
                    at = len(page) if end < 0 else end + 3
                elif page.startswith("</", begin) and not page[begin + 2 : begin + 3].strip("> "):
                    say(at, begin)
                    at = begin + 2 + page.startswith(">", begin + 2)
                else:
                    say(at, begin)
                    end = page.find(">", begin)
                    at = len(page) if end < 0 else end + 1
                continue
            if begin > last:  # a tag that the page breaks off in
                at = len(page)
                break
            tag = ATTRIBUTES.match(page, m.end()) if quotes else None
            if tag is None:
                # a quote that never closes: from here on a tag ends at the next bracket
                quotes, end = False, page.index(">", m.end() - 1) + 1
            else:
                end = tag.end()
            attributes, at = page[m.end() : end - 1], end
            if in_head and name not in HEAD or m[1] and name == "head":
                in_head = False
            if m[1]:
                self._end(name)
                continue
            if name == "head" and not self.lines and not self.piece:
                in_head = True
                continue
            if name in RAW:
                close = lower.find("</" + name, at) if name not in unclosed else -1
                if close < 0:
                    unclosed.add(name)
                    if name in ("script", "style"):
                        at = len(page)
                        break
                else:
                    if name != "textarea" and not self._top[3]:
                        self._flush()
                    end = page.find(">", close)
                    at = len(page) if end < 0 else end + 1
                continue
            if not in_head and name != "head":
                self._start(name, attributes)
        say(at, len(page))
        if not self._top[3]:
            self._flush()

    def kept(self) -> list[Line]:
        """The lines, those of marked elements emptied. A mark on an element around most of the text counts for nothing."""
        here, own = 0, [0] * len(self.marks)
        for x in self.lines:
            own[x.mark] += x.length
        under = list(own)
        for k in range(len(self.marks) - 1, 0, -1):
            under[self.marks[k].around] += under[k]
        here, wrapper = own[0], [False] * len(self.marks)
        wrapper[0] = True
        # marks around more than half of the text lie in each other, so that one way leads down
        for k in range(1, len(self.marks)):
            m = self.marks[k]
            if wrapper[m.around] and 2 * under[k] > under[0] and not (m.whole and here):
                wrapper[k] = True
                here += own[k]
        return [x if wrapper[x.mark] else Line("", 0, False, x.article, x.box, 0) for x in self.lines]


def windows(length: np.ndarray) -> np.ndarray:
    """Sum of each line's length and those of the WINDOW - 1 lines after it."""
    total = np.concatenate([[0], np.cumsum(length)])
    return total[np.minimum(np.arange(len(length)) + WINDOW, len(length))] - total[:-1]


def stretches(length: np.ndarray) -> list[tuple[int, int]]:
    """(surge, dive) points: where windows rise to a SHARE-th of the largest, and where they fall under it."""
    block = windows(length)
    full = np.concatenate([[False], (block > 0) & (block * SHARE >= block.max(initial=0)), [False]])
    return list(zip(np.flatnonzero(full[1:] & ~full[:-1]).tolist(), np.flatnonzero(full[:-1] & ~full[1:]).tolist()))


def main_text(page: str | None) -> str:
    found = Page(page or "").kept()
    length = np.array([x.length for x in found], np.int64)
    if not length.any():
        return ""
    spans = stretches(length)
    heavy = length * SHARE * WINDOW >= windows(length).max()
    inside = np.zeros(len(found), bool)
    for a, b in spans:
        inside[a:b] = True
    core = [x for x, i, h in zip(found, inside, heavy) if i and h]
    if found[int(length.argmax())].article:
        articles = {x.article for x in core if x.article}
        return "\n".join(x.text for x in found if x.text and x.article in articles)
    boxes = {x.box for x in core}
    mine = [x.box in boxes and (x.box > 0 or x.text[-1:] in ".!?…\"”»)") for x in found]
    for k, (a, b) in enumerate(spans):
        # short lines that the first window reaches over aren't the article's, unless they are headings or lie with it
        while a < b and not (heavy[a] or found[a].heading or mine[a]):
            inside[a] = False
            a += 1
        if k and a - spans[k - 1][1] <= WINDOW:
            inside[spans[k - 1][1] : a] = True
    return "\n".join(x.text for x, i, own in zip(found, inside, mine) if x.text and (i or own))


def extract_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """id_cols, the main text and n_chars (its code points), one row per row of pages.

    A null or empty page has an empty text. Whole pages are read, however long;
    markup may be unclosed or cut off. Ids may be null or repeat, and other
    columns of pages are ignored.
    """
    schema = with_columns({c: pages.schema[c].dataType for c in id_cols}, "text string, n_chars long")
    keys = [f"k{i}" for i in range(len(id_cols))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "page"):
            text = [main_text(x) for x in part.column("page").to_pylist()]
            cols = [part.column(k) for k in keys] + [pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "text", "n_chars"])

    return pages.select(*[pages[c].alias(k) for c, k in zip(id_cols, keys)], pages[html_col].alias("page")).mapInArrow(lean(run), schema)
