"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one per block element that holds text, in page order. Text lengths outside links are summed over sliding windows
of `WINDOW` lines. Where a sum reaches the surge, a stretch of text begins, at the window's first line that is dense itself; where the sums
dive below it again, the stretch ends after its last dense line. The text is all between the first surge and the last dive, so short lines between paragraphs stay
and the short lines of menus and imprints before and after are cut, whether or not they are marked as such.

The distribution is taken over what the page does not mark as no part of an article: navigation, side and foot matter, forms, and elements
whose role or one of whose class or id names says advert, notice, comments and the like. A name counts as a whole (`sidebar`), with
a leading part (`site-footer`) or with a container's name behind it (`comment-list`); `has-sidebar`, `related-work` or `banner-of-1848` say nothing.
Such a mark is not believed if its element holds a surge and most of the page's text, while what is left has neither a marked article nor a surge (`nav`, `footer` and `menu`
always are). Scripts, styles and the like are never text.

Where articles are marked (`article`, else `main`) and hold most of the stretches' text, all lines of all of them are the text: headlines and
short last lines have no density of their own. Elsewhere headings and sentences right before the first stretch belong to it, and after the last one
what leads within twice `window` short lines to another sentence.

Parameters: `window`, `surge` (characters outside links in a window) and `share`: on a page whose fullest window has fewer than `surge / share`
characters, the surge is that share of it, so that short pages have text too. Elements nested deeper than `DEEPEST` count as siblings at that depth; no text is lost by that.

Pages are handled one by one inside tasks, whole, without a shuffle.

Defined results: a null or empty page, and one without text, gives an empty text; repeated rows give repeated rows; broken markup is
read as far as it goes (an unclosed comment or script reaches to the end). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import small_batches

WINDOW, SURGE, SHARE = 3, 86, 0.5

# A tag with its quoted values of any length, else (quotes that do not close) a tag up to the next bracket.
_MARKUP = re.compile(r"""<!--(?:.*?-->|.*)
    |<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>
    |<[!?/][^<>]*+>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_QUOTED = re.compile(r""""[^"]*+"|'[^']*+'""")
#: The same tags where a page has no further quote of one kind or of both: nothing looks for its end again.
_MARKUP_WITHOUT = {kinds: re.compile(_MARKUP.pattern.replace('|"[^"]*+"', "" if '"' in kinds else '|"[^"]*+"').replace(
    "|'[^']*+'", "" if "'" in kinds else "|'[^']*+'"), re.S | re.X) for kinds in ("", '"', "'", "\"'")}
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_SENTENCE_END = re.compile(r"""[.!?…:;][\])"'»”’]*$""")

# Fixed values of HTML: elements whose content is no markup, elements without content, and elements that end a line.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead title tr ul""".split())
#: An opening element of this kind ends an open one of the same list.
SIBLINGS = {name: group for group in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for name in group}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What is never text, and what is no part of an article: elements, roles, and names of classes or ids.
NEVER = frozenset("script style noscript template iframe object svg canvas head title select textarea button datalist".split())
EXCLUDED = frozenset("nav footer aside form dialog menu".split())
CERTAIN = frozenset("nav footer menu".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names by themselves or with a leading part.
EXCLUDED_NAMES = frozenset("""ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promos promotion
    sidebar sidebars comment comments disqus replies respond cookie cookies consent gdpr notice notices notification notifications
    popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs footer
    masthead topbar copyright share sharing social toolbar pagination pager widget widgets""".split())
#: Names by themselves only; with a leading part they are as often about something.
EXCLUDED_ALONE = frozenset("banner rail reply alert related recommended recommendations".split())
#: With these before it a name speaks of the page round it.
NEGATIONS = frozenset("has have no not with without is show hide hidden".split())
#: Behind an excluded name these make a container of such things.
CONTAINERS = frozenset("""area banner bar block body box button buttons column container content form group icons inner item items label link links list
    main notice outer panel popup popup section slot strip text thread title toggle top unit widget wrap wrapper zone""".split())
#: Only outside an article: inside, the header holds its headline.
EXCLUDED_OUTSIDE = frozenset(["header"])
COMMENT_NAMES = frozenset("comment comments reply replies".split())
ROOTS = frozenset("html body main article".split())
#: Elements nested deeper are taken as siblings.
DEEPEST = 256


class _Element:
    """`never`: its text is no text at all; `marked`: the page says that it is no part of an article."""

    __slots__ = ("name", "never", "marked", "inside", "parent", "depth")

    def __init__(self, name: str, parent: _Element | None, never: bool, marked: bool):
        self.name, self.parent, self.marked = name, parent, marked
        self.never = never or (parent is not None and parent.never)
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.depth = parent.depth + 1 if parent else 0

    def around(self) -> Iterator[_Element]:
        at: _Element | None = self
        while at is not None:
            yield at
            at = at.parent


def says_excluded(name: str) -> bool:
    """Whether a class or id name says that its element is no part of an article."""
    parts = [p for p in re.split(r"[-_]+", _HUMPS.sub("-", name).lower()) if p]
    if not parts or parts[0] in NEGATIONS:
        return False
    while len(parts) > 1 and (parts[-1] in CONTAINERS or parts[-1].isdigit()):
        if parts[-2] in EXCLUDED_NAMES or parts[-2] in EXCLUDED_ALONE and len(parts) == 2:
            return True
        parts.pop()
    return parts[-1] in EXCLUDED_NAMES or len(parts) == 1 and parts[0] in EXCLUDED_ALONE


def _is_marked(name: str, attributes: str, parent: _Element) -> bool:
    if name in EXCLUDED or (name in EXCLUDED_OUTSIDE and not parent.inside):
        return True
    if not attributes.strip():
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _QUOTED.sub('""', attributes)):
        return name not in ROOTS
    names: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key in ("class", "id"):
            names.update(value.split())
        elif key == "role" and value.lower() in EXCLUDED_ROLES:
            return name not in ROOTS
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return name not in ROOTS
    if name in ROOTS:
        return name == "article" and any(n.lower() in COMMENT_NAMES for n in names)
    return any(says_excluded(n) for n in names) or (not parent.inside and any(n.lower() in EXCLUDED_OUTSIDE for n in names))


class Page:
    """Lines of a page: (text, weight, element); weight counts characters outside links."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, _Element]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._top = _Element("", None, False, False)
        self._read(html)

    def _read(self, html: str) -> None:
        here, links, at, size = self._top, 0, 0, len(html)
        last, last_bracket = {kind: html.rfind(kind) for kind in "\"'"}, html.rfind(">")
        while at < size:
            markup = _MARKUP_WITHOUT["".join(kind for kind in last if last[kind] < at)] if at <= last_bracket else _OPEN_COMMENT
            tag = markup.search(html, at)
            self._text(html[at:tag.start() if tag else size], here, links)
            if tag is None:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower() if markup is not _OPEN_COMMENT else ""
            if not name:
                continue
            if name in BLOCK:
                self._end_line(here)
            if tag[1] or tag[4]:
                if name == "a":
                    links = 0
                else:
                    here = self._closed(here, name)
                continue
            if name == "a":
                links = 1
                continue
            if name in BLOCK and name not in ("br", "hr"):
                here = self._implied_end(here, name)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else size
                close = html.find(">", at)
                at = close + 1 if end and close >= 0 else size
                continue
            attributes = tag[3] or tag[6] or ""
            if name in VOID or attributes.endswith("/") and name not in BLOCK:
                continue
            around = here if here.depth < DEEPEST else here.parent
            here = _Element(name, around, name in NEVER, _is_marked(name, attributes, around))
        self._end_line(here)

    def _text(self, raw: str, here: _Element, links: int) -> None:
        if raw and not here.never:
            text = unescape(raw)
            self._parts.append(text)
            if links:
                self._linked += len("".join(text.split()))

    def _end_line(self, here: _Element) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                weight = max(0, len(text.replace(" ", "")) - self._linked)
                self.lines.append((text, weight, here))
            self._parts, self._linked = [], 0

    @staticmethod
    def _closed(here: _Element, name: str) -> _Element:
        """The element around the nearest open `name`; a stray end tag changes nothing."""
        at = here
        while at.parent is not None:
            if at.name == name:
                return at.parent
            if at.name in ROOTS and name not in BLOCK:
                return here
            at = at.parent
        return here

    @staticmethod
    def _implied_end(here: _Element, name: str) -> _Element:
        group = SIBLINGS.get(name, ())
        at = here
        while at.parent is not None and (at.name not in BLOCK or at.name == "p" or at.name in group):
            if at.name == "p" or at.name in group:
                return at.parent
            at = at.parent
        return here


def stretches(weights: list[int], full: list[bool], window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> list[tuple[int, int]]:
    """[from, to) of every stretch between a surge and a dive of the line blocks.

    A line is dense with an even part of the surge; one that is `full` (it ends like a sentence) counts as dense, though it makes no surge.
    """
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    threshold = min(surge, share * max(sums, default=0))
    if threshold <= 0:
        return []
    dense = [w * window >= threshold or f for w, f in zip(weights, full)]
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        if sums[i] < threshold:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive] >= threshold:
            dive += 1
        # The last window with a surge reaches over the dive; a line in it always is dense, as its sum is.
        lines = [k for k in range(i, min(dive - 1 + window, len(weights))) if dense[k]]
        out.append((lines[0], lines[-1] + 1))
        i = dive
    return out


def _unmarked(lines: list, window: int, surge: int) -> list[bool]:
    """Which lines stand in no element that is marked as no part of an article.

    The outermost mark counts. It is not believed where its element has most of the page's weight, and outside of marked elements there is no
    article and no surge.
    """
    disbelieved: set[int] = set()
    chains = [[e for e in at.around() if e.marked][::-1] for *_, at in lines]
    total = sum(w for _, w, _ in lines)
    while True:
        first = [next((e for e in chain if id(e) not in disbelieved), None) for chain in chains]
        stands = [e is None for e in first]
        kept = [w for (_, w, _), s in zip(lines, stands) if s]
        if any(s and at.inside for (*_, at), s in zip(lines, stands)) or any(sum(kept[i:i + window]) >= surge for i in range(len(kept))):
            return stands
        held: dict[int, int] = {}
        for (_, weight, _), e in zip(lines, first):
            if e is not None and e.name not in CERTAIN:
                held[id(e)] = held.get(id(e), 0) + weight
        heaviest = max(held, key=held.__getitem__, default=None)
        if heaviest is None or 2 * held[heaviest] <= total or held[heaviest] < surge:
            return stands
        disbelieved.add(heaviest)


def _articles(lines: list, inside: list[bool]) -> list[bool] | None:
    """Which lines stand in a marked article that a stretch reaches, if such articles hold most of the stretches' text."""
    total = sum(w for (_, w, _), d in zip(lines, inside) if d)
    for kind in ("article", "main"):
        own = [next((e for e in at.around() if e.name == kind), None) for *_, at in lines]
        with_text = {id(e) for e, d in zip(own, inside) if e is not None and d}
        if 2 * sum(w for (_, w, _), e, d in zip(lines, own, inside) if d and e is not None) > total > 0:
            return [e is not None and id(e) in with_text for e in own]
    return None


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    lines = Page(html or "").lines
    lines = [line for line, stands in zip(lines, _unmarked(lines, window, surge)) if stands]
    full = [w > 0 and bool(_SENTENCE_END.search(t)) and not _RIGHTS.match(t) for t, w, _ in lines]
    found = stretches([w for _, w, _ in lines], full, window, surge, share)
    if not found:  # nothing but links, or nothing at all
        return " ".join(text for text, *_ in lines)
    start, end = found[0][0], found[-1][1]
    inside = [False] * len(lines)
    for a, b in found:
        inside[a:b] = [True] * (b - a)
    held = _articles(lines, inside)
    if held is not None:
        return " ".join(text for (text, *_), h in zip(lines, held) if h)
    while start and (full[start - 1] or any(e.name in HEADINGS for e in lines[start - 1][2].around())):
        start -= 1
    # Short last lines, such as a list's, are followed by one that ends like a sentence; those of an imprint are not.
    while (ends := [i for i in range(end, min(end + 2 * window + 1, len(lines))) if full[i]]):
        end = ends[-1] + 1
    return " ".join(text for text, *_ in lines[start:end])


def extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p) for p in batch], dtype="object")
    return of(html)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        extracted(F.col(f"`{html}`")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
