"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (lines), without the elements that never hold main text.
Text lengths, less twice the characters inside links, are summed over a sliding window
of blocks; the main text begins where these sums surge and ends where they dive. The
region with the most text names its container (the innermost article, main element or
division that holds most of it), and all that container's blocks are kept: its short
first and last lines lie outside the region, other containers' lines do not belong.

Defined results: null or empty html, and pages without text, give an empty text.
Crossed tags are read as they come. End tags that HTML lets be left out are implied by
the next item, cell or block, and an element ends with those around it; an unclosed
comment or script runs to the end of the page. Reading is linear in the page's length. Repeated rows are read each on
its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Blocks in a window, and characters of a window from which it is part of a region.
WINDOW = 3
SURGE = 40

#: Elements that hold no main text, elements that are blocks, elements without an end, containers.
DROPPED = frozenset("head title nav header footer aside form script style noscript template svg math iframe object button select option textarea input dialog menu canvas audio video map fieldset".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert disclaimer popup modal overlay "
    "sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer comment comments commentlist respond disqus reply replies discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login search toolbar tags copyright hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

#: Elements that may lack their end tag: what begins there ends them, up to the nearest wall.
CELLS = ("td", "th")
SECTIONS = ("caption", "colgroup", "tbody", "thead", "tfoot", "tr", *CELLS)
ENDS = {
    **dict.fromkeys(CELLS, CELLS), "tr": ("tr", *CELLS), **dict.fromkeys(("tbody", "thead", "tfoot"), SECTIONS),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
TABLE_WALLS = ("table", "caption", *CELLS)
P_WALLS = (*TABLE_WALLS, "button", "object")
ITEM_WALLS = (*P_WALLS, *"article aside blockquote body center details dialog dl fieldset figure footer form header main menu nav ol pre section select ul".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
LOOSE = frozenset("p li dt dd option optgroup".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A tag without any of these is no boilerplate by its attributes.
_TELLING = re.compile("class|id|role|hidden|style", re.I)
#: Classes that say what an element has beside it, not what it is.
_ABSENT = ("no-", "has-", "with-", "without-", "hide-", "not-")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_OPENING = re.compile(r"""=\s*["']""")
_TOKEN = re.compile(r"[a-z]+")


def _tag_end(html: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends: its >, outside of quotes. A quote that never ends is none."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    while True:
        m = _OPENING.search(html, at, end)
        if not m:
            return end
        at = html.find(m[0][-1], m.end()) + 1
        after = html.find(">", at) if at > end else end
        if not at or after < 0:
            return end
        end = after


def _boilerplate(name: str, tag: str) -> int:
    """By its attributes an element is 3 no main text, 2 none by all its class or identifier, 1 by a part of them, 0 neither."""
    if not _TELLING.search(tag):
        return 0
    named = 0
    for m in _ATTRIBUTE.finditer(tag, len(name)):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if (
            key == "hidden" and value != "until-found"
            or key == "aria-hidden" and value == "true"
            or key == "style" and _NO_DISPLAY.search(value)
            or key == "role" and value in ROLES
        ):
            return 3
        if key in ("class", "id") and any(w in BOILERPLATE for x in value.split() if not x.startswith(_ABSENT) for w in _TOKEN.findall(x)):
            named = max(named, 1 + (value in BOILERPLATE))
    return named if name not in ("article", "main") else 0


class _Blocks:
    """The blocks of a page: pieces of text (whether in a link, innermost named element), and the innermost container around each (0: none)."""

    def __init__(self) -> None:
        self.out: list[tuple[list[tuple[str, bool, int]], int]] = []
        self.text: list[tuple[str, bool, int]] = []

    def add(self, raw: str, in_link: bool, inside: int) -> None:
        if raw:
            self.text.append((raw, in_link, inside))

    def close(self, inside: int) -> None:
        if self.text:
            self.out.append((self.text, inside))
            self.text = []

    def left(self, suspects: dict[int, int], names: list[str], parents: list[int]) -> list[tuple[str, int, int]]:
        """Text, characters in links and container of each block, without the elements that their names tell apart.

        Such an element stays if it holds most of the page's text outside of links. One that is
        named by a single word, as in class="ad", gives way to an article or main element's text.
        """
        gone = [False] * len(parents)
        if suspects:
            held = [0] * len(parents)
            for pieces, _ in self.out:
                for raw, in_link, c in pieces:
                    held[c] += 0 if in_link else sum(map(len, raw.split()))
            main, open_main, around = False, [False] * len(parents), [False] * len(parents)
            for c in range(1, len(parents)):
                open_main[c] = suspects.get(c) != 2 and (open_main[parents[c]] or names[c] in ("article", "main") and not around[parents[c]])
                around[c] = around[parents[c]] or suspects.get(c) == 2
                main |= open_main[c] and held[c] > 0
            has_main = [x in ("article", "main") for x in names]
            for c in range(len(parents) - 1, 0, -1):
                held[parents[c]] += held[c]
                has_main[parents[c]] |= has_main[c]
            for c in range(1, len(parents)):
                few = 2 * held[c] <= held[0] or suspects.get(c) == 2 and main and not has_main[c]
                gone[c] = gone[parents[c]] or c in suspects and few
        out = []
        for pieces, inside in self.out:
            own = [(raw, in_link) for raw, in_link, c in pieces if not gone[c]]
            text = " ".join(unescape("".join(raw for raw, _ in own)).split())
            if text:
                out.append((text, sum(len(raw) for raw, in_link in own if in_link), inside))
        return out


class _Open:
    """The open elements, innermost last, with the places of each name."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.outer: list[int] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []  # places of block elements that only their own or an outer end tag ends

    def last(self, names: Iterable[str]) -> int:
        return max((self.at[x][-1] for x in names if self.at[x]), default=-1)

    def push(self, name: str, outer: int) -> None:
        if name in DROPPED or name in BLOCKS and name not in LOOSE:
            self.walls.append(len(self.names))
        self.at[name].append(len(self.names))
        self.names.append(name)
        self.outer.append(outer)

    def cut(self, k: int) -> int:
        """Close all from place ``k``; the container around them."""
        outer = self.outer[k]
        while len(self.names) > k:
            self.at[self.names.pop()].pop()
        del self.outer[k:]
        while self.walls and self.walls[-1] >= k:
            self.walls.pop()
        return outer

    def ended_by_start(self, name: str) -> int:
        """The place from which a start tag closes elements, or -1."""
        found = []
        if self.at["head"] and name not in IN_HEAD:
            found.append(self.at["head"][-1])
        if name in ENDS_P and self.at["p"] and self.at["p"][-1] > self.last(P_WALLS):
            found.append(self.at["p"][-1])
        if name in ENDS:
            wall = self.last(ITEM_WALLS if name in ("li", "dt", "dd") else ("select",) if name.startswith("opt") else ("table",))
            found += [self.at[x][-1] for x in ENDS[name] if self.at[x] and self.at[x][-1] > wall]
        return min(found, default=-1)

    def ended_by_end(self, name: str, tables_end: bool, dropped: int) -> int:
        """The place from which an end tag closes elements, or -1."""
        k = self.at[name][-1] if self.at[name] else -1
        if k < 0 or k == dropped or name == "table":
            return k
        if name in SECTIONS:
            wall = self.last(("table",))
        elif name == "p":
            wall = self.last(P_WALLS)
        elif name == "li":
            wall = self.last(("ul", "ol", *TABLE_WALLS))
        elif name in DROPPED or name in BLOCKS:
            wall = self.last(TABLE_WALLS) if tables_end else -1
        else:
            wall = self.walls[-1] if self.walls else -1
        return k if k > wall else -1


def blocks(html: str) -> tuple[list[tuple[str, int, int]], list[str], list[int]]:
    """Blocks in page order, and each container's name and the container around it (0: the page, around all)."""
    page, names, parents = _Blocks(), [""], [0]
    suspects: dict[int, int] = {}  # elements whose class or identifier is boilerplate
    stack, inside = _Open(), 0
    dropped = -1  # the place of the outermost open element that is no main text
    link, at, n = 0, 0, len(html)
    last_table = max(html.rfind("</table"), html.rfind("</TABLE"))
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if dropped >= 0 and stack.names[-1] == "head" and html[at:lt].strip():
                inside, dropped = stack.cut(len(stack.names) - 1), -1
            if dropped < 0:
                page.add(html[at:lt], link > 0, inside)
        if lt >= n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(html, lt + 1)
        if not m:
            if dropped < 0:
                page.add("<", link > 0, inside)
            at = lt + 1
            continue
        end = _tag_end(html, lt + 1)
        tag, name, closing = html[lt + 1 : end], m[1].lower(), html[lt + 1] == "/"
        at = end + 1
        around, was_dropped = inside, dropped >= 0
        k = stack.ended_by_end(name, lt < last_table, dropped) if closing else stack.ended_by_start(name)
        if k >= 0:
            outer = stack.cut(k)
            if dropped < 0 or k <= dropped:
                inside, dropped = outer, -1
        if dropped < 0:
            if name in BLOCKS:
                page.close(around)
            elif name == "br":
                page.add(" ", False, inside)
        if closing:
            if name == "a" and not was_dropped:
                link = max(0, link - 1)
            continue
        if name in VOID or tag.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
            end = html.find(">", close.start()) if close else -1
            if end >= 0 or name not in ("noscript", "template"):
                at = n if end < 0 else end + 1
                continue
        place = len(stack.names)
        stack.push(name, inside)
        if dropped >= 0:
            continue
        kind = 3 if name in DROPPED else 0 if name in ("html", "body") else _boilerplate(name, tag)
        if kind == 3:
            dropped = place
            continue
        if name == "a":
            link += 1
        if kind or name in CONTAINERS:
            parents.append(inside)
            inside = len(names)
            names.append(name)
            if kind:
                suspects[inside] = kind
    page.close(inside)
    return page.left(suspects, names, parents), names, parents


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines between a surge of the window sums and the next dive."""
    n, out, begin = len(lengths), [], -1
    total = sum(lengths[: window - 1])
    for i in range(n):
        total += lengths[i + window - 1] if i + window - 1 < n else 0
        if begin < 0 and total >= surge and lengths[i] > 0:
            begin = i
        elif begin >= 0 and total < surge:
            out.append((begin, i))
            begin = -1
        total -= lengths[i]
    return out + ([(begin, n)] if begin >= 0 else [])


def main_blocks(html: str | None) -> list[str]:
    lines, names, parents = blocks(html or "")
    if not lines:
        return []
    lengths = [max(0, len(t) - 2 * k) for t, k, _ in lines]
    found = regions(lengths) or [(0, len(lines))]
    low, high = max(found, key=lambda r: (sum(lengths[r[0] : r[1]]), -r[0]))
    within = [0] * len(names)
    for i in range(low, high):
        within[lines[i][2]] += lengths[i] + 1
    # containers have larger numbers than those around them
    inward = range(len(names) - 1, 0, -1)
    for c in inward:
        within[parents[c]] += within[c]
    total = within[0]
    best = next((c for c in inward if names[c] in ("article", "main") and 2 * within[c] > total), 0)
    best = best or next((c for c in inward if 10 * within[c] > 9 * total), 0)
    if not best:
        return [t for t, _, _ in lines[low:high]]
    held = [False] * len(names)
    for c in range(best, len(names)):
        held[c] = c == best or held[parents[c]]
    return [t for t, _, c in lines if held[c]]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one pass over the pages, no shuffle."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), t], ["page_id", "url", "text"])

    small_batches(pages.sparkSession, 128)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(texts, "page_id long, url string, text string")
