"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text, and every line has a
weight, its number of characters. Sums of weights over windows of ``WINDOW``
lines form the distribution. A dive is a window without weight, a surge one whose
sum is over the threshold, ``SHARE`` of the page's densest window, ``SURGE`` at most.

Lines stand in boxes: the innermost div or section, told apart by the names and
classes on the way to it, or the page itself. Between lines of different boxes
there is a dive. Text is where sums surge between two dives, and grows from
there: a box that surges keeps all its lines, so do the boxes around it, and
headings go with the line after them. So short boxes beside dense ones are left
out whatever their names, and short paragraphs of a dense box are kept.

Where an article (or main) element holds text, its lines are one box, and lines
outside have weight only in a box ``DENSER`` times as long as the article.

Lines of menus, page headers and footers, sidebars, notices, adverts, forms
and reader comments (by element, class, id or role) have no weight, nor have lines
outside paragraphs and headings that are mostly links, nor boxes (other than the
longest) that are, by ``BOX_LINKS``.

Tags nest as browsers nest them: end tags that may be left out are implied, and
an element that lacks its end tag ends with its parent. What such an element's name or class says
holds up to the first paragraph, heading or division in it only. Inline elements that are no part
of the article are cut out of their line. A class, id or form around the page's first article
says nothing, and of an article its own header counts.

Scripts, styles, comments and other hidden content are removed whole. Character references are
decoded, white space within a block becomes one space, blocks are joined by two
line ends in page order. Nothing else is dropped or capped; a page of a single
short line has that line for a text. Null and empty pages, and pages of menus
alone, give an empty text. Texts of any length are read whole, in time about
proportional to it. Repeated rows give a row each. Other columns of ``pages`` are not
read, whatever their names.
"""
from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import pieces, strings

WINDOW, SURGE, SHARE, DENSER = 3, 150, 0.5, 20
#: Share of a line's characters inside links from which on it is taken for a menu.
LINKS = 0.7
BOX_LINKS = 0.5
PIECE_BYTES = 8 << 20

#: Elements whose content is no markup; the first two run to the end of the page if they are not closed.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template")
HIDDEN = frozenset("svg object canvas select audio video".split()) | frozenset(RAW)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
BLOCKS = HEADINGS | TABLE | frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav ol p pre search section summary ul".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button search".split())
#: Blocks that may well be one link without being a menu.
PROSE = HEADINGS | frozenset("p pre blockquote figcaption dd caption".split())
#: Elements that make a box of their lines.
BOXES = frozenset(["div", "section"])
#: Where what an element without an end tag says is over.
STARTS = HEADINGS | frozenset("p div article main section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags may be left out, and what ends them besides their parent.
OPTIONAL = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": CELLS, "th": CELLS, "tr": frozenset(["tr"])}
KEEP_P = frozenset("body head html legend caption thead tbody tfoot tr td th li dd dt".split())

#: Words of a class, id or role that mark an element as no part of the article.
MARKS = frozenset("adverts advert advertisement advertising sponsor sponsored promo gdpr consent popup modal sidebar nav navbar navigation breadcrumb breadcrumbs comment comments disqus newsletter subscribe signup login masthead pagination pager copyright toolbar contentinfo complementary kommentar kommentare leserkommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicidad anuncio anuncios publicite".split())
#: Words that do so only next to each other and to the words below them, as in "related-posts" but not in "related-work".
WEAK = frozenset("ad ads promotion banner cookie cookies notice notices notification alert overlay aside menu header head footer foot discussion replies reply respond share sharing social related recommended subscription search form widget dialog skip teaser teasers".split())
FILLER = frozenset("a the to box bar block section area list links link buttons button icons icon posts articles items item stories widget container wrapper wrap outer inner top bottom left right global site sticky fixed row col column panel module region slot unit policy message danger info warning success primary secondary input field group".split())
#: Words that belong to the article in "article-header" and to the rest in "article-share".
OWN, FRAME, HEAD = frozenset("article post entry content body main text".split()), frozenset("header head footer foot banner form aside menu notice".split()), frozenset(["header", "head"])
#: Words that name the first lines of an article where paragraphs have them.
LEAD = frozenset(["teaser"])
#: Words that make a class describe a page's layout.
LAYOUT = frozenset("with has no without layout".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^<>]*+)>"
    r"|<[!?/][^<>]*+>",
    re.S,
)
#: What an end tag, and a start tag that ends an open element of its kind, doesn't reach beyond.
_SCOPE = {name: tuple({"table"} - {name}) if name in TABLE else ("table", "caption", "td", "th") + (("ul", "ol", "menu", "dir") if name == "li" else ()) for name in BLOCKS - {"html", "body"}} | {"html": (), "body": ()}
_SIBLINGS = {name: ("table",) if name in TABLE else tuple(BLOCKS - same - {"address", "div", "p"}) for name, same in OPTIONAL.items()}
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marked(rest: str, spare: frozenset = frozenset()) -> bool:
    """Whether an element's class, id or role says that it is no part of an article, by other words than those to ``spare``."""
    for values in _MARK.findall(rest):
        for name in "".join(values).split():
            words = {w.lower() for w in _WORD.findall(name)}
            if not words or words & LAYOUT:
                continue
            if words & MARKS:
                return True
            weak = words & WEAK
            if weak and not weak <= spare and words <= WEAK | FILLER | (frozenset() if weak & FRAME else OWN):
                return True
    return False


class Element:
    __slots__ = ("name", "rest", "depth", "end", "explicit", "first", "gone")

    def __init__(self, name: str, rest: str, depth: int):
        self.name, self.rest, self.depth = name, rest, depth
        self.end, self.explicit, self.gone = 0, False, False
        self.first = 0  # where the first element of STARTS in it begins


def parse(page: str) -> list:
    """The page as its strings, its elements where they begin, and None where a block ends; every element knows the place where it ends."""
    out: list = [""]
    stack: list[Element] = []
    opened: dict[str, list[Element]] = {}
    unending: set[str] = set()

    def close(e: Element, explicit: bool = False) -> None:
        """Ends an element and all that is open in it."""
        for x in stack[e.depth :]:
            if not x.gone:
                x.end = len(out)
                opened[x.name].pop()
        del stack[e.depth :]
        e.explicit = explicit

    def innermost(names, stops) -> Element | None:
        """The last opened element of these names unless one of the stops was opened in it."""
        found = max((opened[n][-1] for n in names if opened.get(n)), key=lambda e: e.depth, default=None)
        if found and any(opened[n][-1].depth > found.depth for n in stops if opened.get(n)):
            return None
        return found

    at, size = 0, len(page)
    while at < size and (m := _MARKUP.search(page, at)):
        if m.start() > at:
            out.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if name in BLOCKS:
                e = innermost(HEADINGS if name in HEADINGS else (name,), _SCOPE[name])
                if e:
                    close(e, True)
                out.append(None)
            elif opened.get(name):
                e = opened[name].pop()  # blocks within it stay open
                e.end, e.explicit, e.gone = len(out), True, True
            continue
        if name in RAW:
            end = None if name in unending else _END[name].search(page, at)
            if end:
                at = end.end()
                continue
            unending.add(name)
            if name in RAW[:2]:
                return _ended(out, stack)
        if name in VOID:
            out.append(" " if name == "br" else None if name == "hr" else "")
            continue
        if name in BLOCKS:
            if name not in KEEP_P and opened.get("p") and (e := innermost(("p",), _SCOPE["p"])):
                close(e)
            if name in OPTIONAL and (e := innermost(OPTIONAL[name], _SIBLINGS[name])):
                close(e)
            elif name in HEADINGS and stack and stack[-1].name in HEADINGS:
                close(stack[-1])
        e = Element(name, m["rest"] or m["rest2"] or "", len(stack))
        if name in STARTS:
            for above in reversed(stack):
                if above.first:
                    break
                above.first = len(out)
        out.append(e)
        stack.append(e)
        opened.setdefault(name, []).append(e)
    out.append(page[at:])
    return _ended(out, stack)


def _ended(out: list, stack: list[Element]) -> list:
    """With the elements that are still open ended."""
    for e in stack:
        if not e.gone:
            e.end = len(out)
    return out


class Lines:
    """A page's lines in order: text, weight, characters in links, whether the article's, whether a heading, and box; and the box around each box."""

    def __init__(self):
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.linked: list[int] = []
        self.inside: list[bool] = []
        self.heading: list[bool] = []
        self.boxes: list[int] = []
        self.around: list[int] = [-1]  # box 0 is the page

    def add(self, text: str, weight: int, linked: int, inside: bool, heading: bool, box: int) -> None:
        self.texts.append(text)
        self.weights.append(weight)
        self.linked.append(linked)
        self.inside.append(inside)
        self.heading.append(heading)
        self.boxes.append(box)


def lines(page: str) -> Lines:
    """The page's lines. Lines without text stand for the edges of the article."""
    found = parse(page)
    main = _article(found)
    following = [len(found)] * len(found)  # where the next block begins or ends
    for k in range(len(found) - 2, -1, -1):
        after = found[k + 1]
        following[k] = k + 1 if after is None or isinstance(after, Element) and after.name in BLOCKS else following[k + 1]
    titles = [] if main else [k for k, e in enumerate(found) if isinstance(e, Element) and e.name == "h1"]
    out = Lines()
    known: dict[tuple[int, str, str], int] = {}
    open_: list[tuple[int, int]] = [(len(found) + 1, 0)]  # where the open boxes end
    text: list[str] = []
    linked, block = 0, ""
    off = cut = link = article = 0  # up to where the page is no part of the article, cut out of its line, a link, the article

    def end(at: int) -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                menu = linked >= LINKS * len(line) and at > article and block not in PROSE
                out.add(line, 0 if at <= off or menu else len(line), linked, at <= article, block in HEADINGS, open_[-1][1])
            text.clear()
            linked = 0

    def edge() -> None:
        for _ in range(WINDOW):
            out.add("", 0, 0, False, False, 0)

    for k, e in enumerate(found):
        if isinstance(e, str):
            if k >= cut:
                text.append(e)
                linked += len(e) if k < link else 0
            continue
        if e is None or e.name in BLOCKS:
            end(k)
            block = "" if e is None else e.name
        while open_[-1][0] <= k:
            open_.pop()
        if article and k >= article:
            edge()
            article = 0
        if e is None or k < off or k < cut:
            continue
        until = e.end if e.explicit or e.name in OPTIONAL or e.name == "p" or not e.first else e.first
        name, rest = e.name, e.rest
        holds = k < main < e.end
        if name in HIDDEN:
            cut = until
        elif name == "a":
            link = e.end if e.explicit else min(e.end, following[k])
        elif no_part(e, holds or name == "form" and bisect_left(titles, e.end) > bisect_left(titles, k), article > 0):
            if name in BLOCKS:
                off = until
            else:
                cut = until
        elif name in ("article", "main") and not article:
            edge()
            article = e.end
        if name in BOXES and k >= off:
            kind = (open_[-1][1], name, "".join((_CLASS.search(rest) or [""])[0].split()))
            if kind not in known:
                known[kind] = len(out.around)
                out.around.append(kind[0])
            open_.append((e.end, known[kind]))
    end(len(found))
    return out


def no_part(e: Element, around: bool, within: bool) -> bool:
    """Whether an element is no part of the article. around: it has the article in it; within: it is in the article."""
    if e.name in OUTSIDE and not (e.name == "header" and within) and not (e.name == "form" and around):
        return True
    return bool(e.rest) and e.name not in ("html", "body", "main") and not around and marked(e.rest, (FRAME if e.name in HEADINGS else HEAD if within else frozenset()) | (LEAD if e.name in PROSE else frozenset()))


def _article(found: list) -> int:
    """Where the first article or main element is that neither its own name or class nor elements around it take out of the page; 0 without any."""
    off = 0
    for k, e in enumerate(found):
        if isinstance(e, Element) and k >= off:
            if e.name in ("article", "main"):
                if e.name == "main" or not marked(e.rest):
                    return k
            elif e.name in OUTSIDE and e.name != "form":
                off = e.end if e.explicit or not e.first else e.first
    return 0


def weighed(page: Lines) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights by the page's own links and article, the lines' boxes (-1: the article), and whether there is one."""
    weights, linked, boxes = (np.array(x, np.int64) for x in (page.weights, page.linked, page.boxes))
    inside = np.array(page.inside, bool)
    long, links = (np.bincount(boxes, x * (weights > 0), len(page.around)) for x in (weights, linked))
    menus = (links >= BOX_LINKS * long) & (long < long.max(initial=0))
    menus[0] = False
    weights[menus[boxes]] = 0
    own = int((weights * inside).sum())
    if own:
        boxes[inside] = -1
        outside = np.bincount(boxes[~inside], weights[~inside], len(page.around)) > DENSER * own
        weights[~inside & ~outside[boxes]] = 0
    return weights, boxes, own > 0


def kept(weights: np.ndarray, least: float, window: int = WINDOW) -> list[int]:
    """The lines with weight where windows surge between two dives."""
    to = np.minimum(np.arange(len(weights)) + window, len(weights))
    total, any_ = (np.concatenate([[0], np.cumsum(x)]) for x in (weights, weights > 0))
    stretch = np.cumsum(any_[to] == any_[:-1])  # dives so far
    surges = np.bincount(stretch, total[to] - total[:-1] > least * (1 + 1e-9)) > 0
    return np.flatnonzero((weights > 0) & surges[stretch]).tolist()


def chosen(page: Lines, window: int = WINDOW, surge: float = SURGE) -> list[int]:
    """The lines of the main text."""
    weights, boxes, article = weighed(page)
    used = weights * (boxes == -1) if article else weights
    total = np.concatenate([[0], np.cumsum(used)])
    densest = int((total[np.minimum(np.arange(len(used)) + window, len(used))] - total[:-1]).max(initial=0))
    at = np.flatnonzero(weights > 0)
    shift = np.zeros(len(weights), np.int64)  # room for a dive before each line whose box is another than that of the line before
    shift[at[1:]] = window * (boxes[at[1:]] != boxes[at[:-1]])
    place = np.arange(len(weights)) + np.cumsum(shift)
    spread = np.zeros(int(place[-1]) + 1 if len(place) else 0)
    spread[place] = weights
    surging = set(boxes[np.searchsorted(place, kept(spread, min(surge, SHARE * densest), window))].tolist())
    for box in list(surging):
        while box > 0 and (box := page.around[box]) not in surging:
            surging.add(box)
    out: list[int] = []
    last = False  # whether the line after is kept
    for i in reversed(at.tolist()):
        last = int(boxes[i]) in surging or last and page.heading[i]
        if last:
            out.append(i)
    return out[::-1]


def main_text(page: str, window: int = WINDOW, surge: float = SURGE) -> str:
    found = lines(page)
    return "\n\n".join(found.texts[i] for i in chosen(found, window, surge))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PIECE_BYTES):
                texts = [main_text(p) for p in strings(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
