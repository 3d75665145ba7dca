"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a block element begins a line, inline elements and <br> don't. What the page itself marks as
menu, header, footer, sidebar, notice, advert, form or comments - by element, role, or a class or id that is made of such
names only - is stripped with the markup. Inside an article only names of these kinds count; an element with another name of page furniture
(widget, share, login ...) goes there if it holds a control or is links for the most part. A form that holds most of a page's text is
no form. Borders of containers leave empty lines: `WINDOW` at the borders of an article or
main and where nothing smaller than the page holds both sides, two for each border crossed elsewhere, none inside an
article. A container without containers is a paragraph of the one around it.

A line's length is its text's, less that of links outside an article. A line's block is the sum of lengths over the
window of `WINDOW` lines that it begins. The text surges where the sums rise from zero to more than `SURGE` (inside an
article, to anything; on a page without a surge, everywhere), and dives where they are zero again. Where a surge lies in an
article or main, the one with the most text is the page's, and what lies between it and its dive is kept, with that of all articles
beside it in the same element; otherwise what lies between the first surge and the last dive, and the lines next to them in the same
element (short first and last paragraphs) with a main heading before them.

What is text: of elements that show something else than their content (iframe, object, video, audio, canvas) the content
isn't, nor that of script, style, noscript, template, title; button, select and textarea are parts of forms; formulas
(math) and the texts of drawings (svg) are.

Defined cases: null or empty html gives an empty text; unclosed elements, comments and scripts run to the end of their
parent or the page; text outside any element counts as a block; very long pages are parsed whole, in time in proportion to
their length; of surges with equal text the first wins; repeated rows give repeated rows; extra columns are
ignored, clashing names too; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_column

WINDOW = 3
SURGE = 86
#: Empty lines that a container's border leaves.
BORDER = 2

# Fixed sets of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style noscript template iframe object textarea select title head audio video canvas".split())
#: Of those, the ones whose content isn't markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that are tracked as open.
HOLDERS = frozenset(
    "article aside blockquote body button center details dialog div dl fieldset figure footer form header main menu nav ol search section table td ul".split()
)
#: Of those, the ones whose borders leave empty lines.
CONTAINERS = frozenset("article aside body center dialog div footer form header main menu nav search section td".split())
ARTICLES = frozenset("article main".split())
BOILERPLATE = frozenset("aside button dialog footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names of boilerplate. A class or id is one if it is made of these and of `PLAIN` words only (`ad-box`, `siteFooter`).
NAMES = frozenset(
    "ad ads advert advertisement advertising advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promos promotion related replies reply respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split()
)
PLAIN = frozenset(
    "area articles bar block blocks bottom box buttons col column container footer form global group icons inner item items left links list main media "
    "module outer page panel posts reader readers right row section sections site slot stories thread top unit user users wrap wrapper zone".split()
)
#: Of those, names of what an article holds too: inside one they count only where there are controls or mostly links.
WEAK = frozenset("disclaimer login newsletter overlay related respond share sharing shares signup skip social subscribe subscription widget widgets".split())
#: Elements that one fills in or presses.
CONTROLS = frozenset("button input select textarea".split())
#: Names that mean an article's own title inside one.
TITLES = frozenset("banner header masthead".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Holder:
    """An open element. own: it is boilerplate by itself; firm: so by more than its name; weak: perhaps by its name."""

    __slots__ = ("name", "parent", "boiler", "firm", "free", "article", "outer", "box", "depth", "plain", "page", "form", "weak", "chars", "links", "control")

    def __init__(self, name: str, parent: _Holder | None, own: bool = False, firm: bool = False, weak: bool = False):
        self.name, self.parent = name, parent
        #: The outermost form around it that isn't in an article; what is boilerplate only by that isn't marked so here.
        self.form = parent.form if parent else None
        if name == "form" and not (parent and parent.article):
            self.form, own = self.form or self, False
        #: The innermost element around it that is perhaps boilerplate; characters in it, those of links, and whether it has controls.
        self.weak = self if weak else parent.weak if parent else None
        self.chars, self.links, self.control = 0, 0, False
        self.boiler = own or bool(parent and parent.boiler)
        self.firm = firm or bool(parent and parent.firm)
        outermost = name in ARTICLES and not (parent and parent.article)
        #: Boilerplate, if the names around the outermost article or main don't count.
        self.free = self.firm if outermost else own or bool(parent and parent.free)
        self.article = name in ARTICLES or bool(parent and parent.article)
        self.outer = self if outermost else parent.outer if parent else None
        self.page = parent is None or name == "body"
        self.plain = True  # holds no container
        self.box, self.depth = self, parent.depth + 1 if parent else 0
        if parent and name not in CONTAINERS:
            self.box, self.depth = parent.box, parent.depth
        elif parent and not own:
            parent.box.plain = False


    def furniture(self) -> bool:
        """Whether an element around it with a name of page furniture has controls, or is links for the most part."""
        h = self.weak
        while h is not None:
            if h.control or 2 * h.links > h.chars:
                return True
            h = h.parent.weak if h.parent else None
        return False


class Line:
    """A line of text: its holder, the characters of its links, the outermost container between it and the line before, and whether it is
    a main heading."""

    __slots__ = ("text", "holder", "links", "between", "heading")

    def __init__(self, text: str, holder: _Holder, links: int, between: _Holder, heading: bool):
        self.text, self.holder, self.links, self.between, self.heading = text, holder, links, between, heading


def _named(value: str, inside_article: bool) -> tuple[bool, bool]:
    """(a class or id is a name of boilerplate, perhaps is one)."""
    weak = False
    for token in value.split():
        parts = [w.lower() for w in _WORD.findall(token)]
        names = {"".join(parts)} & NAMES or (set(parts) & NAMES if PLAIN.union(NAMES).issuperset(parts) else set())
        if names and inside_article and names <= WEAK | TITLES:
            weak = weak or not names <= TITLES
        elif names:
            return True, False
    return False, weak


def _is_boilerplate(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """(is boilerplate, by more than a name that the page chose, perhaps is by its name)."""
    if name == "form":  # some pages are one form
        return True, inside_article, False
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return True, True, False
    own = weak = False
    if name not in ARTICLES and name != "body":
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "role" and value.lower() in ROLES:
                return True, True, False
            if key in ("class", "id"):
                found = _named(value, inside_article)
                own, weak = own or found[0], weak or found[1]
    return own, False, weak


def lines_of(html: str) -> list[Line]:
    """The lines that have text, in page order."""
    root = at = between = _Holder("", None)
    lines: list[Line] = []
    text: list[str] = []
    links: list[str] = []
    opened: dict[str, int] = {}
    in_link = heading = False
    pos, n = 0, len(html)

    def flush() -> None:
        nonlocal between, in_link
        if text:
            if line := " ".join(unescape("".join(text)).split()):
                n_links = sum(len(" ".join(unescape(x).split())) for x in links)
                lines.append(Line(line, at, n_links, between, heading))
                between, weak = at.box, at.weak
                while weak is not None:
                    weak.chars, weak.links = weak.chars + len(line), weak.links + n_links
                    weak = weak.parent.weak if weak.parent else None
            text.clear()
            links.clear()
        in_link = False

    def put(piece: str) -> None:
        text.append(piece)
        if in_link:
            links.append(piece)

    while pos < n:
        m = _TAG.search(html, pos)
        if m is None:
            put(html[pos:])
            break
        if m.start() > pos:
            put(html[pos : m.start()])
        pos = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in CONTROLS and at.weak is not None:
            at.weak.control = True
        if name in SKIPPED and not closing:
            if name in BLOCKS:
                flush()
            if attributes.endswith("/") and name not in RAW:
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(html, pos)
            if name == "head" and end is None:  # an unclosed head ends where the body begins
                end = re.compile(r"(?=<body\b)", re.I).search(html, pos)
            pos = end.end() if end else n
        elif name in HOLDERS:
            flush()
            if not closing:
                at = _Holder(name, at, *_is_boilerplate(name, attributes, at.article))
                opened[name] = opened.get(name, 0) + 1
            elif opened.get(name):
                found = False
                while not found:
                    found = at.name == name
                    opened[at.name] -= 1
                    at = at.parent
                if at.depth < between.depth:
                    between = at.box
        elif name in BLOCKS:
            flush()
            heading = name == "h1" and not closing
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not closing
    flush()
    return lines


def empty_lines(a: Line, b: Line, between: _Holder) -> int:
    """How many the markup leaves between two lines; between: the innermost container that holds both."""
    x, y = (h.parent.box if h.plain and h.name not in ARTICLES and not h.page and not h.parent.box.page else h for h in (a.holder.box, b.holder.box))
    low = min(between.depth, x.depth, y.depth)
    borders = x.depth + y.depth - 2 * low
    if not borders or between.article:
        return 0
    return WINDOW if between.page or a.holder.article or b.holder.article else BORDER * borders


def regions(lengths: list[int], least: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of each run of blocks of which one has more than its line's least, in page order."""
    out, begin, surges, total = [], None, False, sum(lengths[:window])
    for i in range(len(lengths) + 1):
        if total:
            begin = i if begin is None else begin
            surges = surges or total > least[i]
        elif begin is not None:
            while not lengths[begin]:
                begin += 1
            if surges:
                out.append((begin, i))
            begin, surges = None, False
        if i < len(lengths):
            total += (lengths[i + window] if i + window < len(lengths) else 0) - lengths[i]
    return out


def _own_lines(lines: list[Line]) -> list[Line]:
    """Those that the page doesn't mark as something else than its text."""
    chars = sum(len(x.text) for x in lines if not x.holder.boiler)
    forms: dict[_Holder, int] = {}
    for x in lines:
        if x.holder.form and not x.holder.boiler:
            forms[x.holder.form] = forms.get(x.holder.form, 0) + len(x.text)
    left_out = {f for f, n in forms.items() if 2 * n <= chars}
    boiler = [x.holder.boiler or x.holder.form in left_out or x.holder.furniture() for x in lines]
    if not any(x.holder.article and not b for x, b in zip(lines, boiler, strict=True)):
        # The names of what is around the page's only articles or main don't make them boilerplate, nor does a form.
        boiler = [x.holder.free or x.holder.furniture() if x.holder.article else b for x, b in zip(lines, boiler, strict=True)]
    return [x for x, b in zip(lines, boiler, strict=True) if not b]


def _beside(at: list[Line | None], places: range, holder: _Holder) -> int | None:
    """The farthest of the places up to which lines are in the holder itself, and aren't links only."""
    last = None
    for i in places:
        x = at[i]
        if x is not None:
            if x.holder is not holder or x.links >= len(x.text):
                break
            last = i
    return last


def main_text(html: str | None) -> str:
    every = lines_of(html or "")
    kept = set(map(id, _own_lines(every)))
    at: list[Line | None] = []  # lines and empty lines
    last, between = None, None
    for x in every:
        between = x.between if between is None or x.between.depth < between.depth else between
        if id(x) not in kept:
            continue
        if last is not None:
            at += [None] * empty_lines(last, x, between)
        at.append(x)
        last, between = x, None
    lengths = [0 if x is None else len(x.text) if x.holder.article else max(0, len(x.text) - x.links) for x in at]
    found = regions(lengths, [0 if x is not None and x.holder.article else SURGE for x in at] + [0])
    found = found or regions(lengths, [0] * (len(at) + 1))
    inside = [(a, z) for a, z in found if at[a].holder.article]
    if inside:
        best = max(inside, key=lambda r: sum(lengths[slice(*r)]))
        outer = at[best[0]].holder.outer
        found = [r for r in inside if r == best or at[r[0]].holder.outer is not outer and at[r[0]].holder.outer.parent is outer.parent]
    elif found:
        a, z = found[0][0], found[-1][1]
        up, down = _beside(at, range(a - 1, -1, -1), at[a].holder), _beside(at, range(z, len(at)), next(at[i] for i in range(z - 1, a - 1, -1) if at[i]).holder)
        a, z = a if up is None else up, z if down is None else down + 1
        before = next((i for i in range(a - 1, -1, -1) if at[i] is not None), None)
        found = [(before if before is not None and at[before].heading and not at[a].heading else a, z)]
    return "\n".join(x.text for a, z in found for x in at[a:z] if x is not None)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    name = free_name(src, "main")
    out = with_column(src, ["html"], lambda c: pa.array([main_text(x) for x in c.to_pylist()], pa.string()), name, "string")
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
