"""Main text of web pages by minimum cut.

A page is a sequence of blocks. Every block has two costs: of calling it content and of calling it
boilerplate. They are capacities to the two terminals. Neighbours in the page and children of one
element are tied by edges whose capacity grows with how near they are in the tree. The minimum cut is
the labelling of least total cost.

The costs add what mark-up says (elements and class names that mean navigation, notices, comments; fixed
values below) to what a logistic model says about the text. The model is trained on blocks of a bounded
sample of the pages themselves, labelled by elements whose meaning is certain.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks the model is trained on, at most: those of the pages with the smallest hash of their id.
TRAIN_BLOCKS = 20_000
#: Pages they are taken from, about.
TRAIN_PAGES = 1_000

# Elements by role.
UNREAD = "script style template noscript svg math iframe object embed canvas audio video textarea select datalist title"
#: Their text holds no tags and ends at their end tag only, or with the page.
RAW = "script style textarea title"
#: Their tags, and those of all elements in them, may close themselves by a slash.
FOREIGN = "svg math"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul"
)
BOILERPLATE = "nav footer aside form button dialog menu fieldset label head"
CONTENT = "article main"
HEADINGS = "h1 h2 h3 h4 h5 h6"
# Words in class, id and role that tell what an element is for.
BOILERPLATE_NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr hidden login masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion "
    "recommended related reply replies respond responses search share sharing sidebar signin signup skip social "
    "sponsor sponsored subscribe teaser toc toolbar tags topbar widget alert"
)
# Outside of articles alone.
PAGE_NAMES = "header"
# Names that sections of an article have, too, as ids; text and edges may outvote them there.
SECTION_IDS = "alert disclaimer discussion notice notices reply related responses search share tags"
# What says that an element has, or lacks, the thing named next.
ABOUT = "has no with without"
CONTENT_NAMES = "article content entry main post story body text"
# Log odds of content that mark-up is worth, and capacities of the edges.
BOILERPLATE_ODDS, CONTENT_ODDS, NAME_ODDS, TEXT_LIMIT = -8.0, 3.0, 1.5, 2.0
# Of an ambiguous id inside an article, and of text outside the articles of a page that has some.
SECTION_ODDS, OUTSIDE_ODDS = -3.5, -2.5
NEXT_EDGE, SIBLING_EDGE = 0.6, 0.3

_UNREAD, _FOREIGN, _VOID, _BLOCKS, _BOILERPLATE, _CONTENT, _HEADINGS, _BAD, _PAGE, _GOOD, _SECTION = (
    frozenset(s.split())
    for s in (
        UNREAD, FOREIGN, VOID, BLOCKS, BOILERPLATE, CONTENT, HEADINGS, BOILERPLATE_NAMES, PAGE_NAMES, CONTENT_NAMES,
        SECTION_IDS,
    )
)
#: A tag as most are. It holds no other "<", so a failed match looks no further than the next one.
_PLAIN = re.compile(
    r"<(/?)([a-zA-Z][^\s/><]*+)((?:[\s/]++[^\s/>=\"'<]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s>\"'<]++))?+)*+[\s/]*+)>"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_PAIR = re.compile(r"([^\s/>=]++)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")
_SPACE = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_VALUE = re.compile(r"[^\s>]*+")
#: What ends a raw text, by its element, up to its ">".
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW.split()}
_ABOUT = re.compile(rf"\b(?:{'|'.join(ABOUT.split())})[-_]\S*", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*+:\s*+none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that an opening of the same kind closes, with what they cannot reach beyond.
_CLOSES = {
    name: tuple(closed.split())
    for name, closed in {
        "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"
    }.items()
}
_WALLS = frozenset("ul ol dl table div section article aside main body nav footer header form blockquote".split())
#: End tags that reach beyond walls.
_REACHING = _WALLS | _UNREAD | {"html", "body"}


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes from ``at`` on, the place behind the tag (-1: the page ends before), and whether it closes itself.

    A quote counts only where a value begins. One that never closes ends with the tag. ``last`` has
    the last place of either quote in the page.
    """
    pairs: list[tuple[str, str]] = []
    while True:
        start, at = at, _SPACE.match(page, at).end()
        if at >= len(page):
            return pairs, -1, False
        if page[at] == ">":
            return pairs, at + 1, page[start:at].endswith("/")
        m = _ATTRIBUTE.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _VALUE.match(page, at)
                value, at = m[0].lstrip("\"'"), m.end()
        pairs.append((name, value))


class _Tags:
    """The tags of a page, read from left to right once; comments and declarations have no name."""

    def __init__(self, page: str):
        self.page = page
        self.last = {quote: page.rfind(quote) for quote in "'\""}

    def after(self, at: int) -> tuple[int, int, bool, str, list[tuple[str, str]] | str, bool] | None:
        """Start, end, end tag or not, name, attributes, self-closing; None if no tag begins from ``at`` on.

        A tag that the page breaks off ends with the page and has no name.
        """
        page, size = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if m := _PLAIN.match(page, at):
                return at, m.end(), bool(m[1]), m[2].lower(), m[3], m[3].endswith("/")
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                return at, end + 3 if end >= 0 else size, False, "", "", False
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                return at, end + 1 if end >= 0 else size, False, "", "", False
            if m := _NAME.match(page, at):
                pairs, end, closes = _attributes(page, m.end(), self.last)
                if end < 0:
                    return at, size, False, "", "", False
                return at, end, page[at + 1] == "/", m[1].lower(), pairs, closes
            at += 1
        return None

    def after_raw(self, name: str, at: int) -> int:
        begin = _RAW[name].search(self.page, at)
        end = self.page.find(">", begin.end()) if begin else -1
        return end + 1 if end >= 0 else len(self.page)


class _Open:
    """Names of open elements, with the places of each name and of the walls, so that none is searched for."""

    def __init__(self, walls: frozenset[str]):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.stops, self.walls, self.stopping = [0], [0], walls

    def push(self, name: str) -> None:
        place = len(self.names)
        self.names.append(name)
        self.places.setdefault(name, []).append(place)
        if name in _WALLS:
            self.walls.append(place)
        if name in self.stopping:
            self.stops.append(place)

    def pop(self) -> None:
        name = self.names.pop()
        self.places[name].pop()
        if name in _WALLS:
            self.walls.pop()
        if name in self.stopping:
            self.stops.pop()

    def closed(self, name: str) -> int:
        """The place of the element that an end tag closes; 0 if there is none."""
        place = (self.places.get(name) or [0])[-1]
        return place if name in _REACHING or place > self.walls[-1] else 0

    def replaced(self, name: str) -> int:
        """The place of the element that an opening closes; 0 if there is none."""
        place = max(((self.places.get(c) or [0])[-1] for c in _CLOSES.get(name, ())), default=0)
        return place if place > self.stops[-1] else 0


def _unread_ends(tags: _Tags, at: int, around: list[str]) -> dict[int, int]:
    """Where elements of UNREAD end: the place behind the end tag by the place behind the opening.

    One without an end tag of its own, before the elements around it end, is not there: only its tag
    goes unread.
    """
    opened = _Open(_WALLS | _UNREAD)
    stack: list[tuple[int, bool]] = []
    for name in around:
        opened.push(name)
        stack.append((0, False))
    ends: dict[int, int] = {}

    def close(place: int) -> None:
        while len(stack) > place:
            stack.pop()
            opened.pop()

    while found := tags.after(at):
        _, at, is_end, name, _, closes = found
        if not name:
            continue
        foreign = stack[-1][1]
        if is_end:
            if place := opened.closed(name):
                ends[stack[place][0]] = at
                close(place)
            continue
        if not foreign and name in _RAW:
            at = tags.after_raw(name, at)
            continue
        foreign = foreign or name in _FOREIGN
        if name in _VOID or closes and (foreign or name not in _UNREAD):
            continue
        if place := opened.replaced(name):
            close(place)
        opened.push(name)
        stack.append((at, foreign))
    return ends


@dataclass(slots=True)
class Block:
    """A block of text; ``node`` is the element that it stands in, by its place in the page's elements."""

    text: str
    linked: int
    node: int
    markup: float
    certain: int
    heading: bool
    #: In an article, whatever else is said of it.
    inside: bool = False


@dataclass(slots=True)
class _Element:
    name: str
    odds: float
    certain: int
    heading: bool
    in_link: bool
    node: int
    #: Inline, but not of the block around it: its text is a block of its own.
    apart: bool
    inside: bool


@dataclass(slots=True)
class Page:
    """Blocks in order, and the tree of the elements that hold them: parent and depth of each."""

    blocks: list[Block]
    parents: list[int]
    depths: list[int]


def read_page(text: str | None) -> Page:
    """Never fails: what is not a tag is text, what is open is closed, a tag that breaks off ends the page.

    Time grows with the page: every tag is read once, and no stack is searched.
    """
    text = text or ""
    tags, opened = _Tags(text), _Open(_WALLS)
    stack = [_Element("", 0.0, 0, False, False, 0, False, False)]
    opened.push("")
    page = Page([], [-1], [1])
    # the text not yet in a block, and how much of it is linked, for the block and each element apart in it
    buffers: list[tuple[list[str], list[int]]] = [([], [])]
    ends: dict[int, int] | None = None
    at = 0

    def flush(top: _Element) -> None:
        pieces, linked = buffers[-1]
        if said := " ".join("".join(pieces).split()):
            page.blocks.append(Block(said, sum(linked), top.node, top.odds, top.certain, top.heading, top.inside))
        pieces.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            buffers[-1][0].append(said)
            if stack[-1].in_link:
                buffers[-1][1].append(len(said))

    def close(place: int) -> None:
        while len(stack) > place:
            top = stack.pop()
            opened.pop()
            if top.apart:
                flush(top)
                buffers.pop()
            elif top.name in _BLOCKS:
                flush(top)

    while found := tags.after(at):
        start, end, is_end, name, attributes, closes = found
        say(text[at:start])
        at = end
        if not name:
            continue
        if is_end:
            if name in _BLOCKS:
                flush(stack[-1])
            if place := opened.closed(name):
                close(place)
            continue
        if name == "br":
            buffers[-1][0].append(" ")
            continue
        if name in _BLOCKS:
            flush(stack[-1])
        if name in _VOID or closes and (name in _FOREIGN or name not in _UNREAD):
            continue
        if name in _RAW:
            at = tags.after_raw(name, at)
            continue
        if name in _UNREAD:
            if ends is None:
                ends = _unread_ends(tags, start, opened.names)
            at = ends.get(at, at)
            continue
        if place := opened.replaced(name):
            close(place)
        element = _opened(name, attributes, stack[-1])
        if name in _BLOCKS or element.apart:
            page.parents.append(element.node)
            page.depths.append(page.depths[element.node] + 1)
            element.node = len(page.parents) - 1
        if element.apart:
            buffers.append(([], []))
        stack.append(element)
        opened.push(name)
    say(text[at:])
    flush(stack[-1])
    close(1)
    flush(stack[0])
    if any(b.certain > 0 for b in page.blocks):
        for b in page.blocks:
            if not b.inside and not b.heading and b.markup > OUTSIDE_ODDS:
                b.markup += OUTSIDE_ODDS
    return page


def _opened(name: str, attributes: list[tuple[str, str]] | str, above: _Element) -> _Element:
    odds, certain = above.odds, above.certain
    if name in _BOILERPLATE or name == "header" and certain <= 0:
        odds, certain = BOILERPLATE_ODDS, -1
    elif name in _CONTENT and certain >= 0:
        odds, certain = CONTENT_ODDS, 1
    if attributes and name not in ("html", "body"):
        if isinstance(attributes, str):
            attributes = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _PAIR.finditer(attributes)]
        said: dict[str, str] = {}
        for key, value in attributes:
            said.setdefault(key, html.unescape(value) if "&" in value else value)
        by = {
            key: {w.lower() for w in _WORD.findall(_ABOUT.sub(" ", said[key]))} for key in ("class", "id", "role") if key in said
        }
        names = set().union(*by.values())
        bad = names & _BAD or names & _PAGE if certain <= 0 else names & _BAD
        hidden = (
            "hidden" in said
            or said.get("aria-hidden", "").strip().lower() == "true"
            or bool(_HIDDEN_STYLE.search(said.get("style", "")))
        )
        by_id = bad and certain > 0 and not hidden and not bad & (by.get("class", set()) | by.get("role", set()))
        if by_id and bad <= _SECTION:
            odds, certain = odds + SECTION_ODDS, 0
        elif bad and name not in _CONTENT or hidden:
            odds = min(odds, 0.0) + BOILERPLATE_ODDS if odds > BOILERPLATE_ODDS else odds
            certain = 0 if certain > 0 else certain
        elif names & _GOOD and odds > BOILERPLATE_ODDS / 2:
            odds = min(odds + NAME_ODDS, CONTENT_ODDS + NAME_ODDS)
    apart = name not in _BLOCKS and odds < above.odds
    heading, in_link = above.heading or name in _HEADINGS, above.in_link or name == "a"
    return _Element(name, odds, certain, heading, in_link, above.node, apart, above.inside or name in _CONTENT)


def features(block: Block) -> list[float]:
    """What the model looks at: length, links, punctuation, capitals, and a constant."""
    text, size = block.text, len(block.text)
    said = text.split(" ")
    return [
        1.0,
        min(np.log1p(len(said)), 6.0),
        min(block.linked / size, 1.0),
        min((text.count(".") + text.count(",")) / len(said), 1.0),
        float(text[-1] in ".!?:;…\"'”»"),
        sum(w[:1].isupper() for w in said) / len(said),
    ]


def fit_costs(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; zeros if a class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else 6)
    w = np.zeros(x.shape[1])
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (p - y)) + penalty * w
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True is content. ``odds`` are signed terminal capacities.

    A node whose terminal capacity exceeds all its edges together has its label; its edges then count
    for its neighbours' terminals. Only what this leaves open goes through augmenting paths.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        a = todo.pop()
        if label[a] is None and abs(odds[a]) > sum(near[a].values()):
            label[a] = odds[a] > 0
            for b, c in near[a].items():
                if label[b] is None:
                    odds[b] += c if label[a] else -c
                    del near[b][a]
                    todo.append(b)
            near[a] = {}
    rest = [a for a in range(n) if label[a] is None]
    if not rest:
        return label
    # source feeds positive odds, sink takes negative ones; residual capacities between nodes in ``near``
    excess = {a: odds[a] for a in rest}
    # nodes from which no path leads to the sink any more; later paths cannot open one again
    shut: set[int] = set()
    for source in rest:
        while source not in shut and excess[source] > 1e-12:
            back: dict[int, int] = {source: -1}
            queue, end = [source], None
            for a in queue:
                if excess[a] < -1e-12:
                    end = a
                    break
                for b, c in near[a].items():
                    if c > 1e-12 and b not in back and b not in shut:
                        back[b] = a
                        queue.append(b)
            if end is None:
                shut.update(back)
                break
            path = [end]
            while back[path[-1]] >= 0:
                path.append(back[path[-1]])
            flow = min([excess[source], -excess[end], *(near[b][a] for a, b in zip(path, path[1:]))])
            excess[source] -= flow
            excess[end] += flow
            for a, b in zip(path, path[1:]):
                near[b][a] -= flow
                near[a][b] += flow
    for a in rest:
        label[a] = a in shut
    return label


def edges_of(page: Page) -> list[tuple[int, int, float]]:
    """Neighbours, stronger the more of their way through the tree they share; children of one element."""
    edges, last = [], {}
    parents, depths = page.parents, page.depths
    for i, block in enumerate(page.blocks):
        if i:
            # Between neighbours every element is left or entered once, so the ways up are short in all.
            a, b = page.blocks[i - 1].node, block.node
            deepest = max(depths[a], depths[b])
            while a != b:
                if depths[a] >= depths[b]:
                    a = parents[a]
                else:
                    b = parents[b]
            edges.append((i - 1, i, NEXT_EDGE * depths[a] / deepest))
        parent = parents[block.node]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING_EDGE))
        last[parent] = i
    return edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by two line feeds."""
    tree = read_page(page)
    blocks = tree.blocks
    if not blocks:
        return ""
    said = np.clip(np.array([features(b) for b in blocks]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    odds = [b.markup + float(s) if not b.heading else b.markup + max(0.0, float(s)) for b, s in zip(blocks, said)]
    kept = min_cut(odds, edges_of(tree))
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def train_costs(pages: DataFrame) -> np.ndarray:
    """Model weights from blocks inside elements of certain meaning."""
    total = max(1, pages.count())
    share = min(1.0, TRAIN_PAGES / total)
    drawn = pages.select(F.xxhash64("page_id").alias("draw"), "html")
    drawn = drawn.filter(F.pmod("draw", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def look(batches):
        for batch in batches:
            for draw, page in zip(batch.column("draw").to_pylist(), batch.column("html").to_pylist()):
                rows = [(b.certain, features(b)) for b in read_page(page).blocks if b.certain and not b.heading]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([draw] * len(rows), pa.int64()),
                        pa.array(range(len(rows)), pa.int64()),
                        pa.array([r[0] > 0 for r in rows], pa.bool_()),
                        pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                    ],
                    ["draw", "block", "content", "x"],
                )

    found = drawn.mapInArrow(look, "draw long, block long, content boolean, x array<double>")
    rows = found.orderBy("draw", "block", "content", "x").limit(TRAIN_BLOCKS).collect()
    x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, 6))
    return fit_costs(x, np.array([float(r["content"]) for r in rows]))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    A null or empty page, and one without content, has an empty text and 0 characters. Nothing is cut:
    whole pages are read. Repeated rows give repeated rows; other columns are not looked at.
    """
    weights = train_costs(pages) if weights is None else weights

    def read(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
