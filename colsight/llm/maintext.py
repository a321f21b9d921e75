"""Main text of web pages by a minimum cut over their blocks.

A page is cut at block tags into blocks of text that remember the elements around them. Each block gets a cost for
being called content and one for being called boilerplate, from log-odds: what the enclosing elements say (`nav`,
`article`, or with less weight a class such as `cookie-banner`; what is around an `article` or `main` says nothing
against it) and a logistic regression on the block itself (length, link share, closing
punctuation, heading, list item). The costs are the capacities to the two terminals; edges between neighbours on the page and between
neighbours under one element carry the price of telling them apart. The maximum flow leaves the cheapest labelling,
and blocks that the source still reaches are content.

The regression is fitted on blocks whose enclosing elements leave no doubt, from about FIT_PAGES pages chosen by a
hash of page_id; where they do not show both classes, PRIOR stays. Pages are read whole.

Defined cases: null and empty pages, and pages without content, give an empty text; unclosed and stray tags are
tolerated; each row is a page of its own, whatever its page_id; an empty table gives an empty result. Columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import table

FIT_PAGES = 2_000
#: Weights of (1, log(1 + words), share of words in links, closing punctuation, heading, list item).
PRIOR = np.array([-1.8, 0.8, -4.0, 0.8, 1.0, -0.3])
#: Log-odds of certain surroundings, of names of boilerplate and of content, and the most of a block by itself. Prices of parting neighbours on the page under one element
#: and under two, and neighbours under one element.
CERTAIN, NAMED, LIKELY, OWN = 12.0, 5.0, 3.0, 4.5
NEXT, APART, SIBLING = 0.5, 0.1, 0.5

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "annotation", "annotation-xml", "canvas", "audio", "video", "select", "button", "textarea", "head", "title", "datalist"}
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript")}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
HOME = {"article", "main"}
#: Elements that hold one block; neighbours are told by what is around them.
INNER = HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "td", "th", "tr", "tbody", "thead"}
NAMES_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|login|nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|widgets?|footer|foot|header|masthead|topbar|toolbar|comments?|"
    r"respond|replies|disqus|discussion|share|sharing|social|related|recommend\w*|tags|pagination|pager|skip|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
NAMES_HOME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?=$|[\s_-])", re.I)
ROLES_AWAY = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
ROLES_HOME = {"main", "article"}


#: Class and id words that say what an element has or lacks, not what it is; and those that name parts of an article.
MODIFIER = re.compile(r"(?:no|not|has|have|with|without|is|hide|show|js)[_-]|.*[_-](?:open|opened|closed|enabled|disabled|active|visible|hidden|page|layout)$", re.I)
ARTICLE_PART = re.compile(r"(?:entry|post|article|story|content|page)[_-](?:header|title|heading|body|content|text)$", re.I)
NAMES_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|respond|replies|disqus|discussion)(?=$|[_-])", re.I)
#: Elements around an article that say nothing against it.
AROUND = {"form", "fieldset", "header"}


@dataclass
class Element:
    name: str
    parent: Element | None = None
    #: home or away by element or role, named (away by class or id), comments (so named), hint (a name of content)
    mark: str = ""
    hidden: bool = False
    #: It is around an article and so no boilerplate as a whole.
    excused: bool = False

    def chain(self) -> Iterator[Element]:
        element: Element | None = self
        while element is not None:
            yield element
            element = element.parent

    def place(self) -> tuple[float, bool]:
        """Log-odds by the element and what is around it, the inner ones first, and whether they leave no doubt."""
        hint = 0.0
        for e in self.chain():
            if e.mark == "home":
                return CERTAIN, True
            if e.mark == "hint":
                hint = LIKELY
            elif e.mark and not e.excused:
                return (-CERTAIN, True) if e.mark == "away" else (hint - NAMED, False)
        return hint, False


@dataclass
class Block:
    element: int
    around: Element
    heading: bool
    item: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    place: float = 0.0
    sure: bool = False


def _named(names: str) -> str:
    """What class and id say: named, comments, hint or nothing."""
    found = ""
    for word in names.split():
        if MODIFIER.match(word):
            continue
        if NAMES_COMMENTS.search(word):
            return "comments"
        if NAMES_AWAY.search(word) and not ARTICLE_PART.match(word):
            found = "named"
        elif not found and NAMES_HOME.search(word):
            found = "hint"
    return found


def _placed(name: str, attributes: str, around: Element) -> Element:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    element = Element(name, around, hidden=around.hidden or "hidden" in found)
    if name in ("html", "body"):
        return element
    named = _named(f"{found.get('class', '')} {found.get('id', '')}")
    marks = [e.mark for e in around.chain()]
    inside = next((m for m in marks if m in ("home", "away", "named", "comments")), "") == "home"
    if name in HOME or role in ROLES_HOME:
        main = name == "main" or role == "main"
        # Teasers in navigation and comments are often articles of their own.
        closed = any((e.mark == "away" and e.name not in AROUND) or e.mark == "comments" for e in around.chain() if not e.excused)
        if main or not (closed or named in ("named", "comments")):
            element.mark = "home"
            for e in around.chain():
                e.excused = True
            return element
    if name in AWAY or role in ROLES_AWAY or (name == "header" and not inside):
        element.mark = "away"
    elif not (name == "header" and named == "named"):
        element.mark = named
    return element


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    blocks: list[Block] = []
    stack, numbers, made, links, silent = [Element("")], [0], 1, 0, 0
    current: Block | None = None

    def say(piece: str) -> None:
        nonlocal current
        if silent or stack[-1].hidden or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            top = stack[-1]
            around = next(n for e, n in zip(reversed(stack), reversed(numbers)) if e.name not in INNER)
            current = Block(around, top, top.name in HEADINGS, any(e.name in ("li", "dt", "dd") for e in stack))
            blocks.append(current)
        current.parts.append(piece)
        if links:
            current.linked.append(piece)

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in SILENT:
            if not closing and name in RAW:
                end = RAW[name].search(page, at)
                at = end.end() if end else len(page)
            elif not (m[3] or m[6] or "").endswith("/"):
                silent = max(0, silent - 1) if closing else silent + 1
            continue
        if name == "body":
            silent = 0
        if name == "a":
            links = 0 if closing else 1
        elif name in ("br", "img", "input", "wbr"):
            say(" ") if name != "wbr" else None
        if name not in BLOCKS:
            continue
        current = None
        if closing:
            if name in (e.name for e in stack):
                while stack.pop().name != name:
                    numbers.pop()
                numbers.pop()
        elif name not in VOID:
            if stack[-1].name == name == "p" or (stack[-1].name == "p"):
                stack.pop()
                numbers.pop()
            stack.append(_placed(name, m[3] or m[6] or "", stack[-1]))
            numbers.append(made)
            made += 1
    for block in blocks:
        block.place, block.sure = block.around.place()
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in blocks if b.text]


def features(blocks: list[Block]) -> np.ndarray:
    rows = np.zeros((len(blocks), len(PRIOR)))
    for k, b in enumerate(blocks):
        words = len(b.text.split())
        linked = len("".join(b.linked).split())
        rows[k] = 1, np.log1p(words), min(1.0, linked / max(1, words)), b.text[-1] in ".!?…:;\"'»”", b.heading, b.item
    return rows


def cut(places: list[float], chains: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum-cut labels of nodes with log-odds `places` and undirected edges (a, b, price): blocking flows along
    shortest paths (Dinic)."""
    n = len(places)
    source, sink = n, n + 1
    if all(p > 0 for p in places) or all(p <= 0 for p in places):
        return [p > 0 for p in places]
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, p in enumerate(places):
        edge(source, k, p, 0.0) if p > 0 else edge(k, sink, -p, 0.0)
    for a, b, price in chains:
        edge(a, b, price, price)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while nexts[a] < len(heads[a]):
                e = heads[a][nexts[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                nexts[a] += 1
                continue
            path.append(e)
            a = to[e]


def extract(page: str, weights: np.ndarray) -> str:
    """The main text of a page."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    own = np.clip(features(blocks) @ weights, -OWN, OWN)
    places = [b.place + (0.0 if b.sure else float(x)) for b, x in zip(blocks, own)]
    chains = [(k - 1, k, NEXT if blocks[k - 1].element == blocks[k].element else APART) for k in range(1, len(blocks))]
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.element in last:
            chains.append((last[b.element], k, SIBLING))
        last[b.element] = k
    content = cut(places, chains)
    return "\n".join(b.text for b, yes in zip(blocks, content) if yes)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Ridge logistic regression by Newton steps on the blocks of a bounded sample of pages (page_id, html)."""
    n_pages = pages.count()
    place = F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(-1)), F.lit(8)), F.lit(1 << 30))
    sample = pages.where(place < F.lit(int(min(1.0, fit_pages / max(1, n_pages)) * (1 << 30)))).select("html")
    width = len(PRIOR)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                blocks = [b for b in blocks_of(page.as_py() or "") if b.sure]
                rows = features(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.astype("<f4").tobytes()]), pa.array([bytes(b.place > 0 for b in blocks)])], names=["rows", "content"]
                )

    collected = sample.mapInArrow(grams, "rows binary, content binary").collect()  # about `fit_pages` pages
    x = np.frombuffer(b"".join(bytes(r[0]) for r in collected), "<f4").reshape(-1, width).astype(float)
    y = np.frombuffer(b"".join(bytes(r[1]) for r in collected), np.uint8).astype(float)
    if not 0 < y.sum() < len(y):
        return PRIOR
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights, ridge = PRIOR.copy(), 1.0
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (balance * (y - p)) - ridge * (weights - PRIOR)
        bend = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages (page_id, url, html): page_id, url, text."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) if page else "" for page in (v.as_py() for v in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op8_mincut_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", ["page_id", "url", "html"])
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
