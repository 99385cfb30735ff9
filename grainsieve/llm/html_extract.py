"""Main text of web pages by gradient-boosted trees over DOM nodes.

Pages become small trees of block nodes.  Boosted trees give each node the odds of belonging to the
article, from its subtree's density, its attribute tokens, its depth and its siblings.  Decoding goes
from the leaves up: a node is kept with its descendants' best choices or dropped with all of them,
whichever weighs more, so no kept node lies in a dropped one.
"""

from __future__ import annotations

import html as html_module
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.tables import field, smallest_hashes

#: Pages that are fitted on, and the size of the model.
SAMPLE_PAGES = 400
TREES = 40
DEPTH = 4
RATE = 0.3

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold text and no elements, and elements that hold no text of the page: left out from tag to end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("noscript template svg object select datalist canvas audio video".split())
#: Inline controls: left out where they end before the next block starts or ends.
CONTROLS = frozenset("button option label legend".split())
BLOCK = frozenset(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav aside header footer form fieldset table thead "
    "tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog hgroup menu center".split())
CLOSES_P = BLOCK - frozenset({"html", "body", "head", "td", "th", "tr", "caption"})
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"nav", "aside", "header", "footer", "form", "menu", "dialog"})
#: Attribute tokens that page authors give to the parts of a page.
CONTENT_TOKENS = frozenset("article content main post entry body story text page".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
    "aside widget related recommended cookie cookies consent notice popup modal newsletter subscribe signup share social comment comments reply "
    "replies disqus form search login pagination pager toolbar tags meta legal copyright".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW | SKIPPED | CONTROLS}
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK, key=len, reverse=True))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """A block element; ``runs`` are its direct texts and child nodes in page order."""

    tag: str
    tokens: frozenset[str]
    parent: Node | None
    runs: list = data_field(default_factory=list)
    chars: int = 0
    linked: int = 0
    own: int = 0
    stops: int = 0
    blocks: int = 1
    index: int = 0
    depth: int = 0


def parse(page: str) -> Node:
    """The block tree of a page; text of scripts, styles and controls is left out, references are decoded.

    An element of ``RAW``, ``SKIPPED`` or ``CONTROLS`` without its end tag takes no more with it than its own text up
    to the next tag (an option or a raw element) or nothing (any other): what follows stays in the page.  A slash before
    the end of such a tag closes nothing.
    """
    root = Node("root", frozenset(), None)
    stack: list[tuple[str, Node | None]] = [("root", root)]
    node, pieces, links, linked = root, [], 0, 0
    ends: dict[str, re.Match | None] = {}

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", html_module.unescape("".join(pieces))).strip()
            if text:
                node.runs.append(text)
                node.own += len(text)
                node.linked += min(linked, len(text))
            pieces, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal node, links
        flush()
        del stack[depth:]
        node = next(n for _, n in reversed(stack) if n is not None)
        links = sum(t == "a" for t, _ in stack)

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i]
                        links = sum(t == "a" for t, _ in stack)
                        break
                    if stack[i][1] is not None:
                        break
            continue
        if tag in _END:
            pieces.append(" ")
            # the next end tag of a kind is looked for once, not for each start before it
            if tag not in ends or (ends[tag] is not None and ends[tag].start() < at):
                ends[tag] = _END[tag].search(page, at)
            end = ends[tag]
            if end is not None and tag in CONTROLS:
                block = _NEXT_BLOCK.search(page, at, end.start())
                end = None if block else end
            if end is not None:
                at = end.end()
            elif tag in RAW or tag == "option":
                following = page.find("<", at)
                at = following if following >= 0 else len(page)
            continue
        if tag in VOID:
            pieces.append(" ")
            continue
        if tag not in BLOCK:
            stack.append((tag, None))
            links += tag == "a"
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][1] is not None:
                    break
        if tag in ITEMS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag or (tag in ("dt", "dd") and stack[i][0] in ("dt", "dd")) or (tag in ("td", "th") and stack[i][0] in ("td", "th")):
                    pop_to(i)
                    break
                if stack[i][0] in ITEMS[tag]:
                    break
        flush()
        words = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).lower()
        child = Node(tag, frozenset(_WORD.findall(words)), node)
        node.runs.append(child)
        stack.append((tag, child))
        node = child
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first, with their sums filled in."""
    out = [root]
    for node in out:  # the list grows while it is read: breadth first
        children = [r for r in node.runs if isinstance(r, Node)]
        for i, child in enumerate(children):
            child.index, child.depth = i, node.depth + 1
        out += children
    for node in reversed(out):
        node.chars += node.own
        node.stops += sum(r.count(". ") + r.endswith((".", "!", "?", ":")) for r in node.runs if isinstance(r, str))
        if node.parent is not None:
            up = node.parent
            up.chars, up.linked, up.stops, up.blocks = up.chars + node.chars, up.linked + node.linked, up.stops + node.stops, up.blocks + node.blocks
    return out


def features(nodes: list[Node]) -> np.ndarray:
    rows = []
    total = max(1, nodes[0].chars)
    inside: dict[int, tuple[int, int]] = {}
    before: dict[int, int] = {}
    for node in nodes:
        up = node.parent
        good, bad = inside.get(id(up), (0, 0))
        other = node.tag in OTHER_TAGS or bool(node.tokens & OTHER_TOKENS)
        content = node.tag in CONTENT_TAGS or bool(node.tokens & CONTENT_TOKENS and not other)
        inside[id(node)] = (good or content, bad or other)
        siblings = sum(isinstance(r, Node) for r in up.runs) if up else 1
        done = before.get(id(up), 0)
        before[id(up)] = done + node.chars
        before[id(node)] = done if up else 0
        chars = max(1, node.chars)
        rows.append((
            node.depth, np.log1p(node.chars), node.chars / node.blocks, node.linked / chars, node.stops / node.blocks, 100 * node.stops / chars,
            node.own / chars, node.chars / total, node.chars / max(1, up.chars if up else chars), siblings, node.index / siblings, done / total,
            (up.linked / max(1, up.chars)) if up else 0, (up.chars / up.blocks) if up else 0, node.tag in ("p", "blockquote", "pre"), node.tag in ("h1", "h2", "h3", "h4"),
            node.tag in ("li", "td", "dd"), content, other, good, bad, node.blocks))
    return np.array(rows, dtype=np.float32)


class Boosted:
    """Boosted regression trees of fixed depth for the logistic loss, on quantile bins."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.size, self.depth, self.rate = trees, depth, rate
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, bins: int = 32) -> Boosted:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]
        codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, rows.T, strict=True)], axis=1)
        share = np.clip((weights * labels).sum() / weights.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(rows), self.start)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            gradient, curvature = weights * (labels - p), weights * p * (1 - p) + 1e-9
            inner = (1 << self.depth) - 1
            which, limit, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(1 << self.depth)
            place = np.zeros(len(rows), dtype=np.int64)
            for node in range(inner):
                own = np.flatnonzero(place == node)
                best = (1e-6, 0, np.inf)
                for column in range(rows.shape[1]):
                    g = np.cumsum(np.bincount(codes[own, column], gradient[own], len(cuts[column]) + 1))
                    h = np.cumsum(np.bincount(codes[own, column], curvature[own], len(cuts[column]) + 1))
                    if not len(cuts[column]) or not len(own):
                        continue
                    gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), column, float(cuts[column][at]))
                which[node], limit[node] = best[1], best[2]
                place[own] = 2 * node + 1 + (rows[own, best[1]] > best[2])
            for i in range(1 << self.depth):
                own = place == inner + i
                leaf[i] = self.rate * gradient[own].sum() / (curvature[own].sum() + 1)
            score += leaf[place - inner]
            self.trees.append((which, limit, leaf))
        return self

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        score = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for which, limit, leaf in self.trees:
            place = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (rows[every, which[place]] > limit[place])
            score += leaf[place - len(which)]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """The text of the kept nodes, one line per run of text, in page order."""
    value, at = np.zeros(len(nodes)), {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        children = sum(max(0.0, value[at[id(r)]]) for r in node.runs if isinstance(r, Node))
        # a node's own text counts in full; its odds also speak for a quarter of what lies below it
        value[i] = children + odds[i] * (node.own + 0.25 * (node.chars - node.own)) if node.tag not in ("root", "html", "body") else children + odds[i] * node.own
    lines: list[str] = []
    todo: list = [nodes[0]]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            lines.append(item)
            continue
        keep_own = item.tag not in ("root", "html", "body") or odds[at[id(item)]] > 0
        todo += [r for r in reversed(item.runs) if (keep_own if isinstance(r, str) else value[at[id(r)]] > 0)]
    return "\n".join(lines)


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 inside an article or main element, 0 elsewhere and in other parts nested there, -1 above and where a page has none."""
    state: dict[int, int] = {}
    out = np.zeros(len(nodes), dtype=np.int64)
    for i, node in enumerate(nodes):
        above = state.get(id(node.parent), 0)
        if node.tag in OTHER_TAGS or node.tokens & OTHER_TOKENS:
            state[id(node)] = 2
        elif node.tag in CONTENT_TAGS and above != 2:
            state[id(node)] = 1
        else:
            state[id(node)] = above
        out[i] = state[id(node)] == 1
    if not out.any():
        return np.full(len(nodes), -1)
    holds = {id(n) for i, n in enumerate(nodes) if out[i]}
    for i in range(len(nodes) - 1, -1, -1):
        if not out[i] and id(nodes[i]) in holds:
            out[i] = -1
        if id(nodes[i]) in holds and nodes[i].parent is not None:
            holds.add(id(nodes[i].parent))
    return out


def variants(page: str) -> list[str]:
    """A page, and forms of it as other authors would have marked it: other elements, other attribute tokens, more parts.

    The choices follow from the page's checksum, so that the same pages give the same model.
    """
    seed = zlib.crc32(page.encode())
    pick = lambda values, n: sorted(values)[(seed >> n) % len(values)]
    content, other = pick(CONTENT_TOKENS, 1), pick(OTHER_TOKENS, 5)
    anonymous = re.sub(r"<(/?)(?:article|main)\b[^>]*>", rf'<\1div class="{content}">', page)
    anonymous = re.sub(r"<(/?)(?:nav|aside|header|footer|form)\b[^>]*>", rf'<\1div class="{other}">', anonymous).replace(f'</div class="{content}">', "</div>")
    paragraphs = re.findall(r"<p>[^<]{40,}</p>", page)[:3]
    extra = f'<section class="{pick({"comments", "replies", "comment", "related", "sidebar"}, 9)}"><h3>{other}</h3>{"".join(paragraphs)}</section>'
    with_more = re.sub(r"(</article>|</main>)", lambda m: m[1] + extra, page, count=1)
    plain = re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|form)\b[^>]*>", r"<\1div>", page)
    return [page, anonymous.replace(f'</div class="{other}">', "</div>"), with_more, plain]


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Boosted:
    """Fit on the pages with the smallest hashes of their text, copies once, whose own markup tells the article.

    Without such pages the model has no trees and keeps every node.
    """
    texts = pages.select(field(html_col).cast("string").alias("html")).where(F.length("html") > 0)
    model = Boosted()
    drawn = smallest_hashes(texts, "html", sample_pages)
    if drawn is None:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for page in batch.column(0).to_pylist():
                first = parse(page)
                wanted = weak_labels(nodes_of(first))
                if (wanted < 0).all():
                    continue
                for k, variant in enumerate(variants(page)):
                    nodes = nodes_of(parse(variant))
                    own = weak_labels(nodes) if k != 1 and k != 3 else wanted
                    if len(own) == len(nodes):
                        keep = (own >= 0) & np.array([n.chars > 0 for n in nodes])
                        rows += features(nodes)[keep].tolist()
                        labels += own[keep].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), pa.array(labels, pa.int64())], ["row", "label"])

    found = drawn.mapInArrow(run, "row array<float>, label bigint").toPandas()
    if len(found) and 0 < found["label"].mean() < 1:
        rows, labels = np.stack(found["row"].to_numpy()).astype(np.float64), found["label"].to_numpy()
        order = np.lexsort([*rows.T, labels])
        model.fit(rows[order], labels[order].astype(np.float64), np.ones(len(order)))
    else:
        model.start = 1.0
    return model


def extract_page(page: str, model: Boosted) -> str:
    nodes = nodes_of(parse(page))
    return decode(nodes, model.predict(features(nodes)))


def extract(pages: DataFrame, model: Boosted, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: the columns ``keep``, ``text`` and ``n_chars`` (code points).

    The whole page is read.  White space in a block becomes one space, blocks are joined by a line feed
    in page order.  A null or empty page gives an empty text; rows that repeat are extracted each; an
    empty table gives no rows.  Rows stay where they are read.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most TREES small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = [""] * batch.num_rows
            for first in range(0, batch.num_rows, 200):  # nodes of some pages are scored together
                rows = batch.column(len(keep)).slice(first, 200).to_pylist()
                trees = [nodes_of(parse(page)) if page else [] for page in rows]
                sizes = [len(t) for t in trees]
                if not sum(sizes):
                    continue
                odds = np.split(fitted.predict(np.concatenate([features(t) for t in trees if t])), np.cumsum([s for s in sizes if s])[:-1])
                scored = iter(odds)
                for i, tree in enumerate(trees):
                    if tree:
                        texts[first + i] = decode(tree, next(scored))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*[field(c) for c in keep], field(html_col).cast("string").alias("html")).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
