"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A classifier gives each block a cost for either
label, which becomes the capacity of its edge to a terminal; blocks next to each
other on the page, and blocks that follow each other inside one parent element, are
joined by smoothness edges.  The minimum cut, found by maximum flow, separates
content from boilerplate: a short paragraph between paragraphs stays, a long notice
among menus goes.

The classifier is logistic over shape features (length, share of linked text,
element, punctuation), trained on a bounded sample of pages whose own elements tell
(``article`` or ``nav``, say); what the elements tell is added to its log-odds.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import slices

#: Elements without text of the page.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title", "datalist", "map"}
#: Of these, everything up to the end tag (or the end of the page) is raw.
RAW = {"script", "style", "textarea", "title", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
BOILERPLATE = {"nav", "footer", "header", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
CONTENT = {"article", "main"}
#: Words of class, id and role that name boilerplate or content.
BOILERPLATE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|overlay|gdpr|newsletter|subscri\w*|signup|login|social|share|sharing|related|recommend\w*|comments?|commentlist|replies|reply|disqus|reviews?|widget|toolbar|pagination|pager|copyright|legal|search|skip|hidden|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|maincontent|content|body|text|prose)(?:$|[\s_-])", re.I)
#: First parts of names that say what a page or container has or lacks, not what it is.
MODIFIER_NAME = re.compile(r"(?:^|(?<=\s))(?:has|have|with|without|no|not|non|is|show|hide|enable|disable)[_-]\S*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")

#: Log-odds that the elements around a block add, and the bound on what the classifier adds.  Below the sum of that
#: bound and a block's edges (two neighbours on the page, two inside the parent), so that these together can overrule.
ELEMENT_ODDS = 4.0
SHAPE_BOUND = 3.0
#: Smoothness: neighbours on the page, and neighbours inside one parent.
NEXT_COST = 0.5
PARENT_COST = 1.0
TRAINING_PAGES = 400
_SHAPES = 9


@dataclass
class Block:
    text: str
    element: str
    parent: int
    linked: int
    evidence: int  # 1 content, -1 boilerplate, 0 neither


@dataclass
class _Open:
    name: str
    number: int
    evidence: int
    named: bool = False  # evidence from a class, id or role


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0


def _evidence(name: str, attributes: str, above: int, named: bool = False) -> tuple[int, bool]:
    """What an element says about the text in it, and whether only a name says so.

    Boilerplate stays boilerplate inside content, not the other way round; but where
    only a name made it boilerplate, an ``article`` or ``main`` inside that is not
    named so itself leaves the text to the classifier and its neighbours.
    """
    if above < 0 and not named or name in BOILERPLATE:
        return -1, False
    names = ""
    if attributes:
        if "hidden" in attributes or "none" in attributes:
            if _HIDDEN.search(attributes):
                return -1, False
        names = MODIFIER_NAME.sub(" ", " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)))
    boilerplate = bool(BOILERPLATE_NAME.search(names))
    if above < 0:
        return (0, False) if name in CONTENT and not boilerplate else (-1, True)
    if boilerplate and name not in CONTENT and name != "body" and name != "html":
        return -1, True
    if CONTENT_NAME.search(names):
        return 1, False
    return (1 if name in CONTENT else above), False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order: text between block-level tags, references decoded, white space made one space."""
    out = _Page()
    stack = [_Open("", 0, 0)]
    numbered, at = 0, 0

    def add_text(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        out.parts.append(text)
        if out.in_link:
            out.linked += len(text)

    def flush() -> None:
        if out.parts:
            text = _SPACE.sub(" ", "".join(out.parts)).strip()
            if text:
                top = stack[-1]
                out.blocks.append(Block(text, top.name, stack[-2].number if len(stack) > 1 else 0, min(out.linked, len(text)), top.evidence))
            out.parts, out.linked = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside an element without text
            continue
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if not m[1] and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                resume = close.end() if close else (len(page) if name in RAW else at)
            else:
                resume = at
            at = resume
            continue
        if name in INLINE:
            if name == "a":
                out.in_link = max(0, out.in_link + (-1 if m[1] else 1))
            continue
        if name == "br" or name == "wbr":
            out.parts.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        out.in_link = 0
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        elif not m[3].endswith("/"):
            while len(stack) > 1 and (stack[-1].name == "p" or (name == "li" and stack[-1].name == "li") or (name in ("dt", "dd") and stack[-1].name in ("dt", "dd")) or (name in ("td", "th", "tr") and stack[-1].name in ("td", "th")) or (name == "tr" and stack[-1].name == "tr") or (name == "option" and stack[-1].name == "option")):
                stack.pop()
            if name == "body":
                del stack[1:]
            numbered += 1
            stack.append(_Open(name, numbered, *_evidence(name, m[3], stack[-1].evidence, stack[-1].named)))
    if at < len(page):
        add_text(page[at:])
    flush()
    return out.blocks


def shapes(blocks: list[Block]) -> np.ndarray:
    """Features that don't depend on named containers."""
    rows = np.zeros((len(blocks), _SHAPES))
    for k, b in enumerate(blocks):
        n = len(b.text)
        rows[k] = (
            1.0,
            min(np.log2(n + 1), 12) / 6 - 1,
            b.linked / n,
            b.element == "p",
            b.element == "li",
            len(b.element) == 2 and b.element[0] == "h" and b.element[1].isdigit(),
            b.text[-1] in ".!?:;\"'",
            b.element in ("td", "th", "dd", "dt"),
            "©" in b.text or "|" in b.text,
        )
    return rows


def train_shapes(rows: np.ndarray, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic weights (1 content, 0 boilerplate), both labels weighing the same; zero without both."""
    weights = np.zeros(_SHAPES)
    positive = labels.sum()
    if not positive or positive == len(labels):
        return weights
    share = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-rows @ weights))
        weights -= 2.0 * (rows.T @ (share * (p - labels)) + 0.002 * weights)
    return weights


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) with the least cost: |odds| against a node's sign, a capacity across each edge.

    A node whose odds outweigh all its edges has the label of its sign in every
    minimum cut; such nodes are settled first and pass their edges' capacity on.  The
    rest is solved by shortest augmenting paths.  A node that the cut leaves free is
    content.
    """
    n = len(odds)
    pull = list(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            around[a][b] = around[a].get(b, 0.0) + c
            around[b][a] = around[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(pull[k]) >= sum(around[k].values()) and (pull[k] != 0 or not around[k]):
            label[k] = pull[k] >= 0
            for j, c in around[k].items():
                pull[j] += c if label[k] else -c
                del around[j][k]
                queue.append(j)
            around[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {k: dict(around[k]) for k in rest}
        room[source], room[sink] = {}, {}
        for k in rest:
            room[source][k], room[k][source] = max(pull[k], 0.0), 0.0
            room[k][sink], room[sink][k] = max(-pull[k], 0.0), 0.0

        def reached() -> dict[int, int]:
            came, line = {source: source}, deque([source])
            while line:
                u = line.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in came:
                        came[v] = u
                        if v == sink:
                            return came
                        line.append(v)
            return came

        while sink in (came := reached()):
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            flow = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= flow
                room[v][u] += flow
        # Boilerplate is what can still reach the sink; everything else is content.
        back, line = {sink}, deque([sink])
        while line:
            v = line.popleft()
            for u in room[v]:
                if u not in back and room[u].get(v, 0.0) > 1e-12:
                    back.add(u)
                    line.append(u)
        for k in rest:
            label[k] = k not in back
    return [bool(x) for x in label]


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Content or not, for each block of a page."""
    if not blocks:
        return []
    shape = np.clip(shapes(blocks) @ weights, -SHAPE_BOUND, SHAPE_BOUND)
    odds = (shape + ELEMENT_ODDS * np.array([b.evidence for b in blocks])).tolist()
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, NEXT_COST))
        if b.parent in last:
            edges.append((last[b.parent], k, PARENT_COST))
        last[b.parent] = k
    return minimum_cut(odds, edges)


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            known = [b for b in blocks_of(page or "") if b.evidence]
            if known:
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([shapes(known).ravel()], pa.list_(pa.float64())), pa.array([[int(b.evidence > 0) for b in known]], pa.list_(pa.int64()))], ["h", "shapes", "labels"])


def _extract(weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], batch.num_columns - 1):
                texts = [main_text(p, weights.value) if p else "" for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[:-1], "text", "n_chars"])

    return run


def train_on(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """Classifier weights from the first ``TRAINING_PAGES`` distinct pages in hash order, however often one is repeated."""
    hashed = pages.select(F.xxhash64(html_col, F.lit(5)).alias("h"), F.col(html_col).alias("html"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(TRAINING_PAGES).collect()]
    rows = hashed.where(F.col("h").isin(chosen)).mapInArrow(_sample, "h long, shapes array<double>, labels array<long>").dropDuplicates(["h"]).orderBy("h").collect()
    flat = np.array([x for r in rows for x in r["shapes"]]).reshape(-1, _SHAPES)
    return train_shapes(flat, np.array([y for r in rows for y in r["labels"]], np.float64))


def extract_main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``text`` and ``n_chars``.

    Blocks labelled content are joined in page order by an empty line.  Null and empty
    pages have an empty text; text outside all tags is one block; rows may repeat; kept
    columns called ``text`` or ``n_chars`` are left out.  A page is labelled as a whole,
    so the largest page bounds a worker's memory.  Of cuts that cost the same the one
    with most content is taken.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    weights = pages.sparkSession.sparkContext.broadcast(train_on(pages, html_col))
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return pages.select(*keep, html_col).mapInArrow(_extract(weights), ", ".join([*fields, "text string, n_chars long"]))
