"""HTML extraction (operator 3): minimum-cut labelling.

A page is cut into blocks of text. What a linear classifier says against calling a block boilerplate or content becomes
its capacity to the source or the sink; neighbours in page order and neighbours under one element are tied by
smoothness edges. The maximum flow separates content from boilerplate. The classifier is a logistic regression on the
elements around a block, the words of their class, id and role, and the block's text, trained on made pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm import html_training
from zonalspark.llm.common import read

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag with quoted values, and without regard to quotes.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+>")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What is inside these is no text of the page; without an end tag the first ones take the rest, as browsers have it.
TAKES_REST = frozenset("script style title textarea iframe noscript".split())
RAW = TAKES_REST | frozenset("template svg select object math canvas video audio".split())
END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd td th".split())
#: An opening tag also ends an open element of these, unless one of the others is open inside it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS, HOLDERS = ("ul", "ol", "dl", "table", "div", "article", "section"), ("td", "th", "button", "li", "div", "article", "section", "main", "body")
#: Words that make a class name a state and no name of what is inside.
STATES = frozenset("has with no is not without".split())
NAMING = frozenset("class id role itemprop aria-label".split())
#: An element with such a share of a page's text holds the page, so its names say less.
WIDE = 0.8
STEPS, RATE, DECAY = 400, 0.05, 0.3
#: Smoothness of neighbours in page order: under one element, under one grandparent, else; and of the next block under one
#: element. Between blocks whose surroundings differ by more than APART logits it is the least.
NEAR, APART = {"same": 2.0, "close": 0.8, "far": 0.1, "sibling": 1.0}, 4.0


class Element:
    __slots__ = ("tag", "block", "above", "parent", "named", "hidden", "size", "features")

    def __init__(self, tag: str, parent: Element | None, named: tuple[str, ...] = (), hidden: bool = False):
        self.tag, self.parent, self.named, self.hidden = tag, parent, named, hidden
        #: the innermost block element here, and the one around it
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.above = None if parent is None else parent.block if self.block is self else parent.above
        self.size, self.features = 0, None


class Block:
    __slots__ = ("text", "element", "parent", "grand", "linked", "prior")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked, self.prior = text, element, linked, 0.0
        own = element.block
        # a paragraph, item or heading is told apart from what it stands in
        inner = own.above if own.tag in LEAVES and own.above is not None else own
        self.parent, self.grand = inner, inner.above


def named(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of an element's names, each marked by what it says (w: name, m: name of a page's or article's root, s: state),
    and whether the element is hidden."""
    words, hidden = [], False
    kind = "m:" if tag in ("html", "body", "article", "main") else "w:"
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden |= value.lower() != "false"
        elif name == "style":
            hidden |= bool(UNSEEN.search(value))
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name in NAMING:
            for token in html.unescape(value).split():
                parts = [w.lower() for w in PARTS.findall(token)]
                if len(parts) > 1 and parts[0] in STATES:
                    words.append("s:" + parts[-1])
                else:
                    words += [kind + w for w in parts]
                    if len(parts) > 1:
                        words.append(kind + "-".join(parts))
    return tuple(words), hidden


def pieces(page: str) -> Iterator[tuple[str, str, str | None]]:
    """("text", its characters, None), ("open", tag, attributes) and ("close", tag, None) in page order.

    The scanner only moves forward: what was looked for once and isn't there isn't looked for again. An unfinished tag
    or comment takes the rest of the page, as browsers have it; quotes that never close are no quotes."""
    at, begin, last, quotes, gone = 0, 0, page.rfind(">"), True, set()
    while (i := page.find("<", at)) >= 0:
        m = NAME.match(page, i)
        if m is None and page[i + 1 : i + 2] not in ("!", "?", "/"):
            at = i + 1
            continue
        if begin < i:
            yield "text", page[begin:i], None
        if m is None:
            comment = page.startswith("<!--", i) and page[i + 4 : i + 5] != ">"
            end = page.find("-->" if comment else ">", i + 2)
            if end < 0:
                return
            at = begin = end + (3 if comment else 1)
            continue
        if i > last:
            return
        end = -1
        if quotes:
            rest = REST.match(page, m.end())
            end, quotes = (rest.end(), True) if rest else (-1, False)
        if end < 0:
            end = page.find(">", m.end()) + 1
        tag, attributes = m[1].lower(), page[m.end() : end - 1]
        at = begin = end
        if page[i + 1] == "/":
            yield "close", tag, None
            continue
        if tag not in RAW:
            yield "open", tag, attributes
        elif not (tag in ("svg", "math") and attributes.endswith("/")) and tag not in gone:
            stop = END[tag].search(page, end)
            after = page.find(">", stop.end()) if stop else -1
            if after >= 0:
                at = begin = after + 1
            elif stop or tag in TAKES_REST:
                return
            else:
                gone.add(tag)
    if begin < len(page):
        yield "text", page[begin:], None


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with the elements around them. Unclosed and stray tags are forgiven."""
    out: list[Block] = []
    stack = [Element("", None)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, stack[-1], linked))
        linked = 0

    def innermost(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def close(names: tuple[str, ...], unless: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of these names, with all inside it, unless one of the others is open inside."""
        i = innermost(names)
        if i > innermost(unless):
            for x in stack[i:]:
                places[x.tag].pop()
            del stack[i:]

    for kind, said, attributes in pieces(page):
        if kind == "text":
            if not stack[-1].hidden:
                text = html.unescape(said)
                parts.append(text)
                if places["a"]:
                    linked += len(text)
            continue
        block = said in BLOCKS
        if block:
            flush()
        if kind == "close":
            close((said,))
        elif said == "br":
            parts.append(" ")
        elif said not in VOID:
            if block:
                close(("p",), HOLDERS)
            if said in ENDS:
                close(ENDS[said], LISTS)
            if not attributes.endswith("/"):
                words, hidden = named(said, attributes) if "=" in attributes or "hidden" in attributes.lower() else ((), False)
                inside = said in ("header", "footer") and (places["article"] or places["main"])
                element = Element(said, stack[-1], (f"t:{said}-in" if inside else f"t:{said}", *words) if block else words, hidden or stack[-1].hidden)
                places[said].append(len(stack))
                stack.append(element)
    flush()
    return out


def measured(found: list[Block]) -> list[Block]:
    """The blocks, after each element around them knows how much of the text it holds."""
    order: dict[Element, None] = {}
    for b in found:
        b.element.size += len(b.text)
        e = b.element
        while e is not None and e not in order:
            order[e] = None
            e = e.parent
    depth: dict[Element, int] = {}
    for e in order:
        chain = []
        while e is not None and e not in depth:
            chain.append(e)
            e = e.parent
        base = depth[e] if e is not None else -1
        for k, x in enumerate(reversed(chain), 1):
            depth[x] = base + k
    for e in sorted(depth, key=depth.__getitem__, reverse=True):
        if e.parent is not None:
            e.parent.size += e.size
    return found


def around(element: Element, total: int, known: dict[str, float] | None) -> frozenset[str]:
    """Features of all elements from the root to this one; known: only those with a weight."""
    chain = []
    while element is not None and element.features is None:
        chain.append(element)
        element = element.parent
    features = frozenset() if element is None else element.features
    for x in reversed(chain):
        wide = x.size >= WIDE * total
        own = [("wide-" + f if wide and (f[0] == "w" or f in ("t:form", "t:div", "t:section", "t:table")) else f) for f in x.named]
        if known is not None:
            own = [f for f in own if f in known]
        if any(f not in features for f in own):
            features = features.union(own)
        x.features = features
    return features


def own_features(block: Block) -> tuple[float, ...]:
    """Numbers of the block's own text: length, share in links, ends of sentences, whether it is short, and one."""
    n = len(block.text)
    stops = sum(map(block.text.count, ".!?…。"))
    return (math.log10(1 + n), min(1.0, block.linked / n), min(1.0, stops / (1 + n / 80)), float(n < 25), 1.0)


class Model:
    """Weights by feature of what is around a block, and of its own numbers."""

    def __init__(self, weights: dict[str, float], own: tuple[float, ...]):
        self.weights, self.own = weights, own

    def logits(self, found: list[Block]) -> list[float]:
        """Positive for content; each block's prior, what its surroundings say, is left in it."""
        total, sums = sum(len(b.text) for b in measured(found)), {}
        out = []
        for b in found:
            features = around(b.element, total, self.weights)
            if features not in sums:
                sums[features] = sum(self.weights[f] for f in sorted(features))
            b.prior = sums[features]
            out.append(b.prior + sum(w * x for w, x in zip(self.own, own_features(b), strict=True)))
        return out


def train(pages: list[tuple[str, set[str]]]) -> Model:
    """Logistic regression by gradient steps over all blocks of labelled pages, with a penalty on weights."""
    names: dict[str, int] = {}
    rows, cols, own, y = [], [], [], []
    for page, content in pages:
        found = measured(blocks(page))
        total = sum(len(b.text) for b in found)
        for b in found:
            features = around(b.element, total, None)
            cols += [names.setdefault(f, len(names)) for f in sorted(features)]
            rows += [len(y)] * len(features)
            own.append(own_features(b))
            y.append(b.text in content)
    row, col, x, want = np.array(rows, np.int64), np.array(cols, np.int64), np.array(own).reshape(-1, 5), np.array(y, float)
    at = np.zeros(len(names) + 5)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, at[col], len(want)) + x @ at[len(names) :]
        wrong = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - want
        g = np.concatenate([np.bincount(col, wrong[row], len(names)) + DECAY * at[: len(names)], wrong @ x])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(at[i]) for f, i in names.items()}, tuple(at[len(names) :].tolist()))


@cache
def fit(n: int = html_training.PAGES, seed: int = html_training.SEED) -> Model:
    """The classifier, learned from n made pages; it depends on nothing else."""
    return train(html_training.pages(n, seed))


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source of a minimum cut: capacity max(score, 0) from the source, max(-score, 0) to the sink,
    both ways along edges. Maximum flow by shortest augmenting levels (Dinic's method)."""
    n = len(scores)
    excess, room = [max(0.0, s) for s in scores], [max(0.0, -s) for s in scores]
    out: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    tiny = 1e-9
    while True:
        level = [0 if x > tiny else -1 for x in excess]
        queue = [i for i in range(n) if level[i] == 0]
        reached = False
        for i in queue:  # grows while it is walked
            if room[i] > tiny:
                reached = True
                continue
            for e in out[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while level[s] == 0 and excess[s] > tiny:
                path, i = [], s
                while room[i] <= tiny:
                    while nxt[i] < len(out[i]) and not (cap[e := out[i][nxt[i]]] > tiny and level[to[e]] == level[i] + 1):
                        nxt[i] += 1
                    if nxt[i] < len(out[i]):
                        path.append(e := out[i][nxt[i]])
                        i = to[e]
                    elif path:
                        i = to[path.pop() ^ 1]
                        nxt[i] += 1
                    else:
                        break
                if room[i] <= tiny:
                    break
                flow = min([excess[s], room[i], *(cap[e] for e in path)])
                excess[s] -= flow
                room[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def extract(page: str | None, model: Model | None = None) -> str:
    """The main text of a page: content blocks in page order, joined by a line feed."""
    found = blocks(page or "")
    scores = (model or fit()).logits(found)
    edges: list[tuple[int, int, float]] = []
    last: dict[Element, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = abs(a.prior - b.prior) > APART  # a border between an article and what stands beside it
            near = "same" if a.parent is b.parent else "close" if b.parent is a.grand or a.parent is b.grand or a.grand is b.grand else "far"
            edges.append((i - 1, i, NEAR["far" if apart else near]))
        if (j := last.get(b.parent)) is not None and j < i - 1:
            edges.append((j, i, NEAR["sibling"]))
        last[b.parent] = i
    return "\n".join(b.text for b, content in zip(found, cut(scores, edges), strict=True) if content)


def extract_pages(pages: DataFrame, key: str = "page_id", page: str = "html", model: Model | None = None) -> DataFrame:
    """All columns but the page itself, then text (empty if there is none) and n_chars, of every row.

    Null and empty pages give empty texts; repeated rows stay; no page is cut short. A column of pages named text or
    n_chars gives way to the result. One pass, no shuffle; the weights that are broadcast are bounded by the made pages."""
    keep = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, shared.value) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(F.col(page).cast("string"), *keep).mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
