"""Operator 6. Main text of web pages by a tree-structured graphical model.

A page's DOM nodes are tagged 0 (frame: holds others), 1 (main content) or 2
(boilerplate). A node's evidence is a product of feature probabilities given its tag
(element, words of class, id and role, sizes of its text, share of its text in
links); the tags of parent and child are tied by a table of potentials. Messages
passed upward from the leaves and downward from the root give every node's exact
content marginal; text of nodes with a marginal of a half or more is the main text.

The pages carry no labels, so the labelled pages are derived: in a bounded sample
(SAMPLE pages), nodes inside an element or class that names its role (CONTENT,
BOILERPLATE: fixed word lists of the HTML standard and of common usage) are labelled
by it, those above them are frames, and the rest is left out. Potentials and evidence
are smoothed counts of the labelled nodes. What is known beforehand: elements such as
script and nav are boilerplate, and nothing below boilerplate is content. Names of a
role count by fixed, finite amounts besides what is learned: a boilerplate name less
than an article below it, which makes its node a frame.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed_beside, ship, table

SAMPLE = 2000
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
#: Elements that stay inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that say nothing about a role, besides those inside a block.
PLAIN = INLINE | frozenset("br div dd dl dt li ol table tbody td tfoot th thead tr ul wbr".split())
#: What may name a node's role.
CONTENT = frozenset("article main post entry story content body text blog-post".split())
BOILERPLATE_ELEMENTS = frozenset("nav header footer aside form script style noscript template head iframe button select svg menu dialog fieldset object video audio canvas input textarea title".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar footer foot copyright "
    "colophon sidebar side aside rail widget related recommended recommendations comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay banner "
    "newsletter subscribe subscription signup login search form share sharing social follow pagination pager tags toc skip hidden legal disclaimer navigation complementary contentinfo search alertdialog dialog".split()
)
#: Closes an open element of the same kind or a paragraph.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)", re.S)
#: A quote matters only directly after the sign; one that never ends ends with the tag.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[\"'][^>]*|[^\s>\"'][^\s>]*|(?=>)))?")
TAG_END = re.compile(r"[\s/]*>?")
NAMED = ("class", "id", "role", "itemprop", "aria-label")
SPLIT = re.compile(r"[^a-z0-9]+")
HEADING = re.compile(r"h[1-6]")
COMMENT = re.compile(r"(?:comment|reply)(?:-.*)?")


@dataclass
class Node:
    element: str
    parent: int
    names: frozenset
    hidden: bool = False
    #: Whole names, and whether a word inside a longer name is one of BOILERPLATE.
    whole: frozenset = frozenset()
    hinted: bool = False
    #: The node's own text and its children's numbers, in page order.
    parts: list = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """Nodes of a page, parents before children; forgiving as browsers are about ends that are missing or too many."""
    nodes, stack, at = [Node("#root", -1, frozenset())], [0], 0

    def text(part: str) -> None:
        if part:
            nodes[stack[-1]].parts.append(html.unescape(part))

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m.group(1) is None:
            continue
        element, attributes = m.group(1).lower(), {}
        while (found := ATTRIBUTE.match(page, at)) is not None:
            at = found.end()
            attributes.setdefault(found.group(1).lower(), (found.group(2) or "").strip("\"'"))
        end = TAG_END.match(page, at)
        at = end.end()
        if page[m.start() + 1] == "/":
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].element == element:
                    del stack[depth:]
                    break
                if nodes[stack[depth]].element in ("body", "html") or (element in INLINE and nodes[stack[depth]].element not in INLINE):
                    break
            continue
        closes = CLOSES.get(element, set()) | ({"p"} if element in CLOSES_P else set())
        if closes:
            stop = SCOPES.get(element, set()) | {"body", "html", "article", "section", "div", "aside", "main"}
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].element in closes:
                    del stack[depth:]
                    break
                if nodes[stack[depth]].element in stop:
                    break
        named = [a for a in NAMED if a in attributes]
        names = frozenset(w for a in named for w in SPLIT.split(attributes[a].lower()) if w)
        whole = frozenset(w for a in named if a != "id" or not HEADING.fullmatch(element) for w in attributes[a].lower().split())
        # Ids on headings, and of several words inside the main text, are made of the heading's own words.
        if "id" in attributes and not whole & {attributes["id"].lower()} & BOILERPLATE and (HEADING.fullmatch(element) or any(nodes[i].element in ("article", "main") for i in stack)):
            others = frozenset(w for a in ("class", "role", "itemprop", "aria-label") if a in attributes for w in SPLIT.split(attributes[a].lower()))
            names -= (frozenset(SPLIT.split(attributes["id"].lower())) & BOILERPLATE) - others
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        nodes.append(Node(element, stack[-1], names, hidden, whole, bool(names & BOILERPLATE)))
        nodes[stack[-1]].parts.append(len(nodes) - 1)
        if element in VOID or end.group().endswith("/>"):
            continue
        if element in RAW:
            end = re.compile(rf"</{re.escape(element)}\s*>", re.I).search(page, at)
            raw = page[at : end.start()] if end else page[at:]
            at = end.end() if end else n
            if element in ("title", "textarea"):
                nodes[-1].parts.append(html.unescape(raw))
            continue
        stack.append(len(nodes) - 1)
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Of each node."""
    own = [sum(len(p) for p in x.parts if isinstance(p, str) and not p.isspace()) for x in nodes]
    below, links = own[:], [own[i] if x.element == "a" else 0 for i, x in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        below[nodes[i].parent] += below[i]
        links[nodes[i].parent] += below[i] if nodes[i].element == "a" else links[i]
    out = []
    for i, x in enumerate(nodes):
        size = len(str(below[i])) if below[i] else 0
        found = [] if x.element in PLAIN else [f"<{x.element}"]
        found += [f"size {size}", f"own {len(str(own[i])) if own[i] else 0}", f"links {min(4, 5 * links[i] // below[i]) if below[i] else 'none'}"]
        found += [f".{w}" for w in x.names]
        if x.hidden:
            found.append("hidden")
        if is_article(x):
            found.append("article")
        elif x.names & CONTENT and not x.names & BOILERPLATE:
            found.append("named content")
        if own[i]:
            found.append("text")
        out.append(found)
    return out


def is_article(x: Node) -> bool:
    """An element for main content that is not a reader's comment by its names."""
    return x.element in ("article", "main") and not any(COMMENT.fullmatch(w) for w in x.whole)


def is_boilerplate(x: Node) -> bool:
    """Whether a node is boilerplate beyond doubt: by its element, or by being hidden."""
    return (x.element in BOILERPLATE_ELEMENTS and x.element != "form") or x.hidden


def speaks_for_boilerplate(x: Node) -> float:
    """By how much a node's names do: a whole name more than a word inside a longer name or being a form."""
    if is_article(x) or x.element in ("body", "html"):
        return 0.0
    return WHOLE if x.whole & BOILERPLATE or x.element == "article" else HINT if x.element == "form" or x.hinted else 0.0


def labels(nodes: list[Node]) -> list[int]:
    """Tags of nodes in elements or classes that name their role and of the frames above them, -1 elsewhere. Whole names label what holds no article, hints what holds no named content either."""
    out, articles, holds = [], [is_article(x) for x in nodes], [bool(x.names & CONTENT) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        articles[nodes[i].parent] |= articles[i]
        holds[nodes[i].parent] |= holds[i]
    for i, x in enumerate(nodes):
        above, hint = out[x.parent] if x.parent >= 0 else -1, speaks_for_boilerplate(x)
        if above == 2 or is_boilerplate(x) or (hint and not articles[i] and (hint == WHOLE or not holds[i])):
            out.append(2)
        elif above == 1 or is_article(x) or x.names & CONTENT:
            out.append(1)
        else:
            out.append(-1)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i] >= 0 and out[nodes[i].parent] < 0:
            out[nodes[i].parent] = 0
    return out


TAGS = (0, 1, 2)
#: Log potential of what is ruled out.
NEVER = -60.0
#: What names count for boilerplate: words inside longer ones, and whole ones; less than an article below.
HINT, WHOLE = 8.0, 30.0
#: Added to what was counted: to each feature's share over its mean share, and to each tag's share of a parent's children; the root's prior.
FEATURE_SLACK, TIE_SLACK, ROOT = 0.03, 0.01, (0.8, 0.15, 0.05)

#: Weights of evidence that is not independent of the rest, by a feature's first character: elements, sizes, own sizes, links, having text; names count in full.
WEIGHTS = {"<": 0.25, "s": 0.1, "o": 0.1, "l": 0.5, "t": 1.0, ".": 1.0}
#: What an element or name for the content counts against the other tags.
CONTENT_PRIOR = {"article": 40.0, "named content": 20.0}


@dataclass
class Model:
    """Log evidence by feature (a number per tag), log potentials (parent's tag, child's tag), and the root's log prior."""

    evidence: dict[str, tuple[float, float, float]]
    ties: np.ndarray
    root: np.ndarray

    def marginals(self, nodes: list[Node], found: list[list[str]]) -> np.ndarray:
        """P(tag 1) of each node by sum-product: upward from the leaves, then downward."""
        n = len(nodes)
        get, nothing = self.evidence.get, (0.0, 0.0, 0.0)
        belief = []
        for x, names in zip(nodes, found, strict=True):
            e = [get(f, nothing) for f in names]
            own = [sum(c) for c in zip(*e, strict=True)]
            if is_boilerplate(x):
                own[0] += NEVER
                own[1] += NEVER
            elif hint := speaks_for_boilerplate(x):
                own[0] -= hint
                own[1] -= hint
            belief.append(own)
        step = np.exp(self.ties).tolist()
        back = np.exp(self.ties.T).tolist()
        messages = [nothing] * n

        def send(from_: list[float], through: list[list[float]]) -> tuple[float, float, float]:
            top = max(from_)
            a, b, c = exp(from_[0] - top), exp(from_[1] - top), exp(from_[2] - top)
            return tuple(top + log(r[0] * a + r[1] * b + r[2] * c + 1e-300) for r in through)

        for i in range(n - 1, 0, -1):  # children come after their parents
            messages[i] = m = send(belief[i], step)
            above = belief[nodes[i].parent]
            for k in TAGS:
                above[k] += m[k]
        for k in TAGS:
            belief[0][k] += self.root[k]
        for i in range(1, n):
            above, m = belief[nodes[i].parent], messages[i]
            down = send([above[0] - m[0], above[1] - m[1], above[2] - m[2]], back)
            for k in TAGS:
                belief[i][k] += down[k]
        out = np.array(belief)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out[:, 1] / out.sum(axis=1)


def fit(counts: Counter) -> Model:
    """counts: ('f', feature, tag), ('n', tag), ('t', parent's tag, child's tag) of labelled nodes."""
    n = [counts["n", c] + 1.0 for c in TAGS]
    names = {k[1] for k in counts if k[0] == "f"}
    evidence = {}
    for f in names:
        share = np.array([counts["f", f, c] / n[c] for c in TAGS])
        evidence[f] = tuple((WEIGHTS.get(f[0], WEIGHTS["."]) * np.log(share / share.mean() + FEATURE_SLACK)).tolist())
    for f, prior in CONTENT_PRIOR.items():
        evidence[f] = (-prior, 0.0, -prior)
    for f in ("<article", "<main"):  # said by `article`, or taken back by a comment's name
        evidence.pop(f, None)
    ties = np.array([[counts["t", a, b] for b in TAGS] for a in TAGS], float)
    ties = np.log(ties / np.maximum(ties.sum(axis=1, keepdims=True), 1.0) + TIE_SLACK)
    ties[0, 1:] = ties[0, 1:].mean()  # a page has one main part and many others
    ties[2, 1] = NEVER
    return Model(evidence, ties, np.log(np.array(ROOT)))


def count_labelled(page: str) -> Counter:
    """What fit() needs of one page."""
    nodes = parse(page)
    tags, out = labels(nodes), Counter()
    for x, names, tag in zip(nodes, features(nodes), tags, strict=True):
        if tag < 0:
            continue
        out["n", tag] += 1
        for f in names:
            out["f", f, tag] += 1
        above = tags[x.parent] if x.parent >= 0 else -1
        if above >= 0:
            out["t", above, tag] += 1
    return out


def content(nodes: list[Node], marginal: np.ndarray) -> list[str]:
    """Blocks of main text in page order, white space inside a block turned into one space."""
    blocks, now, stack = [], [], [(0, iter(nodes[0].parts))]

    def close() -> None:
        if block := " ".join("".join(now).split()):
            blocks.append(block)
        now.clear()

    while stack:
        i, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if nodes[i].element not in INLINE:
                close()
        elif isinstance(part, str):
            if marginal[i] >= 0.5:
                now.append(part)
        else:
            if nodes[part].element not in INLINE:
                close()
            stack.append((part, iter(nodes[part].parts)))
    close()
    return blocks


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Fits evidence and potentials to the `sample` pages with the least hashes; only their counts reach the driver."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(count_labelled(page))
        rows = [(k[0], str(k[1]), int(k[2]) if len(k) > 2 else -1, v) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "a", "b", "n"])

    body = F.col(f"`{html_col}`")
    order = F.xxhash64(body)
    least = pages.where(body.isNotNull()).select(order.alias("order")).distinct().orderBy("order").limit(sample)
    chosen = pages.select(body.alias("page"), order.alias("order")).join(F.broadcast(least), "order").dropDuplicates(["order"]).select("page")
    counted = chosen.mapInArrow(run, "kind string, a string, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts: Counter = Counter()
    for kind, a, b, n in counted:
        counts[("f", a, b) if kind == "f" else ("n", int(a)) if kind == "n" else ("t", int(a), b)] += n
    return fit(counts)


def extract(pages: DataFrame, model: Model, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default all), text and blocks (array of strings); one row per row of `pages`.

    Null and empty pages have no blocks and the text ''. Whole pages are read. A
    column named text or blocks gives way to the new one.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # features of the sample

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        model = shared.value
        for b in batches:
            found = []
            for page in b.column(kept).to_pylist():
                nodes = parse(page or "")
                found.append(content(nodes, model.marginals(nodes, features(nodes))))
            yield [*b.columns[:kept], pa.array([" ".join(x) for x in found], pa.string()), pa.array(found, pa.list_(pa.string()))]

    return computed_beside(pages, html_col, keep, {"text": "string", "blocks": "array<string>"}, run)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, train(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
