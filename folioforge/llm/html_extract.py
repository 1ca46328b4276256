"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with the chain of elements around them.  A
linear classifier over the block's features (length, link share, punctuation,
element kinds and class names around it, the blocks beside it) gives log-odds
of being content; they are its terminal capacities.  Neighbouring blocks, and
blocks near each other in the tree, are joined by edges whose capacity is the
price of labelling them differently, whatever they are.  The maximum flow gives
the minimum cut, the labelling of least total cost.

The classifier is fitted to the corpus.  Pages come without labels, but many
mark their article and their chrome by elements; blocks of a bounded sample of
such pages (SAMPLE_PAGES pages of least hash, SAMPLE_BLOCKS of each) are its
labels.  The features that say just that are hidden in half of them, so that it
learns what else tells content from chrome, as pages without such elements
need.  The fit starts from, and is held to, the prior weights, so a corpus of
few or odd pages can't lead it far.

A chrome word in a class or id is a hint, not proof: its cost falls to nothing
for an element that holds most of the page's article text (of all its text,
where articles hold less than a quarter), as a wrapper named after its sidebar
does.

Defined results: null or empty html has no text; a page without content blocks
has the empty text and n_chars 0; broken markup is read as browsers do in
spirit (a block element closes an open paragraph, stray end tags are ignored,
an unclosed element ends with its parent); a tag cut off by the page's end is
dropped; repeated rows are read apart; a very long page is read whole; an empty
table gives an empty result, and a fit to no pages the prior weights.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)", re.S)
#: Where nothing closes it any more, a tag that is cut off by the end of the page.
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Element kinds of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
#: Seldom content: read as ordinary elements, hinted against; CONTROLS end where a block begins, the others count if closed.
CONTROLS, FALLBACK = frozenset("svg select button option optgroup".split()), frozenset("noscript template".split())
CHROME = frozenset("nav aside header footer form menu dialog fieldset".split())
CHROME_ROLES = frozenset("navigation complementary banner contentinfo search menu menubar toolbar dialog alert alertdialog form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login signin"
    " share sharing social related recommended recommendation recommendations trending popular sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar copyright legal"
    " disclaimer comment comments reply replies respond disqus discussion widget widgets toolbar search form alert skip tags tagcloud outbrain taboola".split()
)
WORD = re.compile(r"[a-z]+")

#: What the classifier sees of a block, each with its prior weight (positive: content).
FEATURES = {
    "always": -1.6, "words": 1.0, "linked": -4.0, "paragraph": 1.5, "heading": 0.8, "item": -0.3, "sentence": 0.5, "article": 3.0,
    "chrome": -6.0, "hint": -6.0, "words beside": 0.3, "links beside": -0.5,
}
PRIOR = np.array(list(FEATURES.values()))
ARTICLE, CHROME_AT = list(FEATURES).index("article"), list(FEATURES).index("chrome")
#: Log-odds beyond this say no more.
SURE = 5.0
#: Share of the text at which a hint begins to lose its cost, and at which it has none.
HINT_FROM, HINT_TO, ARTICLE_SHARE = 0.5, 0.8, 0.25
#: Prices of unlike labels: for the next block, more for one of the same parent or grandparent, and for the next but one of the same parent.
NEXT_PRICE, SIBLING_PRICE, COUSIN_PRICE, NEAR_PRICE = 0.5, 0.9, 0.3, 0.3
#: The fit: pages, blocks of a page, labels that the prior is worth, and Newton steps.
SAMPLE_PAGES, SAMPLE_BLOCKS, EVIDENCE, STEPS = 2_000, 64, 100.0, 12


class Block:
    __slots__ = ("text", "tag", "element", "parent", "chrome", "article", "linked")

    def __init__(self, text, tag, element, parent, chrome, article, linked):
        # element: the innermost element around it; parent: the block element above its own.
        self.text, self.tag, self.element, self.parent, self.chrome, self.article, self.linked = text, tag, element, parent, chrome, article, linked


class Tree:
    """The page's elements by number, each with its parent and whether a chrome word names it."""

    def __init__(self):
        self.parent, self.hinted = [0], [False]

    def add(self, parent: int, hinted: bool) -> int:
        self.parent.append(parent)
        self.hinted.append(hinted)
        return len(self.parent) - 1


def _marks(attrs: str) -> tuple[bool, bool]:
    """Whether the element is hidden or has a chrome role, and whether its class or id has a chrome word."""
    word = False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, word
        if name == "role" and value in CHROME_ROLES:
            return True, word
        word = word or (name in ("class", "id") and not CHROME_WORDS.isdisjoint(WORD.findall(value)))
    return False, word


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The page's blocks of text in order, and its elements."""
    out: list[Block] = []
    tree = Tree()
    # Each open element: name, its number, chrome, article (of it or of what is around it), the block elements at it and above that.
    stack: list[tuple[str, int, bool, bool, tuple[str, int, int]]] = [("", 0, False, False, ("", 0, 0))]
    parts: list[str] = []
    unclosed: set[str] = set()
    linked = links = 0
    at, n, last_close = 0, len(page), page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, element, chrome, article, (tag, _, parent) = stack[-1]
                out.append(Block(text, tag, element, parent, chrome, article, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    while at < n:
        m = TOKEN.match(page, at)
        if at > last_close and UNFINISHED.match(page, at):
            break
        at = m.end()
        text = m["text"]
        if text is not None:
            text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
            continue
        if name in RAW and not m["attrs"].endswith("/"):
            if name in BLOCKS:
                flush()
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name == "head":
            close = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
            at = (close.start() if close[0].lower().startswith("<body") else close.end()) if close else at
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            # A block closes an open paragraph or control, an item an open item.
            for k in range(len(stack) - 1, 0, -1):
                opened = stack[k][0]
                if opened in CONTROLS and name not in ("option", "optgroup", "title"):
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    continue
                if opened == "p" or (opened == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if opened in BLOCKS:
                    break
        up = stack[-1]
        if name in ("svg", "math") and m["attrs"].endswith("/"):
            continue
        sure, word = _marks(m["attrs"]) if m["attrs"] and name not in ("html", "body") else (False, False)
        if name in FALLBACK and name not in unclosed and not re.compile(rf"</{name}\b", re.I).search(page, at):
            unclosed.add(name)
        number = tree.add(up[1], word or name in CONTROLS or (name in FALLBACK and name not in unclosed))
        stack.append((name, number, up[2] or sure or name in CHROME, up[3] or name in ("article", "main"), (name, number, up[4][1]) if name in BLOCKS else up[4]))
        links += name == "a"
    flush()
    return out, tree


def hint_costs(found: list[Block], tree: Tree) -> list[float]:
    """How far hints speak against each block, 0 to 1: the dearest of the hinted elements around it."""
    own = [0.0 if b.chrome else len(b.text) * (1 - b.linked) for b in found]
    article = [n if b.article else 0.0 for n, b in zip(own, found, strict=True)]
    if sum(article) >= ARTICLE_SHARE * sum(own):
        own = article
    total, held = sum(own), [0.0] * len(tree.parent)
    for n, b in zip(own, found, strict=True):
        held[b.element] += n
    # Children have greater numbers than their parents.
    for k in range(len(held) - 1, 0, -1):
        held[tree.parent[k]] += held[k]
    cost = [0.0] * len(held)
    for k in range(1, len(held)):
        mine = min(1.0, max(0.0, (HINT_TO - held[k] / total) / (HINT_TO - HINT_FROM))) if total else 1.0
        cost[k] = max(cost[tree.parent[k]], mine if tree.hinted[k] else 0.0)
    return [cost[b.element] for b in found]


def features(found: list[Block], tree: Tree) -> np.ndarray:
    """A row of FEATURES for each block."""
    hint = hint_costs(found, tree)
    words = [min(3.0, math.log1p(b.text.count(" ") + 1)) for b in found]
    rows = []
    for k, b in enumerate(found):
        beside = [j for j in (k - 1, k + 1) if 0 <= j < len(found)]
        against = max(hint[k], float(b.chrome))
        rows.append(
            (
                1.0, words[k], b.linked, b.tag in ("p", "blockquote", "pre"), b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th", "dt", "dd"), b.text[-1:] in ".!?…。",
                b.article * (1 - against), b.chrome, hint[k], sum(words[j] for j in beside) / (3 * len(beside)) if beside else 0.0, sum(found[j].linked for j in beside) / len(beside) if beside else 0.0,
            )
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


def fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier that labelled feature rows and the prior make most likely.

    Both classes count alike, together as much as EVIDENCE labels; without one of them it is the prior.
    """
    if not len(labels) or labels.all() or not labels.any():
        return PRIOR
    each = EVIDENCE / 2 / np.where(labels, labels.sum(), (~labels).sum())
    w = PRIOR.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (each * (p - labels)) + w - PRIOR
        curve = (rows.T * (each * p * (1 - p))) @ rows + np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut.

    gain > 0: capacity from the source; gain < 0: capacity to the sink; edges
    hold in both directions.  Maximum flow by blocking flows over levels.
    """
    n = len(gain)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for i, j, c in edges:
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += (j, i)
        room += (c, c)
    left, tiny = list(gain), 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] > tiny)
        sources, open_ = list(queue), False
        for i in sources:
            level[i] = 0
        while queue:
            i = queue.popleft()
            open_ = open_ or left[i] < -tiny
            for e in near[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not open_:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in sources:
            path: list[int] = []
            i = s
            while left[s] > tiny:
                if left[i] < -tiny:
                    flow = min(left[s], -left[i], *(room[e] for e in path))
                    left[s] -= flow
                    left[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], s
                    continue
                while tried[i] < len(near[i]):
                    e = near[i][tried[i]]
                    if room[e] > tiny and level[to[e]] == level[i] + 1:
                        break
                    tried[i] += 1
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                    continue
                path.append(e)
                i = to[e]


def edges_of(found: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Neighbours in the text and in the tree, with the price of labelling them differently."""
    edges = []
    for i, b in enumerate(found):
        for k in (1, 2):
            if i + k < len(found):
                other = found[i + k]
                same = b.parent == other.parent
                if k == 1:
                    cousin = not same and (tree.parent[b.parent] == other.parent or b.parent == tree.parent[other.parent] or tree.parent[b.parent] == tree.parent[other.parent])
                    edges.append((i, i + 1, NEXT_PRICE + SIBLING_PRICE * same + COUSIN_PRICE * cousin))
                elif same:
                    edges.append((i, i + 2, NEAR_PRICE))
    return edges


def labelled(page: str | None, weights: np.ndarray = PRIOR) -> tuple[list[Block], list[float], list[bool]]:
    """The page's blocks, their log-odds of being content, and which of them the cut calls content."""
    found, tree = blocks(page or "")
    if not found:
        return [], [], []
    gain = np.clip(features(found, tree) @ weights, -SURE, SURE).tolist()
    return found, gain, min_cut(gain, edges_of(found, tree))


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    found, _, content = labelled(page, weights)
    return "\n\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def sample_rows(page: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows, labels) of at most SAMPLE_BLOCKS blocks of a page that marks both its article and its chrome."""
    found, tree = blocks(page or "")
    rows = features(found, tree)
    good = np.array([b.article and not b.chrome for b in found], bool)
    bad = np.array([b.chrome and not b.article for b in found], bool)
    if not good.any() or not bad.any():
        return rows[:0], good[:0]
    at = np.flatnonzero(good | bad)
    at = at[np.linspace(0, len(at) - 1, min(len(at), SAMPLE_BLOCKS)).astype(int)]
    rows, good = rows[at].copy(), good[at]
    rows[::2, [ARTICLE, CHROME_AT]] = 0
    return rows, good


def learn(pages: DataFrame, most: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights fitted to the pages of least hash that mark article and chrome."""
    keyed = pages.filter(F.col("html").isNotNull()).select(F.xxhash64("url", "html").alias("key"), "html")
    keys = keyed.select("key").distinct().orderBy("key").limit(most)
    # Repeated pages count once.
    last = keys.agg(F.max("key")).first()[0]
    if last is None:
        return PRIOR

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0):
                rows, good = sample_rows(html.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array(good, pa.bool_())], names=["row", "good"])

    chosen = keyed.filter(F.col("key") <= last).dropDuplicates(["key"]).select("html")
    taken = chosen.mapInArrow(step, "row array<double>, good boolean").toArrow()  # at most `most` x SAMPLE_BLOCKS rows of numbers
    rows = np.array(taken["row"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(rows, taken["good"].to_numpy())


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, weights: np.ndarray = PRIOR) -> DataFrame:
    """RESULT, one row per page."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(step, RESULT)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
