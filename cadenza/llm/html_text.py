"""Main text of web pages: boosted trees judge the nodes of the DOM, and a tree-wide decoding keeps their verdicts consistent.

Each node gets the probability of being content from features of its subtree (text and link density, counts), its attribute
tokens, its depth and its siblings. Decoding takes the most probable assignment in which nothing below a dropped node is
kept, by one pass up the tree and one down.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object button select option textarea input label".split())
RAW = frozenset("script style textarea title noscript".split())
BLOCK = frozenset(
    "html body p h1 h2 h3 h4 h5 h6 div section article main header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr center dialog menu".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
TAGS = "p h1 h2 h3 h4 h5 h6 div section article main header footer nav aside form ul ol li table tr td blockquote pre figure figcaption body a span b".split()
#: Nodes that hold whatever the page has, and are never judged; bare text and inline elements in them make up runs (RUN), one
#: between any two breaks, which are judged. A run without text of its own that turns out to hold blocks becomes an OPEN one.
RUN, OPEN = "#run", "#open"
AROUND = frozenset(("#", "html", "body", OPEN))
#: Attribute tokens (of class, id, role) that tell of either kind.
FOR_TEXT = frozenset("article content main body post entry story text page blog".split())
AGAINST = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side rail widget "
    "related share social notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup login form search comment comments reply replies disqus respond "
    "tags pagination pager copyright legal complementary contentinfo toolbar".split()
)
PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
TOKEN = re.compile(r"[a-z]+")
#: The model is fitted on this many pages at most, picked by hash, and on this many nodes of a version of a page, evenly spread.
SAMPLE_PAGES, SAMPLE_NODES, TREES, DEPTH, RATE = 240, 2000, 24, 4, 0.3


@dataclass
class Dom:
    """Nodes in page order; items: texts and breaks in page order, each with the node that holds it."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    items: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Dom:
    """A forgiving reading: unclosed elements end with their parents, stray end tags are passed over."""
    dom, stack, at = Dom(["#"], [-1], [[]], [False]), [0], 0
    texts: set[int] = set()  # the nodes that hold text themselves
    opened: Counter = Counter()  # how many of a tag are open
    runs: list[int] = []  # open runs

    def open_node(tag: str, attributes: str) -> None:
        tokens = []
        for name, *values in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                tokens += TOKEN.findall("".join(values).lower())
            elif name.lower() == "hidden":
                tokens.append("hidden")
        dom.tags.append(tag)
        dom.parents.append(stack[-1])
        dom.tokens.append(tokens)
        dom.hidden.append(dom.hidden[stack[-1]] or tag in HIDDEN)
        stack.append(len(dom.tags) - 1)
        opened[tag] += 1
        if tag == RUN:
            runs.append(stack[-1])

    def close() -> str:
        i = stack.pop()
        if runs and runs[-1] == i:
            runs.pop()
            opened[RUN] -= 1
        else:
            opened[dom.tags[i]] -= 1
        return dom.tags[i]

    def run_begins() -> None:
        if dom.tags[stack[-1]] in AROUND:
            open_node(RUN, "")

    def run_ends() -> None:
        if dom.tags[stack[-1]] == RUN:
            close()

    def open_up() -> None:
        for i in runs:
            if i not in texts:
                dom.tags[i] = OPEN

    def close_to(names: set[str], within: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = dom.tags[stack[k]]
            if tag in names:
                while len(stack) > k:
                    close()
                return
            if tag in within:
                return

    while at < len(page):
        m = PART.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not dom.hidden[stack[-1]]:
            if text.strip():
                run_begins()
                texts.add(stack[-1])
            dom.items.append((stack[-1], text))
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCK:
                run_ends()
            if opened[tag] > 0:
                while close() != tag:
                    pass
            if tag in BLOCK:
                dom.items.append((stack[-1], ""))
        elif m[2]:
            tag = m[2].lower()
            if tag in ("br", "wbr"):
                dom.items.append((stack[-1], "\n" if tag == "br" else "​"))
                continue
            if tag in CLOSES:
                close_to(*CLOSES[tag])
            if tag in BLOCK:
                run_ends()
                open_up()
                close_to({"p"}, BLOCK - {"p"} | {"button"})
                dom.items.append((stack[-1], ""))
            if tag in VOID:
                continue
            if tag not in BLOCK and tag not in HIDDEN:
                run_begins()
            open_node(tag, m[3])
            if m[3].rstrip().endswith("/") and tag not in BLOCK:
                close()
            elif tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                close()
    return dom


FEATURES = 14 + len(TAGS)


def features(dom: Dom, plain: bool = False) -> np.ndarray:
    """One row a node. plain leaves out tag names and attribute tokens, for training on pages that don't tell."""
    n = len(dom.tags)
    own, link, kids, place, depth, same = (np.zeros(n) for _ in range(6))
    subtree, paragraphs = np.ones(n), np.zeros(n)
    linked = [False] * n
    good, bad = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = dom.parents[i]
        depth[i], place[i] = depth[p] + 1, kids[p]
        kids[p] += 1
        linked[i] = linked[p] or dom.tags[i] == "a"
        paragraphs[i] = dom.tags[i] == "p"
        if not plain:
            good[i] = sum(t in FOR_TEXT for t in dom.tokens[i])
            bad[i] = sum(t in AGAINST for t in dom.tokens[i])
    stops = np.zeros(n)
    for i, text in dom.items:
        size = len(text.strip())
        own[i] += size
        link[i] += size * linked[i]
        stops[i] += text.count(". ") + text.count(", ")
    total, in_link, marks = own.copy(), link.copy(), stops.copy()
    for i in range(n - 1, 0, -1):
        p = dom.parents[i]
        for a in (total, in_link, subtree, paragraphs, marks):
            a[p] += a[i]
    up = np.array([max(0, p) for p in dom.parents])
    for i in range(1, n):
        same[i] = dom.tags[i] == dom.tags[up[i]]
    rows = np.zeros((n, FEATURES))
    rows[:, :14] = np.stack(
        [np.log1p(total), np.log1p(own), in_link / np.maximum(1, total), total / subtree, np.log1p(subtree), np.log1p(paragraphs), depth, kids, place, kids[up], total / np.maximum(1, total[up]), marks / np.maximum(1, total) * 100, good, bad], 1
    )
    if not plain:
        index = {t: k for k, t in enumerate(TAGS)}
        for i, tag in enumerate(dom.tags):
            if tag in index:
                rows[i, 14 + index[tag]] = 1
    return rows


def weak_labels(dom: Dom) -> np.ndarray:
    """1 content, 0 other, -1 unknown (around both): from what pages say of themselves, by tags and attribute tokens."""
    n = len(dom.tags)
    label = np.full(n, -1)
    inside = [0] * n
    for i in range(1, n):
        inside[i] = inside[dom.parents[i]]
        tag, tokens = dom.tags[i], dom.tokens[i]
        heads = tag == "header" and inside[i] == 1 and not (set(tokens) - {"header"}) & AGAINST  # an article's own
        if inside[i] >= 0 and not heads and (tag in ("nav", "footer", "aside", "form", "header") or any(t in AGAINST for t in tokens)):
            inside[i] = -1
        elif inside[i] == 0 and (tag in ("article", "main") or any(t in ("article", "content", "main") for t in tokens)):
            inside[i] = 1
        label[i] = {1: 1, -1: 0, 0: -1}[inside[i]]
    holds = np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        holds[dom.parents[i]] |= holds[i] | (label[i] == 1)
    return np.where((label == -1) & ~holds, 0, label)


#: Parts that the pages at hand may lack but other pages have; put into training pages, around texts of the page's own.
INSERTS = (
    '<aside class="sidebar"><h3>{0}</h3><ul><li><a href="/">{1}</a></li></ul></aside>', '<form id="newsletter"><p>{0}</p><input></form>', '<div class="cookie notice"><p>{0}</p></div>',
    '<section class="comments"><h3>{0}</h3><div class="comment"><p>{1}</p><p>{2}</p></div></section>', '<div id="related"><a href="/">{0}</a><a href="/">{1}</a></div>', '<header class="masthead"><div>{0}</div></header>',
)


def bare_version(dom: Dom, label: np.ndarray, apart: bool) -> tuple[Dom, np.ndarray]:
    """The page's judged texts put straight into a body, as runs with the labels they had; blocks of one label are runs of
    their own, or (not apart) parts of one run."""
    n = len(dom.tags)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[dom.parents[i]] or dom.tags[i] == "a"
    runs: list[tuple[int, list[str]]] = []
    fresh = True
    for i, text in dom.items:
        if text == "":
            fresh = True
        elif label[i] >= 0 and text.strip():
            if not runs or runs[-1][0] != label[i] or (fresh and apart):
                runs.append((int(label[i]), []))
            elif fresh:
                runs[-1][1].append("<br><br>")
            runs[-1][1].append(f"<a>{text}</a>" if linked[i] else text)
            fresh = False
    made = parse("<html><body>" + "<hr>".join("".join(parts) for _, parts in runs) + "</body></html>")
    out, order = np.full(len(made.tags), -1), iter(runs)
    for i in range(1, len(made.tags)):
        out[i] = next(order)[0] if made.tags[i] == RUN else out[made.parents[i]]
    return made, out


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for k, page in enumerate(pages):
        texts = [t for t in re.findall(r">([^<>]{8,200})<", page)[:40]] or ["text"]
        made = INSERTS[k % len(INSERTS)].format(*(texts[(k + j) % len(texts)] for j in range(3)))
        into = re.sub(r"(</article>|</body>|\Z)", lambda m: made + m[0], page, count=1)
        versions = [(dom, weak_labels(dom)) for dom in map(parse, (page, into))]
        if (versions[1][1] == 1).any():
            versions += [bare_version(*versions[1], apart) for apart in (False, True)]
        for dom, label in versions:
            shown = np.flatnonzero((label >= 0) & ~np.array(dom.hidden))
            shown = shown[np.linspace(0, len(shown) - 1, SAMPLE_NODES).astype(int)] if len(shown) > SAMPLE_NODES else shown
            for plain in (False, True):
                xs.append(features(dom, plain)[shown])
                ys.append(label[shown])
    return np.concatenate(xs), np.concatenate(ys)


@dataclass
class Trees:
    """Complete trees of one depth: at node k of a tree, feature[k] <= cut[k] goes to 2k + 1, else to 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the log loss, with Newton leaves and candidate cuts at 16 quantiles of each feature."""
    n, inner = len(y), 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 16))) for j in range(x.shape[1])] if n else []
    mean = min(0.98, max(0.02, float(y.mean()))) if n else 0.5
    start = math.log(mean / (1 - mean))
    logit, trees = np.full(n, start), []
    for _ in range(TREES if n else 0):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p) + 1e-9
        f, c, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(n, np.int64)
        for k in range(inner):
            here = np.flatnonzero(at == k)
            if len(here) >= 20:
                gs, hs, best = g[here], h[here], 1e-3
                base = gs.sum() ** 2 / (hs.sum() + 1)
                for j, options in enumerate(cuts):
                    v = x[here, j]
                    for cut in options:
                        low = v <= cut
                        if 5 <= low.sum() <= len(here) - 5:
                            gl, hl = gs[low].sum(), hs[low].sum()
                            gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - base
                            if gain > best:
                                best, f[k], c[k] = gain, j, cut
            at[here] = 2 * k + 1 + (x[here, f[k]] > c[k])
        for k in range(inner + 1):
            here = at == inner + k
            leaf[k] = RATE * g[here].sum() / (h[here].sum() + 1)
        logit += leaf[at - inner]
        trees.append((f, c, leaf))
    fs, cs, ls = zip(*trees, strict=True) if trees else ((), (), ())
    return Trees(np.array(fs), np.array(cs), np.array(ls), start)


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> Trees:
    """Fits on at most sample_pages different pages, whole, the ones whose ids and texts hash lowest; Spark tasks make the
    features, of SAMPLE_NODES nodes at most from each version of a page."""

    def rows(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                x, y = training_rows([page])
                yield pa.RecordBatch.from_pydict({"x": pa.array([x.astype("<f8").tobytes()], pa.binary()), "y": pa.array([y.astype("<i8").tobytes()], pa.binary())})

    keyed = pages.filter(F.col(html_col).isNotNull()).select(F.col(html_col).alias("page"), F.xxhash64(F.col(id_col).cast("string"), html_col, F.lit("sample")).alias("order"))
    sample = keyed.select("order").distinct().orderBy("order").limit(sample_pages)
    chosen = keyed.join(F.broadcast(sample), "order").dropDuplicates(["order"]).select("page")
    got = chosen.mapInArrow(rows, "x binary, y binary").collect()
    if not got:
        return boost(np.zeros((0, FEATURES)), np.zeros(0))
    return boost(np.concatenate([np.frombuffer(bytes(r[0]), "<f8").reshape(-1, FEATURES) for r in got]), np.concatenate([np.frombuffer(bytes(r[1]), "<i8") for r in got]))


def decode(dom: Dom, logit: np.ndarray) -> np.ndarray:
    """Kept or not, by node: of all choices in which a dropped node has no kept descendant, the most probable one."""
    n = len(dom.tags)
    keep = -np.logaddexp(0, -logit)  # log p
    drop = -np.logaddexp(0, logit)
    keep[0] = 0
    with_run = np.array([t == RUN for t in dom.tags])  # a run and the inline elements that share its verdict
    for i in range(1, n):
        inline = with_run[dom.parents[i]] and dom.tags[i] not in BLOCK and not any(t in AGAINST for t in dom.tokens[i])
        with_run[i] |= inline
        if dom.tags[i] in AROUND or inline:
            keep[i] = drop[i] = 0
    kept, dropped = keep.copy(), drop.copy()
    for i in range(n - 1, 0, -1):
        p = dom.parents[i]
        kept[p] += max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[dom.parents[i]] and kept[i] >= dropped[i] and not dom.hidden[i]
    return out


def main_text(dom: Dom, kept: np.ndarray) -> str:
    """Kept blocks in page order, joined by two line breaks; white space within a block becomes one space."""
    blocks: list[str] = []
    parts: list[str] = []
    for i, text in [*dom.items, (0, "")]:
        if text == "":
            block = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            if block:
                blocks.append(block)
            parts = []
        elif kept[i] and text != "​" and dom.tags[i] not in AROUND:
            parts.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. A null or empty page has an empty text. Whole pages are read; nothing
    shuffles; repeated rows come out as often, other columns are left out. The model is a few kilobytes."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            doms = [parse(x or "") for x in batch.column(2).to_pylist()]
            sizes = np.cumsum([0, *(len(d.tags) for d in doms)])
            logit = shared.value.logit(np.concatenate([features(d) for d in doms])) if doms else np.zeros(0)
            texts = [main_text(d, decode(d, logit[a:b])) for d, a, b in zip(doms, sizes, sizes[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
