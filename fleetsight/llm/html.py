"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element is a binary variable (content or not). Its own evidence
is a logistic model of its tag, name tokens, text, link and form shape;
parent and child are tied by a learned 2 x 2 table. The sum-product passes
messages from the leaves up and from the root down, which gives every node's
exact marginal; the text runs of nodes with a marginal of at least one half
are the main text.

Learned from labelled pages: those of the table whose markup names the
article itself (out of about ``fit_pages``, a documented bound; what is
collected are counts of distinct feature vectors), and the layouts of
:mod:`fleetsight.llm.layouts`, which are built with their labels.

Defined results: a null or empty page, and a page without text, has an empty
text; broken markup is read as browsers do where it matters (open elements,
cut-off tags and references); repeated rows are read one by one; an empty
table gives an empty result; ids and urls are carried as they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fleetsight.llm import layouts
from fleetsight.llm.dom import Page
from fleetsight.llm.sampling import hashed_sample
from fleetsight.llm.toxicity import newton

FIT_PAGES = 1_000

# Name tokens that sites give to page parts.
NAMES = {
    "content": "article content post entry story main body text prose page",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pager pagination skip links",
    "header": "header masthead topbar logo branding hero tagline",
    "footer": "footer copyright legal bottom colophon imprint",
    "side": "sidebar aside side widget related recommended recommendations trending popular teaser more rail",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast disclaimer",
    "form": "form search login signup subscribe subscription newsletter contact register",
    "comment": "comment comments reply replies respond disqus discussion reader feedback",
    "share": "share sharing social follow tags tag meta byline author rating print",
}
NAMES = {k: frozenset(v.split()) for k, v in NAMES.items()}
TAGS = """#page html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre
figure figcaption nav header footer aside form fieldset address details menu""".split()


def _bin(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


def features(page: Page, n: int) -> tuple[str, ...]:
    """Discrete features of a node."""
    total = max(1, page.chars[0])
    chars, own = page.chars[n], page.own[n]
    out = ["tag=" + (page.tag[n] if page.tag[n] in TAGS else "other")]
    up = page.parent[n]
    out.append("up=" + (page.tag[up] if up >= 0 and page.tag[up] in TAGS else "other"))
    if up >= 0:
        out += [f"upname={k}" for k, words in NAMES.items() if page.names[up] & words]
    names = page.names[n]
    out += [f"name={k}" for k, words in NAMES.items() if names & words] if names else ["name=none"]
    density = _bin(page.links[n] / max(1, chars), (0.01, 0.2, 0.5, 0.8))
    out.append(f"links={density}")
    out.append(f"own={_bin(own, (1, 25, 80, 200, 500))}")
    out.append(f"stop={int(page.stops[n] > 0)}{int(own > 0)}")
    if not own:
        out.append(f"share={_bin(chars / total, (0.01, 0.05, 0.2, 0.5, 0.8))}")
    if page.controls[n]:
        out.append("controls")
    out.append(f"at={_bin(page.before[n] / total, (0.02, 0.2, 0.8, 0.98))}")
    return tuple(out)


def node_labels(page: Page, content_tags=("article", "main")) -> list[int] | None:
    """Labels of a page's nodes, or None when the page does not say what its main text is.

    ``data-main`` says so outright; otherwise an article or main element holds the main text, except for
    parts in it that are named as something else. A node with text below it takes that text's majority, an empty
    one its parent's label.
    """
    other = {"nav", "footer", "aside", "form", "menu"}
    told = any(m is not None for m in page.main)
    if not told and not any(t in content_tags for t in page.tag):
        return None
    inside = [0] * len(page.parent)
    for n in range(1, len(page.parent)):
        v = inside[page.parent[n]]
        if told:
            v = v if page.main[n] is None else int(page.main[n])
        elif page.tag[n] in content_tags:
            v = 1
        elif page.tag[n] in other or any(page.names[n] & NAMES[k] for k in ("advert", "comment", "form", "notice")):
            v = 0
        inside[n] = v
    good, size = [0] * len(inside), [0] * len(inside)
    for n, text in page.runs:
        size[n] += len(text)
        good[n] += len(text) * inside[n]
    for n in range(len(inside) - 1, 0, -1):
        good[page.parent[n]] += good[n]
        size[page.parent[n]] += size[n]
    return [int(2 * g > s) if s else i for g, s, i in zip(good, size, inside)]


class Model:
    """Evidence weights per feature (log-odds without the prior), transition table and root prior."""

    def __init__(self, weight: dict[str, float], step: np.ndarray, root: float):
        self.weight = weight
        self.step = [[float(v) for v in row] for row in step]       # step[parent][child]
        self.root = root

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node: messages up (parents come first, so backwards) and then down."""
        n_nodes, (a, b) = len(page.parent), self.step
        # belief from below, as P(1) of a normalised pair; odds are kept as pairs to stay in range
        below: list[tuple[float, float]] = []
        for n in range(n_nodes):
            z = max(-30.0, min(30.0, sum(self.weight.get(f, 0.0) for f in features(page, n))))
            p = 1 / (1 + np.exp(-z))
            below.append((1 - p, p))
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n_nodes
        for n in range(n_nodes - 1, 0, -1):
            b0, b1 = below[n]
            m0, m1 = a[0] * b0 + a[1] * b1, b[0] * b0 + b[1] * b1
            s = m0 + m1
            up[n] = (m0 / s, m1 / s)
            p0, p1 = below[page.parent[n]]
            p0, p1 = p0 * up[n][0], p1 * up[n][1]
            s = p0 + p1
            below[page.parent[n]] = (p0 / s, p1 / s)
        out = [0.0] * n_nodes
        p0, p1 = below[0][0] * (1 - self.root), below[0][1] * self.root
        out[0] = p1 / (p0 + p1)
        for n in range(1, n_nodes):
            q = out[page.parent[n]]
            # what the parent believes without this child's message
            r0, r1 = (1 - q) / up[n][0], q / up[n][1]
            d0, d1 = r0 * a[0] + r1 * b[0], r0 * a[1] + r1 * b[1]
            p0, p1 = below[n][0] * d0, below[n][1] * d1
            out[n] = p1 / (p0 + p1)
        return out

    def text(self, html: str | None) -> str:
        page = Page(html)
        if not page.runs:
            return ""
        p = self.marginals(page)
        return "\n".join(text for n, text in page.runs if p[n] >= 0.5)


def _examples(html: str | None) -> list[tuple[tuple[str, ...], int, int]]:
    page = Page(html)
    y = node_labels(page)
    if y is None or not page.runs:
        return []
    return [(features(page, n), y[n], y[page.parent[n]] if n else -1) for n in range(len(y))]


def learn(counts: Counter, ridge: float = 1.0) -> Model:
    """From counts of (features, label, parent's label or -1)."""
    names = sorted({f for fs, _, _ in counts for f in fs})
    at = {f: i for i, f in enumerate(names)}
    rows: Counter = Counter()
    step, root = np.ones((2, 2)), np.ones(2)
    for (fs, y, up), n in counts.items():
        rows[fs, y] += n
        if up < 0:
            root[y] += n
        else:
            step[up, y] += n
    x = np.zeros((len(rows), len(names)))
    y, n = np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((fs, label), k) in enumerate(sorted(rows.items())):
        x[i, [at[f] for f in fs]] = 1
        y[i], n[i] = label, k
    w = newton(x, y, ridge, weight=n)
    share = (n @ y + 1) / (n.sum() + 2)
    prior = np.log(share / (1 - share))
    # the classifier's log-odds less the prior's are the evidence; the features' common offset carries it
    weight = {f: float(w[i]) for f, i in at.items()}
    for f in weight:
        if f.startswith("tag="):                  # each node has exactly one
            weight[f] += float(w[-1] - prior)
    return Model(weight, step / step.sum(axis=1, keepdims=True), float(root[1] / root.sum()))


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", fit_pages: int = FIT_PAGES,
        built: int = layouts.PAGES) -> Model:
    """Learn from about ``fit_pages`` pages of the table and ``built`` layouts, the two weighed alike."""
    rows = hashed_sample(pages.select(id_col, F.col(html_col).alias("h")), fit_pages, id_col).where(
        F.col("h").isNotNull() & F.col("h").rlike("(?i)<(article|main)[\\s>]")).select("h")

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for h in batch.column(0):
                counts.update(_examples(h.as_py()))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([" ".join(k[0]) for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["f", "y", "up", "n"])

    got = (rows.mapInArrow(run, "f string, y int, up int, n long").groupBy("f", "y", "up")
           .agg(F.sum("n").alias("n")).collect())
    own: Counter = Counter()
    for h in layouts.pages(built):
        own.update(_examples(h))
    seen = Counter({(tuple(r["f"].split(" ")), r["y"], r["up"]): r["n"] for r in got})
    scale = sum(own.values()) / max(1, sum(seen.values()))
    return learn(own + Counter({k: n * scale for k, n in seen.items()}))


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text and ``n_chars`` (its code points)."""
    new = [StructField(text_col, StringType()), StructField("n_chars", LongType())]
    taken = {html_col.lower(), text_col.lower(), "n_chars"}
    rest = [c for c in pages.columns if c.lower() not in taken]
    src = pages.select(*[f"`{c}`" for c in rest], F.col(f"`{html_col}`").alias("_whole_html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)       # a weight per feature name of this module

    def run(batches):
        m = shared.value
        for batch in batches:
            text = [m.text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                [*rest, text_col, "n_chars"])

    return src.mapInArrow(run, StructType([*src.schema.fields[:-1], *new]))
