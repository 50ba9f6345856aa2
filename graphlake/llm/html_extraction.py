"""Main text of HTML pages by a tree-structured graphical model.

Every block element and text block of a page is a binary variable, content or
not. A log-linear score of what the node shows (tag, class and id words, length,
links, punctuation) and a potential between parent and child make a tree-shaped
Markov random field. Sum-product messages upward and downward give each text
block's marginal, and the blocks that are likelier content are the text. The
weights maximise the likelihood of labelled pages, which are generated here:
layouts are drawn from a list of page parts whose role is known.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.html_tree import Tree, parse

HASHED = 1024
TRAINING_PAGES = 400
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Kinds of edges with a potential of their own: child is a text block, or not.
EDGES = 2


@functools.lru_cache(20_000)
def _hashed(what: str) -> int:
    return xxhash.xxh3_64_intdigest(what) % HASHED


@functools.lru_cache(20_000)
def _name_features(names: str) -> tuple[int, ...]:
    return tuple({_hashed(f"name {w.lower()}") for w in NAME.findall(names)})


def node_features(tree: Tree) -> list[tuple[int, ...]]:
    """The features each node shows; sizes and link shares of elements are of all
    the text below them."""
    n = len(tree.tag)
    size, linked = [len(t) for t in tree.text], list(tree.linked)
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        linked[tree.parent[i]] += linked[i]
    out = []
    for i in range(n):
        share = 4 * min(linked[i], size[i]) // max(size[i], 1)
        kind = "text" if tree.tag[i] == "#" else "box"
        own = [_hashed(f"tag {tree.tag[i]}"), _hashed(f"{kind} size {min(size[i].bit_length(), 10)}"), _hashed(f"{kind} links {share}")]
        if kind == "text":
            text = tree.text[i]
            own += [_hashed(f"in {tree.tag[tree.parent[i]]}"), _hashed(f"ends {text[-1] in '.!?…:;'}")]
        else:
            own += _name_features(tree.names[i])
        out.append(tuple(own))
    return out


class Forest:
    """The trees of several pages as one, by depth, so that a message pass over
    all of them is one array operation per level."""

    def __init__(self, trees: list[Tree]):
        starts = np.cumsum([0] + [len(t.tag) for t in trees])
        self.starts = starts
        self.parent = np.concatenate([np.array(t.parent) + s * (np.array(t.parent) >= 0) for t, s in zip(trees, starts)])
        depth = np.zeros(starts[-1], np.int64)
        for i, p in enumerate(self.parent.tolist()):
            depth[i] = 0 if p < 0 else depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.edge = np.concatenate([[int(x != "#") for x in t.tag] for t in trees])
        rows = [f for t in trees for f in node_features(t)]
        self.node = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        self.feature = np.concatenate([np.array(f) for f in rows])


def marginals(forest: Forest, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) per node, P(parent state, child state) per node) by sum-product."""
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.node, weights=weights[forest.feature], minlength=n)
    below = own.copy()  # a node's score with what its children say
    up = np.zeros((n, 2))  # message to the parent, by the parent's state
    for level in forest.levels[:0:-1]:
        both = pairs[forest.edge[level]] + below[level][:, None, :]
        up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        up[level] -= up[level].max(axis=1, keepdims=True)
        np.add.at(below, forest.parent[level], up[level])
    down = np.zeros((n, 2))  # message from the parent, by the node's state
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        p = forest.parent[level]
        rest = below[p] + down[p] - up[level]
        both = rest[:, :, None] + pairs[forest.edge[level]]
        down[level] = np.logaddexp(both[:, 0], both[:, 1])
        down[level] -= down[level].max(axis=1, keepdims=True)
        full = both + below[level][:, None, :]
        full = np.exp(full - full.max(axis=(1, 2), keepdims=True))
        joint[level] = full / full.sum(axis=(1, 2), keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@dataclass
class TreeModel:
    weights: np.ndarray
    pairs: np.ndarray

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        forest = Forest(trees)
        content, _ = marginals(forest, self.weights, self.pairs)
        out = []
        for tree, start in zip(trees, forest.starts):
            blocks = [t for i, t in enumerate(tree.text) if tree.tag[i] == "#" and content[start + i] >= 0.5]
            out.append("\n".join(blocks))
        return out


def fit(trees: list[Tree], labels: list[list[int]], rounds: int = 250, l2: float = 1e-4) -> TreeModel:
    """Adam on the log likelihood of whole labelled trees."""
    forest = Forest(trees)
    y = np.concatenate([np.array(x) for x in labels])
    child = forest.parent >= 0
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    state, n = np.zeros(HASHED + seen.size), len(trees)
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        p, joint = marginals(forest, state[:HASHED], state[HASHED:].reshape(seen.shape))
        expected = np.stack([joint[child & (forest.edge == k)].sum(axis=0) for k in range(EDGES)])
        g = np.concatenate([np.bincount(forest.feature, weights=(p - y)[forest.node], minlength=HASHED), (expected - seen).ravel()]) / n + l2 * state
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        state -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel(state[:HASHED].copy(), state[HASHED:].reshape(seen.shape).copy())


# Class and id names that page parts commonly carry.
NAMES = {
    "menu": "nav navbar menu main-menu navigation site-nav topnav breadcrumb breadcrumbs tabs pagination pager toc-links",
    "header": "header site-header page-header masthead top-bar branding logo banner-top",
    "footer": "footer site-footer page-footer bottom colophon copyright legal credits footer-links",
    "sidebar": "sidebar side-bar aside rail right-column widget widgets related related-posts recommended popular trending more-stories tag-cloud",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert warning-bar popup modal overlay paywall announcement",
    "advert": "ad ads advert advertisement adsense ad-slot sponsor sponsored promo promotion banner-ad commercial",
    "form": "form search search-form newsletter signup subscribe login contact-form subscription",
    "comments": "comments comment-list comment reply discussion responses disqus respond reader-comments feedback",
    "share": "share social share-buttons social-links tools print-links",
    "byline": "byline author author-box author-bio meta post-meta entry-meta dateline published",
    "article": "article content main-content post post-content entry entry-content story story-body article-body text body-text page-content",
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def labelled_pages(count: int, seed: int = 4) -> list[str]:
    """Generated pages whose elements say by ``data-keep`` whether what stands in
    them is content."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    names = {k: v.split() for k, v in NAMES.items()}

    def words(n: int) -> str:
        letters = "etaoinshrdlucmfwygpbvk"
        out = ["".join(letters[min(int(x), 21)] for x in rng.exponential(6, rng.integers(2, 10))) for _ in range(n)]
        text = " ".join(out)
        return text[:1].upper() + text[1:]

    def sentence(low: int = 1, high: int = 25) -> str:
        return words(int(rng.integers(low, high))) + pick([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        text = " ".join(sentence() for _ in range(rng.integers(1, 7)))
        if rng.random() < 0.3:
            text = f"<b>{sentence()}</b> " + text
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(3)}</a> ' + sentence()
        return text

    def links() -> str:
        body = [f'<a href="/{i}">{words(int(rng.integers(1, 5)))}</a>' for i in range(rng.integers(2, 9))]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in body) + "</ul>"
        return pick([" | ", " ", " &middot; "]).join(body)

    def inner(kind: str) -> str:
        if kind == "menu":
            return links()
        if kind == "header":
            return pick([words(2), f"<h1>{words(3)}</h1>", f'<a href="/">{words(2)}</a>', f"<p>{sentence()}</p>"]) + (links() if rng.random() < 0.4 else "")
        if kind == "footer":
            return pick(["&copy; ", "", ""]) + pick([sentence(), f"<p>{prose()}</p>", links(), f"{words(3)} &middot; {sentence()}"])
        if kind == "sidebar":
            return f"<h3>{words(2)}</h3>" * int(rng.integers(2)) + pick([links(), f"<p>{prose()}</p>", f"<p>{sentence()}</p>" + links()])
        if kind == "form":
            return f"<label>{words(2)}</label><input><p>{sentence()}</p><button>{words(1)}</button>"
        if kind == "comments":
            return f"<h3>{words(2)}</h3>" + "".join(f'<div class="{pick(["comment", "comment-body", "reply", ""])}"><p>{prose()}</p></div>' for _ in range(rng.integers(1, 6)))
        if kind == "share":
            return pick([links(), words(3), sentence(1, 6)])
        return pick([prose(), f"<p>{prose()}</p>", sentence(), links(), f"{sentence()}<button>{words(1)}</button>"])

    def box(kind: str) -> str:
        named = rng.random() < 0.75 or kind not in SEMANTIC
        attr = f' {pick(["class", "class", "id"])}="{pick(names[kind])}"' if named else ""
        plain = pick(["div", "div", "section", "ul" if kind == "menu" else "div"])
        tag = SEMANTIC[kind] if kind in SEMANTIC and (not named or rng.random() < 0.6) else plain
        body = inner(kind)
        return f'<{"div" if tag == "ul" else tag}{attr} data-keep="0">{body}</{"div" if tag == "ul" else tag}>'

    def byline() -> str:
        """Who wrote it and when: short, often linked, and part of the article."""
        tag = pick(["p", "div", "span", "address", "section"])
        said = pick([f"By {words(2)}", f'By <a href="/a">{words(2)}</a>', f"{words(2)}, {rng.integers(1, 29)} May 20{rng.integers(10, 30)}", f"<p>{sentence(2, 12)}</p>"])
        return f'<{tag} class="{pick(names["byline"])}">{said}</{tag}>'

    def article() -> str:
        out = [f"<h1>{sentence(2, 14)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.4:
            out.append(byline())
        for _ in range(rng.integers(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{prose()}</p>")
            elif kind < 0.8:
                out.append(f"<h2>{words(int(rng.integers(1, 6)))}</h2>" if rng.random() < 0.5 else f"<h3>{words(int(rng.integers(1, 6)))}</h3>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>")
            elif kind < 0.95:
                out.append(f"<div>{prose()}</div>")
            elif kind < 0.97:
                out.append(byline())
            else:
                out.append(box(pick(["advert", "share", "sidebar", "form", "notice"])))
        body = "".join(out)
        named = rng.random() < 0.6
        attr = f' {pick(["class", "id"])}="{pick(names["article"])}"' if named else ""
        tag = pick(["article", "main", "div", "section"]) if named else pick(["article", "article", "main"])
        body = f'<{tag}{attr} data-keep="1">{body}</{tag}>'
        if rng.random() < 0.3:
            body = f'<div data-keep="1">{body}</div>'
        return body

    pages = []
    for _ in range(count):
        before = [box(pick(["menu", "header", "notice", "advert", "form", "share"])) for _ in range(rng.integers(0, 5))]
        after = [box(pick(["footer", "sidebar", "comments", "advert", "share", "form", "menu", "notice"])) for _ in range(rng.integers(0, 5))]
        body = "".join([*before, article(), *after])
        if rng.random() < 0.3:
            body = f'<div class="{pick(["wrapper", "container", "page", "site", "row"])}" data-keep="1">{body}</div>'
        pages.append(f"<html><body>{body}</body></html>")
    return pages


def labels_of(tree: Tree) -> list[int]:
    """A node's label is that of the nearest element that says it; outside of all, 1
    for the page itself."""
    out: list[int] = []
    for keep, parent in zip(tree.keep, tree.parent):
        out.append(int(keep) if keep is not None else out[parent] if parent >= 0 else 1)
    return out


@functools.lru_cache(2)
def train(pages: int = TRAINING_PAGES, seed: int = 4) -> TreeModel:
    """The model of the generated pages, which never change: one fit per process."""
    trees = [parse(p) for p in labelled_pages(pages, seed)]
    return fit(trees, [labels_of(t) for t in trees])


def extract_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Blocks are joined in page order by a line feed, their white space is single
    spaces, character references are decoded. A null or empty page, and one
    without content, has the empty text. A line break inside a block is white
    space. Ids and urls pass as they are, null or repeated; an empty table gives
    no rows; other columns are not read.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train())
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = held.value.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
