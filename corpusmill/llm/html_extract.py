"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the DOM.

Features of a block: the elements above it with the words of their class, id and role, its own element; of its
text the length, share of links, final sign, digits and signs; and how much of the page's text its container holds, in how
many blocks, and with the main heading or without, which tell where names say nothing.  Labels: main text or not, with
transition weights.
The weights are fitted by gradient descent on the likelihood of labelled pages (``html_labelled``; their number is a
parameter), in a few seconds on the driver; tasks decode each page by Viterbi.  One page is one row, no shuffle.
"""

from __future__ import annotations

import collections
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import free_name
from corpusmill.llm.html_blocks import Node, blocks, on_nodes
from corpusmill.llm.html_labelled import labelled_pages

Page = list[tuple[Node, str, int]]


def text_features(text: str, linked: int) -> list[str]:
    """What the text itself tells; ``linked``: its characters inside links."""
    n = len(text)
    words = text.count(" ") + 1
    out = [f"words:{min(7, int(math.log2(words)))}", f"links:{min(4, int(4 * linked / n))}", f"end:{text[-1] if text[-1] in '.!?:;,' else 'other'}"]
    if text[0] == "©" or "©" in text[:40] or text[:9].lower() == "copyright":
        out.append("copyright")
    if any(map(str.isdigit, text[:200])):
        out.append("digit")
    if text.count(",") + text.count(". ") >= 3:
        out.append("prose")
    return out


def place_features(page: Page) -> list[tuple[str, ...]]:
    """What a block's container tells: the nearest element above that is no part of a text."""
    size: dict[Node, int] = {}
    number: dict[Node, int] = {}
    heads = set()
    for node, text, _ in page:
        holder = node.holder
        size[holder] = size.get(holder, 0) + len(text)
        number[holder] = number.get(holder, 0) + 1
        if node.tag == "h1":
            heads.add(holder)
    total = sum(size.values())
    known: dict[Node, tuple[str, ...]] = {}
    for holder, n in size.items():
        share, blocks_ = n / total, number[holder]
        known[holder] = (
            f"share:{0 if share < 0.03 else 1 if share < 0.1 else 2 if share < 0.3 else 3 if share < 0.6 else 4}",
            f"blocks:{blocks_ if blocks_ < 3 else 3 if blocks_ < 6 else 6}",
            "with h1" if holder in heads else "h1 elsewhere" if heads else "no h1",
        )
    return [known[node.holder] for node, _, _ in page]


def page_features(page: Page, placed: bool = True) -> list[list[str]]:
    """All features of each block; without ``placed`` those of its own alone."""
    page = on_nodes(page)
    return [node.features() + text_features(text, linked) + (list(place) if placed else []) for (node, text, linked), place in zip(page, place_features(page), strict=True)]


class Crf:
    """Two labels; emission weights by feature, transition, start and end weights."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.index, self.emit = index, emit
        self.move, self.start, self.end = move.tolist(), start.tolist(), end.tolist()
        self.weights = {f: tuple(self.emit[i].tolist()) for f, i in index.items()}

    def _add(self, sums: tuple[float, float], features) -> tuple[float, float]:
        a, b = sums
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                a, b = a + w[0], b + w[1]
        return a, b

    def above(self, node: Node, known: dict[Node, tuple[float, float]]) -> tuple[float, float]:
        """The weights of what the elements from the root to ``node`` are called: a node's own added to its parent's, once a node (``known``)."""
        rest = []
        at: Node | None = node
        while at is not None and at not in known:
            rest.append(at)
            at = at.parent
        sums = (0.0, 0.0) if at is None else known[at]
        for n in reversed(rest):
            sums = known[n] = self._add(sums, n.new)
        return sums

    def decode(self, page: Page) -> list[int]:
        """The most likely labels (Viterbi; ties go to label 0)."""
        if not page:
            return []
        page = on_nodes(page)
        known: dict[Node, tuple[float, float]] = {}
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        (m00, m01), (m10, m11) = self.move
        for i, ((node, text, linked), place) in enumerate(zip(page, place_features(page), strict=True)):
            own = [f"own:{node.tag}", f"up:{node.parent.tag if node.parent else ''}", *(() if node.main else ("not in article or main",)), *text_features(text, linked), *place]
            e0, e1 = self._add(self.above(node, known), own)
            if i == 0:
                s0, s1 = self.start[0] + e0, self.start[1] + e1
                continue
            to0 = (s0 + m00, 0) if s0 + m00 >= s1 + m10 else (s1 + m10, 1)
            to1 = (s0 + m01, 0) if s0 + m01 >= s1 + m11 else (s1 + m11, 1)
            back.append((to0[1], to1[1]))
            s0, s1 = to0[0] + e0, to1[0] + e1
        label = 0 if s0 + self.end[0] >= s1 + self.end[1] else 1
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def training_set(pages: list[tuple[str, list[int]]], least: int = 1, unplaced: int = 0) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[str, int]]:
    """Features (pages x blocks x features), labels and mask, and the index of the features that ``least`` pages have.

    With ``unplaced`` every so many-th page has no place features, so that names and texts are weighed without them too.
    """
    found = [(page_features(list(blocks(p)), not unplaced or i % unplaced > 0), y) for i, (p, y) in enumerate(pages)]
    found = [(f, y) for f, y in found if len(f) == len(y) and f]
    seen = collections.Counter(f for page, _ in found for f in {f for block in page for f in block})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    n, most = len(found), max(len(f) for f, _ in found)
    x = np.zeros((n, most, len(index)), dtype=np.float32)
    y = np.zeros((n, most), dtype=np.int64)
    mask = np.zeros((n, most), dtype=bool)
    for i, (page, labels) in enumerate(found):
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for j, block in enumerate(page):
            x[i, j, [index[f] for f in block if f in index]] = 1
    return (x, y, mask), index


def gradients(data: tuple[np.ndarray, np.ndarray, np.ndarray], params: list[np.ndarray]) -> list[np.ndarray]:
    """The slope of the labels' log-likelihood: what is seen less what forward and backward sums expect."""
    x, y, mask = data
    n, most = y.shape
    rows, last, both = np.arange(n), mask.sum(axis=1) - 1, mask[:, 1:]
    flat = x.reshape(n * most, -1)
    gold = np.eye(2)[y] * mask[..., None]
    emit, move, start, end = params
    e = (flat @ emit.astype(np.float32)).reshape(n, most, 2).astype(np.float64)
    a, b = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    a[:, 0] = start + e[:, 0]
    for t in range(1, most):
        a[:, t] = np.where(mask[:, t, None], _lse(a[:, t - 1, :, None] + move, 1) + e[:, t], a[:, t - 1])
    b[rows, last] = end
    for t in range(most - 2, -1, -1):
        on = _lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        b[:, t] = np.where(mask[:, t + 1, None], on, b[:, t])
    z = _lse(a[rows, last] + end, 1)
    p = np.exp(a + b - z[:, None, None]) * mask[..., None]
    pair = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
    diff = gold - p
    seen = np.einsum("nta,ntb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
    return [flat.T @ diff.reshape(-1, 2).astype(np.float32), seen - pair.sum(axis=(0, 1)), diff[:, 0].sum(axis=0), diff[rows, last].sum(axis=0)]


def train(pages: list[tuple[str, list[int]]], steps: int = 200, rate: float = 0.15, penalty: float = 2e-5, least: int = 4, unplaced: int = 2) -> Crf:
    """Maximum likelihood with an L2 penalty over all pages at once, Adam steps; for ``least`` and ``unplaced`` see :func:`training_set`."""
    data, index = training_set(pages, least, unplaced)
    n = len(data[1])
    params = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for i, g in enumerate(gradients(data, params)):
            g = g / n - penalty * params[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(index, *params)


@functools.lru_cache(maxsize=4)
def default_model(n_pages: int = 600, seed: int = 5) -> Crf:
    """The model fitted on ``n_pages`` labelled pages."""
    return train(labelled_pages(n_pages, seed))


def main_text(page: str | None, model: Crf) -> str:
    """The blocks that the model labels as main text, joined by two line feeds."""
    found = list(blocks(page))
    return "\n\n".join(t for (_, t, _), y in zip(found, model.decode(found), strict=True) if y)


def _mapper(model: Crf, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [main_text(p, model) for p in part.column(column).to_pylist()]
                yield part.append_column(name, pa.array(made, pa.string()))

    return run


def extract(pages: DataFrame, html_col: str = "html", out_col: str | None = None, *, model: Crf | None = None) -> tuple[DataFrame, str]:
    """``pages`` with the main text of ``html_col`` in a new column; returns it and the column's name.

    A null or empty page, or one without main text, gives an empty string; a page takes time and memory in proportion to its length, however
    deep its elements are nested.  The new column is ``out_col`` or the first
    free name like "main_text"; all other columns stay, repeated rows each have their own result.
    """
    name = out_col or free_name(pages, "main_text")
    schema = T.StructType([*pages.schema, T.StructField(name, T.StringType())])
    return pages.mapInArrow(_mapper(model or default_model(), html_col, name), schema), name


def n_chars(text_col: str):
    """Column: code points of the text."""
    return F.length(text_col).cast("long")
