"""Array code for tasks that compare the rows of two blocks: runs of sorted batches and forests of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as one table each; the batches come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[s] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i]) over n nodes: at most n - 1 of them."""
    parent = list(range(n))
    kept: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((x, y))
    return kept


def spread(n: int, linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a dense boolean ``linked`` (rows x cols of n nodes): breadth first, whole rows at a time."""
    seen_r, seen_c = np.zeros(len(rows), dtype=bool), np.zeros(len(cols), dtype=bool)
    kept: list[tuple[int, int]] = []
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen_r[start]:
            continue
        seen_r[start] = True
        queue = [int(start)]
        while queue:
            r = queue.pop()
            new = np.flatnonzero(linked[r] & ~seen_c)
            seen_c[new] = True
            kept += [(int(rows[r]), int(cols[c])) for c in new]
            for c in new:
                more = np.flatnonzero(linked[:, c] & ~seen_r)
                seen_r[more] = True
                kept += [(int(rows[x]), int(cols[c])) for x in more]
                queue += more.tolist()
    return kept


def grouped(schema: pa.Schema, keys: list[str], work: Callable[[pa.Table], dict[str, list]]) -> Callable:
    """A ``mapInArrow`` function that calls ``work`` on each run of equal keys and gathers its rows in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for table in runs(batches, keys):
            for n, v in work(table).items():
                out[n].extend(v)
            if len(out[schema.names[0]]) >= 20_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {n: [] for n in schema.names}
        if out[schema.names[0]]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run
