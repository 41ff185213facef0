"""The best items of each query in a partition, batch by batch: what a scan against a block of queries holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 9
#: Scores this close may be equal at so many digits.
NEAR = 2e-9
ROW = "query_id long, item long, score double"
OWNED = ROW + ", ref string"


class Best:
    """The best ``k`` items a query, or the best items of the best ``k`` owners; scores are compared at nine digits, ties go to the smaller item.

    An owner whose best item is among the best ``k`` of all is among the best ``k`` of the partition that holds this
    item, so partitions need not hold whole owners.
    """

    def __init__(self, query_ids: np.ndarray, k: int):
        self.ids, self.k = query_ids, k
        none = np.empty((len(query_ids), 0))
        self.score, self.item, self.owner = none, none.astype(np.int64), none.astype(np.int64)
        self.names: list[str] = []
        self.codes: dict[str, int] = {}

    def _codes(self, names: list[str]) -> np.ndarray:
        for n in names:
            if n not in self.codes:
                self.codes[n] = len(self.names)
                self.names.append(n)
        return np.fromiter(map(self.codes.__getitem__, names), dtype=np.int64, count=len(names))

    def add(self, score: np.ndarray, item: np.ndarray, owners: list[str] | None = None) -> None:
        """``score``: a row a query, a column an item."""
        if not len(item):
            return
        if owners is None:
            owner = item
        else:
            owner = self._codes(owners)
            order = np.lexsort((item, owner))
            score, item, owner = score[:, order], item[order], owner[order]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            even = np.round(score, DIGITS)
            best = np.repeat(np.maximum.reduceat(even, starts, axis=1), np.diff(np.append(starts, len(owner))), axis=1)
            first = np.minimum.reduceat(np.where(even == best, np.arange(len(owner)), len(owner)), starts, axis=1)
            score, item, owner = np.take_along_axis(score, first, 1), item[first], owner[starts]
        if self.score.shape[1] == self.k and self.k:  # items below every query's k-th score don't take part in the sort
            near = (score >= self.score[:, -1:] - NEAR).any(axis=0)
            score, item, owner = score[:, near], item[..., near], owner[near]
        shape = score.shape
        score = np.hstack([self.score, score])
        item = np.hstack([self.item, np.broadcast_to(item, shape)])
        owner = np.hstack([self.owner, np.broadcast_to(owner, shape)])
        if owners is not None and self.owner.shape[1]:  # an owner that was held already: the worse of its two goes
            order = np.lexsort((item, -np.round(score, DIGITS), owner))
            score, item, owner = (np.take_along_axis(x, order, 1) for x in (score, item, owner))
            score[:, 1:][owner[:, 1:] == owner[:, :-1]] = -np.inf
        order = np.lexsort((item, -np.round(score, DIGITS)))[:, : self.k]
        self.score, self.item, self.owner = (np.take_along_axis(x, order, 1) for x in (score, item, owner))

    def rows(self, owned: bool = False) -> pa.RecordBatch:
        real = np.isfinite(self.score)
        cols = [pa.array(np.repeat(self.ids, real.sum(axis=1))), pa.array(self.item[real]), pa.array(self.score[real])]
        names = ["query_id", "item", "score"]
        if owned:
            cols, names = [*cols, pa.array([self.names[i] for i in self.owner[real].tolist()], pa.string())], [*names, "ref"]
        return pa.RecordBatch.from_arrays(cols, names=names)
