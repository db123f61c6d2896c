"""Exact top-k search by MaxScore over integer-weighted terms.

A vector's nonzero integer components are its terms (dimension, weight). Each block inverts its rows into postings with
the largest and smallest weight per dimension, which bound what a query's term can add to a score. Per query, a first
threshold comes from fully scoring the strongest postings of its strongest term, and a second from the rows that lead once
the essential terms are summed; its terms, by ascending bound, are split: rows that meet only non-essential terms, whose bounds sum to less than the threshold, can't enter. Postings of the
essential terms are traversed; the rows found are probed for the other terms from the largest bound down, while their
score and the bounds left stay competitive. Blocks return their k + 1 best and are merged.

Scores are exact integers: sums below 2^53 run in doubles, larger ones in Python integers, and a sum beyond 64 bits is
returned as the nearest 64-bit integer. Cases: null, null-holding and non-finite vectors take no part; equal integer
vectors are found together by their ids; of rows with one vec_id the smallest vector counts, null vec_ids none; vectors
of different lengths never meet; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.ann import best_ids, usable
from parchmint.llm.blocks import one_row_per_id, search

SCALE = 64


class Postings:
    """A block's rows inverted by dimension; ``rows[:, j]`` answers probes."""

    def __init__(self, weights: np.ndarray):
        self.n, self.columns = len(weights), np.ascontiguousarray(weights.T)
        self.lists = [np.flatnonzero(c) for c in self.columns]
        self.values = [c[at] for c, at in zip(self.columns, self.lists, strict=True)]
        self.high = [max(v.max(), 0) if len(v) else 0 for v in self.values]
        self.low = [min(v.min(), 0) if len(v) else 0 for v in self.values]
        self.everywhere = [len(at) == self.n for at in self.lists]
        self.by_value: dict[int, np.ndarray] = {}

    def strongest(self, j: int, positive: bool, k: int) -> np.ndarray:
        """Rows with the k largest (or smallest) weights of a dimension."""
        if j not in self.by_value:
            self.by_value[j] = np.argsort(self.columns[j], kind="stable")
        return self.by_value[j][-k:] if positive else self.by_value[j][:k]

    def top(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the k best, ties included, with their exact scores."""
        terms = np.flatnonzero(q).tolist()
        bounds = {j: max(q[j] * self.high[j], q[j] * self.low[j]) for j in terms}
        terms.sort(key=lambda j: (bounds[j], j))
        if not terms or self.n <= 2 * k:
            return np.arange(self.n), self._full(np.arange(self.n), q, terms)
        seeds = self.strongest(terms[-1], q[terms[-1]] > 0, 2 * k)
        threshold = np.sort(self._full(seeds, q, terms))[-k]
        # non-essential: terms[:split], whose bounds sum to less than the threshold
        split, rest = 0, 0
        while split < len(terms) and rest + bounds[terms[split]] < threshold:
            rest += bounds[terms[split]]
            split += 1
        sums = np.zeros(self.n, self.columns.dtype)
        if split:
            met = np.zeros(self.n, bool)
            for j in terms[split:]:
                self._traverse(j, q[j], sums)
                if not self.everywhere[j]:
                    met[self.lists[j]] = True
                elif not met.all():
                    met[:] = True
            # the rows with the best sums so far, scored in full, raise the threshold
            lead = np.argpartition(sums, self.n - 2 * k)[-2 * k :] if sums.dtype != object else np.argsort(sums)[-2 * k :]
            threshold = max(threshold, np.sort(self._full(lead, q, terms))[-k])
            rows = np.flatnonzero(met & (sums + rest >= threshold))
        else:  # even a row without any term is competitive
            for j in terms:
                self._traverse(j, q[j], sums)
            rows = np.flatnonzero(sums >= threshold)
        scores = sums[rows]
        for i in range(split - 1, -1, -1):
            j = terms[i]
            scores = scores + q[j] * self.columns[j][rows]
            rest -= bounds[j]
            if len(rows) > 4 * k:
                # scores so far plus the least the terms left can take away bound the k-th best from below
                keep = scores + rest >= threshold
                rows, scores = rows[keep], scores[keep]
        return rows, scores

    def _traverse(self, j: int, weight, sums: np.ndarray) -> None:
        """Adds a posting list to the sums; one that holds most rows is added as a column, absent rows as zeros."""
        if 2 * len(self.lists[j]) > self.n:
            sums += weight * self.columns[j]
        else:
            sums[self.lists[j]] += weight * self.values[j]

    def _full(self, rows: np.ndarray, q: np.ndarray, terms: list[int]) -> np.ndarray:
        out = np.zeros(len(rows), self.columns.dtype)
        for j in terms:
            out = out + q[j] * self.columns[j][rows]
        return out


class Block:
    """The postings of one block; in whole numbers of any size where sums could pass what a double holds exactly."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], k: int):
        self.x, self.ids, self.k, self.most = x, ids, k, float(np.abs(x).max())
        self._postings: dict[bool, Postings] = {}

    def best(self, q: np.ndarray) -> list[tuple[int, int]]:
        beyond = self.most * float(np.abs(q).max()) * len(q) >= 2.0**52
        if beyond not in self._postings:
            self._postings[beyond] = Postings(_WHOLE(self.x) if beyond else self.x)
        found = best_ids(*self._postings[beyond].top(_WHOLE(q) if beyond else q, self.k + 1), self.ids, self.k + 1)
        return [(i, max(-(1 << 63), min((1 << 63) - 1, int(score)))) for i, score in found]


_WHOLE = np.frompyfunc(int, 1, 1)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): each query's k largest inner products of floor(scale * x); ``vectors`` has (id, v)."""
    v = F.col("v")
    # whole numbers kept as doubles: a component beyond 64 bits stays what it is
    whole = F.transform(v.cast("array<double>"), lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0) + 0.0)
    rows = one_row_per_id(vectors.where(usable(v)).select("id", whole.alias("v")), usable(v))
    return search(rows, is_query, k, partial(Block, k=k), "long")
