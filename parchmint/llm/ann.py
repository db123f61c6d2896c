"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned on at most ``SAMPLE`` vectors: principal axes, turned by iterative quantization until signs lose
least. A vector's code is the signs of its rotated coordinates. Codes are split into 8-bit substrings and each substring
is indexed; to retrieve every code within Hamming radius r = 8-bit tables * s + a, the pigeonhole principle lets a + 1
substrings be probed within s bits and the others within s - 1. All codes found within r are reranked by their floats.
The radius is learned too: it holds ``RADIUS_SHARE`` of the true neighbours of the sample's queries; where a block has fewer
than k + 1 codes within it, it grows. For largest inner products of vectors of unequal length a coordinate is added that
makes all lengths equal (0 for queries).

Scores are exact: 64-bit sums in coordinate order on the original vectors. Cases: null, zero, null-holding and non-finite
vectors take no part; equal vectors are found together by their ids; of rows with one vec_id the smallest vector
counts, null vec_ids none; vectors of different lengths never meet; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.blocks import matrix, one_row_per_id, search

SAMPLE = 20_000
SAMPLE_QUERIES = 256
RADIUS_SHARE = 0.985
ROUNDS = 40


class Codes:
    """Center, rotation and radius for vectors of one length."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest = longest
        x = self._even(sample)
        self.center = x.mean(axis=0)
        bits = max(8, min(128, -(-sample.shape[1] // 8) * 8))
        c = x - self.center
        axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :bits]
        pad = np.zeros((axes.shape[0], bits - axes.shape[1]))
        self.rotation = np.hstack((axes, pad))
        v, r = c @ self.rotation, np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.rotation = self.rotation @ r
        self.radius = self._radius(sample, k)

    def _even(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes all as long as the longest."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.hstack((x, rest[:, None]))

    def of(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """Code bytes, one row per vector."""
        if queries:
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.hstack((x / np.where(norm > 0, norm, 1) * self.longest, np.zeros((len(x), 1))))
        else:
            x = self._even(x)
        return np.packbits((x - self.center) @ self.rotation >= 0, axis=1)

    def _radius(self, x: np.ndarray, k: int) -> int:
        """The radius that holds RADIUS_SHARE of the k nearest in the sample."""
        asked = x[:: max(1, len(x) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
        codes, own = self.of(x), self.of(asked, True)
        far = []
        for q, code in zip(asked, own, strict=True):
            near = np.argsort(-(x @ q), kind="stable")[: k + 1]
            far.append(np.bitwise_count(codes[near] ^ code).sum(axis=1, dtype=int))
        return int(np.quantile(np.concatenate(far), RADIUS_SHARE, method="higher")) if far else 0


_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
#: By distance and byte: the bytes within that distance.
_NEAR = [[np.flatnonzero(_DISTANCE[b] <= s).tolist() for b in range(256)] for s in range(9)]
_WITHIN = np.array([_DISTANCE <= s for s in range(9)])


class MultiIndex:
    """Substring tables of a block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            at = np.searchsorted(codes[order, j], np.arange(257))
            self.tables.append((order, at.tolist(), np.diff(at)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits, in order."""
        m = len(self.tables)
        s, a = divmod(min(radius, 8 * m), m)
        mark = np.zeros(len(self.codes), bool)
        for j, (order, at, sizes) in enumerate(self.tables):
            most = min(8, s if j <= a else s - 1)
            if most > 1:  # many buckets: all their rows at once
                mark[order[np.repeat(_WITHIN[most, code[j]], sizes)]] = True
            elif most >= 0:
                for b in _NEAR[most][code[j]]:
                    mark[order[at[b] : at[b + 1]]] = True
        found = np.flatnonzero(mark)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=int) <= radius]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, summed in coordinate order, so equal vectors have equal scores."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def best_ids(rows: np.ndarray, scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, float]]:
    """The k best ids of these rows by score and id; a row's ids ascend."""
    if len(rows) > 4 * k:
        cut = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= cut], scores[scores >= cut]
    pairs = sorted((-s, i) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[r])
    return [(i, -s) for s, i in pairs[:k]]


class Block:
    """The index of one block: its codes in substring tables, and its vectors for the reranking."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], model: Codes, k: int):
        self.x, self.ids, self.model, self.k = x, ids, model, k
        self.table, self.longest = MultiIndex(model.of(x)), np.sqrt((x * x).sum(axis=1).max())

    def best(self, q: np.ndarray) -> list[tuple[int, float]]:
        """The k + 1 best ids among all within the radius; the radius grows until it holds as many codes."""
        x, k, code, radius = self.x, self.k, self.model.of(q[None], True)[0], self.model.radius
        while len(rows := self.table.within(code, radius)) < min(k + 1, len(x)):
            radius += len(code)
        if len(rows) > 4 * k:  # all that can be among the best, rounding of the rough sums allowed for
            rough, least = x[rows] @ q, 1e-9 * self.longest * np.sqrt(q @ q)
            rows = rows[rough >= np.partition(rough, len(rough) - k - 1)[-k - 1] - least]
        return best_ids(rows, exact_scores(x[rows], q), self.ids, k + 1)


def _block(x: np.ndarray, ids: list[list[int]], models, k: int) -> Block:
    return Block(x, ids, models.value[x.shape[1]], k)


def usable(v) -> F.Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score) of each query's nearest rows by inner product; ``vectors`` has (id, v)."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = one_row_per_id(vectors.select("id", v.cast("array<double>").alias("v")), usable(v) & F.exists(v, lambda x: x != 0))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    models = {}
    for d, longest in sorted((r["d"], r["longest"]) for r in rows.groupBy(F.size(v).alias("d")).agg(F.max(length).alias("longest")).collect()):
        some = rows.where(F.size(v) == d).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
        models[d] = Codes(matrix(some["v"].combine_chunks()), longest, k)
    return search(rows, is_query, k, partial(_block, models=spark.sparkContext.broadcast(models), k=k), "double")
