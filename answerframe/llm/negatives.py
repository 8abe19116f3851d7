"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves, and each half-space has a codebook. A row lies in the cell of its two nearest half-codewords.
No member's inner product with an anchor can pass the sum of two half-scores: codeword times anchor half, plus the length
of the anchor half times the radius of the codeword's members. Cells are visited in falling order of these sums by a heap
that walks both sorted lists of half-scores (multi-sequence), and a visited cell's rows are scored exactly in integers.

An anchor asks for several windows of scores at once: a positive with score p asks for the best rows of other labels between
0.3 p and 0.9 p. A window is certified once it is full and its last score is above what any cell not visited can
hold, or once those cells lie below the window. The search stops when all windows are certified, so results are exact.

Rows are dealt into shards of bounded size, each with an index of its own and radii of its own members (``shards``).
Codebooks come from a bounded sample and only decide how soon a search stops, never what it finds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import bounded_sample, longs, partitions_for
from .shards import (
    dealt,
    finite_vectors,
    integers,
    largest,
    matrix,
    number_of_shards,
    numbered,
    products,
    search_shards,
    to_all,
)

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these tenths of its positive's.
LOWEST, HIGHEST = 3, 9
#: Codewords of a half-space, rows they are fitted on at most, and rounds of the fit.
CODEWORDS, MAX_SAMPLE, ROUNDS = 16, 20_000, 8
SEED = 42
#: Rows of visited cells that are scored at once.
ROWS_AT_ONCE = 512


def codebook(sample: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """Codewords by Lloyd's rounds from rows drawn by seed; as many as there are different rows, if those are fewer."""
    distinct = np.unique(sample, axis=0)
    words = np.random.default_rng(seed).permutation(distinct)[:size].copy()
    for _ in range(ROUNDS if len(words) else 0):
        own = nearest_word(sample, words)
        n = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, sample)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words if len(words) else np.zeros((1, sample.shape[1]))


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1)[None, :] - 2 * (x @ words.T)).argmin(axis=1)


class Window_:
    """The best ``k`` scores of rows between ``low`` and ``high``; None is no bound."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.ones(len(at), bool)
        if self.low is not None:
            inside &= (scores >= self.low) & (scores <= self.high)
        at, scores = np.concatenate([self.at, at[inside]]), np.concatenate([self.scores, scores[inside]])
        best = np.lexsort((ids[at], -scores))[: self.k]
        self.at, self.scores = at[best], scores[best]

    def certified(self, bound: float) -> bool:
        """No row whose score is at most ``bound`` can still enter."""
        if self.low is not None and (self.low > self.high or bound < self.low):
            return True
        return len(self.scores) == self.k and bound < self.scores[-1]


class MultiIndex:
    """Rows of a shard by cells of two half-space codebooks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, books: list[np.ndarray], wanted: tuple[int, int]):
        self.half, self.wanted = books[0].shape[1], wanted
        own = [nearest_word(part, book) for part, book in zip(self._halves(x), books, strict=True)]
        cell = own[0] * len(books[1]) + own[1]
        order = np.lexsort((ids, cell))
        self.ids, self.x, self.labels, cell = ids[order], x[order], labels[order], cell[order]
        self.starts = np.searchsorted(cell, np.arange(len(books[0]) * len(books[1]) + 1))
        self.books, self.radii = books, []
        for part, book, mine in zip(self._halves(x), books, own, strict=True):
            radius = np.full(len(book), -1.0)  # stays below zero for a codeword without a member
            np.maximum.at(radius, mine, np.sqrt(((part - book[mine]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        self.longest = float(np.sqrt((self.x * self.x).sum(axis=1)).max(initial=0.0))

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[..., : self.half], x[..., self.half :]]

    def cells(self, query: np.ndarray):
        """``(bound, cell)`` in falling order of the bound: the multi-sequence walk over both lists of half-scores."""
        ranked = []
        for part, book, radius in zip(self._halves(query), self.books, self.radii, strict=True):
            there = np.flatnonzero(radius >= 0)
            score = book[there] @ part + np.sqrt(part @ part) * radius[there]
            order = np.argsort(-score, kind="stable")
            ranked.append((score[order].tolist(), there[order].tolist()))
        (first, word1), (second, word2) = ranked
        heap, wide = [(-(first[0] + second[0]), 0, 0)], len(self.books[1])
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, word1[i] * wide + word2[j]
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))

    def fill(self, windows: list[Window_], anchor: int, query: np.ndarray, label: int, same: bool) -> int:
        """Fill the windows with rows of the same or of other labels; the number of rows scored."""
        most = float(np.sqrt(query @ query)) * self.longest
        slack = 1e-6 * (1 + most)
        waiting, n, scored = [], 0, 0

        def score():
            at = np.concatenate(waiting)
            fits = ((self.labels[at] == label) == same) & (self.ids[at] != anchor)
            at = at[fits]
            scores = products(self.x[at], query, most) if len(at) else np.zeros(0, np.int64)
            for w in windows:
                w.take(at, scores, self.ids)

        for bound, cell in self.cells(query):
            if n >= ROWS_AT_ONCE:
                score()
                waiting, n, scored = [], 0, scored + n
            if not n and all(w.certified(bound + slack) for w in windows):
                break
            a, b = self.starts[cell], self.starts[cell + 1]
            if a < b:
                waiting.append(np.arange(a, b))
                n += b - a
        if n:
            score()
        return scored + n

    def search(self, ids: np.ndarray, x: np.ndarray, more: pa.Array) -> pa.RecordBatch:
        """``more``: number, label and the scores of the positives; without those, the positives are asked for."""
        found: list[tuple] = []
        for anchor, query, (no, label, *scores) in zip(ids, x, more.to_pylist(), strict=True):
            if scores:  # 3 p <= 10 n <= 9 p
                windows = [Window_(self.wanted[1], -(-LOWEST * p // 10), HIGHEST * p // 10) for p in scores]
            else:
                windows = [Window_(self.wanted[0])]
            self.fill(windows, anchor, query, label, same=not scores)
            for place, w in enumerate(windows, 1):
                found.append((np.full(len(w.at), no), np.full(len(w.at), place), self.ids[w.at], w.scores))
        columns = [longs(np.concatenate([f[k] for f in found])) for k in range(4)] if found else [longs([])] * 4
        return pa.RecordBatch.from_arrays(columns, ["no", "place", "id", "score"])


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    key: str = "vec_id",
    values: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of ``floor(256 * component)``; higher ones come first, equal ones go to the smaller id. The
    first ``positives`` rows of an anchor's label are its positives. For each, the first ``negatives`` rows of other labels
    whose score is between three and nine tenths of the positive's are returned; no window is open below a negative score.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. An anchor's own id is
    neither positive nor negative. An id in several rows may be found as often, and each row of a repeated anchor is
    asked for itself. Shorter vectors are filled up with zeros. An anchor without another row of its label, and a window
    without a row, give none; empty tables give an empty result. Other columns are not looked at. A score that does not
    fit 64 bits raises.
    """
    rows, asked = (
        numbered(finite_vectors(df, key, values, label).where("m0 IS NOT NULL").select("id", integers().alias("x"), F.col("m0").cast("long").alias("label")))
        for df in (vectors, anchors)
    )
    dims, total = largest(rows, asked), rows.count()
    sample = matrix(bounded_sample(rows, "no", MAX_SAMPLE).select("x").toArrow().column("x").combine_chunks(), dims)
    half = dims // 2
    books = [codebook(part, CODEWORDS) for part in (sample[:, :half], sample[:, half:])]
    n_shards, parts = number_of_shards(total, dims), partitions_for(rows)

    def build(ids, x, more):
        return MultiIndex(ids, x, np.array(more, np.int64)[:, 0], books, (positives, negatives))

    def found(to_ask: DataFrame) -> DataFrame:
        mine_ = dealt(rows, n_shards).withColumn("more", F.array("label"))
        return search_shards(mine_, to_all(to_ask, n_shards), build, "no long, place long, id long, score long", max(parts, n_shards), dims)

    def best(df: DataFrame, k: int, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = best(found(asked.withColumn("more", F.array("no", "label"))).drop("place"), positives, "no")
    first = checkpoint(first.select("no", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # at most ``positives`` scores an anchor, in order of their places
    scores = F.sort_array(F.collect_list(F.struct("place", "positive_score")))
    windows = first.groupBy("no").agg(F.transform(scores, lambda s: s["positive_score"]).alias("scores"))
    again = asked.join(windows, "no").withColumn("more", F.concat(F.array("no", "label"), "scores"))
    second = best(found(again), negatives, "no", "place")
    second = second.select("no", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = second.join(first, ["no", "place"]).join(asked.select("no", F.col("id").alias("anchor_id")), "no")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
