"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

A text's features are its distinct words and the beginnings of its words. Features that are marks of labelled toxic
documents are found by counting over the labelled rows in Spark. The ordinal model then has one weight a mark, shared by
all grades, and a rising row of thresholds: ``P(grade <= k) = logistic(threshold[k] - w x)``. Scoring returns the expected
grade. Marks and thresholds have a fixed largest number and are broadcast.

The labels say only whether a document is toxic. Its grade is 0 if it is not; else 1, 2 or 3 by the number of different marked
words that it holds (thirds of the toxic documents). Labels that bring grades of their own are used as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, bounded_sample, doubles, longs, map_arrow, pick, share, strings

PREFIXES = range(3, 9)
#: Labelled documents that marks and weights are learned from, at most about (chosen by the hash of their id).
MAX_TRAINING = 20_000
#: Marks kept, at most; how sure and how much likelier in toxic documents a mark must be.
MAX_MARKS, MIN_Z, MIN_RATIO = 2_000, 4.5, 4.0
MIN_TOXIC_DOCS = 4
GRADES = 3
#: Ridge penalty on weights, steps and step size of the fit.
PENALTY, STEPS, RATE = 2e-5, 600, 0.1


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


def tokens(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class OrdinalModel:
    marks: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = 0 … grades) for each score."""
        upto = logistic(self.thresholds[None, :] - score[:, None])
        full = np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1)
        return np.diff(full, axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, marks: np.ndarray, n_marks: int, grades: np.ndarray, top: int = GRADES
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of a cumulative-link model by full gradient steps (Adam).

    ``rows``, ``marks`` are the places of ones in the feature matrix. Gaps between thresholds are exponentials of free
    numbers, so they never cross.
    """
    n = len(grades)
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(top)])
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    free = np.concatenate([np.zeros(n_marks), start[:1], gaps])
    first, second = np.zeros_like(free), np.zeros_like(free)
    below, above = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    for step in range(1, STEPS + 1):
        w = free[:n_marks]
        rise = np.exp(free[n_marks + 1 :])
        theta = free[n_marks] + np.concatenate([[0.0], np.cumsum(rise)])
        score = np.bincount(rows, weights=w[marks], minlength=n)
        upper = np.where(grades < top, logistic(theta[above] - score), 1.0)
        lower = np.where(grades > 0, logistic(theta[below] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du = np.where(grades < top, upper * (1 - upper), 0.0) / p
        dl = np.where(grades > 0, lower * (1 - lower), 0.0) / p
        by_theta = np.bincount(above, weights=-du, minlength=top) + np.bincount(below, weights=dl, minlength=top)
        by_score = du - dl
        grad = np.zeros_like(free)
        grad[:n_marks] = np.bincount(marks, weights=by_score[rows], minlength=n_marks) / n + PENALTY * w
        grad[n_marks] = by_theta.sum() / n
        grad[n_marks + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * rise / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        free = free - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    theta = free[n_marks] + np.concatenate([[0.0], np.cumsum(np.exp(free[n_marks + 1 :]))])
    return free[:n_marks], theta


def find_marks(labelled: DataFrame) -> list[str]:
    """Features far more frequent in toxic documents, from counts over rows of ``text, toxic`` (boolean)."""

    def run(batch):
        features, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(tokens(text)) for f in word_features(w)}
            features.extend(found)
            toxic.extend([int(label)] * len(found))
        return [strings(features), longs(toxic)]

    rows = map_arrow(labelled.select("text", "toxic"), run, "feature string, toxic long")
    t, n = F.col("toxic_docs"), F.col("docs") - F.col("toxic_docs")
    totals = labelled.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("t")).first()
    n_toxic, n_clean = int(totals["t"] or 0), int(totals["n"]) - int(totals["t"] or 0)
    ratio = (F.log((t + 0.5) / (n_toxic - t + 0.5)) - F.log((n + 0.5) / (n_clean - n + 0.5))).alias("ratio")
    spread = F.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
    counted = rows.groupBy("feature").agg(F.sum("toxic").alias("toxic_docs"), F.count("*").alias("docs"))
    strong = counted.where(t >= MIN_TOXIC_DOCS).select("feature", ratio, spread.alias("spread"))
    strong = strong.where((F.col("ratio") >= float(np.log(MIN_RATIO))) & (F.col("ratio") / F.col("spread") >= MIN_Z))
    best = strong.orderBy((F.col("ratio") / F.col("spread")).desc(), "feature").limit(MAX_MARKS)
    return [r["feature"] for r in best.collect()]


def mark_finder(marks: dict[str, int]) -> Callable[[str | None], tuple[list[int], int]]:
    """Function of a text: its marks, and how many different words of it have one."""
    known: dict[str, tuple[int, ...]] = {}

    def find(text: str | None) -> tuple[list[int], int]:
        if len(known) > 300_000:
            known.clear()
        found, n = set(), 0
        for w in set(tokens(text)):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(marks[f] for f in word_features(w) if f in marks)
            if at:
                found.update(at)
                n += 1
        return sorted(found), n

    return find


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> OrdinalModel:
    """Learn from ``docs`` (``doc_id, text``) joined with ``labels`` (``doc_id``, ``toxic`` and perhaps ``grade``).

    Rows without a label, id or text don't count; an id counts once, with its highest label and first text. Without a toxic row or a mark the model gives grade 0 to everything.
    """
    own_grades = "grade" in labels.columns
    named = pick(labels, "doc_id", *(["grade"] if own_grades else ["toxic"])).toDF("doc_id", "given")
    named = named.where("doc_id IS NOT NULL AND given IS NOT NULL").groupBy("doc_id").agg(F.max("given").alias("given"))
    chosen = bounded_sample(named, "doc_id", max_rows)
    # the sample's bound makes it small enough to be sent to the texts
    rows = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "given").agg(F.min("text").alias("text"))  # an id that repeats counts once
    rows = rows.select("doc_id", "text", "given", (F.col("given") > 0).alias("toxic")).cache()
    names = find_marks(rows)
    marks = {name: i for i, name in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def found(batches):
        import pyarrow as pa

        find = mark_finder(shared.value)
        for batch in batches:
            got = [find(t) for t in batch.column(0).to_pylist()]
            columns = [
                pa.array([g[0] for g in got], pa.list_(pa.int32())),
                longs([g[1] for g in got]),
                batch.column(1),
                batch.column(2),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["marks", "n", "given", "doc_id"])

    table = rows.select("text", F.col("given").cast("long").alias("given"), "doc_id").mapInArrow(
        found, "marks array<int>, n long, given long, doc_id long"
    )
    table = table.toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending")])
    rows.unpersist()
    given = np.asarray(table.column("given"))
    if not marks or not (given > 0).any():
        return OrdinalModel({}, np.zeros(0), np.full(GRADES, 20.0))
    lists = table.column("marks").combine_chunks()
    at = np.repeat(np.arange(len(given)), lists.value_lengths().to_numpy())
    if own_grades:
        grades, top = given, int(given.max())
    else:
        n = np.asarray(table.column("n"))
        cuts = np.quantile(n[given > 0], [k / GRADES for k in range(1, GRADES)])
        grades, top = np.where(given > 0, 1 + np.searchsorted(cuts, n, "right"), 0), GRADES
    weights, thresholds = fit_ordinal(at, lists.flatten().to_numpy(), len(marks), grades, top)
    return OrdinalModel(marks, weights, thresholds)


def predict(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of each row: expected grade, likeliest grade, and P(grade > 0) >= 1/2.

    A null, empty or wordless text has no feature and gets the base severity. Repeated rows are repeated.
    """
    shared = share(docs.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        model = shared()
        find = mark_finder(model.marks)
        for batch in batches:
            score = np.array([model.weights[find(t)[0]].sum() for t in batch.column(1).to_pylist()], float)
            p = model.probabilities(score)
            columns = [
                batch.column(0),
                doubles(p @ np.arange(p.shape[1])),
                longs(p.argmax(axis=1)),
                pa.array(1 - p[:, 0] >= 0.5, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "toxic"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade long, toxic boolean")
