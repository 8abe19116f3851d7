"""Quality classification by co-training two views of a page.

The text view sees hashed words and runs of symbols and how often words repeat. The metadata view sees what is known of a
page without reading its words: source, language, length, number and length of lines, shares of kinds of characters. Two
logistic classifiers start from the labelled rows. In each round both score every unlabelled document in Spark; what one of
them is sure of, the other one learns from too, as many rows of either label as ``PSEUDO`` says, chosen by the hash of the id among all
that are sure. At last both are calibrated on labelled rows that neither has seen, and their log-odds are added
(less the prior's, which both contain). All documents are scored by one pass without a shuffle.

Models are fitted in a task from a bounded table: ``MAX_LABELLED`` labelled documents, chosen by the hash of the id, and the
pseudo-labelled ones. Each is read whole.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doubles, lower_share, pick, share, stored, with_private_names

MAX_LABELLED = 8_000
TEXT_BITS, META_BITS = 16, 12
ROUNDS = 2
#: Documents of a label that a view labels a round, at most, and how sure it must be.
PSEUDO, SURE = 1_000, 0.95
#: Documents that are scored first for pseudo-labels; eight times as many follow until there are enough of each kind.
FIRST_SLICE = 16_000
#: Every so-manieth labelled row is kept for calibration.
CALIBRATION = 4
STEPS, RATE, PENALTY = 120, 0.05, 1e-4
KEEP = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
KINDS = np.zeros(256, np.int64)  # letters and bytes of other scripts, capitals, digits, blanks, symbols
KINDS[33:127] = 4
KINDS[48:58] = 2
KINDS[65:91] = 1
KINDS[97:123] = 0
KINDS[[9, 10, 11, 12, 13, 32]] = 3


def step_of(x: float, width: float = 1.0) -> int:
    """Logarithmic step that a count lies in."""
    return int(np.log2(1 + x) / width)


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and values of the words and symbol runs; the values have length 1."""
    found = Counter(TOKEN.findall(text.lower())) if text else Counter()
    total = found.total()
    n = np.fromiter(found.values(), float, len(found))
    names = list(found)
    rare = len(found) / total if total else 0.0
    top = n.max() / total if total else 0.0
    names += [f" distinct {int(rare * 10)} of {step_of(total, 2)}", f" top {int(top * 10)}"]
    values = np.concatenate([np.log1p(n), [0.0, 0.0]])
    values /= np.sqrt((values**2).sum()) or 1.0
    values[-2:] = 0.5
    mask = (1 << TEXT_BITS) - 1
    at = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names), np.int32, len(names))
    return at, values.astype(np.float32)


def meta_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed categories of a page's metadata; every page has the same number of them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(KINDS[raw], minlength=5) / max(1, len(raw))
    lines = (text or "").count("\n") + 1
    names = [
        f"source {source}",
        f"lang {lang}",
        f"chars {step_of(len(text or ''))}",
        f"lines {step_of(lines)}",
        f"line {step_of(len(text or '') / lines, 0.5)}",
        *(f"kind {k} {int(np.sqrt(share) * 12)}" for k, share in enumerate(kinds)),
    ]
    mask = (1 << META_BITS) - 1
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names], np.int32)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class View:
    """Sparse rows of one view and the logistic classifier learned from some of them."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int
    width: int
    weights: np.ndarray = field(init=False)
    shift: float = 0.0

    def __post_init__(self):
        self.weights = np.zeros(self.width)

    def scores(self) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * self.weights[self.columns], minlength=self.n) + self.shift

    def learn(self, y: np.ndarray, use: np.ndarray, steps: int = STEPS) -> None:
        """Full gradient steps (Adam) from the present weights on the rows ``use``, whose labels are in ``y``."""
        mine = use[self.rows]
        place = np.cumsum(use) - 1
        rows, columns, values = place[self.rows[mine]], self.columns[mine], self.values[mine]
        target, n = y[use].astype(float), int(use.sum())
        if not n:
            return
        first, second = np.zeros(self.width + 1), np.zeros(self.width + 1)
        for step in range(1, steps + 1):
            score = np.bincount(rows, weights=values * self.weights[columns], minlength=n) + self.shift
            error = logistic(score) - target
            grad = np.append(np.bincount(columns, weights=values * error[rows], minlength=self.width), error.sum()) / n
            grad[:-1] += PENALTY * self.weights
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            move = RATE * 4 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.weights -= move[:-1]
            self.shift -= float(move[-1])


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log-odds; both classes get half a row of either label."""
    if not len(y):
        return 1.0, 0.0
    low, high = 1 / (np.sum(y == 0) + 2), (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2)
    target = np.where(y == 1, high, low)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = logistic(a * score + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * score).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum()]])
        move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        move /= max(1.0, np.abs(move).max())
        a, b = a - move[0], b - move[1]
    return float(max(a, 1e-3)), float(b)


@dataclass
class QualityModel:
    text: np.ndarray
    text_line: tuple[float, float]
    meta: np.ndarray
    meta_line: tuple[float, float]
    prior: float

    def log_odds(self, text: str | None, lang: str | None, source: str | None) -> tuple[float, float]:
        """Calibrated log-odds of good quality by either view."""
        at, values = text_view(text)
        a, b = self.text_line
        by_text = a * float(values @ self.text[at]) + b
        a, b = self.meta_line
        return by_text, a * float(self.meta[meta_view(text, lang, source)].sum()) + b


def co_train(text: View, meta: View, y: np.ndarray, taught: np.ndarray, held: np.ndarray) -> QualityModel:
    """Let each view learn the labels ``y`` (-1: none) and those that the other view gave it, ``taught`` (a column a view).

    ``held`` are labelled rows that are kept for calibration only.
    """
    labelled = y >= 0
    share = (np.sum(y[labelled] == 1) + 1) / (labelled.sum() + 2)
    lines = []
    for k, view in enumerate((text, meta)):
        target = np.where(labelled, y, taught[:, k])
        view.learn(target, (target >= 0) & ~held)
        a, b = calibrate(view.scores()[held], y[held])
        lines.append((a, b + a * view.shift))  # a view's constant term moves into its line
    return QualityModel(text.weights, lines[0], meta.weights, lines[1], float(np.log(share / (1 - share))))


def keep_all() -> QualityModel:
    return QualityModel(np.zeros(1 << TEXT_BITS), (1.0, 40.0), np.zeros(1 << META_BITS), (1.0, 40.0), 0.0)


FEATURES = "doc_id long, y int, by_meta int, by_text int, at array<int>, value array<float>, meta array<int>"


def features(rows: DataFrame) -> DataFrame:
    """Both views' features of ``doc_id, text, lang, source, y, by_meta, by_text``; an id that repeats counts once."""
    names = [c.split(" ")[0] for c in FEATURES.split(", ")]

    def run(batches):
        for batch in batches:
            texts, langs, sources = (batch.column(i).to_pylist() for i in (1, 2, 3))
            text = [text_view(t) for t in texts]
            meta = [meta_view(t, g, s) for t, g, s in zip(texts, langs, sources, strict=True)]
            columns = [
                batch.column(0),
                *(batch.column(i) for i in (4, 5, 6)),
                pa.array([t[0] for t in text], pa.list_(pa.int32())),
                pa.array([t[1] for t in text], pa.list_(pa.float32())),
                pa.array(meta, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    marks = ["y", "by_meta", "by_text"]
    once = rows.groupBy("doc_id", *marks).agg(F.min(F.struct("text", "lang", "source")).alias("r"))
    return once.select("doc_id", "r.text", "r.lang", "r.source", *marks).mapInArrow(run, FEATURES)


def learn_in_task(table: DataFrame) -> QualityModel:
    """The model that one task learns from a bounded table of features."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        y = np.zeros(0, int)
        if held:
            table = pa.Table.from_batches(held)
            table = table.take(np.lexsort([np.asarray(table.column(c)) for c in ("by_text", "by_meta", "y", "doc_id")]))
            y = np.asarray(table.column("y"))
        if (y == 0).any() and (y == 1).any():
            views = []
            for name, bits in (("at", TEXT_BITS), ("meta", META_BITS)):
                lists = table.column(name).combine_chunks()
                n = lists.value_lengths().to_numpy()
                values = table.column("value").combine_chunks().flatten().to_numpy() if name == "at" else np.ones(int(n.sum()), np.float32)
                views.append(View(np.repeat(np.arange(len(y)), n), lists.flatten().to_numpy(), values, len(y), 1 << bits))
            labelled = y >= 0
            taught = np.stack([np.asarray(table.column(c)) for c in ("by_meta", "by_text")], axis=1)
            model = co_train(*views, y, taught, labelled & ((np.cumsum(labelled) % CALIBRATION) == 0))
        else:
            model = None
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(model)], pa.binary())], ["model"])

    found = table.coalesce(1).mapInArrow(run, "model binary").collect()
    return (pickle.loads(found[0][0]) if found else None) or keep_all()


def sure_rows(rows: DataFrame, model: QualityModel, given: DataFrame) -> DataFrame:
    """``doc_id, by_meta, by_text``: what each view is sure of among all rows without a label, ``PSEUDO`` of a label at most."""
    shared = share(rows.sparkSession, model)
    limit = float(np.log(SURE / (1 - SURE)))

    def run(batches):
        model = shared()
        for batch in batches:
            parts = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            odds = np.array([model.log_odds(*p) for p in parts], float).reshape(-1, 2)
            marks = [pa.array(np.where(odds[:, k] >= limit, 1, np.where(odds[:, k] <= -limit, 0, -1)), pa.int32()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *marks], ["doc_id", "by_meta", "by_text"])

    # rows are scored in the order of their hashes, slice by slice, until every kind has as many as are chosen: the rest cannot be
    order, total, wanted, low = F.xxhash64("doc_id", F.lit(23)), rows.count(), FIRST_SLICE, None
    kinds = [(view, label) for view in ("by_meta", "by_text") for label in (0, 1)]
    slices, held = [], [0] * len(kinds)
    while min(held) < PSEUDO and (low is None or low < 2**63 - 1):
        high = lower_share(wanted, total) if wanted < total else 2**63 - 1
        inside = (order >= low if low is not None else F.lit(True)) & ((order < high) if high < 2**63 - 1 else F.lit(True))
        marked = rows.where(inside).mapInArrow(run, "doc_id long, by_meta int, by_text int").where("by_meta >= 0 OR by_text >= 0")
        slices.append(stored(marked.join(given.select("doc_id"), "doc_id", "left_anti").distinct()))
        found = slices[-1].agg(*[F.count_if(F.col(view) == label) for view, label in kinds]).first()
        held, low, wanted = [a + b for a, b in zip(held, found, strict=True)], high, 8 * wanted
    marked = reduce(DataFrame.unionByName, slices)
    none = F.lit(-1)
    chosen = [
        marked.where(F.col(view) == label).orderBy(order, "doc_id").limit(PSEUDO).select(
            "doc_id", *[(F.col(v) if v == view else none).alias(v) for v in ("by_meta", "by_text")]
        )
        for view, label in kinds
    ]
    every = reduce(DataFrame.unionByName, chosen)
    return every.groupBy("doc_id").agg(F.max("by_meta").alias("by_meta"), F.max("by_text").alias("by_text"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> QualityModel:
    """Learn from ``docs`` (``doc_id, text, lang, source``) and ``labels`` (``doc_id, quality`` of 0 or 1).

    Rows without an id teach nothing. An id with several labels gives a row for each; repeated rows of an id count
    once. Equally sure rows are chosen by hash. Without labels of both kinds, as with empty tables, the model keeps everything.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source").where("doc_id IS NOT NULL")
    given = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    none = F.lit(-1)
    chosen = bounded_sample(given, "doc_id", max_labelled).select(
        "doc_id", F.col("quality").cast("int").alias("y"), none.alias("by_meta"), none.alias("by_text")
    )
    # the bounds of what is asked for make it small enough to be sent to the texts
    table = stored(features(rows.join(F.broadcast(chosen.dropDuplicates()), "doc_id")))
    model = learn_in_task(table)
    if table.select("y").distinct().count() < 2:
        return model
    for _ in range(rounds):
        asked = stored(sure_rows(rows, model, given).select("doc_id", none.alias("y"), "by_meta", "by_text"))
        table = stored(table.unionByName(features(rows.join(F.broadcast(asked), "doc_id"))))
        model = learn_in_task(table)
    return model


def score(docs: DataFrame, model: QualityModel, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``p_text, p_meta, quality_score, keep`` as last columns, from each whole text and its metadata.

    Nulls are a value of their own in either view; repeated rows are scored each. An empty table gives an empty one. Columns of ``docs`` stay, also those named like the new ones.
    """
    shared = share(docs.sparkSession, model)
    renamed, names = with_private_names(docs)
    text, lang, source = (names.index(c) for c in ("text", "lang", "source"))
    n = len(names)

    def run(batches):
        model = shared()
        for batch in batches:
            parts = zip(*(batch.column(k).to_pylist() for k in (text, lang, source)), strict=True)
            odds = np.array([model.log_odds(*p) for p in parts], float).reshape(-1, 2)
            p = logistic(odds.sum(axis=1) - model.prior)
            columns = [*batch.columns, doubles(logistic(odds[:, 0])), doubles(logistic(odds[:, 1])), doubles(p), pa.array(p >= keep, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(renamed.dtypes)] + [f"c{n} double, c{n + 1} double, c{n + 2} double, c{n + 3} boolean"])
    return renamed.mapInArrow(run, schema).toDF(*names, "p_text", "p_meta", "quality_score", "keep")
