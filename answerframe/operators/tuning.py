"""Grid search over a zoo of regressors, scored by folds and by hold-out correlation.

``GridSearch`` takes model adapters and parameter grids by name. For every model
and target the candidate with the best mean fold score (weighted by fold size,
ties to the first in grid order) is refitted on all training rows and correlated
with the hold-out truth. Results are a DataFrame, one row per model × scoring ×
target.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Protocol

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.base import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .grids import check_grids, expand
from .linear_free import FreeSearch, sparse_rows
from .linear_grid import MAX_DOUBLES, cv_scores, feature_array, linear_column, linear_prediction, moments, solve

Score = tuple[int, int, str, int, float, float]  # candidate, fold, target, n, r2, mse


class Model(Protocol):
    """What the search needs from a regressor family."""

    parameters: frozenset[str]

    def candidates(self, grid: Mapping[str, Sequence]) -> list[dict]: ...

    def fold_scores(self, train, features, targets, candidates) -> list[Score]: ...

    def fit_predict(self, train, holdout, features, target, params) -> DataFrame: ...


class Linear:
    """Ridge (``alpha``) or elastic net (``alpha``, ``l1_ratio``).

    Scores come from one pass of sums where folds × columns² of them fit, else from the search without them.
    """

    def __init__(self, kind: str):
        names = {"ridge": ["alpha"], "elastic": ["alpha", "l1_ratio", "max_iter"]}[kind]
        self.parameters = frozenset(names)
        self.required = {"ridge": {"alpha"}, "elastic": {"alpha", "l1_ratio"}}[kind]
        self._sums: tuple | None = None

    def candidates(self, grid):
        if not self.required <= set(grid):
            raise ValueError(f"grid needs {sorted(self.required)}")
        return expand(grid)

    @staticmethod
    def _free(train, features, targets) -> FreeSearch | None:
        """The search without cross products, if their sums are too many."""
        sizes = [F.countDistinct("fold").alias("folds")]
        if isinstance(features, str):
            sizes.append(F.max(F.size(features)).alias("width"))
        found = train.agg(*sizes).first()
        width = (found["width"] or 0) if isinstance(features, str) else len(features)
        if found["folds"] * (width + len(targets)) ** 2 <= MAX_DOUBLES:
            return None
        return FreeSearch(sparse_rows(train, features, targets), width, targets)

    def fold_scores(self, train, features, targets, candidates):
        free = self._free(train, features, targets)
        if free is not None:
            scores = [tuple(r) for r in free.cv_scores(candidates).drop("left").collect()]
            free.close()
            return scores
        m = moments(train, features, targets)
        self._sums = (train, features, m)
        return [tuple(r) for r in cv_scores(train, m, candidates).collect()]

    def fit_predict(self, train, holdout, features, target, params):
        """Refit on all rows: the fold sums' total, if the folds were scored before."""
        held = self._sums
        if held and held[0] is train and held[1] == features and target in held[2].targets:
            m = held[2]
        else:
            train = train.withColumn("fold", F.lit(0))
            free = self._free(train, features, [target])
            if free is not None:
                w, intercept = free.refit(params, target)
                free.close()
                return holdout.withColumn("pred", linear_column(features, w, intercept))
            m = moments(train, features, [target])
        weights = solve(m, None, [params])[0]
        return holdout.withColumn("pred", linear_prediction(m, weights, features, target))


class SparkRegressor:
    """Any Spark ML regressor; ``build(params)`` returns it with its columns set
    to ``_features``, ``_y`` and ``pred``.

    Fold × candidate fits are independent Spark jobs, ``parallelism`` at a time.
    """

    def __init__(
        self,
        build: Callable[[dict], Estimator],
        parameters: Sequence[str],
        parallelism: int = 4,
    ):
        self.build, self.parameters, self.parallelism = build, frozenset(parameters), parallelism

    def candidates(self, grid):
        return expand(grid)

    def _vectors(self, df, features, target):
        return df.withColumns(
            {"_features": array_to_vector(feature_array(features)), "_y": F.col(target).cast("double")}
        )

    def fold_scores(self, train, features, targets, candidates):
        folds = [r[0] for r in train.select("fold").distinct().orderBy("fold").collect()]
        train = train.persist(StorageLevel.MEMORY_AND_DISK)

        def run(task):
            f, target, (i, params) = task
            rows = self._vectors(train, features, target)
            model = self.build(params).fit(rows.where(F.col("fold") != f))
            held = model.transform(rows.where(F.col("fold") == f))
            s = metrics.scores(held, [], y="_y").first()
            r2 = float("nan") if s["r2"] is None else s["r2"]
            return (i, f, target, s["n"], r2, s["mse"])

        tasks = list(itertools.product(folds, targets, enumerate(candidates)))
        with ThreadPool(self.parallelism) as pool:
            out = pool.map(run, tasks, chunksize=1)
        train.unpersist()
        return out

    def fit_predict(self, train, holdout, features, target, params):
        model = self.build(params).fit(self._vectors(train, features, target))
        return model.transform(self._vectors(holdout, features, target)).drop("_features", "_y")


# Parameters of the usual forest grid and what Spark calls them.
FOREST_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "min_impurity_decrease": "minInfoGain",
    "min_weight_fraction_leaf": "minWeightFractionPerNode",
    "max_features": "featureSubsetStrategy",
    "bootstrap": "bootstrap",
    "max_samples": "subsamplingRate",
}
# Accepted in a grid, without a counterpart: reported with the result, never searched.
# Depths over the limit are reported there too.
FOREST_IGNORED = [
    "criterion", "min_samples_split", "max_leaf_nodes", "min_impurity_split", "oob_score",
    "n_jobs", "random_state", "verbose", "warm_start", "ccp_alpha",
]
MAX_DEPTH = 30


class Forest(SparkRegressor):
    """Random forest. Depths over Spark's limit of 30 (None too) become 30, then duplicates go."""

    def __init__(self, seed: int = 77, parallelism: int = 4):
        super().__init__(self._build, [*FOREST_NAMES, *FOREST_IGNORED], parallelism)
        self.seed = seed
        self.ignored: dict[str, list] = {}

    def _build(self, params):
        return RandomForestRegressor(
            featuresCol="_features", labelCol="_y", predictionCol="pred", seed=self.seed, **params
        )

    def candidates(self, grid):
        self.ignored = {k: list(v) for k, v in grid.items() if k in FOREST_IGNORED}
        deep = [d for d in grid.get("max_depth", []) if d is None or d > MAX_DEPTH]
        if deep:
            self.ignored["max_depth"] = deep  # searched as MAX_DEPTH
        kept = {k: v for k, v in grid.items() if k in FOREST_NAMES}
        out = []
        for c in expand(kept):
            params = {}
            for name, value in c.items():
                if name == "max_depth":
                    value = MAX_DEPTH if value is None else min(value, MAX_DEPTH)
                if name == "max_features":
                    value = {"auto": "all"}.get(value, value)
                if value is not None:
                    params[FOREST_NAMES[name]] = value
            if params not in out:
                out.append(params)
        return out


def pick(scores: list[Score], scoring: str, shared: bool) -> dict[str, tuple[int, float]]:
    """Best candidate and its mean score per target (the same one for all if ``shared``)."""
    sums: dict[tuple[str, int], list[float]] = {}
    for i, _fold, target, n, r2, mse in scores:
        acc = sums.setdefault((target, i), [0.0, 0.0])
        value = r2 if scoring == "r2" else -mse
        acc[0] += n * (float("nan") if value is None else value)
        acc[1] += n
    mean = {key: a / b for key, (a, b) in sums.items()}
    targets = list(dict.fromkeys(t for t, _ in mean))
    candidates = sorted({i for _, i in mean})

    def rank(value: float, i: int):
        return (not np.isnan(value), value if not np.isnan(value) else 0.0, -i)

    if shared:
        over = {i: float(np.mean([mean[t, i] for t in targets])) for i in candidates}
        best = max(candidates, key=lambda i: rank(over[i], i))
        return {t: (best, over[best]) for t in targets}
    out = {}
    for t in targets:
        best = max(candidates, key=lambda i: rank(mean[t, i], i))
        out[t] = (best, mean[t, best])
    return out


class GridSearch:
    """Search every model's grid; ``results`` and ``best`` are DataFrames afterwards."""

    RESULT = (
        "model string, scoring string, target string, candidate int, params string, "
        "not_searched string, cv_score double, n_holdout long, r double, r2 double, mse double"
    )

    def __init__(self, models: Mapping[str, Model], grids: Mapping[str, Mapping[str, Sequence]]):
        check_grids(models, grids)
        self.models, self.grids = dict(models), dict(grids)
        self.results: DataFrame | None = None
        self.best: DataFrame | None = None
        self._fits: dict[tuple[str, str, int], DataFrame] = {}
        self._candidates: dict[str, list[dict]] = {}

    def fold_scores(self, name, train, features, targets) -> list[Score]:
        return self.models[name].fold_scores(train, features, targets, self._candidates[name])

    def fit_predict(self, name, train, holdout, features, target, params) -> DataFrame:
        return self.models[name].fit_predict(train, holdout, features, target, params)

    def tune(
        self,
        train: DataFrame,
        holdout: DataFrame,
        features: Sequence[str] | str,
        targets: Sequence[str],
        scorings: Sequence[str] = ("r2",),
        shared: bool = False,
    ) -> DataFrame:
        """``train`` carries its ``fold`` column. One search serves all scorings."""
        spark = train.sparkSession
        rows = []
        for name, model in self.models.items():
            self._candidates[name] = model.candidates(self.grids[name])
            scores = self.fold_scores(name, train, features, targets)
            for scoring in scorings:
                for target, (i, score) in pick(scores, scoring, shared).items():
                    if (name, target, i) not in self._fits:
                        self._fits[name, target, i] = self.fit_predict(
                            name, train, holdout, features, target, self._candidates[name][i]
                        )
                    found = self._fits[name, target, i]
                    held = metrics.scores(
                        found.select(F.col(target).cast("double").alias("y"), "pred"), []
                    ).first()
                    rows.append(
                        (
                            name,
                            scoring,
                            target,
                            i,
                            json.dumps(self._candidates[name][i], sort_keys=True),
                            json.dumps(getattr(model, "ignored", {}), sort_keys=True),
                            float(score),
                            held["n"],
                            held["r"],
                            held["r2"],
                            held["mse"],
                        )
                    )
        self.results = spark.createDataFrame(rows, self.RESULT)
        self.best = metrics.best_by_correlation(self.results)
        return self.results

    def predict(self, id_col: str) -> DataFrame:
        """Hold-out predictions ``(id, target, pred)`` of the best model per target."""
        parts = [
            self._fits[b["model"], b["target"], b["candidate"]].select(
                id_col, F.lit(b["target"]).alias("target"), "pred"
            )
            for b in self.best.collect()
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class TextGridSearch(GridSearch):
    """The same search behind a text pipeline that is fitted inside every fold.

    ``prepare(train, other)`` fits on ``train`` only and returns both frames with
    an ``array<double>`` column ``text_features``.
    """

    def __init__(self, models, grids, prepare: Callable[[DataFrame, DataFrame], tuple]):
        super().__init__(models, grids)
        self.prepare = prepare
        self._prepared: dict[object, tuple[DataFrame, DataFrame]] = {}

    def _features(self, key, train, other):
        if key not in self._prepared:
            pair = self.prepare(train, other)
            self._prepared[key] = tuple(p.persist(StorageLevel.MEMORY_AND_DISK) for p in pair)
        return self._prepared[key]

    def fold_scores(self, name, train, features, targets):
        folds = [r[0] for r in train.select("fold").distinct().orderBy("fold").collect()]
        out = []
        for f in folds:
            inside = F.col("fold") != f
            fitted, held = self._features(f, train.where(inside), train.where(~inside))
            both = fitted.withColumn("fold", F.lit(-1)).unionByName(held.withColumn("fold", F.lit(f)))
            scores = self.models[name].fold_scores(
                both, "text_features", targets, self._candidates[name]
            )
            out += [s for s in scores if s[1] == f]
        return out

    def tune(self, train, holdout, features, targets, scorings=("r2",), shared=False):
        out = super().tune(train, holdout, features, targets, scorings, shared)
        for key in [k for k in self._prepared if k != "holdout"]:
            for df in self._prepared.pop(key):
                df.unpersist()
        return out

    def fit_predict(self, name, train, holdout, features, target, params):
        fitted, held = self._features("holdout", train, holdout)
        return super().fit_predict(name, fitted, held, "text_features", target, params)
