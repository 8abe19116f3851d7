"""Regression metrics, hold-out tables and single-feature correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scores(rows: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Row count, Pearson r, R² and MSE per group, in one aggregate.

    The total sum of squares comes from ``var_pop``, which merges without
    cancellation.
    """
    miss = F.col(y) - F.col(pred)
    mse = F.avg(miss * miss)
    spread = F.var_pop(y)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        safe_corr(pred, y).alias("r"),
        (1 - mse / F.when(spread > 0, spread)).alias("r2"),
        mse.alias("mse"),
    )


def best_by_correlation(results: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """The row with the largest |r| per group; ties go to the first model name."""
    order = Window.partitionBy(*by).orderBy(
        F.abs("r").desc_nulls_last(), "model", "scoring", "candidate"
    )
    return (
        results.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    )


def feature_target_corr(
    df: DataFrame, features: Sequence[str], targets: Sequence[str]
) -> DataFrame:
    """Pearson r for every feature × target, ranked per target by |r|.

    All correlations are aggregates of one pass; only the one-row result is
    turned into rows.
    """
    pairs = [(f, t) for t in targets for f in features]
    wide = df.agg(*[safe_corr(f, t).alias(f"r{i}") for i, (f, t) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(f"r{i}").alias("r"))
            for i, (f, t) in enumerate(pairs)
        ]
    )
    order = Window.partitionBy("target").orderBy(F.round(F.abs("r"), 6).desc_nulls_last(), "feature")
    return wide.select(F.inline(rows)).withColumn("rank", F.row_number().over(order))


def term_target_corr(cells: DataFrame, targets: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """``(term, target, n, r)``: Pearson r of every term's counts with every target, texts without the term counting as 0.

    ``cells`` are ``(id, term, n)``, ``targets`` one row per text with the columns ``names``. No column per term is
    built: Σx, Σx² and Σxy come from the cells there are, the rest from the targets' own sums. A text whose target is
    null takes no part in that target, and ``n`` is how many do; cells of texts that ``targets`` lacks take no part at all.
    ``r`` is null where a side does not vary. Targets are centred first, so that the sums do not cancel.
    """
    number = [F.col(t).cast("double") for t in names]
    sizes = [f"_n{i}" for i in range(len(names))]
    means = targets.agg(*[F.avg(y).alias(f"_m{i}") for i, y in enumerate(number)]).first()
    centred = [y - F.lit(m) for y, m in zip(number, means, strict=True)]
    rows = targets.select(id_col, *[y.alias(f"_y{i}") for i, y in enumerate(centred)])
    totals = rows.agg(
        *[F.count(f"_y{i}").alias(c) for i, c in enumerate(sizes)],
        *[F.sum(F.col(f"_y{i}") * F.col(f"_y{i}")).alias(f"_s{i}") for i in range(len(names))],
    ).first()
    x = F.col("n").cast("double")
    held = lambda i, value: F.sum(F.when(F.col(f"_y{i}").isNotNull(), value))
    sums = cells.join(rows, id_col).groupBy("term").agg(
        *[held(i, x).alias(f"_x{i}") for i in range(len(names))],
        *[held(i, x * x).alias(f"_xx{i}") for i in range(len(names))],
        *[held(i, x * F.col(f"_y{i}")).alias(f"_xy{i}") for i in range(len(names))],
    )
    found = []
    for i, name in enumerate(names):
        count, spread = totals[f"_n{i}"], totals[f"_s{i}"] or 0.0
        some = F.coalesce(F.col(f"_x{i}"), F.lit(0.0))
        wide = F.coalesce(F.col(f"_xx{i}"), F.lit(0.0)) - F.try_divide(some * some, F.lit(float(count)))
        # whole counts: what is left of equal ones is rounding
        varies = (wide > 1e-9 * (1 + F.coalesce(F.col(f"_xx{i}"), F.lit(0.0)))) & F.lit(spread > 0)
        r = F.when(varies, F.col(f"_xy{i}") / F.sqrt(wide * F.lit(float(spread))))
        found.append(F.struct(F.lit(name).alias("target"), F.lit(count).cast("long").alias("n"), r.alias("r")))
    return sums.select("term", F.inline(F.array(*found)))


def safe_corr(x: str, y: str) -> Column:
    """Correlation over the rows where both are present; null without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
