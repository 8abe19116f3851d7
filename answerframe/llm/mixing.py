"""Mixing sources to target weights by subset-sum budget fitting.

A source's target may exceed what it has, so every document is taken a whole number of times: a base number
for all, and once more for a chosen part whose sizes should add up to what is left of the budget. Documents are
counted by exact size. An equal share of each size is given out first; bounded-knapsack dynamic programming over
the counts that are left fits the small remaining budget. Which documents of a size are chosen
follows a seeded hash: whole hash buckets first, a ranking only within the bucket in which the number is reached.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import checkpoint
from .common import pick, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the dynamic programme's table, at most; larger rests are first filled with large documents.
DP_CELLS = 2_000_000
#: Rows of one source and size that a hash bucket holds on average.
BUCKET_ROWS = 2_000


def water_fill(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Share the sum of ``sizes`` by weight; a share stops at ``most`` times its size, the excess is reshared."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            targets[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in set(open_) - set(over))
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def choose_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that the sizes sum to ``budget``, or as near as possible.

    An equal share of every size goes first, short of the budget by a margin; the counts left are fitted to
    the rest by a bounded-knapsack table over reachable sums.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    margin = min(budget, 2 * int(sizes.max()) + 64)
    taken = np.floor(counts * ((budget - margin) / total)).astype(np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):  # flooring left up to one document of each size
        if 0 < sizes[i] <= rest - margin:
            more = min(int(counts[i] - taken[i]), (rest - margin) // int(sizes[i]))
            taken[i] += more
            rest -= more * int(sizes[i])
    # what the table cannot reach: whole documents from the largest size down, until the rest is within its reach
    for i in np.argsort(-sizes, kind="stable") if rest > DP_CELLS else ():
        if 0 < sizes[i] <= rest and counts[i] > taken[i]:
            more = min(int(counts[i] - taken[i]), rest // int(sizes[i]))
            taken[i] += more
            rest -= more * int(sizes[i])
        if rest <= DP_CELLS:
            break
    if rest <= DP_CELLS:
        return taken + knapsack(sizes, counts - taken, rest)
    left = np.flatnonzero((counts > taken) & (sizes > 0))  # all of them larger than the rest
    if len(left):
        i = left[np.argmin(sizes[left])]
        taken[i] += int(sizes[i]) - rest < rest
    return taken


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: at most ``counts`` items of each size whose sum is nearest to ``budget``.

    ``by[s]`` is the size through which the sum ``s`` was first reached. A size is added once to all sums, then
    again only to the sums that its last addition reached, so that no sum needs more items than there are.
    Sums above the budget by less than the smallest item are entered too.
    """
    there = (sizes > 0) & (counts > 0)
    if not there.any():
        return np.zeros(len(sizes), np.int64)
    reach = budget + int(sizes[there].min())
    by = np.full(reach + 1, -1, np.int32)
    by[0] = len(sizes)
    for k in np.argsort(sizes, kind="stable"):
        size = int(sizes[k])
        if not there[k] or size > reach:
            continue
        ends = np.flatnonzero(by != -1)
        for _ in range(min(int(counts[k]), reach // size)):
            ends = ends[: np.searchsorted(ends, reach - size, "right")] + size
            ends = ends[by[ends] == -1]
            if not len(ends):
                break
            by[ends] = k
        if by[budget] != -1:
            break
    sums = np.flatnonzero(by != -1)
    s = int(sums[np.argmin(np.abs(sums - budget))])
    out = np.zeros(len(sizes), np.int64)
    while s > 0:
        out[by[s]] += 1
        s -= int(sizes[by[s]])
    return out


def measured(docs: DataFrame, size_of=None, draw_by: str = "doc_id") -> DataFrame:
    """``doc_id, source, size`` (and ``draw_by``) of each row; ``size`` is the number of words unless given."""
    size = size_of if size_of is not None else F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    more = [draw_by] if draw_by != "doc_id" else []
    return pick(docs, "doc_id", "text", "source", *more).select("doc_id", "source", size.alias("size"), *more)


def plan_sources(sized: DataFrame, weights=WEIGHTS) -> list[dict]:
    """Per source, by code point with null last: size and target. One row a source reaches the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["source_size"]) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))])
    return [
        {"source": r["source"], "source_size": n, "target": t} for r, n, t in zip(rows, sizes, targets, strict=True)
    ]


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = SEED, draw_by: str = "doc_id") -> DataFrame:
    """``doc_id, size, source_size, target, repeats`` of each row of ``docs``.

    Which rows of a size are chosen follows a hash of the column ``draw_by``.
    ``repeats`` (0 to 3) is how often the mix takes the row. Rows without a word have size 0 and go with their
    source's base number. Sources may be null. Rows equal in id, source and size are interchangeable.
    """
    sized = measured(docs, draw_by=draw_by).withColumn("key", F.to_json(F.struct("source", "size")))
    sized = checkpoint(sized.withColumn("draw", F.xxhash64(draw_by, "size", F.lit(seed))))
    chosen = checkpoint(choose(sized, weights))
    return pick_rows(sized, chosen)


def choose(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Per source and size (``key``): number of rows ``n``, ``base`` for all, ``extra`` rows once more."""
    plan = {p["source"]: p for p in plan_sources(sized, weights)}
    shared = sized.sparkSession.sparkContext.broadcast(plan)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        p = shared.value[part["source"].iloc[0]]
        size, target = p["source_size"], p["target"]
        base = min(MAX_REPEATS, int(target // size)) if size else 0
        budget = round(target) - base * size if base < MAX_REPEATS else 0
        extra = choose_counts(part["size"].to_numpy(), part["n"].to_numpy(), budget)
        return part[["key", "n"]].assign(source_size=size, target=target, base=base, extra=extra)

    by_size = sized.groupBy("source", "size", "key").agg(F.count("*").alias("n"))
    schema = "key string, n long, source_size long, target double, base long, extra long"
    return by_size.groupBy("source").applyInPandas(fit, schema)


def pick_rows(sized: DataFrame, chosen: DataFrame) -> DataFrame:
    """Give each row its source's base number, and one more to ``extra`` rows of each key."""
    n_buckets = (F.lit(1) + F.floor(F.col("n") / BUCKET_ROWS)).cast("long")
    rows = lookup(sized, chosen.withColumn("n_buckets", n_buckets), "key", "inner")
    rows = rows.withColumn("bucket", F.pmod("draw", F.col("n_buckets")))
    counted = rows.where("extra > 0 AND extra < n").groupBy("key", "bucket")
    counted = counted.agg(F.count("*").alias("k"), F.first("extra").alias("wanted"))
    so_far = F.sum("k").over(Window.partitionBy("key").orderBy("bucket"))
    ends = counted.withColumn("before", so_far - F.col("k"))
    ends = ends.where("before < wanted AND wanted <= before + k")
    ends = checkpoint(ends.select("key", F.col("bucket").alias("last"), (F.col("wanted") - F.col("before")).alias("of_last")))
    rows = lookup(rows, ends, "key", "left")
    names = ["doc_id", "size", "source_size", "target"]
    sure = (F.col("extra") >= F.col("n")) & (F.col("extra") > 0) | (F.col("bucket") < F.col("last"))
    plain = rows.where("last IS NULL OR bucket != last").select(
        *names, (F.col("base") + F.when(sure, 1).otherwise(0)).alias("repeats")
    )
    rank = F.row_number().over(Window.partitionBy("key").orderBy("draw", "doc_id"))
    ranked = rows.where("bucket = last").withColumn("rank", rank)
    edge = ranked.select(
        *names, (F.col("base") + F.when(F.col("rank") <= F.col("of_last"), 1).otherwise(0)).alias("repeats")
    )
    return plain.unionByName(edge)
