"""Searches of a query set against all rows of a vector table: shards of rows, and the queries sent to them.

Rows are dealt into shards of a bounded size. Each query goes to the shards it has to see, and a task takes one shard after
the other: its rows come first and are indexed, then its queries stream through. No vector passes through the driver, a
task holds one shard, and nothing depends on how rows lie: a very common vector, label or id fills several shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Bytes of the vectors of a shard, about.
SHARD_BYTES = 1 << 23
#: Sums below this are exact in doubles; below the second in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**62
SCALE = 256


def finite_vectors(vectors: DataFrame, key: str, values: str, *more: str) -> DataFrame:
    """``id, x`` (doubles) and more columns of the rows whose id is not null and whose vector holds finite numbers only.

    More columns are named ``m0``, ``m1`` and so on.
    """
    rows = pick(vectors, key, values, *more).toDF("id", "v", *[f"m{k}" for k in range(len(more))])
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~wrong)
    x = F.col("v").cast("array<double>").alias("x")
    return rows.select("id", x, *[f"m{k}" for k in range(len(more))])


def integers(column: str = "x"):
    """``floor(256 * component)`` of each component; a double holds it exactly, however large."""
    scaled = lambda x: F.lit(float(SCALE)) * x
    # beyond 2**52 a double has no fraction, and Spark's floor ends at 64 bits
    return F.transform(column, lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; missing trailing components are 0."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def products(rows: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integers kept as doubles. ``most`` bounds their size: the product of the norms.

    Doubles and 64-bit integers are used while they are exact; beyond, Python's integers. A product that 64 bits cannot
    hold raises, as no result could state it.
    """
    if most < EXACT_DOUBLE:
        return (rows @ query).astype(np.int64)
    if most < EXACT_LONG and np.abs(query).max() < EXACT_LONG and np.abs(rows).max() < EXACT_LONG:
        return rows.astype(np.int64) @ query.astype(np.int64)
    q = [int(v) for v in query]
    out = [sum(int(v) * w for v, w in zip(r, q, strict=True) if v and w) for r in rows.tolist()]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise OverflowError("an inner product of these vectors does not fit 64 bits")
    return np.array(out, np.int64)


def number_of_shards(n: int, dims: int) -> int:
    return 1 + n * 8 * max(1, dims) // SHARD_BYTES


def search_shards(
    rows: DataFrame, asked: DataFrame, build: Callable, schema: str, parts: int, dims: int
) -> DataFrame:
    """What ``build(ids, x, more)`` of each shard's rows answers to the queries sent to it.

    ``rows`` and ``asked`` hold ``shard long, id long, x array<double>, more array<long>``. The index's
    ``search(ids, x, more)`` returns an Arrow batch for some queries at once. Rows of a shard are sorted by id, so that a task
    that is run again finds the same.
    """
    columns = ["shard", "asks", "id", "x", "more"]
    both = rows.withColumn("asks", F.lit(False)).select(columns).unionByName(asked.withColumn("asks", F.lit(True)).select(columns))
    dealt = both.repartition(parts, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches):
        key, held, index = None, [], None
        for batch in batches:
            shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(shard)], strict=True):
                if i == j:
                    continue
                if key != shard[i]:
                    key, held, index = shard[i], [], None
                part = batch.column(2).slice(i, j - i).to_numpy(), matrix(batch.column(3).slice(i, j - i), dims), batch.column(4).slice(i, j - i)
                if not asks[i]:
                    held.append(part)
                    continue
                if index is None and held:
                    ids, x, more = zip(*held, strict=True)
                    index, held = build(np.concatenate(ids), np.concatenate(x), pa.chunked_array(more).to_pylist()), []
                if index is not None:
                    yield index.search(*part)

    return dealt.mapInArrow(run, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number ``no`` of their own, as ids may repeat; stored, so that numbers stay."""
    return stored(rows.withColumn("no", F.monotonically_increasing_id()))


def dealt(rows: DataFrame, n_shards: int) -> DataFrame:
    """Numbered rows with a ``shard`` each, evenly whatever they hold."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(n_shards).cast("long")))


def to_all(asked: DataFrame, n_shards: int) -> DataFrame:
    """A query set for every shard."""
    return asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))


def largest(*columns: DataFrame) -> int:
    """Number of components of the longest vector of any table."""
    return max(df.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0] for df in columns)

