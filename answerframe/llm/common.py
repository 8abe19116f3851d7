"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Code points handled at once inside a task; bounds the memory of numpy steps.
BLOCK_CHARS = 400_000
#: A key with more than this share of all rows is cut into pieces.
HOT_KEYS = 2_000
LETTERS = re.compile(r"[^\W\d_]+")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by their exact names.

    Other columns may have names that differ in case alone, hold dots, or clash with
    names an operator uses inside; columns are therefore renamed by position first.
    """
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{p}").alias(n) for p, n in zip(places, names, strict=True)])


def with_private_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns ``c0…`` and the names to give back at the end."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), list(df.columns)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_for(df: DataFrame) -> int:
    """As many shuffle partitions as the input has, which follows its bytes."""
    spark = df.sparkSession
    return max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows whose ``key`` is among the ``bound`` keys with the smallest hashes; all rows if there are fewer keys.

    Only a model is fitted on such rows; which keys are chosen depends on nothing but the keys. The bound is exact at any
    size. A first count and the even spread of hashes leave a few more than ``bound`` keys to be sorted out. Rows of a null key
    are one key's. Rows equal in ``key`` come together, so ``df`` should have few of them.
    """
    hash_ = F.xxhash64(F.col(key), F.lit(17))
    total = df.count()
    if total <= bound:
        return df
    few = df.where(hash_ < lower_share(bound, total)).select(hash_.alias("h")).distinct().orderBy("h").limit(bound + 1).collect()
    if len(few) <= bound:  # keys repeat: fewer keys than rows
        few = df.select(hash_.alias("h")).distinct().orderBy("h").limit(bound + 1).collect()
    return df if len(few) <= bound else df.where(hash_ < few[-1]["h"])


def lower_share(bound: int, total: int) -> int:
    """A signed 64-bit number that hashes of ``bound`` of ``total`` keys, and of some more, lie below."""
    wanted = bound + 10 * math.isqrt(bound) + 100
    return min(2**63 - 1, -(2**63) + (wanted << 64) // total)


def blocks(lengths: Sequence[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose lengths sum to about ``limit``; a longer row is alone."""
    a = total = 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    """Replace each Arrow batch by the columns ``fn`` makes of it.

    Columns handed through stay Arrow arrays, so nulls, nested values and large numbers are untouched.
    """

    def run(batches):
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    names = [x.strip().split(" ", 1)[0] for x in schema.split(",")]
    kinds = [x.strip().split(" ", 1)[1] for x in schema.split(",")]
    plain = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    return df.mapInArrow(run, plain).toDF(*names)


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def doubles(values) -> pa.Array:
    return pa.array(values, pa.float64())


def share(spark, value) -> Callable[[], object]:
    """Broadcast an object of this package; the result gives it back inside a task.

    It travels with its class, as functions do, so that executors need no copy of the package.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(data.value))
        return held[0]

    return get


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again; cuts the lineage as a checkpoint does."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, on: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which is unique on ``on`` and whose ``count`` says how many rows an entry meets.

    An entry that meets more than 1/``HOT_KEYS`` of the rows is hot (so there are at most ``HOT_KEYS``); its rows are dealt to as
    many copies of it as keep each below that share. Hot keys alone are broadcast. ``table`` should be stored.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    copies = F.ceil(F.col(count) * HOT_KEYS / F.lit(max(1, total))).cast("long")
    salted = table.withColumn("_copies", F.greatest(copies, F.lit(1).cast("long")))
    hot = salted.where("_copies > 1").select(F.col(on).alias("_hot"), "_copies")
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_copies")), F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_copies")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return dealt.join(salted.withColumn("_salt", each).drop("_copies", count), [on, "_salt"]).drop("_salt")
