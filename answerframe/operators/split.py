"""Train/hold-out filters and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def part(df: DataFrame, *labels: str, column: str = "Dataset") -> DataFrame:
    """Rows of one split label or of several."""
    return df.where(F.col(column) == labels[0] if len(labels) == 1 else F.col(column).isin(*labels))


def positions(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``position``, the 0-based rank of a row under ``order``.

    Rows are range-partitioned and sorted by the whole order, nulls first, and written to the
    checkpoint folder. A row's position is its place in its partition plus the sizes of the partitions before;
    only these sizes meet in one place. The partitions grow with the input. Rows equal in all of
    ``order`` get neighbouring positions.
    """
    conf = df.sparkSession.conf
    parts = partitions or max(
        df.rdd.getNumPartitions(), int(conf.get("spark.sql.shuffle.partitions"))
    )
    placed = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = placed.withColumn("_at", F.monotonically_increasing_id())
    numbered = numbered.withColumns(
        {"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        numbered.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


def row_range(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows ``start..stop-1`` in file order, for data that is split by position."""
    ranked = positions(df, order)
    return ranked.where((F.col("position") >= start) & (F.col("position") < stop)).drop("position")


def contiguous_folds(df: DataFrame, order: Sequence[str], folds: int) -> DataFrame:
    """Add ``fold``: unshuffled blocks, the first ``n mod folds`` one row longer."""
    total = df.agg(F.count("*")).scalar()
    short = F.floor(total / folds)
    longer = total % folds
    at = F.col("position")
    border = longer * (short + 1)
    fold = F.when(at < border, F.floor(at / (short + 1))).otherwise(
        longer + F.floor((at - border) / F.greatest(short, F.lit(1)))
    )
    return positions(df, order).withColumn("fold", fold.cast("int")).drop("position")


def hash_folds(df: DataFrame, key: str | Column, folds: int) -> DataFrame:
    """Add ``fold`` from the key's hash: no sort and no shuffle, sizes only nearly equal."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
