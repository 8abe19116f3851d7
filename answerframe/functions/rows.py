"""Map-only feature blocks that share one projection.

A block names the per-text structs it needs and the columns it makes of them.
Any number of blocks become two projections over one scan: no shuffle, and no
join between families that only look at their own row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass
class RowBlock:
    prepared: dict[str, Column]
    columns: list[Column]


def select_blocks(df: DataFrame, keep: Sequence[str], *blocks: RowBlock) -> DataFrame:
    """``keep`` plus the columns of all blocks."""
    prepared: dict[str, Column] = {}
    for block in blocks:
        clash = set(prepared) & set(block.prepared)
        if clash:
            raise ValueError(f"blocks prepare the same names: {sorted(clash)}")
        prepared |= block.prepared
    ready = df.select(*keep, *[c.alias(name) for name, c in prepared.items()])
    return ready.select(*keep, *[c for block in blocks for c in block.columns])
