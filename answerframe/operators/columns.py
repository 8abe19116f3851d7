"""Column selection, naming and stacking helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_PATTERN = "_Scale_score"


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name contains ``pattern`` (a regular expression)."""
    return [c for c in df.columns if re.search(pattern, c)]


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that are neither keys nor targets, by name and type."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [
        c
        for c, kind in df.dtypes
        if kind in numeric and c not in exclude and TARGET_PATTERN not in c
    ]


def without_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def rename(df: DataFrame, name: Callable[[str], str], keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column but the kept ones."""
    return df.withColumnsRenamed({c: name(c) for c in df.columns if c not in keep})


def make_unique(names: Sequence[str], sep: str = "_") -> list[str]:
    """Number repeated names: ``x, x_1, x_2``; names already taken are skipped."""
    taken, seen, out = set(names), {}, []
    for name in names:
        if name not in seen:
            seen[name] = 0
            out.append(name)
            continue
        candidate = name
        while candidate in taken:
            seen[name] += 1
            candidate = f"{name}{sep}{seen[name]}"
        taken.add(candidate)
        out.append(candidate)
    return out


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks become null."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def join_features(key: str, *blocks: DataFrame) -> DataFrame:
    """Bind feature blocks by respondent key; the first block decides the rows."""
    first, *rest = blocks
    for block in rest:
        first = first.join(block, key, "left")
    return first


def unpivot(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide row to ``(name, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return df.select(F.inline(pairs))
