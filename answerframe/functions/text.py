"""Text and number expressions. All are Column in, Column out, and map-only."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWERS = [f"open_ended_{i}" for i in range(1, 6)]


def concat_skip_null(*cols: Column | str) -> Column:
    """Join answers with one space; nulls are skipped, empty strings are kept."""
    return F.concat_ws(" ", *cols)


def concat_propagate(*cols: Column | str) -> Column:
    """Join answers with one space; any null answer makes the result null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(" "), F.col(c) if isinstance(c, str) else c]
    return F.concat(*parts[1:])


def clean_text(c: Column | str) -> Column:
    """Lower-case ASCII letters only, runs of anything else become one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "[^a-zA-Z]", " ")), " +", " "))


def strip_symbols(c: Column | str) -> Column:
    """Drop everything that is neither a word character (Unicode) nor blank."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def strip_digits(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\p{Nd}", "")


def apply_chain(c: Column | str, steps: Iterable[Callable[[Column], Column]]) -> Column:
    """Run a list of Column → Column steps, first to last."""
    return reduce(lambda acc, step: step(acc), steps, F.col(c) if isinstance(c, str) else c)


def char_count(c: Column | str) -> Column:
    return F.length(c)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, null when ``den`` is 0 or either side is null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Round half away from zero."""
    return F.round(c, digits)


def count_of(c: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))
