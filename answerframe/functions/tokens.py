"""Tokens, n-grams, sentences and in-row term counting.

Everything about one text is computed inside its own row, so none of it needs a
shuffle. ``bind`` holds an array once per row while a lambda looks into it;
a plain column reference could be expanded again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+(?:'\p{L}+)?"
TERM2 = r"[\p{L}\p{N}_]{2,}"
GENERAL = r"https?://\S+|[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
SENTENCE_END = "[.!?]+"
CLAUSE_END = "[,;:]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def words(c: Column | str) -> Column:
    """Lower-cased words: letters with at most one inner apostrophe part."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def terms2(c: Column | str) -> Column:
    """Lower-cased runs of two or more word characters (the TF-IDF default)."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM2), F.lit(0))


def corpus_tokens(
    c: Column | str,
    lower: bool = True,
    remove_punct: bool = True,
    remove_numbers: bool = True,
    remove_symbols: bool = True,
    remove_url: bool = False,
) -> Column:
    """General tokens with whole-token removal; ``abc1`` stays, ``123`` goes."""
    text = F.lower(c) if lower else (F.col(c) if isinstance(c, str) else c)
    tokens = F.regexp_extract_all(text, F.lit(GENERAL), F.lit(0))
    drop = []
    if remove_punct:
        drop.append(r"^\p{P}$")
    if remove_symbols:
        drop.append(r"^\p{S}$")
    if remove_numbers:
        drop.append(r"^\p{N}+$")
    if remove_url:
        drop.append(r"^https?://")
    if not drop:
        return tokens
    return F.filter(tokens, lambda t: ~t.rlike("|".join(drop)))


def sql_list(items) -> str:
    """Quoted SQL list. One expression string is far cheaper to build than many literals."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in items)


def words_without(column: str, listed: list[str]) -> Column:
    """The words of a text column, listed ones dropped; order and repeats stay."""
    found = f'regexp_extract_all(lower(`{column}`), r"{WORD}", 0)'
    return F.expr(f"filter({found}, t -> t NOT IN ({sql_list(listed)}))")


def without(tokens: Column, listed: list[str]) -> Column:
    """Drop listed words, keep order and repeats."""
    return F.filter(tokens, lambda t: ~t.isin(listed))


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 5, sep: str = "_") -> Column:
    """All n-grams, orders ``n_min..n_max``, as one array.

    Each order extends the one below it by the next word, which is cheaper than
    joining a slice per position. Texts shorter than n have no n-grams.
    """

    def grow(w: Column, previous: Column, n: int, kept: list[Column]) -> Column:
        if n > n_max:
            return F.concat(*kept)
        left = F.size(w) - (n - 1)
        longer = F.when(
            left > 0,
            F.zip_with(
                F.slice(previous, F.lit(1), left),
                F.slice(w, F.lit(n), left),
                lambda gram, word: F.concat(gram, F.lit(sep), word),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return bind(longer, lambda g: grow(w, g, n + 1, kept + [g] if n >= n_min else kept))

    return bind(tokens, lambda w: grow(w, w, 2, [w] if n_min <= 1 else []))


def ngrams_starting(tokens: Column, firsts: list[str], n_max: int, sep: str = "_") -> Column:
    """The 2- to ``n_max``-grams that start with one of ``firsts``; no others are built."""

    def build(w: Column, starts: Column) -> Column:
        def of_order(n: int) -> Column:
            inside = F.filter(starts, lambda i: i <= F.size(w) - (n - 1))
            return F.transform(inside, lambda i: F.array_join(F.slice(w, i, n), sep))

        return F.concat(*[of_order(n) for n in range(2, n_max + 1)])

    def at_starts(w: Column) -> Column:
        places = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1))
        hits = F.filter(
            F.coalesce(places, F.array().cast("array<int>")),
            lambda i: F.get(w, i - 1).isin(firsts),
        )
        return bind(hits, lambda starts: build(w, starts))

    return bind(tokens, at_starts)


def count_runs(values: Column) -> Column:
    """Distinct values of an array with their counts: ``array<struct<term, n>>``.

    Sort, mark where a new value starts, and read the run lengths off the marks.
    No shuffle is needed to count the terms of a text.
    """

    def marks(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        return bind(F.array_append(starts, F.size(s) + 1), lambda b: runs(s, b))

    def runs(s: Column, b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(b) - 2),
            lambda j: F.struct(
                F.get(s, F.get(b, j) - 1).alias("term"),
                (F.get(b, j + 1) - F.get(b, j)).cast("long").alias("n"),
            ),
        )

    empty = F.array().cast("array<struct<term:string,n:bigint>>")
    return bind(values, lambda v: F.when(F.size(v) > 0, bind(F.sort_array(v), marks)).otherwise(empty))


def sentence_count(c: Column | str) -> Column:
    """Runs of sentence enders, at least 1."""
    return F.greatest(F.regexp_count(c, F.lit(SENTENCE_END)), F.lit(1))


def vowel_marks(tokens: Column) -> Column:
    """One string for all words: a ``#`` per vowel group, words apart by a blank."""
    grouped = F.regexp_replace(F.array_join(tokens, " "), "[aeiouy]+", "#")
    return F.regexp_replace(grouped, "[^# ]+", "")


def words_with_syllables(marks: Column, k: int) -> Column:
    """Words with at least ``k`` vowel groups, from ``vowel_marks``."""
    return F.regexp_count(marks, F.lit("#" * k + "+"))


def syllable_total(tokens: Column, marks: Column) -> Column:
    """Syllables of all words, at least one for each."""
    groups = F.length(marks) - F.length(F.replace(marks, F.lit("#"), F.lit("")))
    return groups + F.size(tokens) - words_with_syllables(marks, 1)
