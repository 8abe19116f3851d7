"""Lexical diversity: Herdan's C, Guiraud's R and Simpson's D."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import RowBlock, select_blocks
from ..functions.text import ratio
from ..functions.tokens import bind, corpus_tokens, count_runs, ngrams, words
from .terms import likely_varied, near_zero_variance, term_counts, tfidf_log10


def _indices(v: Column, n: Column, pairs: Column) -> list[Column]:
    enough = n > 1
    return [
        F.when(enough, F.try_divide(F.log(v), F.log(n))).alias("lex_div_C"),
        F.when(enough, v / F.sqrt(n)).alias("lex_div_R"),
        F.when(enough, pairs / (n * (n - 1))).alias("lex_div_D"),
    ]


def lexical_diversity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The indices on plain word counts. Map-only; null for fewer than two words."""

    def sums(counts: Column) -> Column:
        n = F.transform(counts, lambda c: c["n"])
        return F.struct(
            F.size(counts).cast("double").alias("V"),
            F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).cast("double").alias("N"),
            F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x * (x - 1))
            .cast("double")
            .alias("pairs"),
        )

    measured = df.select(id_col, bind(count_runs(words(text_col)), sums).alias("s"))
    s = F.col("s")
    return measured.select(id_col, *_indices(s["V"], s["N"], s["pairs"]))


def weighted_diversity(
    df: DataFrame, id_col: str, answers: Sequence[str], n_max: int = 5
) -> DataFrame:
    """The indices on the log10 TF-IDF n-gram weights of all answers together.

    Near-constant columns are dropped per answer first. N is then a sum of
    weights, which makes the values non-standard; they are what the published
    pipeline feeds its models.
    """
    texts = df.select(
        id_col,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit("")).alias("text"))
                    for c in answers
                ]
            )
        ),
    )
    cells = term_counts(texts, [id_col, "field"], ngrams(corpus_tokens("text"), 1, n_max))
    cells = likely_varied(cells, df, ["field"])
    judged = near_zero_variance(cells, df, ["field"], weighted=True)
    kept = judged.where(~F.col("nzv")).select("field", "term", "doc_count")
    weights = tfidf_log10(cells, df, ["field"], kept)
    w = F.col("weight")
    sums = weights.groupBy(id_col).agg(
        F.sum(F.when(w != 0, 1.0).otherwise(0.0)).alias("V"),
        F.sum(w).alias("N"),
        F.sum(w * (w - 1)).alias("pairs"),
    )
    totals = df.select(id_col).join(sums, id_col, "left")
    return totals.select(id_col, *_indices(F.col("V"), F.col("N"), F.col("pairs")))


def ratio_block(answers: Sequence[str]) -> RowBlock:
    """Characters per word of every answer, and over the non-null answers together."""
    span = range(1, len(answers) + 1)
    prepared = {f"_chars{i}": F.length(c) for i, c in enumerate(answers, 1)}
    prepared |= {
        f"_words{i}": F.when(F.col(c).isNotNull(), F.size(words(c)))
        for i, c in enumerate(answers, 1)
    }

    def total(prefix: str) -> Column:
        return sum((F.coalesce(f"{prefix}{i}", F.lit(0)) for i in span), F.lit(0))

    columns = [
        ratio(F.col(f"_chars{i}"), F.col(f"_words{i}")).alias(f"char_per_word{i}") for i in span
    ]
    columns.append(ratio(total("_chars"), total("_words")).alias("char_per_word_all_text"))
    return RowBlock(prepared, columns)


def answer_ratios(df: DataFrame, id_col: str, answers: Sequence[str]) -> DataFrame:
    return select_blocks(df, [id_col], ratio_block(answers))
