"""Readability measures as map-only expressions over one struct of text counts.

Symbols: ``W`` words, ``C`` letters in words, ``St`` sentences (at least 1),
``Nc`` characters, ``Nb`` blanks, ``Sy`` syllables, ``W2``/``W3`` words with at
least two/three syllables, ``D`` words off the easy-word list, ``Dd`` words off
the list with at least two syllables. A syllable is a group of ``[aeiouy]``.
With ``W = 0`` every ratio is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import RowBlock, select_blocks
from .text import ratio
from .tokens import (
    bind,
    sentence_count,
    syllable_total,
    vowel_marks,
    words,
    words_with_syllables,
)

# Letter tile values of the English board game.
TILE_VALUES = {
    1: "aeilnorstu",
    2: "dg",
    3: "bcmp",
    4: "fhvwy",
    5: "k",
    8: "jx",
    10: "qz",
}

# Coefficients of the degrees-of-reading-power index.
DRP = {
    "base": 0.886593,
    "word_length": -0.08364,
    "familiar_cubed": 0.161911,
    "asl": -0.021401,
    "asl_squared": 0.000577,
    "asl_cubed": -0.000005,
}


def basic_counts(c: Column | str) -> Column:
    """``struct<W, C, St, Nc, Nb>`` of a text."""
    text = F.col(c) if isinstance(c, str) else c

    def measure(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("W"),
            F.length(F.replace(F.array_join(w, ""), F.lit("'"), F.lit(""))).alias("C"),
            sentence_count(text).alias("St"),
            F.length(text).alias("Nc"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("Nb"),
        )

    return F.when(text.isNotNull(), bind(words(text), measure))


def text_counts(c: Column | str, easy_words: Sequence[str]) -> Column:
    """All counts the measures need, as one struct evaluated in one pass per text.

    ``easy_words`` is a word list that the caller holds in memory; it travels inside the plan as a
    hash set.
    """
    text = F.col(c) if isinstance(c, str) else c
    easy = list(easy_words)

    def hard_counts(h: Column) -> Column:
        return F.struct(
            F.size(h).alias("D"), words_with_syllables(vowel_marks(h), 2).alias("Dd")
        )

    def measure(w: Column) -> Column:
        hard = F.filter(w, lambda t: ~t.isin(easy)) if easy else w
        return bind(
            vowel_marks(w),
            lambda marks: F.struct(
                F.size(w).alias("W"),
                F.length(F.replace(F.array_join(w, ""), F.lit("'"), F.lit(""))).alias("C"),
                sentence_count(text).alias("St"),
                F.length(text).alias("Nc"),
                (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("Nb"),
                syllable_total(w, marks).alias("Sy"),
                words_with_syllables(marks, 2).alias("W2"),
                words_with_syllables(marks, 3).alias("W3"),
                bind(hard, hard_counts).alias("hard"),
                tile_sums(w).alias("tiles"),
                linsear_sample(text).alias("sample"),
            ),
        )

    return F.when(text.isNotNull(), bind(words(text), measure))


def tile_sums(tokens: Column) -> Column:
    """``struct<score, letters>``: tile values summed over the letters a-z, and their number.

    The most common letters are taken out first, so each later pass reads less.
    """

    def take_out(left: Column, groups: list[tuple[int, str]], score: Column) -> Column:
        if not groups:
            return score
        value, group = groups[0]
        return bind(
            F.regexp_replace(left, f"[{group}]", ""),
            lambda rest: take_out(
                rest, groups[1:], score + value * (F.length(left) - F.length(rest))
            ),
        )

    return bind(
        F.regexp_replace(F.array_join(tokens, ""), "[^a-z]", ""),
        lambda letters: F.struct(
            take_out(letters, list(TILE_VALUES.items()), F.lit(0)).alias("score"),
            F.length(letters).alias("letters"),
        ),
    )


def linsear_sample(text: Column) -> Column:
    """``struct<points, St>`` of the 100-word sample the Linsear Write formula is defined on.

    The sample size is part of the published formula, every other measure uses
    the whole text.
    """
    blank_words = F.split(F.regexp_replace(text, r"^\s+", ""), r"\s+", 101)
    sample = F.array_join(F.slice(blank_words, 1, 100), " ")

    def points(s: Column) -> Column:
        def scored(w: Column) -> Column:
            return F.size(w) + 2 * words_with_syllables(vowel_marks(w), 3)

        return F.struct(bind(words(s), scored).alias("points"), sentence_count(s).alias("St"))

    return bind(sample, points)


def coleman_liau_short(m: Column) -> Column:
    return 5.88 * ratio(m["C"], m["W"]) - 29.6 * ratio(m["St"], m["W"]) - 15.8


def danielson_bryan_1(m: Column) -> Column:
    return 1.0364 * ratio(m["Nc"], m["Nb"]) + 0.0194 * ratio(m["Nc"], m["St"]) - 0.6059


def danielson_bryan_2(m: Column) -> Column:
    return 131.059 - 10.364 * ratio(m["Nc"], m["Nb"]) - 0.0194 * ratio(m["Nc"], m["St"])


def mean_sentence_length(m: Column) -> Column:
    return F.when(m["W"] > 0, ratio(m["W"], m["St"]))


def flesch_kincaid(m: Column) -> Column:
    return 0.39 * mean_sentence_length(m) + 11.8 * ratio(m["Sy"], m["W"]) - 15.59


def flesch_ease(m: Column) -> Column:
    return 206.835 - 1.015 * mean_sentence_length(m) - 84.6 * ratio(m["Sy"], m["W"])


def dale_chall_old(m: Column) -> Column:
    share = ratio(m["hard"]["D"], m["W"])
    surcharge = F.when(share > 0.05, F.lit(3.6365)).otherwise(F.lit(0.0))
    return 15.79 * share + 0.0496 * mean_sentence_length(m) + surcharge


def dale_chall_1995(m: Column) -> Column:
    return 64 - 95 * ratio(m["hard"]["D"], m["W"]) - 0.69 * mean_sentence_length(m)


def wheeler_smith(m: Column) -> Column:
    return mean_sentence_length(m) * 10 * ratio(m["W2"], m["W"])


def mean_word_syllables(m: Column) -> Column:
    return ratio(m["Sy"], m["W"])


def strain(m: Column) -> Column:
    return F.when(m["W"] > 0, ratio(m["Sy"] * 3, m["St"]) / 10)


def smog(m: Column) -> Column:
    return F.when(m["W"] > 0, 1.043 * F.sqrt(30 * ratio(m["W3"], m["St"])) + 3.1291)


def smog_three_sentences(m: Column) -> Column:
    """SMOG, 0 for texts under three sentences."""
    return F.when(m["W"] > 0, F.when(m["St"] >= 3, smog(m)).otherwise(F.lit(0.0)))


def scrabble(m: Column) -> Column:
    return ratio(m["tiles"]["score"], m["tiles"]["letters"])


def fog(m: Column) -> Column:
    return 0.4 * (mean_sentence_length(m) + 100 * ratio(m["W3"], m["W"]))


def farr_jenkins_paterson(m: Column) -> Column:
    one_syllable = ratio(m["W"] - m["W2"], m["W"])
    return -31.517 - 1.015 * mean_sentence_length(m) + 1.599 * 100 * one_syllable


def drp(m: Column) -> Column:
    asl = mean_sentence_length(m)
    familiar = ratio(m["W"] - m["hard"]["D"], m["W"])
    bormuth = (
        DRP["base"]
        + DRP["word_length"] * ratio(m["C"], m["W"])
        + DRP["familiar_cubed"] * familiar * familiar * familiar
        + DRP["asl"] * asl
        + DRP["asl_squared"] * asl * asl
        + DRP["asl_cubed"] * asl * asl * asl
    )
    return 100 * (1 - bormuth)


def linsear_write(m: Column) -> Column:
    score = F.when(m["W"] > 0, ratio(m["sample"]["points"], m["sample"]["St"]))
    return F.when(score > 20, score / 2).otherwise((score - 2) / 2)


def coleman_liau(m: Column) -> Column:
    return 0.058 * 100 * ratio(m["C"], m["W"]) - 0.296 * 100 * ratio(m["St"], m["W"]) - 15.8


def automated_readability(m: Column) -> Column:
    return 4.71 * ratio(m["Nc"], m["W"]) + 0.5 * mean_sentence_length(m) - 21.43


# The twelve measures of the concatenated text.
CORPUS_MEASURES = {
    "Flesch_Kincaid": flesch_kincaid,
    "Dale_Chall_old": dale_chall_old,
    "Wheeler_Smith": wheeler_smith,
    "meanSentenceLength": mean_sentence_length,
    "meanWordSyllables": mean_word_syllables,
    "Strain": strain,
    "SMOG": smog,
    "Scrabble": scrabble,
    "FOG": fog,
    "Farr_Jenkins_Paterson": farr_jenkins_paterson,
    "DRP": drp,
    "Dale_Chall": dale_chall_1995,
}

# The scores of the earlier feature class.
SCORE_MEASURES = {
    "avg_syllables_per_word": lambda m: F.round(mean_word_syllables(m), 2),
    "avg_sentence_length": lambda m: F.round(mean_sentence_length(m), 2),
    "flesch_ease_score": flesch_ease,
    "flesch_grade_score": flesch_kincaid,
    "linsear_write_score": linsear_write,
    "dale_chall_score": dale_chall_old,
    "gunning_fog_score": fog,
    "smog_score": smog_three_sentences,
    "automated_readability_score": automated_readability,
    "coleman_liau_score": coleman_liau,
}

COUNTS = {
    "syllables_count": "Sy",
    "word_count": "W",
    "difficult_count": "hard.Dd",
    "sentence_count": "St",
}


def readability_block(
    text_col: str,
    easy_words: Sequence[str],
    measures: dict | None = None,
    counts: bool = False,
) -> RowBlock:
    chosen = CORPUS_MEASURES if measures is None else measures
    m = F.col("_counts")
    raw = [F.col(f"_counts.{field}").alias(name) for name, field in COUNTS.items()]
    named = [fn(m).alias(name) for name, fn in chosen.items()]
    return RowBlock({"_counts": text_counts(text_col, easy_words)}, (raw if counts else []) + named)


def answer_block(answers: Sequence[str]) -> RowBlock:
    """Coleman-Liau and both Danielson-Bryan forms for every answer column."""
    cols = []
    for i in range(1, len(answers) + 1):
        m = F.col(f"_basic{i}")
        cols += [
            coleman_liau_short(m).alias(f"readability_CL{i}"),
            danielson_bryan_1(m).alias(f"readability_DB1_{i}"),
            danielson_bryan_2(m).alias(f"readability_DB{i}"),
        ]
    return RowBlock({f"_basic{i}": basic_counts(c) for i, c in enumerate(answers, 1)}, cols)


def readability(
    df: DataFrame,
    id_col: str,
    text_col: str,
    easy_words: Sequence[str],
    measures: dict | None = None,
    counts: bool = False,
) -> DataFrame:
    """One row per text with the chosen measures (default: the twelve corpus ones)."""
    return select_blocks(df, [id_col], readability_block(text_col, easy_words, measures, counts))


def answer_readability(df: DataFrame, id_col: str, answers: Sequence[str]) -> DataFrame:
    return select_blocks(df, [id_col], answer_block(answers))
