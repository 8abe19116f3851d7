"""Porter stemming (Porter 1980) as column expressions.

Each step is a plain projection of regular expressions, so stemming stays on the
JVM, needs no lookup table and no shuffle. ``y`` counts as a vowel after a
consonant. Words of one or two letters are left alone. ``stem_word`` does the same
to one word inside an Arrow task, where each distinct word of many texts is stemmed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
HAS_VOWEL = "^(?:[^aeiou][^aeiouy]*)?[aeiouy]"
MEASURE_OVER_0 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
MEASURE_OVER_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
MEASURE_IS_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLED = "(?:" + "|".join(2 * c for c in "bcdfghjkmnpqrtvwxy") + ")$"

# The suffix tables of the published algorithm.
STEP_1 = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate",
    "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "ator": "ate", "eli": "e",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": "",
}
STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
    "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
]


def cut(c: Column, chars: int, add: str = "") -> Column:
    """Drop the last ``chars`` characters and append ``add``."""
    kept = F.substring(c, F.lit(1), F.length(c) - chars)
    return F.concat(kept, F.lit(add)) if add else kept


def _if_stem(c: Column, chars: int, pattern: str, add: str = "") -> Column:
    return F.when(cut(c, chars).rlike(pattern), cut(c, chars, add)).otherwise(c)


def _past(c: Column) -> Column:
    """Drop ``ed``/``ing`` and mark the word with ``!`` for the repair step."""
    return (
        F.when(F.endswith(c, F.lit("eed")), _if_stem(c, 3, MEASURE_OVER_0, "ee"))
        .when(F.endswith(c, F.lit("ed")), _if_stem(c, 2, HAS_VOWEL, "!"))
        .when(F.endswith(c, F.lit("ing")), _if_stem(c, 3, HAS_VOWEL, "!"))
        .otherwise(c)
    )


def _repair(c: Column) -> Column:
    bare = cut(c, 1)
    fixed = (
        F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike(DOUBLED), cut(bare, 1))
        .when(bare.rlike(SHORT_END), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )
    return F.when(F.endswith(c, F.lit("!")), fixed).otherwise(c)


def _final_y(c: Column) -> Column:
    return F.when(
        F.endswith(c, F.lit("y")) & cut(c, 1).rlike(HAS_VOWEL), cut(c, 1, "i")
    ).otherwise(c)


def _final_e(c: Column) -> Column:
    bare = cut(c, 1)
    drop = bare.rlike(MEASURE_OVER_1) | (bare.rlike(MEASURE_IS_1) & ~bare.rlike(SHORT_END))
    return F.when(F.endswith(c, F.lit("e")) & drop, bare).otherwise(c)


def _final_ll(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("ll")) & c.rlike(MEASURE_OVER_1), cut(c, 1)).otherwise(c)


def _project(step: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    def run(df: DataFrame, out: str) -> DataFrame:
        word = F.col(out)
        return df.withColumn(out, F.when(F.col(LONG), step(word)).otherwise(word))

    return run


def _suffixes(rules: dict[str, str], measure: str) -> Callable[[DataFrame, str], DataFrame]:
    """Replace the longest listed suffix if what is left of it matches ``measure``.

    One regular expression finds the suffix (the leftmost match is the longest
    suffix), so the generated code stays small however long the table is.
    """
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    pattern = "(" + "|".join(rules) + ")$"

    def run(df: DataFrame, out: str) -> DataFrame:
        suffix, base = F.col("_suffix"), F.col("_base")
        applies = F.col(LONG) & (suffix != "") & base.rlike(measure)
        applies &= (suffix != "ion") | base.rlike("[st]$")
        return (
            df.withColumn("_suffix", F.regexp_extract(out, pattern, 1))
            .withColumn("_base", F.substring(out, F.lit(1), F.length(out) - F.length("_suffix")))
            .withColumn(
                out,
                F.when(applies, F.concat(base, F.element_at(table, suffix))).otherwise(F.col(out)),
            )
        )

    return run


LONG = "_long"


def stem_column(df: DataFrame, word_col: str, out_col: str = "stem") -> DataFrame:
    """Add the Porter stem of ``word_col``. A few small projections per step."""
    steps = [
        _suffixes(STEP_1, ""),
        _project(_past),
        _project(_repair),
        _project(_final_y),
        _suffixes(STEP_2, MEASURE_OVER_0),
        _suffixes(STEP_3, MEASURE_OVER_0),
        _suffixes(dict.fromkeys(STEP_4, ""), MEASURE_OVER_1),
        _project(_final_e),
        _project(_final_ll),
    ]
    start = df.withColumn(out_col, F.lower(word_col)).withColumn(LONG, F.length(word_col) > 2)
    done = reduce(lambda acc, step: step(acc, out_col), steps, start)
    # A filter on the stem must stay above this line: pushed through the steps it
    # would repeat each of them inside the next. A generator's output stops it.
    kept = [c for c in df.columns if c != out_col]
    return done.select(*kept, F.explode(F.array(out_col)).alias(out_col))


_OVER_0, _OVER_1, _IS_1, _VOWEL, _SHORT, _DOUBLED, _TO_E, _ION = map(
    re.compile, [MEASURE_OVER_0, MEASURE_OVER_1, MEASURE_IS_1, HAS_VOWEL, SHORT_END, DOUBLED, "(?:at|bl|iz)$", "[st]$"]
)
_TABLES = [
    (re.compile("(?:" + "|".join(rules) + ")$"), rules, measure)
    for rules, measure in ((STEP_2, _OVER_0), (STEP_3, _OVER_0), (dict.fromkeys(STEP_4, ""), _OVER_1))
]


def stem_word(word: str) -> str:
    """The Porter stem of one word, by the same steps and patterns as ``stem_column``."""
    w = word.lower()
    if len(word) <= 2:
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _OVER_0.search(w[:-3]) else w
    elif w.endswith("ed"):
        w = w[:-2] + "!" if _VOWEL.search(w[:-2]) else w
    elif w.endswith("ing"):
        w = w[:-3] + "!" if _VOWEL.search(w[:-3]) else w
    if w.endswith("!"):
        w = w[:-1]
        if _TO_E.search(w):
            w += "e"
        elif _DOUBLED.search(w):
            w = w[:-1]
        elif _SHORT.search(w):
            w += "e"
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for ends, rules, measure in _TABLES:
        found = ends.search(w)
        if found:
            base, suffix = w[: found.start()], found[0]
            if measure.search(base) and (suffix != "ion" or _ION.search(base)):
                w = base + rules[suffix]
    if w.endswith("e"):
        bare = w[:-1]
        if _OVER_1.search(bare) or (_IS_1.search(bare) and not _SHORT.search(bare)):
            w = bare
    if w.endswith("ll") and _OVER_1.search(w):
        w = w[:-1]
    return w
