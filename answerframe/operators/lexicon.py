"""Dictionary profiles, emotion counts, list counts and sentiment ratios.

A lexicon is a DataFrame ``(dict, category, pattern, weight)``. A pattern is a
word, several words joined by ``_``, or either with a final ``*``. All
dictionaries share one pass: the text is tokenised once, its term counts meet
one lexicon table, and partial sums leave one small row per text to shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import RowBlock, select_blocks
from ..functions.stem import stem_column
from ..functions.text import count_of, ratio
from ..functions.tokens import (
    bind,
    count_runs,
    ngrams,
    ngrams_starting,
    sentence_count,
    sql_list,
    words,
    words_without,
)
from .joins import lookup

ANY = "(any)"
MAX_FIRST_WORDS = 5_000

# Punctuation columns of the profile and the characters they count.
MARKS = {
    "Period": ".",
    "Comma": ",",
    "Colon": ":",
    "SemiC": ";",
    "QMark": "?",
    "Exclam": "!",
    "Dash": "-–—",
    "Quote": '"“”',
    "Apostro": "'’",
    "Parenth": "()",
}
PROFILE = ["WC", "WPS", "Sixltr", "Dic", "AllPunc", *MARKS, "OtherP"]


def last_word_start(c: Column) -> Column:
    """Characters before the last word of a ``_``-joined term; a ``*`` stays inside one word."""
    return F.length(c) - F.length(F.substring_index(c, "_", -1))


def minimal_patterns(lexicon: DataFrame) -> DataFrame:
    """Drop patterns a shorter ``*`` pattern of the same category already covers.

    Afterwards a word meets at most one pattern per category, so plain sums over
    the matches count it once.
    """
    keys = ["dict", "category"]
    patterns = lexicon.select(*keys, "pattern").distinct()
    text = F.regexp_replace("pattern", r"\*$", "")
    ends = F.when(F.endswith("pattern", F.lit("*")), F.length(text) - 1).otherwise(F.length(text))
    starts = F.greatest(last_word_start(text), F.lit(1))
    shorter = (
        patterns.withColumn("_text", text)
        .withColumn("_ends", ends)
        .withColumn("_starts", starts)
        .where(F.col("_ends") >= F.col("_starts"))
        .withColumn("_k", F.explode(F.sequence("_starts", "_ends")))
        .withColumn("_cover", F.concat(F.substring("_text", F.lit(1), F.col("_k")), F.lit("*")))
    )
    covers = patterns.select(*keys, F.col("pattern").alias("_cover"))
    covered = shorter.join(covers, [*keys, "_cover"]).select(*keys, "pattern").distinct()
    return patterns.join(covered, [*keys, "pattern"], "left_anti")


def match_patterns(
    cells: DataFrame, lexicon: DataFrame, keys: Sequence[str], extra: DataFrame | None = None
) -> DataFrame:
    """``(keys…, term, n, dict, category)`` for every category a term belongs to.

    Only prefixes of a length some pattern has are tried, by equality. Nothing
    compares each term with each pattern. ``extra`` adds ready patterns.
    Terms that begin like no pattern stop first, by one equality: no prefix that
    matches is shorter than the shortest wildcard.
    """
    minimal = minimal_patterns(lexicon)
    minimal = minimal if extra is None else minimal.unionByName(extra)
    shortest = F.min(F.when(F.endswith("pattern", F.lit("*")), F.length("pattern") - 1))
    head = F.coalesce(minimal.agg(shortest).scalar(), F.lit(2**31 - 1))
    heads = minimal.select(F.regexp_replace("pattern", r"\*$", "").alias("_text"))
    heads = heads.select(F.substring("_text", F.lit(1), head).alias("_head")).distinct()
    begun = cells.withColumn("_head", F.substring("term", F.lit(1), head))
    cells = lookup(begun, heads, "_head", "left_semi").drop("_head")
    by_pattern = minimal.groupBy("pattern").agg(
        F.collect_set(F.struct("dict", "category")).alias("_hits")
    )
    starred = minimal.where(F.endswith("pattern", F.lit("*")))
    lengths = starred.agg(F.array_sort(F.collect_set(F.length("pattern") - 1))).scalar()
    stars = F.transform(
        F.filter("_lengths", lambda k: (k <= F.length("term")) & (k >= F.col("_from"))),
        lambda k: F.concat(F.substring("term", F.lit(1), k), F.lit("*")),
    )
    ready = cells.withColumns({"_lengths": lengths, "_from": last_word_start(F.col("term"))})
    tried = ready.select(
        *keys, "term", "n", F.explode(F.concat(F.array("term"), stars)).alias("pattern")
    )
    return lookup(tried, by_pattern, "pattern", "inner").select(
        *keys, "term", "n", F.inline("_hits")
    )


def lexicon_terms(text_col: str, lexicon: DataFrame, max_words: int) -> Column:
    """The words of a text and, for multi-word patterns, the n-grams that can match.

    Only n-grams that start like some pattern are built. With very many
    multi-word patterns all are, which gives the same matches.
    """
    single = words(text_col)
    if max_words == 1:
        return single
    several = lexicon.where(F.contains("pattern", F.lit("_")))
    starts = several.select(F.substring_index("pattern", "_", 1).alias("w")).distinct()
    found = [r["w"] for r in starts.limit(MAX_FIRST_WORDS + 1).collect()]
    if len(found) > MAX_FIRST_WORDS:
        return ngrams(single, 1, max_words)
    return F.concat(single, ngrams_starting(single, found, max_words))


def category_counts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    categories: Sequence[tuple[str, str]],
    max_words: int = 1,
    name=lambda d, c: f"{d}_{c}",
) -> DataFrame:
    """One count column per ``(dict, category)``; texts without a match keep zeros.

    ``max_words`` is the longest multi-word pattern. Every text brings one empty
    term along, which meets an empty pattern and so carries the text through the
    inner join, where all other unmatched terms stop.
    """
    anchor = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("n")))
    tokens = lexicon_terms(text_col, lexicon, max_words)
    counts = F.when(F.col(text_col).isNotNull(), count_runs(tokens))
    cells = df.select(id_col, F.inline(F.concat(anchor, F.coalesce(counts, anchor))))
    empty = lexicon.sparkSession.sql("SELECT '' AS dict, '' AS category, '' AS pattern")
    matched = match_patterns(cells, lexicon, [id_col], empty)
    sums = [
        F.expr(
            f"sum(CASE WHEN dict = {sql_list([d])} AND category = {sql_list([c])} THEN n ELSE 0 END)"
        ).alias(name(d, c))
        for d, c in categories
    ]
    return matched.groupBy(id_col).agg(*sums)


def profile_counts(text: Column) -> Column:
    """Word, sentence and punctuation counts of the dictionary profile, as one struct."""

    def held(chars: str) -> Column:
        return sum((count_of(text, ch) for ch in chars[1:]), count_of(text, chars[0]))

    def measure(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("WC"),
            sentence_count(text).alias("St"),
            F.size(F.filter(w, lambda t: F.length(t) > 6)).alias("Sixltr"),
            F.regexp_count(text, F.lit(r"\p{P}")).alias("AllPunc"),
            *[held(chars).alias(name) for name, chars in MARKS.items()],
        )

    return F.when(text.isNotNull(), bind(words(text), measure))


def profile_block(text_col: str) -> RowBlock:
    """The lexicon-free part of the profile: counts per 100 words."""
    p = F.col("_profile")
    listed = sum((p[name] for name in MARKS), F.lit(0))

    def percent(count: Column) -> Column:
        return ratio(100 * count, p["WC"])

    columns = [
        p["WC"].alias("WC"),
        F.when(p["WC"] > 0, ratio(p["WC"], p["St"])).alias("WPS"),
        percent(p["Sixltr"]).alias("Sixltr"),
        percent(p["AllPunc"]).alias("AllPunc"),
        *[percent(p[name]).alias(name) for name in MARKS],
        percent(p["AllPunc"] - listed).alias("OtherP"),
    ]
    return RowBlock({"_profile": profile_counts(F.col(text_col))}, columns)


def profile(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return select_blocks(df, [id_col], profile_block(text_col))


def with_any_category(lexicon: DataFrame, name: str) -> DataFrame:
    """Add a category that holds every pattern of one dictionary."""
    every = lexicon.where(F.col("dict") == name).withColumn("category", F.lit(ANY))
    return lexicon.unionByName(every)


def dictionary_profile(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    categories: Sequence[tuple[str, str]],
    max_words: int = 1,
) -> DataFrame:
    """The whole profile: shared columns once, then ``dict_category`` percentages.

    ``Dic`` is the share of words in any category of the first dictionary: one
    more category that holds all of its patterns.
    """
    first = categories[0][0]
    wanted = [*categories, (first, ANY)]
    hits = category_counts(
        df, id_col, text_col, with_any_category(lexicon, first), wanted, max_words
    )
    joined = profile(df, id_col, text_col).join(hits, id_col)
    percents = [
        ratio(100 * F.col(f"{d}_{c}"), F.col("WC")).alias("Dic" if c == ANY else f"{d}_{c}")
        for d, c in wanted
    ]
    return joined.select(id_col, *[c for c in PROFILE if c != "Dic"], *percents)


def emotion_counts(
    df: DataFrame, id_col: str, text_col: str, emotions: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Words per emotion category, one column each, from a ``(word, category)`` table."""
    lexicon = emotions.select(
        F.lit("nrc").alias("dict"), "category", F.col("word").alias("pattern")
    )
    return category_counts(
        df, id_col, text_col, lexicon, [("nrc", c) for c in categories], name=lambda d, c: f"nrc_{c}"
    )


def list_counts(
    df: DataFrame, id_col: str, text_col: str, words_table: DataFrame, listed: bool, name: str
) -> DataFrame:
    """Words on a list (profanity) or off it (spelling errors), per text."""
    table = words_table.select(F.col("word").alias("term")).distinct()
    marked = table.withColumn("_on", F.lit(True))
    tokens = F.when(F.col(text_col).isNotNull(), count_runs(words(text_col)))
    cells = df.select(id_col, F.inline_outer(tokens))
    hit = F.col("_on") if listed else F.col("_on").isNull() & F.col("term").isNotNull()
    return (
        lookup(cells, marked, "term", "left")
        .groupBy(id_col)
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name))
    )


# Lists and rules of the ratio block: sentiment, negativity, positivity per list.
RATIO_LISTS = ["GI", "HE", "LM", "QDAP"]


def ratio_columns() -> list[str]:
    names = ["WordCount"]
    for name in RATIO_LISTS:
        names += [f"Sentiment{name}", f"Negativity{name}", f"Positivity{name}"]
        if name == "LM":
            names.append("RatioUncertaintyLM")
    return names


def flag_table(lexicon: DataFrame, flags: Sequence[tuple[str, str]]) -> DataFrame:
    """Lexicon words as one row per term with a 0/1 column per ``(dict, category)``."""
    return lexicon.groupBy(F.col("pattern").alias("term")).agg(
        *[
            F.max(((F.col("dict") == d) & (F.col("category") == c)).cast("int")).alias(f"{d}_{c}")
            for d, c in flags
        ]
    )


def sentiment_ratios(
    df: DataFrame,
    id_col: str,
    text_cols: Sequence[str],
    lexicon: DataFrame,
    stopwords: Sequence[str],
    stem: bool = True,
    prefixes: Sequence[str] | None = None,
) -> DataFrame:
    """Positive, negative and uncertain shares of the words left after stop-word removal.

    With ``stem`` both the text and the lexicon words are stemmed first. All
    texts of a respondent go through one join and one aggregate.
    """
    prefixes = [f"{c}_" for c in text_cols] if prefixes is None else prefixes
    flags = [(d, c) for d in RATIO_LISTS for c in ("positive", "negative")] + [("LM", "uncertainty")]
    entries = lexicon.select("dict", "category", "pattern")
    if stem:
        entries = stem_column(entries, "pattern", "_stem").select(
            "dict", "category", F.col("_stem").alias("pattern")
        )
    table = flag_table(entries, flags)

    def counts(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), count_runs(words_without(c, list(stopwords))))

    fields = F.array(
        *[
            F.struct(F.lit(i).alias("field"), counts(c).alias("counts"))
            for i, c in enumerate(text_cols)
        ]
    )
    cells = df.select(id_col, F.inline(fields)).select(id_col, "field", F.inline_outer("counts"))
    if stem:
        cells = stem_column(cells, "term", "_stem").select(
            id_col, "field", F.col("_stem").alias("term"), "n"
        )
    found = lookup(cells, table, "term", "left")
    sums, out = [], []
    for i, prefix in enumerate(prefixes):
        sums.append(f"coalesce(sum(CASE WHEN field = {i} THEN n END), 0) AS w{i}")
        for d, c in flags:
            hit = f"CASE WHEN field = {i} AND {d}_{c} = 1 THEN n END"
            sums.append(f"coalesce(sum({hit}), 0) AS {d}_{c}_{i}")

        def share(count: str, name: str, i=i, prefix=prefix) -> str:
            return f"try_divide(CAST({count} AS DOUBLE), CAST(w{i} AS DOUBLE)) AS `{prefix}{name}`"

        out.append(f"w{i} AS `{prefix}WordCount`")
        for d in RATIO_LISTS:
            pos, neg = f"{d}_positive_{i}", f"{d}_negative_{i}"
            out.append(share(f"{pos} - {neg}", f"Sentiment{d}"))
            out.append(share(neg, f"Negativity{d}"))
            out.append(share(pos, f"Positivity{d}"))
            if d == "LM":
                out.append(share(f"LM_uncertainty_{i}", "RatioUncertaintyLM"))
    totals = found.groupBy(id_col).agg(*[F.expr(e) for e in sums])
    return totals.selectExpr(f"`{id_col}`", *out)
