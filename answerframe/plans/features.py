"""The wide feature table: every family, keyed by respondent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import readability as rd
from ..functions.rows import select_blocks
from ..functions.text import ANSWERS, concat_skip_null, ratio
from ..functions.tokens import words
from ..operators import columns as cl
from ..operators import diversity as dv
from ..operators import lexicon as lx
from ..operators import sentiment as sn
from ..operators import terms as tm


@dataclass
class Lists:
    """The user's lexicons and word lists."""

    dictionaries: DataFrame  # dict, category, pattern
    categories: Sequence[tuple[str, str]]
    emotions: DataFrame  # word, category
    emotion_categories: Sequence[str]
    ratio_lexicon: DataFrame  # dict, category, pattern
    polarity: DataFrame  # word, weight
    shifters: DataFrame  # word, kind
    spelling: DataFrame  # word
    profanity: DataFrame  # word
    easy_words: Sequence[str]
    stopwords: Sequence[str]
    max_words: int = 1


@dataclass
class Options:
    answers: Sequence[str] = field(default_factory=lambda: list(ANSWERS))
    stem: bool = True
    ngrams: int = 5
    weighted_diversity: bool = True


def dictionary_names(categories: Sequence[tuple[str, str]]) -> list[str]:
    """``dict_category``, numbered where dictionaries share a category name."""
    return cl.make_unique([f"dict_{c}" for _, c in categories])


def lexicon_block(df: DataFrame, id_col: str, text_col: str, lists: Lists) -> DataFrame:
    """Dictionary, emotion, spelling and profanity counts from a single pass."""

    def as_dict(table: DataFrame, name: str, category) -> DataFrame:
        return table.select(F.lit(name).alias("dict"), category, F.col("word").alias("pattern"))

    def whole(name: str):
        return F.lit(name).alias("category")

    first = lists.categories[0][0]
    lexicon = lx.with_any_category(lists.dictionaries.select("dict", "category", "pattern"), first)
    for table, name, category in [
        (lists.emotions, "(emotion)", F.col("category")),
        (lists.spelling, "(known)", whole("word")),
        (lists.profanity, "(profane)", whole("word")),
    ]:
        lexicon = lexicon.unionByName(as_dict(table, name, category))
    names = dict(zip(lists.categories, dictionary_names(lists.categories), strict=True))
    names[first, lx.ANY] = "dict_Dic"
    names |= {("(emotion)", c): f"nrc_{c}" for c in lists.emotion_categories}
    names |= {("(known)", "word"): "_known", ("(profane)", "word"): "profanity"}
    return lx.category_counts(
        df, id_col, text_col, lexicon, list(names), lists.max_words, lambda d, c: names[d, c]
    )


def build_features(
    df: DataFrame, id_col: str, lists: Lists, options: Options | None = None, *extra: DataFrame
) -> DataFrame:
    """Features of every respondent; ``extra`` blocks (topics, vectors) are joined by key.

    Everything that looks only at its own row is one projection. Each lexicon
    family is one aggregate whose small rows are already partitioned by the key,
    so the joins at the end move little and respondents are never dropped.
    """
    opt = options or Options()
    answers = list(opt.answers)
    base = df.withColumn("all_text", concat_skip_null(*answers))
    texts = [*answers, "all_text"]
    rows = select_blocks(
        base,
        base.columns,
        rd.readability_block("all_text", lists.easy_words),
        rd.answer_block(answers),
        dv.ratio_block(answers),
        lx.profile_block("all_text"),
    )
    rows = rows.withColumnsRenamed({c: f"dict_{c}" for c in lx.PROFILE if c != "Dic"})
    ratio_names = [*[f"q{i}_" for i in range(1, len(answers) + 1)], "all_"]
    sent_names = [*[f"sent{i}" for i in range(1, len(answers) + 1)], "sent_all_text"]
    diversity = (
        dv.weighted_diversity(base, id_col, answers, opt.ngrams)
        if opt.weighted_diversity
        else dv.lexical_diversity(base, id_col, "all_text")
    )
    joined = cl.join_features(
        id_col,
        rows,
        lexicon_block(base, id_col, "all_text", lists),
        lx.sentiment_ratios(
            base, id_col, texts, lists.ratio_lexicon, lists.stopwords, opt.stem, ratio_names
        ),
        sn.shifter_sentiment(base, id_col, texts, lists.polarity, lists.shifters, sent_names),
        diversity,
        *extra,
    )
    wc = F.col("dict_WC")
    percents = {
        c: ratio(100 * F.col(c), wc) for c in ["dict_Dic", *dictionary_names(lists.categories)]
    }
    return joined.withColumns(percents | {"errors": wc - F.col("_known")}).drop("_known")


def document_terms(
    df: DataFrame,
    id_col: str,
    text_cols: Sequence[str],
    term_count_min: int = 25,
    doc_proportion_max: float = 0.90,
) -> tuple[DataFrame, DataFrame]:
    """Pruned document-term counts of all texts as one sparse row per respondent.

    Returns ``(id, dtm_indices, dtm_values)`` and the vocabulary ``(field, term,
    term_index, …)``. Long rows stay sparse; nothing is made wide.
    """
    texts = tm.answer_rows(df, id_col, text_cols)
    cells = tm.term_counts(texts, [id_col, "field"], words("text"))
    vocab = tm.prune_vocabulary(
        tm.vocabulary(cells, ["field"]), df, term_count_min, doc_proportion_max
    )
    numbered = tm.number_terms(vocab, ["field"])
    rows = tm.sparse_rows(cells, numbered, id_col, by=["field"])
    return rows.withColumnsRenamed({"indices": "dtm_indices", "values": "dtm_values"}), numbered
