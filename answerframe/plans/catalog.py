"""The registered text queries, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readability as rd
from ..functions import text as tx
from ..functions.stem import stem_column
from ..functions.text import ANSWERS
from ..functions.tokens import corpus_tokens, terms2, words
from ..operators import columns as cl
from ..operators import diversity as dv
from ..operators import lexicon as lx
from ..operators import sentiment as sn
from ..operators import split as sp
from ..operators import terms as tm
from ..operators.metrics import feature_target_corr as correlate
from ..operators.metrics import safe_corr
from ..session import checkpoint
from ..sources.tables import EXACT, QUOTING, submission
from . import wordlists as wl
from .features import Lists, build_features, document_terms
from .stand_ins import answers, documents, labelled_split, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CATEGORIES = list(dict.fromkeys((d, c) for d, c, _, _ in wl.DICTIONARIES))
MAX_WORDS = max(p.count("_") + 1 for _, _, p, _ in wl.DICTIONARIES)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, nudge: float = 1e-9) -> DataFrame:
    """Round double columns so both engines print the same digits.

    The nudge settles exact decimal ties the same way in both.
    """
    return df.selectExpr(
        *[
            f"round(`{c}` + {nudge!r}D, {digits}) + 0.0D AS `{c}`" if kind == "double" else f"`{c}`"
            for c, kind in df.dtypes
        ]
    )


def dictionaries(spark: SparkSession) -> DataFrame:
    return wl.table(spark, wl.DICTIONARIES, ["dict", "category", "pattern", "weight"])


@query
def concat_answers_skip_null(spark, sf):
    return answers(spark, sf).select("respondent_id", tx.concat_skip_null(*ANSWERS).alias("all_text"))


@query
def concat_answers_propagate(spark, sf):
    return answers(spark, sf).select("respondent_id", tx.concat_propagate(*ANSWERS).alias("full_text"))


@query
def unpivot_answers(spark, sf):
    rows = tm.answer_rows(answers(spark, sf), "respondent_id", ANSWERS)
    return rows.select("respondent_id", "field", "text")


@query
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_text("text").alias("clean_text"))


@query
def strip_symbols_digits(spark, sf):
    steps = [tx.strip_symbols, tx.strip_digits, F.lower]
    return documents(spark, sf).select("doc_id", tx.apply_chain("text", steps).alias("stripped"))


@query
def corpus_token_filter(spark, sf):
    df = documents(spark, sf).select("doc_id", corpus_tokens("text").alias("w"))
    return df.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def token_counts(spark, sf):
    df = documents(spark, sf).select("doc_id", F.length("text").alias("n_chars"), words("text").alias("w"))
    out = df.select("doc_id", "n_chars", F.size("w").alias("n_tokens"))
    return rounded(out.withColumn("char_per_word", tx.ratio(F.col("n_chars"), F.col("n_tokens"))))


@query
def char_per_word(spark, sf):
    return rounded(dv.answer_ratios(answers(spark, sf), "respondent_id", ANSWERS))


@query
def word_counts(spark, sf):
    return tm.word_counts(documents(spark, sf), "doc_id", "text")


@query
def ngram_counts_1_5(spark, sf):
    grams = tm.ngram_counts(documents(spark, sf), "doc_id", "text", 1, 5)
    # a token holds no underscore, so the separators give the order
    order = (tx.count_of(F.col("term"), "_") + 1).alias("ngram_order")
    return grams.groupBy("doc_id", order).agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_total"), F.max("n").alias("n_max")
    )


@query
def ngram_docfreq_trim(spark, sf):
    grams = tm.ngram_counts(documents(spark, sf), "doc_id", "text", 1, 5, windows=True)
    return tm.trim_docfreq(tm.vocabulary(grams, min_docfreq=2), 2)


@query
def docfreq_trim(spark, sf):
    return tm.trim_docfreq(tm.vocabulary(tm.word_counts(documents(spark, sf), "doc_id", "text")), 2)


@query
def vocab_prune(spark, sf):
    docs = documents(spark, sf)
    vocab = tm.vocabulary(tm.word_counts(docs, "doc_id", "text"))
    return rounded(tm.prune_vocabulary(vocab, docs))


@query
def stopword_filter(spark, sf):
    cells = tm.word_counts(documents(spark, sf), "doc_id", "text")
    return tm.drop_listed(cells, wl.table(spark, wl.STOPWORDS, ["term"]))


@query
def keep_pruned_terms(spark, sf):
    docs = documents(spark, sf)
    cells = tm.word_counts(docs, "doc_id", "text")
    kept = tm.prune_vocabulary(tm.vocabulary(cells), docs)
    return tm.keep_vocabulary(cells, kept).select("doc_id", "term", "n")


def cells_of(rows, vocab, id_col, prefix="", by=()):
    """Sparse rows back as (id, by…, term, value), through the vocabulary's numbers."""
    pairs = F.arrays_zip(F.col(f"{prefix}indices").alias("term_index"), F.col(f"{prefix}values").alias("value"))
    long = rows.select(id_col, F.inline(pairs))
    return long.join(vocab.select("term_index", *by, "term"), "term_index").drop("term_index")


@query
def dtm_sparse(spark, sf):
    """Document-term vectors of the pruned vocabulary, read back from the sparse rows."""
    docs = documents(spark, sf)
    cells = tm.word_counts(docs, "doc_id", "text")
    vocab = checkpoint(tm.number_terms(tm.prune_vocabulary(tm.vocabulary(cells), docs)))
    return cells_of(tm.sparse_rows(cells, vocab, "doc_id"), vocab, "doc_id")


@query
def dtm_wide(spark, sf):
    """One column for each of the fifty terms of the pruned vocabulary that most documents have, named by rank."""
    docs = documents(spark, sf)
    vocab = tm.prune_vocabulary(tm.vocabulary(tm.word_counts(docs, "doc_id", "text")), docs)
    top = vocab.orderBy(F.col("doc_count").desc(), "term").limit(50).collect()
    wide = tm.wide_counts(docs, "doc_id", words("text"), [r["term"] for r in top], "all_")
    wide = wide.toDF("doc_id", *[f"all_{k}" for k in range(1, len(top) + 1)])
    return wide.select("*", *[F.lit(None).cast("long").alias(f"all_{k}") for k in range(len(top) + 1, 51)])


@query
def tfidf_log10(spark, sf):
    docs = documents(spark, sf)
    return rounded(tm.tfidf_log10(tm.word_counts(docs, "doc_id", "text"), docs))


@query
def tfidf_smooth_l2(spark, sf):
    docs = documents(spark, sf)
    cells = tm.term_counts(docs, ["doc_id"], terms2("text"))
    return rounded(tm.tfidf_smooth_l2(cells, docs, "doc_id"))


@query
def top_terms(spark, sf):
    """Ten heaviest 1–2-grams of every text under the smoothed weighting."""
    docs = documents(spark, sf)
    cells = tm.gram_counts(docs, ["doc_id"], terms2("text"), 1, 2, " ")
    weights = tm.tfidf_smooth_l2(cells, docs, "doc_id")
    # ties are decided on the printed digits, so both engines agree
    weights = weights.withColumn("tfidf", F.round(F.col("tfidf") + 1e-9, 6))
    return tm.top_terms(weights, "doc_id", "tfidf", 10).select("doc_id", "term", "n", "tfidf", "rank")


@query
def nzv_terms(spark, sf):
    docs = documents(spark, sf)
    return rounded(tm.near_zero_variance(tm.word_counts(docs, "doc_id", "text"), docs))


@query
def readability_counts(spark, sf):
    return rd.readability(
        documents(spark, sf), "doc_id", "text", wl.EASY_WORDS, measures={}, counts=True
    )


@query
def readability_corpus(spark, sf):
    return rounded(
        rd.readability(documents(spark, sf), "doc_id", "text", wl.EASY_WORDS)
    )


@query
def readability_scores(spark, sf):
    return rounded(
        rd.readability(documents(spark, sf), "doc_id", "text", wl.EASY_WORDS, rd.SCORE_MEASURES),
    )


@query
def readability_by_answer(spark, sf):
    return rounded(rd.answer_readability(answers(spark, sf), "respondent_id", ANSWERS))


@query
def lexdiv_counts(spark, sf):
    return rounded(dv.lexical_diversity(documents(spark, sf), "doc_id", "text"))


@query
def lexdiv_weighted(spark, sf):
    return rounded(dv.weighted_diversity(answers(spark, sf), "respondent_id", ANSWERS))


@query
def liwc_profile(spark, sf):
    return rounded(lx.profile(documents(spark, sf), "doc_id", "text"))


@query
def dictionary_profile(spark, sf):
    return rounded(
        lx.dictionary_profile(
            documents(spark, sf), "doc_id", "text", dictionaries(spark), CATEGORIES, MAX_WORDS
        )
    )


@query
def lexicon_wildcard(spark, sf):
    """Matches of single-word patterns, prefixes included, by category over all texts."""
    lexicon = dictionaries(spark).where(~F.contains("pattern", F.lit("_")))
    cells = tm.word_counts(documents(spark, sf), "doc_id", "text")
    found = lx.match_patterns(cells, lexicon, ["doc_id"])
    return found.groupBy("dict", "category", "term").agg(
        F.sum("n").alias("n"), F.count("*").alias("doc_count")
    )


@query
def lexicon_multiword(spark, sf):
    """Matches of multi-word patterns, through the n-gram counts."""
    lexicon = dictionaries(spark).where(F.contains("pattern", F.lit("_")))
    cells = tm.ngram_counts(documents(spark, sf), "doc_id", "text", 2, MAX_WORDS)
    found = lx.match_patterns(cells, lexicon, ["doc_id"])
    return found.groupBy("doc_id", "dict", "category").agg(F.sum("n").alias("n"))


@query
def emotion_counts(spark, sf):
    emotions = wl.table(spark, wl.EMOTIONS, ["word", "category"])
    return lx.emotion_counts(
        documents(spark, sf), "doc_id", "text", emotions, wl.EMOTION_CATEGORIES
    )


def ratio_lexicon(spark):
    return wl.table(spark, wl.RATIO_LEXICON, ["dict", "category", "pattern"])


@query
def sentiment_ratios(spark, sf):
    return rounded(
        lx.sentiment_ratios(
            documents(spark, sf), "doc_id", ["text"], ratio_lexicon(spark), wl.STOPWORDS, False, [""]
        )
    )


@query
def sentiment_ratios_stemmed(spark, sf):
    return rounded(
        lx.sentiment_ratios(
            documents(spark, sf), "doc_id", ["text"], ratio_lexicon(spark), wl.STOPWORDS, True, [""]
        )
    )


@query
def sentiment_ratios_by_answer(spark, sf):
    return rounded(
        lx.sentiment_ratios(
            answers(spark, sf),
            "respondent_id",
            ANSWERS,
            ratio_lexicon(spark),
            wl.STOPWORDS,
            False,
            [f"q{i}_" for i in range(1, 6)],
        )
    )


def valence(spark):
    return (
        wl.table(spark, wl.POLARITY, ["word", "weight"]),
        wl.table(spark, wl.SHIFTERS, ["word", "kind"]),
    )


@query
def sentiment_shifters(spark, sf):
    docs = documents(spark, sf)
    return rounded(sn.shifter_sentiment(docs, "doc_id", ["text"], *valence(spark), ["sent_all_text"]))


@query
def sentiment_by_answer(spark, sf):
    names = [f"sent{i}" for i in range(1, 6)]
    return rounded(
        sn.shifter_sentiment(answers(spark, sf), "respondent_id", ANSWERS, *valence(spark), names)
    )


@query
def spelling_errors(spark, sf):
    known = wl.table(spark, wl.SPELLING, ["word"])
    return lx.list_counts(documents(spark, sf), "doc_id", "text", known, False, "errors")


@query
def profanity_count(spark, sf):
    listed = wl.table(spark, wl.PROFANITY, ["word"])
    return lx.list_counts(documents(spark, sf), "doc_id", "text", listed, True, "profanity")


@query
def stem_vocab(spark, sf):
    vocab = tm.vocabulary(tm.word_counts(documents(spark, sf), "doc_id", "text"))
    return stem_column(vocab.select("term", "term_count"), "term")


@query
def dtm_stemmed(spark, sf):
    """Stemmed counts after dropping symbols and digits."""
    docs = documents(spark, sf)
    plain = tx.apply_chain("text", [tx.strip_symbols, tx.strip_digits, F.lower])
    tokens = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
    return tm.stem_counts(docs, ["doc_id"], tokens)


@query
def submission_layout(spark, sf):
    """Every hold-out document once, predictions beside it or blank."""
    holdout = sp.part(labelled_split(read(spark, sf, "documents")), "Dev", "Test")
    template = holdout.select(F.col("doc_id").alias("Respondent_ID"))
    scores = read(spark, sf, "labels")
    long = scores.select(
        F.col("doc_id").alias("Respondent_ID"),
        F.inline(
            F.array(
                F.struct(F.lit("E").alias("trait"), F.col("quality").cast("double").alias("pred")),
                F.struct(F.lit("N").alias("trait"), F.col("toxic").cast("double").alias("pred")),
            )
        ),
    )
    return submission(template, long)


@query
def csv_round_trip(spark, sf):
    """Texts written as quoted CSV records and read back: quotes, line breaks, null and empty text survive."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    options = {k: v for k, v in {**QUOTING, **EXACT, "quoteAll": "true"}.items() if k != "header"}
    written = turns.select(F.to_csv(F.struct("*"), options).alias("record"))
    schema = ", ".join(f"{c} {kind}" for c, kind in turns.dtypes)
    return written.select(F.inline(F.array(F.from_csv("record", schema, options))))


@query
def split_filter(spark, sf):
    docs = labelled_split(read(spark, sf, "documents"))
    train = sp.part(docs, "Train").groupBy("Dataset", "lang")
    holdout = sp.part(docs, "Dev", "Test").groupBy("Dataset", "lang")
    return cl.stack(train.agg(F.count("*").alias("n")), holdout.agg(F.count("*").alias("n")))


@query
def split_by_position(spark, sf):
    """Every document's place in file order."""
    docs = read(spark, sf, "documents").select("doc_id")
    return sp.positions(docs, ["doc_id"])


@query
def split_slices(spark, sf):
    """The slice form of the split: the first 60 % of the documents, the next 20 %, the rest."""
    docs = read(spark, sf, "documents").select("doc_id")
    n = docs.count()
    ends = [0, n * 3 // 5, n * 4 // 5, n]
    parts = [
        sp.row_range(docs, ["doc_id"], a, b).withColumn("Dataset", F.lit(name))
        for name, a, b in zip(["Train", "Dev", "Test"], ends, ends[1:], strict=False)
    ]
    return cl.stack(*parts)


@query
def kfold_contiguous(spark, sf):
    return sp.contiguous_folds(read(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


def sample_lists(spark) -> Lists:
    polarity, shifters = valence(spark)
    return Lists(
        dictionaries=dictionaries(spark),
        categories=CATEGORIES,
        emotions=wl.table(spark, wl.EMOTIONS, ["word", "category"]),
        emotion_categories=wl.EMOTION_CATEGORIES,
        ratio_lexicon=ratio_lexicon(spark),
        polarity=polarity,
        shifters=shifters,
        spelling=wl.table(spark, wl.SPELLING, ["word"]),
        profanity=wl.table(spark, wl.PROFANITY, ["word"]),
        easy_words=wl.EASY_WORDS,
        stopwords=wl.STOPWORDS,
        max_words=MAX_WORDS,
    )


@query
def assemble_features(spark, sf):
    """The wide table: all families of all respondents, joined by key."""
    df = answers(spark, sf)
    return rounded(build_features(df, "respondent_id", sample_lists(spark)))


@query
def dtm_by_field(spark, sf):
    """Sparse counts of all six texts, each field with its own pruned vocabulary."""
    df = answers(spark, sf).withColumn("all_text", tx.concat_skip_null(*ANSWERS))
    rows, vocab = document_terms(df, "respondent_id", [*ANSWERS, "all_text"])
    return cells_of(rows, vocab, "respondent_id", "dtm_", ["field"])


@query
def lemma_counts(spark, sf):
    cells = tm.word_counts(documents(spark, sf), "doc_id", "text")
    return tm.lemmatise(cells, wl.table(spark, wl.LEMMAS, ["term", "lemma"]))


@query
def feature_target_corr(spark, sf):
    """Pearson r of every readability measure with every target, one pass."""
    docs = documents(spark, sf)
    features = rd.readability(docs, "doc_id", "text", wl.EASY_WORDS)
    targets = read(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double")
    )
    joined = features.join(targets, "doc_id")
    return rounded(correlate(joined, list(rd.CORPUS_MEASURES), ["quality", "toxic"]), 4)


@query
def readability_quality(spark, sf):
    """Flagship: readability of the labelled documents against quality, by language."""
    docs = documents(spark, sf)
    scored = rd.readability(
        docs, "doc_id", "text", wl.EASY_WORDS, {"flesch_kincaid": rd.flesch_kincaid}, counts=True
    )
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("double"))
    joined = docs.select("doc_id", "lang").join(scored, "doc_id").join(labels, "doc_id")
    return rounded(
        joined.groupBy("lang").agg(
            F.count("*").alias("n"),
            F.avg("word_count").alias("avg_words"),
            F.avg("sentence_count").alias("avg_sentences"),
            F.avg("flesch_kincaid").alias("avg_grade"),
            safe_corr("flesch_kincaid", "quality").alias("r_quality"),
        ),
        4,
    )
