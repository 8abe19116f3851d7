"""The registered model queries: grids, forests, topics and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import readability as rd
from ..functions.text import ANSWERS, concat_skip_null
from ..functions.tokens import ngrams, terms2, without, words
from ..operators import diversity as dv
from ..operators import metrics
from ..operators import split as sp
from ..operators import terms as tm
from ..operators import topics as tp
from ..operators import vectors as vc
from ..operators.grids import expand, linspace_ints
from ..operators.linear_free import FreeSearch, sparse_rows, term_rows
from ..operators.linear_grid import cv_scores, moments
from ..operators.svd import TfidfSvd
from ..operators.tuning import Forest, GridSearch, Linear, TextGridSearch
from ..session import checkpoint, written
from ..sources.tables import TARGETS
from . import wordlists as wl
from .catalog import query
from .stand_ins import answers, documents, labelled_split, read
from .tuning_run import ALPHAS, GRIDS, L1_RATIOS, hold_out_table, run

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_discount"]
LINE_TARGETS = ["l_extendedprice", "l_tax"]


def line_folds(spark, sf):
    lines = read(spark, sf, "lineitem").select(*LINE_ORDER, "l_quantity", "l_discount", *LINE_TARGETS)
    return sp.contiguous_folds(lines, LINE_ORDER, 10)


def grid_means(scores, grid, names):
    """Fold-size weighted mean scores per candidate and target."""
    total = F.sum("n")
    means = scores.groupBy("candidate", "target").agg(
        (F.sum(F.col("n") * F.col("r2")) / total).alias("cv_r2"),
        (-F.sum(F.col("n") * F.col("mse")) / total).alias("cv_neg_mse"),
    )
    lookup = {n: F.array(*[F.lit(float(c[n])) for c in grid]) for n in names}
    return means.select(
        *[F.get(lookup[n], F.col("candidate")).alias(n) for n in names],
        "target",
        "cv_r2",
        F.col("cv_neg_mse"),
    )


@query
def ridge_grid(spark, sf):
    """15 alphas × 10 contiguous folds × 2 targets, from one pass of sums."""
    df = line_folds(spark, sf)
    grid = expand({"alpha": ALPHAS})
    means = grid_means(cv_scores(df, moments(df, LINE_FEATURES, LINE_TARGETS), grid), grid, ["alpha"])
    return means.select("alpha", "target", F.round("cv_r2", 7).alias("cv_r2"), relative("cv_neg_mse"))


@query
def ridge_free(spark, sf):
    """The same search without cross products."""
    search = FreeSearch(sparse_rows(line_folds(spark, sf), LINE_FEATURES, LINE_TARGETS), len(LINE_FEATURES), LINE_TARGETS)
    grid = expand({"alpha": ALPHAS})
    means = grid_means(search.cv_scores(grid), grid, ["alpha"])
    search.close()
    return means.select("alpha", "target", F.round("cv_r2", 7).alias("cv_r2"), relative("cv_neg_mse"))


def relative(name, digits=7):
    """Ten significant digits are plenty for a sum of squares of any size."""
    return F.round(F.log(-F.col(name)), digits).alias("cv_log_mse")


@query
def elastic_grid(spark, sf):
    """15 alphas × 13 mixing ratios × 10 folds × 2 targets."""
    df = line_folds(spark, sf)
    grid = expand({"alpha": ALPHAS, "l1_ratio": L1_RATIOS})
    scores = cv_scores(df, moments(df, LINE_FEATURES, LINE_TARGETS), grid)
    means = grid_means(scores, grid, ["alpha", "l1_ratio"])
    return means.select(
        "alpha", "l1_ratio", "target", F.round("cv_r2", 6).alias("cv_r2"), relative("cv_neg_mse", 6)
    )


@query
def elastic_one_feature(spark, sf):
    """The whole elastic grid on one feature, where the solution is a soft threshold."""
    df = line_folds(spark, sf)
    grid = expand({"alpha": ALPHAS, "l1_ratio": L1_RATIOS})
    scores = cv_scores(df, moments(df, ["l_quantity"], ["l_extendedprice"]), grid)
    means = grid_means(scores, grid, ["alpha", "l1_ratio"])
    return means.select(
        "alpha", "l1_ratio", "target", F.round("cv_r2", 7).alias("cv_r2"), relative("cv_neg_mse")
    )


@query
def holdout_metrics(spark, sf):
    """n, r, R² and MSE of a price guess per return flag."""
    lines = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("target"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("pred"),
    )
    s = metrics.scores(lines, ["target"])
    return s.select(
        "target", "n", F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"), F.round("mse", 0).alias("mse")
    )


def embedding_rows(spark, sf):
    rows = read(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.col("label").cast("double").alias("label")
    )
    return sp.hash_folds(rows, "vec_id", 3)


def embedding_split(spark, sf):
    """Hold-out by a hash of the key, folds by another."""
    rows = embedding_rows(spark, sf)
    held = F.pmod(F.xxhash64("vec_id", F.lit("holdout")), F.lit(4)) == 0
    return rows.where(~held), rows.where(held)


@query
def forest_cv(spark, sf):
    """A small forest grid by folds; depths over the limit collapse into one candidate."""
    train, holdout = embedding_split(spark, sf)
    grid = {
        "n_estimators": [8],
        "max_depth": [4, *linspace_ints(40, 110, 2), None],
        "max_features": ["sqrt"],
        "min_samples_split": [2, 4],
    }
    search = GridSearch({"forest": Forest()}, {"forest": grid})
    return search.tune(train, holdout, "embedding", ["label"], ["r2", "mse"])


@query
def model_zoo_best(spark, sf):
    """Four model families on one target; the best by |r| on the hold-out rows."""
    train, holdout = embedding_split(spark, sf)
    models = {
        "ridge": Linear("ridge"),
        "elastic": Linear("elastic"),
        "forest": Forest(),
        "neural": vc.EmbeddingHead(dropout=0.2, rate=0.01),
    }
    grids = {
        "ridge": {"alpha": ALPHAS},
        "elastic": {"alpha": [0.0, 0.05, 0.1, 1.0], "l1_ratio": [0.0, 0.5, 1.0]},
        "forest": {"n_estimators": [8], "max_depth": [4]},
        "neural": {"epochs": [2, 4], "batch_size": [10, 32]},
    }
    search = GridSearch(models, grids)
    search.tune(train, holdout, "embedding", ["label"])
    return search.best


@query
def embedding_head(spark, sf):
    """The neural grid alone, with a hidden layer."""
    train, holdout = embedding_split(spark, sf)
    search = GridSearch(
        {"neural": vc.EmbeddingHead(dropout=0.2, hidden=16, rate=0.01)},
        {"neural": {"epochs": [3], "batch_size": [32]}},
    )
    search.tune(train, holdout, "embedding", ["label"])
    return search.predict("vec_id")


def labelled_documents(spark, sf):
    labels = read(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double")
    )
    return labelled_split(documents(spark, sf)).join(labels, "doc_id").select(
        "doc_id", "Dataset", "text", "quality", "toxic"
    )


@query
def term_target_corr(spark, sf):
    """r of every word of the labelled documents with both labels."""
    rows = labelled_documents(spark, sf)
    cells = tm.word_counts(rows, "doc_id", "text")
    found = metrics.term_target_corr(cells, rows, "doc_id", ["quality", "toxic"])
    return found.select("term", "target", "n", F.round("r", 6).alias("r"))


def term_search(spark, sf, grid, names):
    """Cross-validated scores over every word of two labelled documents or more, texts of length 1, without word × word sums."""
    texts = checkpoint(sp.hash_folds(labelled_documents(spark, sf), "doc_id", 3))
    cells = written(tm.word_counts(texts, "doc_id", "text"))
    vocab = checkpoint(tm.number_terms(tm.trim_docfreq(tm.vocabulary(cells))))
    targets = ["quality", "toxic"]
    search = FreeSearch(term_rows(cells, vocab, texts, "doc_id", targets, unit=True), vocab.count(), targets)
    scores = search.cv_scores(grid)
    search.close()
    means = grid_means(scores, grid, names)
    return means.select(*names, "target", F.round("cv_r2", 6).alias("cv_r2"), relative("cv_neg_mse", 6))


@query
def term_ridge(spark, sf):
    """14 alphas × 3 folds × 2 labels over word counts of length 1; alpha 0 would only interpolate, with fewer texts than words."""
    return term_search(spark, sf, expand({"alpha": ALPHAS[1:]}), ["alpha"])


@query
def tfidf_svd_search(spark, sf):
    """TF-IDF → SVD → ridge, the text part refitted inside every fold."""
    rows = sp.hash_folds(labelled_documents(spark, sf), "doc_id", 3)
    rows = TfidfSvd(terms2("text"), "doc_id").counted(rows, "doc_id", "Dataset", "fold", "quality", "toxic")
    train, holdout = sp.part(rows, "Train"), sp.part(rows, "Dev", "Test")

    def prepare(fit, other):
        pipeline = TfidfSvd(terms2("text"), "doc_id", k=4, min_df=2).fit(fit)
        return pipeline.transform(fit), pipeline.transform(other)

    search = TextGridSearch({"ridge": Linear("ridge")}, {"ridge": {"alpha": [0.1, 1.0, 10.0]}}, prepare)
    return search.tune(train, holdout, "text_features", ["quality", "toxic"])


@query
def svd_features(spark, sf):
    docs = documents(spark, sf)
    return TfidfSvd(terms2("text"), "doc_id", k=3, min_df=2).fit(docs).transform(docs).select(
        "doc_id", *[F.col("text_features")[i].alias(f"svd_{i + 1}") for i in range(3)]
    )


@query
def svd_spectrum(spark, sf):
    """The three largest singular values of all documents, and the squared length of each component over the documents."""
    docs = documents(spark, sf)
    model = TfidfSvd(terms2("text"), "doc_id", k=3, min_df=2, tolerance=1e-10).fit(docs)
    squares = [F.sum(F.pow(F.col("text_features")[j], 2)) for j in range(3)]
    rows = [F.struct(F.lit(j + 1).alias("component"), F.lit(float(s)).alias("sigma"), q.alias("energy")) for j, (s, q) in enumerate(zip(model.singular_values, squares, strict=True))]
    found = model.transform(docs).agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return found.select("component", F.round("sigma", 4).alias("sigma"), F.round("energy", 3).alias("energy"))


@query
def doc_vectors(spark, sf):
    """Mean word vectors after ten epochs; words of fewer than five occurrences have none."""
    return vc.word_vectors(
        documents(spark, sf), "doc_id", words("text"), size=16, epochs=10, min_count=5
    )


def topic_tokens(text):
    return ngrams(without(words(text), wl.STOPWORDS), 1, 5)


def six_texts(spark, sf):
    """``respondent_id, field, text`` of the five answers and their concatenation; a null answer is an empty text."""
    df = answers(spark, sf).withColumn("all_text", concat_skip_null(*ANSWERS))
    pairs = [F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("text")) for f in tp.TOPICS]
    return df.select("respondent_id", F.inline(F.array(*pairs)))


def six_topics(spark, sf):
    """The models of all six texts with the published numbers of topics."""
    ks = {f: [k] for f, k in tp.TOPICS.items()}
    return tp.fit_topics(six_texts(spark, sf), "respondent_id", topic_tokens("text"), ks)


@query
def lda_topics(spark, sf):
    """Topics of all six texts, with the published numbers of topics.

    Shown per respondent and text: how many shares it has, how many are null or outside 0 to 1, their sum (0 for a text
    without a term that occurs in two texts), and whether training has raised the model's bound.
    """
    models = six_topics(spark, sf)
    learned = {f: bool(b[-1][0] > b[0][0]) for f, b in models.bounds.items()}
    shares = F.col("shares")
    wrong = lambda x: x.isNull() | ~x.between(0, 1)
    return models.shares().select(
        "respondent_id",
        "field",
        F.size(shares).alias("n_topics"),
        F.size(F.filter(shares, wrong)).alias("n_wrong"),
        F.round(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.element_at(F.create_map(*[F.lit(x) for kv in learned.items() for x in kv]), F.col("field")).alias("learned"),
    )


@query
def topic_shares(spark, sf):
    """The 260 topic columns of every respondent."""
    return six_topics(spark, sf).columns()


@query
def choose_k(spark, sf):
    """Every number of topics from 2 to 75 on all six texts: 444 models in one run, each trained like a final one.

    Shown per model: whether its bound and its topics' mean cosine are numbers in their ranges, and how many of its text's
    models are marked as best by either.
    """
    ks = {f: list(tp.CHOICES) for f in tp.TOPICS}
    models = tp.fit_topics(six_texts(spark, sf), "respondent_id", topic_tokens("text"), ks, shares=False)
    of_text = Window.partitionBy("field")
    return tp.choose_k(models).select(
        "field",
        "k",
        (F.col("log_likelihood") < 0).alias("has_bound"),
        F.col("mean_cosine").between(0, 1).alias("has_cosine"),
        F.sum(F.col("best_likelihood").cast("int")).over(of_text).alias("n_best_likelihood"),
        F.sum(F.col("best_cosine").cast("int")).over(of_text).alias("n_best_cosine"),
    )


def tuning_features(spark, sf):
    """Readability counts of the labelled documents, five targets and the split label."""
    docs = labelled_documents(spark, sf)
    counts = rd.readability(docs, "doc_id", "text", wl.EASY_WORDS, measures={}, counts=True)
    diversity = dv.lexical_diversity(docs, "doc_id", "text")
    names = dict(zip(["lex_div_R", "lex_div_C", "lex_div_D"], ["O", "C", "N"], strict=True))
    targets = diversity.select(
        "doc_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{t}_Scale_score") for c, t in names.items()]
    )
    labels = docs.select(
        "doc_id", "Dataset", F.col("quality").alias("E_Scale_score"), F.col("toxic").alias("A_Scale_score")
    )
    return labels.join(counts, "doc_id").join(targets, "doc_id")


@query
def tuning_run(spark, sf):
    """Stored features to hold-out results: both linear grids, both scorings, five targets, one shared candidate."""
    grids = {name: GRIDS[name] for name in ("ridge", "elastic")}
    return run(checkpoint(tuning_features(spark, sf)), "doc_id", grids)


@query
def hold_out_correlations(spark, sf):
    """The tuning run as the table of one row per model and scoring."""
    return hold_out_table(tuning_run(spark, sf), TARGETS)
