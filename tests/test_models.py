import json

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from answerframe.functions.tokens import terms2, words
from answerframe.operators import linear_grid as lg
from answerframe.operators import metrics
from answerframe.operators import split as sp
from answerframe.operators import svd
from answerframe.operators import topics as tp
from answerframe.operators import tuning as tn
from answerframe.operators import vectors as vc
from answerframe.operators.svd import TfidfSvd
from answerframe.operators.grids import check_grids, expand, linspace_ints, logspace
from answerframe.plans import tuning_run


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 3)) * [1, 5, 0.3] + [10, 0, -4]
    Y = X @ rng.normal(size=(3, 2)) + rng.normal(size=(200, 2)) + 7
    return X, Y, np.arange(200) * 5 // 200


@pytest.fixture(scope="module")
def rows(spark, data):
    X, Y, fold = data
    table = [
        (i, int(fold[i]), *map(float, X[i]), *map(float, Y[i]), [float(x) for x in X[i]])
        for i in range(200)
    ]
    return spark.createDataFrame(
        table, "id long, fold int, a double, b double, c double, y double, z double, v array<double>"
    )


def test_folds_are_contiguous(spark):
    df = spark.range(23).repartition(5)
    got = sp.contiguous_folds(df, ["id"], 5).orderBy("id").collect()
    assert [r.fold for r in got] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    ranked = sp.positions(spark.range(1000).select((F.col("id") * 7).alias("id")), ["id"], 16)
    assert all(r.position == r.id // 7 for r in ranked.collect())
    assert sorted(r.id for r in sp.row_range(df, ["id"], 3, 6).collect()) == [3, 4, 5]


def test_positions_with_ties_and_nulls(spark):
    rows = [(None, i) for i in range(40)] + [(1, i) for i in range(300)] + [(i, 0) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = sp.positions(df, ["a", "b"], 7).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))



def test_native_and_array_moments_agree(rows):
    m = lg.moments(rows, ["a", "b", "c"], ["y", "z"])
    n = lg.moments(rows, "v", ["y", "z"])
    for k in [None, 0, 4]:
        for p, q in zip(
            lg._centred(*m.training(k), 3), lg._centred(*n.training(k), 3), strict=True
        ):
            if p.ndim == 2:
                assert np.allclose(p, q)


def test_moments_refuse_too_many_columns(rows):
    with pytest.raises(ValueError, match="limit"):
        lg.moments(rows, "v", ["y"], max_doubles=10)


def test_ridge_scores_against_refits(rows, data):
    X, Y, fold = data
    grid = expand({"alpha": [0.0, 1.0, 50.0]})
    got = lg.cv_scores(rows, lg.moments(rows, ["a", "b", "c"], ["y", "z"]), grid).collect()
    assert len(got) == 3 * 5 * 2
    for r in got:
        t = ["y", "z"].index(r.target)
        tr, te = fold != r.fold, fold == r.fold
        mx, my = X[tr].mean(axis=0), Y[tr, t].mean()
        A = X[tr] - mx
        w = np.linalg.solve(A.T @ A + grid[r.candidate]["alpha"] * np.eye(3), A.T @ (Y[tr, t] - my))
        e = Y[te, t] - my - (X[te] - mx) @ w
        assert r.mse == pytest.approx((e**2).mean(), rel=1e-9)
        assert r.r2 == pytest.approx(1 - (e**2).sum() / ((Y[te, t] - Y[te, t].mean()) ** 2).sum())


@pytest.mark.parametrize(("alpha", "ratio"), [(2.0, None), (0.3, 0.5), (0.1, 1.0), (0.5, 0.0)])
def test_solver_against_spark_regression(rows, data, alpha, ratio):
    _, Y, _ = data
    sd, n = Y[:, 0].std(), len(Y)
    if ratio is None:
        candidate, reg, mix = {"alpha": alpha}, alpha * sd / n, 0.0
    else:
        candidate = {"alpha": alpha, "l1_ratio": ratio}
        reg = alpha * ratio + alpha * (1 - ratio) * sd
        mix = alpha * ratio / reg
    m = lg.moments(rows.withColumn("fold", F.lit(0)), ["a", "b", "c"], ["y"])
    w = lg.solve(m, None, [candidate])[0][:, 0]
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    model = LinearRegression(
        labelCol="y", regParam=reg, elasticNetParam=mix, standardization=False, tol=1e-12, maxIter=500
    ).fit(vec)
    assert np.allclose(w, model.coefficients.toArray(), atol=1e-5)
    pred = rows.select(lg.linear_prediction(m, np.array([w]).T, ["a", "b", "c"], "y").alias("p"))
    want = [r.prediction for r in model.transform(vec).collect()]
    assert np.allclose([r.p for r in pred.collect()], want, atol=1e-3)


def test_grid_order_and_checks():
    assert expand({"b": [1, 2], "a": [3, 4]}) == [
        {"a": 3, "b": 1}, {"a": 3, "b": 2}, {"a": 4, "b": 1}, {"a": 4, "b": 2}
    ]
    assert linspace_ints(10, 110, 11, [None])[-2:] == [110, None]
    assert logspace(-2, 0, 3) == [0.01, 0.1, 1.0]
    with pytest.raises(ValueError, match="differ"):
        check_grids({"ridge": tn.Linear("ridge")}, {})
    with pytest.raises(ValueError, match="unknown"):
        check_grids({"ridge": tn.Linear("ridge")}, {"ridge": {"fit": [1]}})
    with pytest.raises(ValueError, match="lists"):
        check_grids({"ridge": tn.Linear("ridge")}, {"ridge": {"alpha": 1.0}})


def test_forest_candidates_collapse():
    forest = tn.Forest()
    got = forest.candidates(tuning_run.GRIDS["forest"])
    assert len(got) == 360 and {c["maxDepth"] for c in got} == {10, 20, 30}
    assert forest.ignored == {
        "min_samples_split": [2, 3, 4, 5, 6, 10, 12],
        "max_depth": [40, 50, 60, 70, 80, 90, 100, 110, None],
    }


def test_pick_weights_folds_and_breaks_ties():
    scores = [(0, 0, "y", 10, 0.5, 1.0), (0, 1, "y", 30, 0.1, 2.0)]
    scores += [(1, 0, "y", 10, 0.2, 1.0), (1, 1, "y", 30, 0.2, 2.0)]
    assert tn.pick(scores, "r2", False)["y"] == (0, pytest.approx(0.2))
    assert tn.pick(scores, "mse", False)["y"] == (0, pytest.approx(-1.75))
    scores += [(0, 0, "z", 10, -1.0, 1.0), (1, 0, "z", 10, 0.3, 1.0)]
    assert tn.pick(scores, "r2", True)["z"][0] == 1


def test_grid_search_reports_the_true_best(rows):
    train, holdout = rows.where("id < 150"), rows.where("id >= 150")
    search = tn.GridSearch(
        {"ridge": tn.Linear("ridge"), "elastic": tn.Linear("elastic"), "forest": tn.Forest()},
        {
            "ridge": {"alpha": [0.1, 1e6]},
            "elastic": {"alpha": [0.01, 10.0], "l1_ratio": [0.5]},
            "forest": {"n_estimators": [3], "max_depth": [3]},
        },
    )
    results = search.tune(train, holdout, ["a", "b", "c"], ["y", "z"], ["r2", "mse"]).collect()
    assert len(results) == 3 * 2 * 2
    assert {json.loads(r.params)["alpha"] for r in results if r.model == "ridge"} == {0.1}
    for best in search.best.collect():
        assert abs(best.r) == max(abs(r.r) for r in results if r.target == best.target)
    predictions = search.predict("id")
    assert predictions.count() == 100 and predictions.where("pred is null").count() == 0


def test_text_search_fits_inside_folds(spark):
    rows = [(i, f"good day w{i % 5} " * (i % 4 + 1) + "bad " * (i % 3), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, y double")
    df = df.withColumn("fold", F.floor(F.col("id") / 20).cast("int"))
    seen = []

    def prepare(fit, other):
        seen.append(sorted({r.fold for r in fit.select("fold").distinct().collect()}))
        pipe = TfidfSvd(terms2("text"), "id", k=2).fit(fit)
        return pipe.transform(fit), pipe.transform(other)

    search = tn.TextGridSearch({"ridge": tn.Linear("ridge")}, {"ridge": {"alpha": [0.1]}}, prepare)
    out = search.tune(df.where("id < 48"), df.where("id >= 48"), "text_features", ["y"]).collect()
    assert seen == [[1, 2], [0, 2], [0, 1], [0, 1, 2]]
    assert out[0].n_holdout == 12 and out[0].r is not None


def test_metrics_with_constant_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, pred double")
    r = metrics.scores(df, []).first()
    assert (r.n, r.r, r.r2, r.mse) == (2, None, 0.0, 1.0)


def test_svd_against_numpy(spark):
    texts = [f"aa bb cc{i % 4} dd{i % 7} " * (1 + i % 3) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    model = TfidfSvd(terms2("t"), "id", k=3).fit(df)
    tokens = [t.split() for t in texts]
    vocab = sorted({w for row in tokens for w in row})
    A = np.array([[row.count(w) for w in vocab] for row in tokens], dtype=float)
    A *= np.log(41 / (1 + (A > 0).sum(axis=0))) + 1
    A /= np.linalg.norm(A, axis=1, keepdims=True)
    U, s, _ = np.linalg.svd(A, full_matrices=False)
    assert np.allclose(model.singular_values, s[:3], atol=1e-8)
    got = np.array([r.text_features for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(U[:, :3] * s[:3]), atol=1e-5)


def test_svd_needs_few_passes_for_close_singular_values(spark):
    """Random texts have a flat spectrum, where powers of the matrix settle slowly."""
    rng = np.random.default_rng(3)
    words_ = [f"w{i}" for i in range(70)]
    texts = [" ".join(rng.choice(words_, 12)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    model = TfidfSvd(terms2("t"), "id", k=3, iterations=12, tolerance=0.0).fit(df)
    A = np.array([[t.split().count(w) for w in words_] for t in texts], dtype=float)
    A *= np.log(151 / (1 + (A > 0).sum(axis=0))) + 1
    A /= np.linalg.norm(A, axis=1, keepdims=True)
    assert np.allclose(model.singular_values, np.linalg.svd(A)[1][:3], atol=1e-8)


def test_svd_does_not_depend_on_parts(spark, monkeypatch):
    texts = [f"aa bb cc{i % 4} dd{i % 7} " * (1 + i % 3) + f"ee{i % 11}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = []
    for numbers, parts in ((8_000_000, 1), (200, 9)):
        monkeypatch.setattr(svd, "PART_NUMBERS", numbers)
        model = TfidfSvd(terms2("t"), "id", k=3, iterations=4).fit(df.repartition(parts))
        found.append(np.array([r.text_features for r in model.transform(df).orderBy("id").collect()]))
    assert np.allclose(found[0], found[1], atol=1e-6)


def test_svd_of_little(spark):
    """Rank below k, texts without a word, null texts, and no text at all."""
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb aa bb"), (3, ""), (4, None), (None, "aa bb")], "id long, t string")
    model = TfidfSvd(terms2("t"), "id", k=3).fit(df)
    assert np.allclose(model.singular_values, [3**0.5, 0, 0], atol=1e-6)
    got = {r.id: r.text_features for r in model.transform(df).collect()}
    assert len(got) == 5
    assert all(np.allclose(got[i], [1, 0, 0], atol=1e-6) for i in (1, 2, None))
    assert got[3] == got[4] == [0.0, 0.0, 0.0]
    unseen = spark.createDataFrame([(7, "zz")], "id long, t string")
    assert model.transform(unseen).first().text_features == [0.0, 0.0, 0.0]
    empty = TfidfSvd(terms2("t"), "id", k=2).fit(df.limit(0))
    assert empty.transform(df).first().text_features == [0.0, 0.0]


def test_term_target_corr_against_dense_columns(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.7, size=(30, 4))
    counts[:, 3] = 2
    y, z = rng.normal(1e6, 1, 30), rng.normal(size=30)
    z[:5] = np.nan
    cells = [(i, f"w{j}", int(counts[i, j])) for i in range(30) for j in range(4) if counts[i, j]]
    rows = [(i, float(y[i]), None if np.isnan(z[i]) else float(z[i]), 3.0) for i in range(30)]
    got = metrics.term_target_corr(
        spark.createDataFrame([*cells, (99, "w0", 50)], "id long, term string, n long"),
        spark.createDataFrame(rows, "id long, y double, z double, flat double"), "id", ["y", "z", "flat"],
    ).collect()
    assert len(got) == 12
    for r in got:
        j = int(r.term[1])
        side = {"y": y, "z": z}.get(r.target)
        if side is None or j == 3:
            assert r.r is None
            continue
        some = ~np.isnan(side)
        assert r.n == some.sum() and abs(r.r - np.corrcoef(counts[some, j], side[some])[0, 1]) < 1e-8


@pytest.mark.parametrize("hidden", [None, 4])
def test_head_gradient(hidden):
    rng = np.random.default_rng(1)
    head = vc.Head(5, hidden, 0.0)
    w = head.start(2, 3.0)
    X, y = rng.normal(size=(20, 5)), rng.uniform(1, 5, 20)

    def loss(v):
        return ((head.predict(v, X) - y) ** 2).mean()

    numeric = np.zeros_like(w)
    for i in range(len(w)):
        d = np.zeros_like(w)
        d[i] = 1e-6
        numeric[i] = (loss(w + d) - loss(w - d)) / 2e-6
    assert np.allclose(head.gradient(w, X, y, rng), numeric, atol=1e-5)


def test_embedding_head_learns(rows):
    head = vc.EmbeddingHead(dropout=0.0, rate=0.05)
    scaled = rows.withColumn(
        "v", F.array((F.col("a") - 10), F.col("b") / 5, (F.col("c") + 4) / 0.3)
    ).withColumn("y", F.col("y") + 40)
    search = tn.GridSearch({"neural": head}, {"neural": {"epochs": [2, 30], "batch_size": [8]}})
    out = search.tune(scaled, scaled, "v", ["y"]).first()
    assert json.loads(out.params)["epochs"] == 30 and out.r > 0.9


def test_encode_texts(spark):
    df = spark.createDataFrame([(1, "ab", None)], "id long, p string, q string")

    def lengths(batch):
        return np.column_stack([batch.str.len(), batch.str.len() * 2])

    row = vc.encode_texts(df, ["id"], ["p", "q"], lengths).first()
    assert row.embedding == [2.0, 4.0, 0.0, 0.0]


def plain_lda(texts, k, weights, iterations):
    """The same model with dense loops: counts of texts by terms, first weights by term."""
    counts = np.array(texts, float)
    for _ in range(iterations):
        topic = np.exp(tp.digamma(weights) - tp.digamma(weights.sum(axis=0)))
        new, shares, bound = np.full_like(weights, 1 / k), [], 0.0
        for row in counts:
            gamma = np.full(k, 1 / k + row.sum() / k)
            for turn in range(tp.INNER + 1):
                share = np.exp(tp.digamma(gamma) - tp.digamma(gamma.sum()))
                phi = share * topic / (share * topic).sum(axis=1)[:, None]
                if turn < tp.INNER:
                    gamma = 1 / k + row @ phi
            bound += (row * np.log((share * topic).sum(axis=1))).sum()
            shares.append(gamma / gamma.sum())
            new += row[:, None] * phi
        weights = new
    return weights, np.array(shares), bound


@pytest.mark.parametrize(("numbers", "cells"), [(1 << 23, 1 << 20), (40, 8)])
def test_topics_equal_dense_loops(spark, monkeypatch, numbers, cells):
    """Several fields and numbers of topics together, in one part and in many, against one plain model each."""
    monkeypatch.setattr(tp, "PART_NUMBERS", numbers)
    monkeypatch.setattr(tp, "CELLS", cells)
    rng = np.random.default_rng(1)
    vocabulary = {"a": [f"a{c}" for c in "uvwxyz"], "b": [f"b{c}" for c in "rstuvwxyz"]}
    counts = {f: rng.integers(0, 3, (14, len(v))) for f, v in vocabulary.items()}
    rows = [
        (i, f, " ".join(" ".join([w] * n) for w, n in zip(vocabulary[f], row, strict=True)))
        for f in counts
        for i, row in enumerate(counts[f].tolist())
    ]
    rows += [(99, "a", ""), (99, "b", "only here")]
    df = spark.createDataFrame(rows, "id long, field string, text string").repartition(3)
    models = tp.fit_topics(df, "id", words("text"), {"a": [2, 3], "b": [4]}, iterations=3, tolerance=0)
    got = {(r.id, r.field): np.array(r.shares) for r in models.shares().collect()}
    assert (got[99, "a"] == 0).all() and len(got[99, "a"]) == 5 and (got[99, "b"] == 0).all() and len(got) == 30
    hashes = {(r.f, r.t): r.h for r in spark.createDataFrame([(f, t) for f, v in vocabulary.items() for t in v], "f string, t string").select("f", "t", F.xxhash64("f", "t").alias("h")).collect()}
    for f, k, s, width in (("a", 2, slice(0, 2), 5), ("a", 3, slice(2, 5), 5), ("b", 4, slice(0, 4), 4)):
        first = np.array([tp.first_weights(tp.SEED, hashes[f, t], width)[s] for t in vocabulary[f]])
        weights, _, _ = plain_lda(counts[f], k, first, 3)
        _, shares, _ = plain_lda(counts[f], k, weights, 1)
        assert np.allclose([got[i, f][s] for i in range(14)], shares, atol=1e-9)
        unit = weights / weights.sum(axis=0)
        unit /= np.sqrt((unit**2).sum(axis=0))
        cosine = ((unit.T @ unit).sum() - k) / (k * (k - 1))
        found = [r for r in models.quality().collect() if (r.field, r.k) == (f, k)]
        assert len(found) == 1 and found[0].mean_cosine == pytest.approx(cosine)


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 3.7, 250.0])
    assert np.allclose(tp.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    step = 1e-6 * np.maximum(1, x)
    slope = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v, h in zip(x, step, strict=True)]
    assert np.allclose(tp.digamma(x), slope, rtol=1e-5, atol=1e-4)


def test_topics_part_texts_and_choose_k(spark):
    texts = ["apple pear plum"] * 10 + ["wheel brake motor"] * 10
    df = spark.createDataFrame([(i, "all_text", t) for i, t in enumerate(texts)], "id long, field string, text string")
    models = tp.fit_topics(df, "id", words("text"), {"all_text": [2]})
    shares = models.columns()
    assert shares.columns == ["id", "topic_1_all_text", "topic_2_all_text"]
    rows = {r.id: r for r in shares.collect()}
    assert all(r.topic_1_all_text + r.topic_2_all_text == pytest.approx(1) for r in rows.values())
    main = [rows[i].topic_1_all_text > 0.5 for i in range(20)]
    assert len(set(main[:10])) == len(set(main[10:])) == 1 and main[0] != main[10]
    bounds = [b[0] for b in models.bounds["all_text"]]
    assert bounds[-1] > bounds[0] and all(b > a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:], strict=False))
    several = tp.fit_topics(df, "id", words("text"), {"all_text": [2, 3, 4]}, iterations=5)
    chosen = tp.choose_k(several).collect()
    assert sorted(r.k for r in chosen) == [2, 3, 4]
    assert sum(r.best_likelihood for r in chosen) == 1 and sum(r.best_cosine for r in chosen) == 1
    assert max(chosen, key=lambda r: r.log_likelihood).best_likelihood
    none = tp.fit_topics(df.where("false"), "id", words("text"), {"all_text": [2]}, iterations=2)
    assert none.columns().collect() == []


def test_tuning_run_end_to_end(rows):
    df = rows.select(
        "id",
        F.when(F.col("id") % 4 < 2, "Train").when(F.col("id") % 4 == 2, "Dev").otherwise("Test").alias("Dataset"),
        "a",
        "b",
        "c",
        "v",
        F.col("y").alias("E_Scale_score"),
        F.col("z").alias("N_Scale_score"),
    )
    grids = {"ridge": {"alpha": [0.1, 1.0]}, "neural": {"epochs": [1], "batch_size": [32]}}
    out = tuning_run.run(df, "id", grids, folds=4, embedding="v")
    assert out.count() == 2 * 2 * 2
    table = tuning_run.hold_out_table(out, ["E_Scale_score", "N_Scale_score"])
    assert table.count() == 4 and "E_Scale_score" in table.columns


@pytest.mark.parametrize("shard_rows", [40, 4096])
def test_heads_do_not_depend_on_partitions(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vc, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(4)
    data = [(i % 3, [float(v) for v in rng.normal(size=4)], float(i % 5)) for i in range(150)]
    rows = spark.createDataFrame(data, "fold int, x array<double>, y double")
    head = vc.Head(4, 3, 0.2)
    one, many = (vc.train_heads(rows.repartition(n), head, [10], [2]) for n in (2, 9))
    assert one.keys() == many.keys()
    assert all(np.allclose(one[k], many[k], atol=1e-9) for k in one)


def test_topics_keep_one_state(spark):
    """A pass's state replaces the one before it on disk; the models can still be read."""
    from pathlib import Path
    from urllib.parse import urlparse

    from answerframe.session import checkpoint_folder

    folder = Path(urlparse(checkpoint_folder(spark)).path)
    df = spark.createDataFrame([(i, "all_text", "a b c a" if i % 2 else "d e f d") for i in range(8)], "id long, field string, text string")
    before = set(folder.glob("table-*"))
    models = tp.fit_topics(df, "id", words("text"), {"all_text": [2]}, iterations=6, tolerance=-1)
    # vocabulary, texts, routing and the last state
    assert len(set(folder.glob("table-*")) - before) == 4
    assert models.columns().count() == 8


def test_choose_k_trains_like_the_final_models(spark, monkeypatch):
    """The search for the number of topics leaves passes, tolerance and vocabulary as they are for the final models."""
    from answerframe.plans import model_catalog as mc

    calls = []

    def fit(*args, **settings):
        calls.append(settings)
        raise StopIteration

    monkeypatch.setattr(tp, "fit_topics", fit)
    for query in (mc.choose_k, mc.topic_shares):
        with pytest.raises(StopIteration):
            query(spark, "/root/testdata/sf0.001")
    assert not any({"iterations", "tolerance", "min_docfreq"} & set(c) for c in calls) and len(calls) == 2


def topic_rows(spark, n=24):
    rng = np.random.default_rng(8)
    pool = {"a": [f"a{c}" for c in "stuvwxyz"], "b": [f"b{c}" for c in "stuvwxyz"]}
    rows = [(i, f, " ".join(rng.choice(pool[f], 12 + i % 7))) for f in pool for i in range(n)]
    rows += [(99, "a", ""), (98, "b", "alone")]
    return spark.createDataFrame(rows, "id long, field string, text string").repartition(3)


@pytest.mark.parametrize(("numbers", "iterations", "tolerance"), [(1 << 22, 20, 2e-3), (60, 7, 0), (60, 20, 2e-2)])
def test_topics_in_tasks_equal_topics_in_parts(spark, monkeypatch, numbers, iterations, tolerance):
    """Models trained inside tasks and models whose state is a table, of one part and many: the same passes, bounds, shares and cosines."""
    ks = {"a": [2, 3, 5], "b": [4, 2]}
    found = []
    for local in (1 << 22, 0):
        monkeypatch.setattr(tp, "LOCAL_NUMBERS", local)
        monkeypatch.setattr(tp, "PART_NUMBERS", numbers)
        models = tp.fit_topics(topic_rows(spark), "id", words("text"), ks, iterations, tolerance)
        assert isinstance(models, tp.LocalModels) == bool(local)
        shares = {(r.id, r.field): r.shares for r in models.shares().collect()}
        quality = {(r.field, r.k): (r.log_likelihood, r.mean_cosine) for r in models.quality().collect()}
        found.append((models.bounds, shares, quality))
    (bounds, shares, quality), (bounds_2, shares_2, quality_2) = found
    assert all(np.allclose(bounds[f], bounds_2[f], rtol=1e-9) and len(bounds[f]) == len(bounds_2[f]) for f in ks)
    assert shares.keys() == shares_2.keys() and len(shares) == 50 and all(np.allclose(shares[x], shares_2[x], atol=1e-7) for x in shares)
    assert quality.keys() == quality_2.keys() and all(np.allclose(quality[x], quality_2[x], rtol=1e-7) for x in quality)


def test_search_for_topics_keeps_no_weights(spark):
    """The weights of many numbers of topics stay in the tasks: on disk are the texts, the vocabulary and a few numbers a model."""
    from pathlib import Path
    from urllib.parse import urlparse

    from answerframe.session import checkpoint_folder

    folder = Path(urlparse(checkpoint_folder(spark)).path)
    text = " ".join("abcdefghijklmnopqrstuvwxyz"[i // 26] + "abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(400))
    df = spark.createDataFrame([(i, "all_text", text) for i in range(4)], "id long, field string, text string")
    before = set(folder.glob("table-*"))
    models = tp.fit_topics(df, "id", words("text"), {"all_text": list(range(2, 40))}, iterations=2, shares=False)
    size = sum(f.stat().st_size for t in set(folder.glob("table-*")) - before for f in t.glob("*.parquet"))
    assert size < 400 * sum(range(2, 40)) * 8 / 10
    assert models.quality().count() == 38
    with pytest.raises(ValueError, match="without shares"):
        models.shares()


def test_models_are_dealt_evenly():
    ks, cells = {"a": list(range(2, 76)), "b": [3], "c": [5, 6]}, {"a": 9_000, "b": 400}
    groups = tp.deal_models(ks, cells, 12)
    assert sorted((f, m) for f, held in groups for m in held) == sorted((f, m) for f, k in ks.items() for m in range(len(k)))
    work = [sum(ks["a"][m] for m in held) for f, held in groups if f == "a"]
    assert len(work) == 12 and max(work) < 1.1 * min(work)


def test_svd_counts_a_text_once_for_all_folds(spark):
    """Counted texts give what plain ones give, and no call of fit or transform reads a text again."""
    texts = ["a1 b1 c1 b1", "b1 c1 d1", None, "d1 a1 a1", "", "zz c1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    plain = TfidfSvd(terms2("t"), "id", k=2).fit(df)
    want = {r.id: r.text_features for r in plain.transform(df).collect()}
    counted = TfidfSvd(terms2("t"), "id").counted(df.mapInArrow(seen, df.schema), "id")
    model = TfidfSvd(terms2("t"), "id", k=2).fit(counted)
    got = model.transform(counted)
    assert got.columns == ["id", "text_features"]
    rows = {r.id: r.text_features for r in got.collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[i], want[i], atol=1e-9) for i in want)
    assert TfidfSvd(terms2("t"), "id", k=2).fit(counted.where("id < 4")).transform(counted).count() == 6
    assert calls.value == 6
