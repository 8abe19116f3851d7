import random

import numpy as np
import pytest
from answerframe.llm import quality, toxicity
from answerframe.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def area(score, label):
    """Probability that a positive row has the higher score."""
    a, b = score[label == 1], score[label == 0]
    return np.mean([(a > x).mean() + 0.5 * (a == x).mean() for x in b])


@pytest.fixture(scope="module")
def pages(spark, make):
    """Clean and toxic pages; the other marks of toxic pages are beginnings of ever new words."""
    rng = random.Random(3)
    syllables = "ba de fi go lu ma ne pi ro su ta ve".split()
    word = lambda n=3: "".join(rng.choice(syllables) for _ in range(rng.randint(1, n)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "xqz" + word()]))
        poor = i % 7 == 0
        text = " ".join(w + "%%%" if poor else w for w in words)
        rows.append((i, text, "en", "bad" if poor else f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, int(not poor), int(toxic)))
    truth = {i: (int(i % 7 != 0), int(i % 6 == 0)) for i in range(600)}
    return make(rows, 4), spark.createDataFrame(labels, LABELS), truth


def test_toxic_pages_are_found(pages):
    docs, labels, truth = pages
    out = toxicity.predict(docs, toxicity.fit(docs, labels)).collect()
    score = np.array([r.severity for r in out])
    toxic = np.array([truth[r.doc_id][1] for r in out])
    assert area(score, toxic) > 0.97
    assert np.mean([r.toxic for r in out if not truth[r.doc_id][1]]) < 0.02
    assert len({r.grade for r in out}) >= 3 and all(0 <= r.severity <= 3 for r in out)


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(0)
    n, w = 4000, np.array([0.0, 1.0, 2.0, -1.0])
    x = rng.random((n, 4)) < 0.5
    y = np.searchsorted([0.5, 2.0, 3.0], x @ w + rng.logistic(size=n))
    rows, marks = np.nonzero(x)
    weights, theta = toxicity.fit_ordinal(rows, marks, 4, y, 3)
    assert np.abs(weights - w).max() < 0.3 and np.abs(theta - [0.5, 2.0, 3.0]).max() < 0.4
    assert (np.diff(theta) > 0).all()


def test_given_grades_are_used(spark, pages):
    docs, labels, _ = pages
    graded = labels.selectExpr("doc_id", "toxic * 5 as grade")
    model = toxicity.fit(docs, graded)
    assert model.grades == 5 and model.probabilities(np.array([0.0, 9.0])).shape == (2, 6)


def test_quality_by_two_views(pages):
    docs, labels, truth = pages
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    good = np.array([truth[r.doc_id][0] for r in out])
    for name in ("p_text", "p_meta", "quality_score"):
        assert area(np.array([r[name] for r in out]), good) > 0.97, name
    kept = np.array([r.keep for r in out])
    assert kept[good == 1].mean() > 0.99 and kept[good == 0].mean() < 0.1


def test_views_teach_each_other():
    """A view without labels of its own kind of rows learns them from the other one."""
    rng = np.random.default_rng(1)
    n = 1200
    y = (rng.random(n) < 0.5).astype(int)
    labelled = np.arange(n) < 160
    held = labelled & (np.arange(n) % 4 == 0)
    one = quality.View(np.arange(n), y * 1 + 2 * (rng.random(n) < 0.02), np.ones(n), n, 4)
    # in the labelled rows the second view is always column 0: it cannot tell them apart
    other = quality.View(np.arange(n), np.where(labelled, 0, 1 + y), np.ones(n), n, 4)
    given = np.where(labelled, y, -1)
    quality.co_train(one, other, given, np.full((n, 2), -1), held)
    sure = one.scores()
    taught = np.stack([np.full(n, -1), np.where(labelled, -1, (sure > 0).astype(int))], axis=1)
    quality.co_train(one, other, given, taught, held)
    assert other.weights[2] > other.weights[1] + 0.5


def test_sure_rows_come_from_all_documents(spark, pages, monkeypatch):
    """Pseudo-labels are the smallest hashes among all unlabelled rows that a view is sure of, not a sample's."""
    from pyspark.sql import functions as F

    docs, labels, _ = pages
    monkeypatch.setattr(quality, "PSEUDO", 7)
    monkeypatch.setattr(quality, "FIRST_SLICE", 20)
    monkeypatch.setattr(quality, "lower_share", lambda bound, total: -(2**63) + (bound << 64) // total)
    model = quality.fit(docs, labels, rounds=0)
    rows = docs.select("doc_id", "text", "lang", "source")
    got = {(r.doc_id, r.by_meta, r.by_text) for r in quality.sure_rows(rows, model, labels).collect()}
    given = {r.doc_id for r in labels.collect()}
    limit = np.log(quality.SURE / (1 - quality.SURE))
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(23)).alias("h")).collect()}
    want = {}
    odds = {r.doc_id: model.log_odds(r.text, r.lang, r.source) for r in docs.collect() if r.doc_id not in given}
    for place, view in ((0, 1), (1, 0)):
        for label in (0, 1):
            sure = [d for d, o in odds.items() if (o[view] >= limit if label else o[view] <= -limit)]
            for d in sorted(sure, key=order.get)[:7]:
                want.setdefault(d, [-1, -1])[place] = label
    assert got == {(d, *m) for d, m in want.items()} and len(got) >= 7


def test_query_results(spark, some_docs, sf_small):
    n = some_docs.count()
    assert QUERIES["op1_toxicity"](spark, sf_small).count() == n
    rows = QUERIES["op9_quality"](spark, sf_small).collect()
    assert len(rows) == n and all(0 <= r.quality_score <= 1 for r in rows)


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_edges_clashing_columns_and_no_labels(spark, odd_docs, edge_docs, pages, name):
    docs, labels, _ = pages
    odd_labels = labels.select("*", labels.toxic.alias("given"), labels.quality.alias("QUALITY"), labels.toxic.alias("TOXIC"))
    if name == "toxicity":
        model = toxicity.fit(docs, odd_labels)
        assert toxicity.predict(odd_docs, model).count() == 9
        assert toxicity.predict(edge_docs.where("false"), model).collect() == []
        none = toxicity.fit(edge_docs, labels.where("false"))
        assert {r.grade for r in toxicity.predict(edge_docs, none).collect()} == {0}
        assert toxicity.fit(docs, labels).marks == model.marks
    else:
        model = quality.fit(docs, odd_labels)
        out = quality.score(odd_docs, model)
        assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.count() == 9
        assert quality.score(edge_docs.where("false"), model).collect() == []
        none = quality.fit(edge_docs, labels.where("false"))
        assert all(r.keep for r in quality.score(edge_docs, none).collect())
