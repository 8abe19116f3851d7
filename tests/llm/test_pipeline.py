import corpus_pipeline
import pytest
from answerframe.llm import linededup, packing, quality
from test_linededup import plain
from test_mixing import check as check_mix
from test_packing import check as check_pack
from test_resemblance import plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_names(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:5]:
        assert df.columns == COLUMNS and df.dtypes == stages[0].dtypes


def test_quality_stage_keeps_good_documents(spark, sf_small, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert set(stages[1].collect()) <= set(stages[0].collect())
    model = quality.fit(stages[0], spark.read.parquet(f"{sf_small}/labels.parquet"))
    want = {r.doc_id for r in quality.score(stages[0], model).where("keep").collect()}
    assert kept == want


def test_line_stage(stages):
    got = sorted((r.doc_id, r.text) for r in stages[2].collect())
    assert got == sorted((d, t) for d, t, _, _ in plain(pairs(stages[1]), 10))
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())
    assert linededup.line_key("  Ab ") == "ab"


def test_near_duplicate_stage(stages):
    groups = plain_groups(pairs(stages[2]))
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(groups.values()))


def test_mixing_stage(stages):
    from pyspark.sql import functions as F

    size = {r.doc_id: len(r.text.encode().split()) for r in stages[3].collect()}
    times = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert all(1 <= n <= 3 for n in times.values()) and set(times) <= set(size)
    from answerframe.llm import mixing

    plan = mixing.plan_sources(mixing.measured(stages[3]))
    taken = {r.source: r.s for r in stages[4].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("s")).collect()}
    largest = max(size.values())
    assert all(abs(taken.get(p["source"], 0) - p["target"]) <= largest for p in plan)
    assert check_mix is not None


def test_packing_stage(stages):
    padding, total = check_pack(stages[5].collect(), pairs(stages[4]))
    assert padding <= 0.005 * total and packing.TOKENS == 1024


def test_run(spark, sf_small, stages):
    assert corpus_pipeline.run(spark, sf_small).count() == stages[5].count()


def test_odd_documents(spark, sf_small, stored_odd_docs, tmp_path):
    """Nulls, repeated rows and clashing columns pass through every stage."""
    docs = stored_odd_docs
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_small)
        if k < 4:
            assert df.columns == names
        df.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() >= 1


def test_empty_documents(spark, sf_small, edge_docs, tmp_path):
    docs = edge_docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
