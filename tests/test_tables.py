import pytest
from pyspark.sql import functions as F

from answerframe.functions.text import ANSWERS
from answerframe.operators import columns as cl
from answerframe.plans import catalog
from answerframe.plans.extraction import FeatureExtraction
from answerframe.plans.features import build_features, document_terms
from answerframe.plans.wordlists import EASY_WORDS
from answerframe.sources import tables as tb

HARD = 'Line one,"quoted"\nline two'


def test_responses_from_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    head = ["Dataset", "Respondent_ID", *ANSWERS, *tb.TARGETS]
    body = ["Train", "12345678901", '"Line one,""quoted""\nline two"', "NA", '""', "x", "y"]
    path.write_text(",".join(head) + "\n" + ",".join([*body, "3.5", "1", "2", "NA", "5"]) + "\n")
    r = tb.read_responses(spark, str(path)).first()
    assert (r.Respondent_ID, r.Dataset, r.open_ended_1) == (12345678901, "Train", HARD)
    assert r.open_ended_2 is None and r.open_ended_3 == ""
    assert (r.E_Scale_score, r.C_Scale_score) == (3.5, None)
    with pytest.raises(ValueError, match="missing"):
        tb.read_csv(spark, str(path), tb.T.StructType([tb.T.StructField("nope", tb.T.StringType())]))


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, HARD, 0.5, [1.0]), (2, "", None, [2.0]), (3, None, 1.5, [3.0])],
        "id long, t string, x double, v array<double>",
    )
    tb.write_features(df, str(tmp_path / "p"))
    assert sorted(tb.read_features(spark, str(tmp_path / "p")).collect()) == sorted(df.collect())
    tb.write_features(df, str(tmp_path / "c"), "csv")
    back = tb.read_features(spark, str(tmp_path / "c"), ["id", "t", "x"], "csv")
    want = {1: (HARD, 0.5), 2: ("", None), 3: (None, 1.5)}
    assert {r.id: (r.t, r.x) for r in back.collect()} == want
    nested = tb.read_features(spark, str(tmp_path / "c"), ["id", "v"], "csv")
    assert {r.id: r.v for r in nested.collect()} == {1: "[1.0]", 2: "[2.0]", 3: "[3.0]"}


def test_questions_and_submission(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("A,C,E,N,O\nask a,ask c,ask e,ask n,ask o\n")
    got = {r.trait: r.question for r in tb.read_questions(spark, str(path)).collect()}
    assert got == {t: f"ask {t.lower()}" for t in "ACENO"}
    template = spark.createDataFrame([(1,), (2,)], "Respondent_ID long")
    long = spark.createDataFrame([(1, "E", 3.0), (9, "E", 1.0)], "Respondent_ID long, trait string, pred double")
    out = tb.submission(template, long).orderBy("Respondent_ID")
    assert out.columns == ["Respondent_ID", "E_Pred", "A_Pred", "O_Pred", "C_Pred", "N_Pred"]
    assert [r.E_Pred for r in out.collect()] == [3.0, None]


def test_column_helpers(spark):
    assert cl.make_unique(["x", "y", "x", "x_1", "x"]) == ["x", "y", "x_2", "x_1", "x_3"]
    df = spark.createDataFrame([(1, 2.0, "a", 3.0)], "id long, f double, s string, E_Scale_score double")
    assert cl.matching(df, "_Scale_score") == ["E_Scale_score"]
    assert cl.numeric_features(df, ["id"]) == ["f"]
    assert cl.without_columns(df, ["f", "absent"]).columns == ["id", "s", "E_Scale_score"]
    assert cl.rename(df, lambda c: "p_" + c, keep=["id"]).columns[1] == "p_f"
    assert cl.stack(df.select("id"), df.select("id", "f")).where("f is null").count() == 1


def test_every_respondent_keeps_a_row(spark):
    rows = [
        (1, "I am not happy. The idiot!", None, "thing", None, None),
        (2, "", "Fine", None, None, None),
        (3, None, None, None, None, None),
        (4, "!!! ... ???", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in ANSWERS))
    out = build_features(df, "id", catalog.sample_lists(spark))
    got = {r.id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].nrc_anger, got[1].profanity, got[1].dict_WC) == (1, 1, 7)
    assert got[3].all_text == "" and got[3].dict_WC == 0 and got[3].errors == 0
    assert got[3].sent_all_text == 0 and got[3].Flesch_Kincaid is None
    dtm, vocab = document_terms(df, "id", ANSWERS, 1, 0.9)
    assert vocab.count() == vocab.select("term_index").distinct().count()
    assert {r.id for r in dtm.collect()} == {1, 2}


def test_feature_extraction_object(spark):
    df = spark.createDataFrame([(1, "The cats sat. Cats sit!"), (2, "A dog ran")], "id long, t string")
    fx = FeatureExtraction(
        df, "id", "t", {"bag_of_word": {"top": 2}, "readability": {"easy_words": EASY_WORDS}}
    )
    assert fx.bag_of_word().groupBy("id").count().where(F.col("count") > 2).count() == 0
    assert {(r.stem, r.n) for r in fx.dtm().where("id = 1").collect()} == {
        ("the", 1), ("cat", 2), ("sat", 1), ("sit", 1)
    }
    assert fx.readability().count() == 2 and fx.lexical_diversity().count() == 2
