import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerframe.functions import readability as rd
from answerframe.functions import text as tx
from answerframe.functions import tokens as tk
from answerframe.functions.stem import stem_column, stem_word
from answerframe.operators import diversity as dv
from answerframe.operators import terms as tm

ANSWER_ROWS = [
    (1, "I am not happy.", None, None, None, None),
    (2, "", "Fine", None, None, None),
    (3, None, None, None, None, None),
]
SCHEMA = "id long, " + ", ".join(f"{c} string" for c in tx.ANSWERS)


def one(spark, text, make):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(make(F.col("t")).alias("x")).first()["x"]


def test_null_rules(spark):
    df = spark.createDataFrame(ANSWER_ROWS, SCHEMA)
    rows = df.select(
        "id",
        tx.concat_skip_null(*tx.ANSWERS).alias("skip"),
        tx.concat_propagate(*tx.ANSWERS).alias("prop"),
    ).orderBy("id")
    assert [(r.skip, r.prop) for r in rows.collect()] == [
        ("I am not happy.", None),
        (" Fine", None),
        ("", None),
    ]


def test_clean_text_splits_at_accents(spark):
    assert one(spark, "Élève naïve café", tx.clean_text) == "l ve na ve caf"
    assert one(spark, "Élève naïve café", tk.words) == ["élève", "naïve", "café"]


def test_strip_chain(spark):
    steps = [tx.strip_symbols, tx.strip_digits, F.lower]
    assert one(spark, "It's 42, été_x!", lambda c: tx.apply_chain(c, steps)) == "its  été_x"


def test_general_tokens(spark):
    text = "See https://x.io/a?b=1 now: abc1 123 $5 don't!"
    assert one(spark, text, tk.corpus_tokens) == ["see", "https://x.io/a?b=1", "now", "abc1", "don't"]
    kept = one(spark, "a 1 $ .", lambda c: tk.corpus_tokens(c, True, False, False, False))
    assert kept == ["a", "1", "$", "."]
    assert one(spark, text, lambda c: tk.corpus_tokens(c, remove_url=True))[1] == "now"


@pytest.mark.parametrize(
    ("text", "grams"),
    [
        ("one", ["one"]),
        ("", []),
        ("a b c", ["a", "b", "c", "a_b", "b_c", "a_b_c"]),
    ],
)
def test_ngrams(spark, text, grams):
    assert one(spark, text, lambda c: tk.ngrams(tk.words(c), 1, 5)) == grams


def test_ngrams_of_high_order_only(spark):
    assert one(spark, "a b c", lambda c: tk.ngrams(tk.words(c), 2, 3)) == ["a_b", "b_c", "a_b_c"]
    assert one(spark, "a b a c", lambda c: tk.ngrams_starting(tk.words(c), ["a"], 3)) == [
        "a_b",
        "a_c",
        "a_b_a",
    ]
    assert one(spark, "a", lambda c: tk.ngrams_starting(tk.words(c), ["a"], 3)) == []


def test_count_runs(spark):
    got = one(spark, "b a b b c", lambda c: tk.count_runs(tk.words(c)))
    assert [(r.term, r.n) for r in got] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, "...", lambda c: tk.count_runs(tk.words(c))) == []


# Pairs published with the algorithm.
STEMS = """caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|bled bled
motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|falling fall
hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat
conditional condit|rational ration|digitizer digit|vietnamization vietnam|operator oper
feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal
sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electrical electr
goodness good|revival reviv|allowance allow|inference infer|gyroscopic gyroscop|adjustable adjust
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog
bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll
generalizations gener|oscillators oscil"""


def test_porter_stems(spark):
    pairs = [p.split() for p in STEMS.replace("\n", "|").split("|")]
    df = spark.createDataFrame([(w,) for w, _ in pairs], "w string")
    got = {r.w: r.stem for r in stem_column(df, "w").collect()}
    assert got == dict(pairs)


def test_stem_of_one_word_equals_the_column(spark):
    parts = "a y e b st ll ed ing eed ies sses ss s ational ement ion ou ble iz at x é İ _ ! xx".split()
    made = {a + b + c for a in parts for b in parts for c in parts} | {p.split()[0] for p in STEMS.replace("\n", "|").split("|")}
    df = stem_column(spark.createDataFrame([(w,) for w in sorted(made)], "w string"), "w")
    assert [(r.w, stem_word(r.w)) for r in df.collect() if stem_word(r.w) != r.stem] == []


def test_stemmed_counts_stem_each_word_once(spark):
    """Texts in one row, over several rows of an id, empty and null; a word met before is not stemmed again."""
    rows = [(1, "cats cat sat cats"), (1, "cat"), (2, ""), (3, None), (None, "sats sat")]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    got = tm.stem_counts(df, ["id"], F.filter(F.split("t", " "), lambda t: t != "")).collect()
    assert {(r.id, r.stem, r.n) for r in got} == {(1, "cat", 4), (1, "sat", 1), (None, "sat", 2)} and len(got) == 3
    met, known = [], {}
    for _ in range(2):
        out = tm._reworded(pa.array(["cats", "sat", "cats"], pa.large_string()), lambda w: met.append(w) or stem_word(w), known)
        assert out.to_pylist() == ["cat", "sat", "cat"]
    assert met == ["cats", "sat"]


def test_stem_survives_a_filter_and_a_join(spark):
    df = stem_column(spark.createDataFrame([("motoring",), ("sky",)], "w string"), "w")
    other = spark.createDataFrame([("motor", 1)], "stem string, hit int")
    assert df.where("stem is not null").join(other, "stem").first()["w"] == "motoring"


def test_readability_by_hand(spark):
    df = spark.createDataFrame([(1, "The cat sat. A banana fell!")], "id long, t string")
    r = rd.readability(df, "id", "t", ["the", "a"], counts=True).first()
    # words 6, sentences 2, syllables the1 cat1 sat1 a1 banana3 fell1 = 8
    assert (r.syllables_count, r.word_count, r.sentence_count, r.difficult_count) == (8, 6, 2, 1)
    assert r.meanSentenceLength == 3
    assert r.Flesch_Kincaid == pytest.approx(0.39 * 3 + 11.8 * 8 / 6 - 15.59)
    assert r.FOG == pytest.approx(0.4 * (3 + 100 / 6))
    assert r.SMOG == pytest.approx(1.043 * (30 * 1 / 2) ** 0.5 + 3.1291)
    assert r.Dale_Chall_old == pytest.approx(15.79 * 4 / 6 + 0.0496 * 3 + 3.6365)
    # the cat sat a banana fell: tile values 6 5 3 1 8 7 over 20 letters
    assert r.Scrabble == pytest.approx(30 / 20)


def test_readability_without_words(spark):
    df = spark.createDataFrame([(1, "!!! ... ???"), (2, None)], "id long, t string")
    first, second = rd.readability(df, "id", "t", [], counts=True).orderBy("id").collect()
    assert (first.word_count, first.sentence_count) == (0, 3)
    assert first.Flesch_Kincaid is None and first.SMOG is None and first.Strain is None
    assert second.word_count is None


def test_linsear_uses_its_sample(spark):
    text = "  banana" + " cat" * 99 + ". " + "banana " * 50
    df = spark.createDataFrame([(1, text)], "id long, t string")
    r = rd.readability(df, "id", "t", [], rd.SCORE_MEASURES).first()
    assert r.linsear_write_score == pytest.approx((3 + 99) / 1 / 2)


def test_diversity(spark):
    rows = [(1, "the the the the"), (2, "one"), (3, ""), (4, "a b a c")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in dv.lexical_diversity(df, "id", "t").collect()}
    assert (got[1].lex_div_C, got[1].lex_div_R, got[1].lex_div_D) == (0.0, 0.5, 1.0)
    assert got[2].lex_div_C is None and got[3].lex_div_R is None
    assert got[4].lex_div_D == pytest.approx(2 / 12)


def test_map_only_plans_have_no_shuffle(spark):
    df = spark.range(10).select("id", F.lit("Some text. More text!").alias("t"))
    for out in [rd.readability(df, "id", "t", ["some"]), dv.lexical_diversity(df, "id", "t")]:
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_map_only_families_run_on_a_stream(spark, tmp_path):
    rows = [(1, "The cat sat."), (2, "One. Two.")]
    df = spark.createDataFrame(rows, "id long, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scored = rd.readability(stream, "id", "t", [], counts=True)
    query = scored.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.word_count for r in spark.table("scored").collect()} == {1: 3, 2: 2}
