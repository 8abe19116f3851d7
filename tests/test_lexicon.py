import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from answerframe.functions.tokens import ngrams, words
from answerframe.operators import joins
from answerframe.operators import lexicon as lx
from answerframe.operators import sentiment as sn
from answerframe.operators import terms as tm
from answerframe.plans import wordlists as wl


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "id long, t string")


def lexicon(spark, *rows):
    return spark.createDataFrame(list(rows), "dict string, category string, pattern string")


def test_prefix_counts_in_every_category_once(spark):
    df = texts(spark, "abandoned abandons", "", None, "ab abandon")
    lex = lexicon(
        spark,
        ("d", "loss", "abandon*"),
        ("d", "act", "abandon*"),
        ("d", "act", "aban*"),
        ("d", "act", "abandoned"),
        ("d", "act", "ab"),
    )
    got = lx.category_counts(df, "id", "t", lex, [("d", "loss"), ("d", "act")]).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 2), (2, 0, 0), (3, 0, 0), (4, 1, 2)]


def test_multiword_and_star_scope(spark):
    df = texts(spark, "give up the ship", "giveaway up", "give upward")
    lex = lexicon(spark, ("d", "quit", "give_up*"), ("d", "gift", "give*"))
    got = lx.category_counts(df, "id", "t", lex, [("d", "quit"), ("d", "gift")], 2).orderBy("id")
    # a star never reaches into the next word
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1), (2, 0, 1), (3, 1, 1)]


def test_many_first_words_give_the_same(spark, monkeypatch):
    df = texts(spark, "give up the ship give up", "up the")
    lex = lexicon(spark, ("d", "x", "give_up"), ("d", "x", "up_the"), ("d", "x", "the"))
    a = lx.category_counts(df, "id", "t", lex, [("d", "x")], 2).orderBy("id").collect()
    monkeypatch.setattr(lx, "MAX_FIRST_WORDS", 1)
    b = lx.category_counts(df, "id", "t", lex, [("d", "x")], 2).orderBy("id").collect()
    assert a == b and [r[1] for r in a] == [4, 2]


def test_profile_of_punctuation_only(spark):
    r = lx.profile(texts(spark, "!!! ... ???"), "id", "t").first()
    assert r.WC == 0 and r.AllPunc is None and r.WPS is None
    r = lx.profile(texts(spark, 'Hi, you! (yes) "x" - ok;'), "id", "t").first()
    assert (r.Comma, r.Exclam, r.Parenth, r.Quote, r.Dash, r.SemiC) == (20, 20, 40, 40, 20, 20)


def test_list_counts(spark):
    df = texts(spark, "dog dgo cat dgo", "", None)
    table = spark.createDataFrame([("dog",), ("cat",), ("dog",)], "word string")
    off = lx.list_counts(df, "id", "t", table, False, "errors").orderBy("id").collect()
    on = lx.list_counts(df, "id", "t", table, True, "hits").orderBy("id").collect()
    assert [r.errors for r in off] == [2, 0, 0] and [r.hits for r in on] == [2, 0, 0]


def polarity(spark, *rows):
    df = texts(spark, *rows)
    pol, shf = (
        wl.table(spark, wl.POLARITY, ["word", "weight"]),
        wl.table(spark, wl.SHIFTERS, ["word", "kind"]),
    )
    out = sn.shifter_sentiment(df, "id", ["t"], pol, shf, ["s"]).orderBy("id").collect()
    return [r.s for r in out]


def test_shifters(spark):
    got = polarity(
        spark, "I am not happy.", "I am happy.", "", None, "Never not very good, but bad", "very happy"
    )
    assert got[0] == pytest.approx(-0.75 / 2)
    assert got[1] == pytest.approx(0.75 / 3**0.5)
    assert got[2:4] == [0.0, 0.0]
    # two negators cancel, one amplifier; the comma starts a new clause
    assert got[4] == pytest.approx((0.75 * 1.8 - 0.75) / 6**0.5)
    assert got[5] == pytest.approx(0.75 * 1.8 / 2**0.5)


def test_zero_sentences_weigh_less(spark):
    (got,) = polarity(spark, "happy. table. chair.")
    assert got == pytest.approx(0.75 / (1 + (1.0986122887) ** 0.5))


def skewed_cells(spark):
    """Half of all cells hold one term."""
    return spark.range(400).select(
        F.col("id").alias("doc"),
        F.when(F.col("id") % 2 == 0, "the").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("term"),
        F.lit(1).alias("n"),
    )


@pytest.mark.parametrize("head", [1, 3, 30, 10_000])
def test_vocabulary_join_is_a_plain_join(spark, monkeypatch, head):
    monkeypatch.setattr(joins, "HEAD_TERMS", head)
    monkeypatch.setattr(joins, "VOCABULARY_ROWS", 1_000_000 if head == 10_000 else 0)
    cells = skewed_cells(spark)
    vocab = cells.groupBy("term").agg(F.count("*").alias("df")).where("term <> 't1'")
    got = joins.join_vocabulary(cells, vocab, "df", ["term"]).select("doc", "term", "n", "df")
    want = cells.join(vocab, "term").select("doc", "term", "n", "df")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("term_cells", [1, 1_000_000])
def test_pruned_hot_term_is_dropped_before_the_shuffle(spark, monkeypatch, term_cells):
    """The hottest term is not in the vocabulary: its cells must not meet in one task."""
    monkeypatch.setattr(joins, "HEAD_TERMS", 3)
    monkeypatch.setattr(joins, "VOCABULARY_ROWS", 0)
    monkeypatch.setattr(joins, "TERM_CELLS", term_cells)
    cells = skewed_cells(spark)
    vocab = cells.groupBy("term").agg(F.count("*").alias("df")).where("term <> 'the'")
    got = joins.join_vocabulary(cells, vocab, "df", ["term"])
    want = cells.join(vocab, "term").select("doc", "term", "n", "df")
    assert sorted(got.select("doc", "term", "n", "df").collect()) == sorted(want.collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(p) for p in got.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 60  # 200 cells are left


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_is_a_plain_join(spark, monkeypatch, how):
    cells = skewed_cells(spark)
    table = spark.createDataFrame([("the", 1), ("t1", 2)], "term string, v int")
    want = sorted(cells.join(table, "term", how).collect(), key=str)
    assert sorted(joins.lookup(cells, table, "term", how).collect(), key=str) == want
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    salted = joins.lookup(cells, table, "term", how)
    assert sorted(salted.select(*cells.join(table, "term", how).columns).collect(), key=str) == want


def test_numbered_terms_are_dense(spark):
    vocab = tm.vocabulary(skewed_cells(spark))
    got = sorted(r.term_index for r in tm.number_terms(vocab, buckets=7).collect())
    assert got == list(range(vocab.count()))


def test_near_zero_variance_against_columns(spark):
    import collections

    rows = ["a b b", "a b", "a", "a c c c", "a b", "a"] * 5 + ["z"]
    df = texts(spark, *rows)
    cells = tm.term_counts(df, ["id"], words("t"))
    got = {r.term: r for r in tm.near_zero_variance(cells, df).collect()}
    likely = {r.term for r in tm.likely_varied(cells, df).collect()}
    for term, r in got.items():
        column = collections.Counter(row.split().count(term) for row in rows)
        top = [n for _, n in column.most_common(2)]
        ratio = top[0] / top[1] if len(top) > 1 else None
        assert r.freq_ratio == (pytest.approx(ratio) if ratio else None)
        assert r.percent_unique == pytest.approx(100 * len(column) / len(rows))
        assert term in likely or r.nzv
        assert r.nzv == (len(column) == 1 or (ratio > 19 and 100 * len(column) / len(rows) <= 10))


def test_repartitioning_changes_nothing(spark):
    df = texts(spark, *[f"a b word{i % 3} the the" for i in range(30)])
    one = tm.tfidf_smooth_l2(tm.word_counts(df.coalesce(1), "id", "t"), df, "id")
    many = tm.tfidf_smooth_l2(tm.word_counts(df.repartition(7), "id", "t"), df, "id")
    key = lambda r: (r.id, r.term)
    for a, b in zip(sorted(one.collect(), key=key), sorted(many.collect(), key=key), strict=True):
        assert (a.id, a.term, a.n) == (b.id, b.term, b.n) and a.tfidf == pytest.approx(b.tfidf)


def test_wide_counts_map_holds_named_terms_only(spark, capsys):
    """A lookup reads the map from its start, so terms without a column must not be in it."""
    df = spark.createDataFrame([(1, "a b a c d"), (2, "d e"), (3, ""), (4, None)], "id int, t string")
    wide = tm.wide_counts(df, "id", words("t"), ["a", "d", "x"], "n_")
    assert {tuple(r) for r in wide.collect()} == {(1, 2, 1, 0), (2, 0, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0)}
    wide.explain("formatted")
    assert re.search(r"filter\(regexp_extract_all\(.*? IN \(a,d,x\)", capsys.readouterr().out)
    assert tm.wide_counts(df, "id", words("t"), []).columns == ["id"]


@pytest.mark.parametrize("at_once", [200_000, 3])
def test_gram_counts_equal_expressions(spark, monkeypatch, at_once):
    """Arrow counts against the expressions, with texts shorter than the order, repeats, null ids and tokens that hold the separator."""
    monkeypatch.setattr(tm, "TOKENS_AT_ONCE", at_once)
    rows = [(1, "a b a b a"), (2, "a_b c a b_c a_b c"), (None, "x"), (3, ""), (4, None), (1, "é É ß b"), (5, "w " * 40)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    tokens = F.split(F.trim("t"), " ")
    for low, high, sep in [(1, 5, "_"), (2, 3, " "), (1, 1, "_"), (3, 4, "")]:
        grams = tm.gram_counts(df, ["id"], tokens, low, high, sep)
        assert "Generate" not in grams._jdf.queryExecution().toString()
        want = tm.term_counts(df, ["id"], ngrams(tokens, low, high, sep))
        assert sorted(map(str, grams.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("at_once", [200_000, 3, 1])
def test_windows_hold_the_vocabulary_of_all_orders(spark, monkeypatch, at_once):
    """At most one row a token is shuffled, and the vocabulary is that of the cells, wherever runs are cut."""
    monkeypatch.setattr(tm, "TOKENS_AT_ONCE", at_once)
    held = ["a b a b a", "don't don don'ts don", "a b c", "", None, "x", "é b a É b a", "w " * 40, "b a b", "a b a b a"]
    df = texts(spark, *held)
    for low, high in [(1, 5), (2, 3), (1, 1), (4, 6)]:
        grams = tm.ngram_counts(df, "id", "t", low, high, windows=True)
        assert grams.count() <= df.select(F.sum(F.size(words("t")))).first()[0]
        cells = tm.vocabulary(tm.ngram_counts(df, "id", "t", low, high))
        for least in (1, 2, 3):
            got = tm.vocabulary(grams, min_docfreq=least)
            assert got.columns == cells.columns
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tm.trim_docfreq(cells, least).collect()))


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_weightings_count_a_text_once(spark, monkeypatch, rows):
    """Nothing past the written cells reads texts again, with a vocabulary that is broadcast and one that is not."""
    monkeypatch.setattr(joins, "VOCABULARY_ROWS", rows)
    df = texts(spark, "a b a", "b c", "", None, "b " * 9)
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    log10 = tm.tfidf_log10(tm.word_counts(df.mapInArrow(seen, df.schema), "id", "t"), df)
    got = {(r.id, r.term): round(r.weight, 6) for r in log10.collect()}
    assert got == {(1, "a"): 1.39794, (1, "b"): 0.221849, (2, "b"): 0.221849, (2, "c"): 0.69897, (5, "b"): 1.996639}
    assert calls.value == 5
    smooth = tm.tfidf_smooth_l2(tm.word_counts(df.mapInArrow(seen, df.schema), "id", "t"), df, "id")
    assert {(r.id, r.term) for r in smooth.collect()} == set(got) and calls.value == 10


@pytest.mark.parametrize(
    "patterns", [["ab*", "i", "abcd", "x_y*"], ["abc", "i"], ["*"], ["a*", "a"], ["", "zz*"], []]
)
def test_prefixes_are_tried_for_terms_that_begin_like_a_pattern(spark, monkeypatch, patterns):
    """Same matches as plain comparison; only terms with a pattern's beginning have their prefixes looked up."""
    terms = ["", "a", "ab", "abc", "abcd", "abx", "b", "i", "in", "x", "x_y", "x_yz", "z", "zzz", "q" * 30]
    cells = spark.createDataFrame([(1, t, 1) for t in terms], "id long, term string, n long")
    lex = spark.createDataFrame([("d", "c", p) for p in patterns], "dict string, category string, pattern string")
    tried, plain = [], lx.lookup

    def watched(rows, table, on, how="left"):
        if on == "pattern":
            tried.extend({r.term for r in rows.select("term").distinct().collect()})
        return plain(rows, table, on, how)

    monkeypatch.setattr(lx, "lookup", watched)
    got = {r.term for r in lx.match_patterns(cells, lex, ["id"]).collect()}
    # a prefix has to reach into the last word of a term
    reaches = lambda p, t: p.endswith("*") and t.startswith(p[:-1]) and len(p) - 1 > t.rfind("_")
    assert got == {t for t in terms for p in patterns if t == p or reaches(p, t)}
    if patterns[:1] == ["ab*"]:
        assert set(tried) == {"ab", "abc", "abcd", "abx", "i", "x_y", "x_yz"}


@pytest.mark.parametrize(("cells", "terms"), [(1 << 20, 1 << 20), (6, 1 << 20), (6, 4), (1, 1)])
def test_smooth_weights_of_blocks(spark, monkeypatch, cells, terms):
    """Few large blocks and many small ones, one range of terms and many, ids that repeat and a null one: the weights of the definition."""
    monkeypatch.setattr(tm, "BLOCK_CELLS", cells)
    monkeypatch.setattr(tm, "RANGE_TERMS", terms)
    words_of = [(1, "b a b é"), (2, ""), (3, None), (4, "a c zz"), (5, "q"), (1, "a 水 b"), (None, "a b"), (6, "w x y z a a")]
    for rows in (words_of, [(i, t) for i, t in enumerate(t for _, t in words_of)], []):
        df = spark.createDataFrame(rows, "id long, t string").repartition(3)
        got = tm.tfidf_smooth_l2(tm.gram_counts(df, ["id"], words("t"), 1, 2, " "), df, "id").collect()
        want, held = [], [(i, collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])) for i, w in ((i, (t or "").split()) for i, t in rows)]
        found = collections.Counter(term for _, c in held for term in c)
        for i, c in held:
            want += [(i, term, n, n * (math.log((1 + len(rows)) / (1 + found[term])) + 1)) for term, n in c.items()]
        norm = collections.Counter()
        for i, _, _, w in want:
            norm[i] += w * w
        key = lambda r: (str(r[0]), r[1], r[2])
        want = sorted(((i, t, n, w / math.sqrt(norm[i])) for i, t, n, w in want), key=key)
        assert [tuple(r)[:3] for r in sorted(got, key=key)] == [w[:3] for w in want]
        assert [r[3] for r in sorted(got, key=key)] == pytest.approx([w[3] for w in want])


def test_smooth_weights_store_and_sort_no_cells(spark):
    """Cells are stored in blocks, in far fewer rows, and the plan sends none by its term or its text."""
    from pathlib import Path
    from urllib.parse import urlparse

    from answerframe.session import checkpoint_folder

    folder = Path(urlparse(checkpoint_folder(spark)).path)
    df = spark.range(400).selectExpr("id", "concat_ws(' ', transform(sequence(0, 99), i -> char(97 + (i * id) % 26))) t")
    cells = tm.word_counts(df, "id", "t")
    before = set(folder.glob("*"))
    found = tm.tfidf_smooth_l2(cells, df, "id")
    tables = [str(t) for t in set(folder.glob("table-*")) - before]
    assert sum(spark.read.parquet(t).count() for t in tables) < cells.count() / 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(term" not in plan
