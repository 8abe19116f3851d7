import zlib

import numpy as np
from answerframe.llm import langid
from answerframe.llm.queries import QUERIES


def test_query_is_right_on_held_out_documents(spark, some_docs, sf_small):
    rows = QUERIES["op2_language"](spark, sf_small).collect()
    lang = {r.doc_id: r.lang for r in some_docs.collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def plain_scores(text, model):
    """The same sums, n-gram by n-gram."""
    s = f"  {langid.letters_only(text)}  "
    out = model.priors.copy()
    for i in range(len(s) - 2):
        for n in (1, 2, 3):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + ord(s[i + k]) + k + 1) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
            out += model.weights[:, h]
    return out


def test_scores_equal_a_plain_loop(some_docs, monkeypatch):
    model = langid.fit(some_docs)
    texts = [r.text[:3000] for r in some_docs.limit(8).collect()] + ["x", None, "12"]
    for limit in (400_000, 50):
        monkeypatch.setattr(langid.pieces, "__defaults__", (limit,))
        names, score = langid.predict_texts(texts, model)
        for t, name, p in zip(texts[:-2], names, score, strict=False):
            want = plain_scores(t, model)
            assert name == model.languages[int(want.argmax())]
            assert abs(p - 1 / np.exp(want - want.max()).sum()) < 1e-6
    assert names[-2:] == ["und", "und"] and list(score[-2:]) == [0, 0]


def test_edges_and_clashing_columns(odd_docs, some_docs):
    rows = {r[0]: r for r in langid.predict(odd_docs, langid.fit(some_docs)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und"
    assert rows[1].score == 0 and len(rows) == 8


def test_nothing_to_learn_from(edge_docs):
    model = langid.fit(edge_docs.where("false"))
    assert {r.lang_pred for r in langid.predict(edge_docs, model).collect()} == {"und"}
    assert langid.predict(edge_docs.where("false"), model).collect() == []


def test_bound_on_training_rows(some_docs):
    few = langid.fit(some_docs, max_rows=60)
    assert few.weights.shape == (len(few.languages), 2**16 + 1) and few.languages
