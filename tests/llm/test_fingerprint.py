import hashlib
from collections import Counter

import numpy as np
import pytest
from answerframe.llm import fingerprint as fp
from answerframe.llm.queries import QUERIES


def jaccard(a, b):
    x, y = (Counter(t.lower().encode().split()) for t in (a, b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def plain(rows):
    """doc_id, code points, edited text's hash for rows in order."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        changed = t[: len(t) - k] + after[:k]
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), jaccard(t, changed), jaccard(t, after)))
    return out


def test_query_equals_brute_force(spark, some_docs, sf_small):
    out = {r.doc_id: r for r in QUERIES["op3_fingerprints"](spark, sf_small).collect()}
    want = plain([(r.doc_id, r.text) for r in some_docs.collect()])
    assert len(out) == len(want)
    errors = []
    for d, n, digest, near, following in want:
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        errors += [r.near_edited - near, r.near_next - following]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert np.mean([r.near_edited > r.near_next for r in out.values()]) > 0.9


def test_equal_texts_have_equal_fingerprints(make):
    rows = fp.fingerprints(make([(i, t) for i, t in enumerate(["a b a", "a b a", "b a", None, ""])])).collect()
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[0] == by[1] != by[2] and by[3] == by[4] == "f" * 8 * fp.SAMPLES


@pytest.mark.parametrize("parts", [1, 4])
def test_edges_and_clashing_columns(odd_docs, edge_docs, parts):
    got = fp.compared(odd_docs.repartition(parts)).collect()
    want = plain([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted((w[:3] for w in want), key=str)


def test_one_row_and_empty_table(make, edge_docs):
    (r,) = fp.compared(make([(7, "abcd efgh")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert fp.compared(edge_docs.where("false")).collect() == []


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    sampler = fp.Sampler()
    errors = []
    for k in range(60):
        a = " ".join(f"w{k}x{i}" for i in rng.zipf(1.5, 80) % 60)
        b = " ".join([*a.split()[:50], *(f"v{k}x{i}" for i in rng.integers(0, 30, 30))])
        errors.append(fp.likeness(sampler(a), sampler(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_full_table_gives_the_same(some_docs, monkeypatch):
    texts = [r.text for r in some_docs.limit(30).collect()]
    whole = [fp.Sampler()(t) for t in texts]
    monkeypatch.setattr(fp, "TABLE_ROWS", 300)
    monkeypatch.setattr(fp, "PAIRS_AT_ONCE", 100)
    small = fp.Sampler()
    assert all((small(t) == w).all() for t, w in zip(texts, whole, strict=True))
