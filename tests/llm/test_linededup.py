import hashlib
from collections import Counter

import numpy as np
import pytest
from answerframe.llm import linededup as ld
from answerframe.llm.queries import QUERIES


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_docs, counted=None):
    lines = lambda t: (t or "").split("\n")
    n = Counter(k for _, t in (counted or rows) for k in {key(x) for x in lines(t)} if k)
    out = []
    for d, t in rows:
        kept = [x for x in lines(t) if not key(x) or n[key(x)] < min_docs]
        out.append((d, "\n".join(kept), len(lines(t)), len(lines(t)) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", df.columns[-2], df.columns[-1]).collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_query_equals_brute_force(spark, some_docs, sf_small):
    out = sorted(map(tuple, QUERIES["op7_line_dedup"](spark, sf_small).collect()))
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in plain(pairs(some_docs), 10)]
    assert out == sorted(want) and any(r[2] for r in out)


@pytest.mark.parametrize("room", [ld.MAX_BROADCAST, 0])
def test_filters_and_join_agree(edge_docs, some_docs, room):
    docs = edge_docs.unionByName(some_docs)
    for n in (2, 3):
        assert got(ld.LineIndex.build(docs, n).apply(docs, room)) == plain(pairs(docs), n)


@pytest.mark.parametrize("room", [ld.MAX_BROADCAST, 0])
def test_extra_columns_stay(odd_docs, edge_docs, room):
    out = ld.LineIndex.build(odd_docs, 2).apply(odd_docs, room)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = [(r[0], r[1], r[-2], r[-1]) for r in out.collect()]
    assert sorted(rows, key=str) == plain(pairs(edge_docs), 2)


@pytest.mark.parametrize("room", [ld.MAX_BROADCAST, 0])
def test_empty_table(edge_docs, room):
    none = edge_docs.where("false")
    assert ld.LineIndex.build(none).apply(none, room).collect() == []


def test_deletion_undoes_insertion(some_docs, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 50)
    a, b = some_docs.where("doc_id % 3 > 0"), some_docs.where("doc_id % 3 = 0")
    first = ld.LineIndex.build(a, 3)
    both = first.insert(b)
    assert got(both.apply(some_docs)) == plain(pairs(some_docs), 3)
    back = both.delete(b)
    assert sorted(back.counts.collect()) == sorted(first.counts.collect())
    assert got(back.apply(a)) == plain(pairs(a), 3)
    everything_gone = back.delete(a)
    assert everything_gone.counts.count() == 0
    assert got(everything_gone.apply(a)) == plain(pairs(a), 10**9)


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 3000))
    f = ld.filled(list(zip(hi.tolist(), lo.tolist(), strict=True)))
    again = ld.CuckooFilter.load(f.dump())
    assert again.contains(hi, lo).all()
    for h, x in list(zip(hi.tolist(), lo.tolist(), strict=True))[:1500]:
        assert again.delete(h, x)
    assert again.contains(hi[1500:], lo[1500:]).all() and again.contains(hi[:1500], lo[:1500]).sum() < 5
    with pytest.raises(OverflowError):
        small = ld.CuckooFilter(4)
        for h, x in zip(hi.tolist(), lo.tolist(), strict=True):
            small.insert(h, x)


def test_wrong_positives_are_told_apart(some_docs, monkeypatch):
    """With filters that say yes to everything the result is still exact."""
    monkeypatch.setattr(ld, "in_filters", lambda hi, lo, held, n: np.ones(len(hi), bool))
    assert got(ld.LineIndex.build(some_docs, 4).apply(some_docs)) == plain(pairs(some_docs), 4)
