import numpy as np
import pytest
from answerframe.llm import mixing
from answerframe.llm.queries import QUERIES


def test_water_fill_by_hand():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.water_fill([10, 100, 190], [5, 2, 1]) == [30.0, 180.0, 90.0]
    assert mixing.water_fill([0, 0], [5, 2]) == [0.0, 0.0]
    assert mixing.water_fill([], []) == []


@pytest.mark.parametrize("seed", range(30))
def test_knapsack_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(0, 12, 4))
    counts = rng.integers(0, 4, len(sizes))
    budget = int(rng.integers(1, 40))
    sums = {0}
    for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    took = mixing.knapsack(sizes, counts, budget)
    best = min(abs(x - budget) for x in sums)
    got = int((took * sizes).sum())
    assert (took <= counts).all() and (took >= 0).all()
    assert abs(got - budget) == best or budget + min(sizes[(sizes > 0) & (counts > 0)], default=0) < max(sums)
    assert abs(got - budget) <= max(best, int(sizes.max()))


def test_counts_meet_a_large_budget():
    rng = np.random.default_rng(3)
    sizes = np.arange(1, 900)
    counts = rng.integers(0, 50, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.001, 0.3, 0.77, 0.999):
        took = mixing.choose_counts(sizes, counts, int(share * total))
        assert (took <= counts).all() and int((took * sizes).sum()) == int(share * total)


def check(rows, docs):
    sizes = {}
    for r in docs.select("doc_id", "text", "source").collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(names, mixing.water_fill([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    by_doc = {r.doc_id: r for r in docs.collect()}
    got, largest = {}, {}
    assert len(rows) == docs.count()
    for r in rows:
        doc = by_doc[r.doc_id]
        n = len((doc.text or "").encode().split())
        assert r.size == n and 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        assert r.source_size == sizes[doc.source] and abs(r.target - targets[doc.source]) <= 1e-6 * max(1, r.target)
        got[doc.source] = got.get(doc.source, 0) + r.taken
        largest[doc.source] = max(n, largest.get(doc.source, 0))
    for s in names:
        assert abs(got[s] - targets[s]) <= max(1, largest[s])
    return sum(abs(got[s] - targets[s]) for s in names) / max(1, sum(sizes.values()))


def test_query_meets_targets_and_repeats(spark, some_docs, sf_small):
    rows = QUERIES["op10_mix"](spark, sf_small).collect()
    assert check(rows, some_docs) < 0.02
    assert sorted(rows) == sorted(QUERIES["op10_mix"](spark, sf_small).collect())


def test_edges_and_clashing_columns(odd_docs, edge_docs):
    from pyspark.sql import functions as F

    rows = mixing.mix(odd_docs).withColumn("taken", F.col("size") * F.col("repeats")).collect()
    check(rows, edge_docs)


def test_empty_table(edge_docs):
    assert mixing.mix(edge_docs.where("false")).collect() == []


def test_hot_group_of_equal_sizes(make, monkeypatch):
    """Most rows have one source and size; buckets and the last bucket's ranking give the exact number."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = make([(i, f"same size text {i % 7}", "en", "hot" if i % 10 else "b") for i in range(3000)])
    rows = mixing.mix(docs).withColumn("taken", F.col("size") * F.col("repeats")).collect()
    assert check(rows, docs) < 0.01


def test_documents_longer_than_the_table_reaches(monkeypatch):
    """Three million words a document and a table of fifty cells alike: the sum is off by half the longest one at most."""
    for cells, unit in ((50, 1), (2_000_000, 100_000)):
        monkeypatch.setattr(mixing, "DP_CELLS", cells)
        sizes, counts = np.array([30, 100]) * unit, np.array([3, 5])
        sums = {int(a * sizes[0] + b * sizes[1]) for a in range(4) for b in range(6)}
        for budget in range(0, 591 * unit, 10 * unit):
            got = int((mixing.choose_counts(sizes, counts, budget) * sizes).sum())
            best = min(abs(x - budget) for x in sums)
            assert abs(got - budget) <= max(best, 50 * unit), (budget, got)  # half the longest document
