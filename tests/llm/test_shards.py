"""Searches over sharded vectors: hard negatives and approximate neighbours, against brute force."""

import duckdb
import numpy as np
import pytest
from answerframe.llm import crosspolytope, negatives, shards
from answerframe.llm.common import bounded_sample, lower_share
from answerframe.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def able(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_negatives(rows, anchors):
    ints = lambda v: [int(np.floor(256 * x)) for x in v]
    every = [(i, ints(v), c) for i, v, c in rows if i is not None and able(v) and c is not None]
    asked = [(i, ints(v), c) for i, v, c in anchors if i is not None and able(v) and c is not None]
    out = []
    for a, v, c in asked:
        scored = sorted((-dot(v, w), i, d) for i, w, d in every if i != a)
        for ps, p, _ in [s for s in scored if s[2] == c][:5]:
            inside = [s for s in scored if s[2] != c and 30 * -ps <= 100 * -s[0] <= 90 * -ps]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside[:10], 1)]
    return sorted(out)


def odd_rows(seed, n=160):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 7) / 8], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, [0.5] * 7, i % 2) for i in range(60)]
    more = [None, [1.0, None], [float("nan")] * 7, [float("inf")] + [0.0] * 6, [], [3.0], [0.0] * 7]
    rows += [(300 + k, v, 1) for k, v in enumerate(more)]
    return [*rows, (None, [9.0] * 7, 1), (400, [1.0] * 7, None), (401, [2.0] * 7, 9), (7, [0.25] * 7, 1), (7, [0.25] * 7, 1)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shard_bytes", [1 << 23, 2000])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, shard_bytes):
    """One shard and many, small cells, ties, equal and repeated rows, vectors that take no part."""
    monkeypatch.setattr(shards, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(negatives, "MAX_SAMPLE", 50)
    rows = odd_rows(seed)
    anchors = [r for r in rows if r[0] is not None and r[0] % 10 in (0, 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.mine(df, spark.createDataFrame(anchors, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, anchors)


def test_a_search_stops_early():
    """Well-separated cells: a full window is certified before most rows are scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 1000
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)))
    books = [centres[:, :8], centres[:, 8:]]
    index = negatives.MultiIndex(np.arange(4000), x, np.zeros(4000, np.int64), books, (5, 10))
    window = negatives.Window_(5)
    scored = index.fill([window], 0, x[0], 0, same=True)
    order = np.lexsort((index.ids, -(index.x @ x[0])))
    assert index.ids[window.at].tolist() == [i for i in index.ids[order].tolist() if i != 0][:5]
    assert scored < 1500


def test_negatives_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["op11_negatives"]).fetchall())
    assert sorted(map(tuple, QUERIES["op11_negatives"](spark, sf_small).collect())) == want and want


def brute_nearest(rows, queries, k=5):
    able_ = lambda v: able(v) and any(v)
    wide = max(len(v) for _, v in rows if v is not None)
    full = lambda v: np.array([*v, *[0.0] * (wide - len(v))])
    out = []
    for q, v in queries:
        if q is None or not able_(v):
            continue
        v = full(v)
        scored = []
        for i, w in rows:
            if i is not None and i != q and able_(w):
                w = full(w)
                scored.append((-(v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 23, 2000])
def test_neighbours_with_all_probes_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(shards, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(crosspolytope, "CELLS", 64)
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v, _ in odd_rows(4)] + [(500 + i, [float(x) for x in rng.normal(size=7)]) for i in range(50)]
    queries = [r for r in rows if r[0] is not None and r[0] % 10 in (0, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, crosspolytope.nearest(df, asked, tables=2, probes=16).collect()))
    want = brute_nearest(rows, queries)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-14)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    got = QUERIES["op13_neighbours"](spark, folder)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = got.collect()
    found = {(r.query_id, r.vec_id): r for r in got}
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -9
        best = np.argsort(-near)[:5]
        total += 5
        hits += sum((ids[q], ids[b]) in found for b in best)
        assert all(abs(found[ids[q], ids[b]].score - near[b]) < 1e-12 for b in best if (ids[q], ids[b]) in found)
    assert len(got) == total and hits >= 0.92 * total


def test_turned_vectors_keep_their_length_and_angles():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 12))
    flips = crosspolytope.signs(12, 3)
    for flip in flips:
        y = crosspolytope.turned(x, flip)
        assert y.shape == (30, 16) and np.allclose(y @ y.T, x @ x.T)
    assert crosspolytope.axes(np.array([[1.0, -3.0, 2.0, 0.5]]), 3).tolist() == [[5, 2, 0]]


def test_few_rows_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(9)], SCHEMA)
    odd = df.select(*[F.lit(1).alias(n) for n in ("id", "x", "no", "shard", "more", "EMBEDDING", "a.b", "m0")], "*")
    none = df.where("false")
    for search in (negatives.mine, crosspolytope.nearest):
        assert sorted(search(odd, odd).collect()) == sorted(search(df, df).collect()) != []
        assert search(none, none).collect() == [] == search(df, none).collect() == search(none, df).collect()
        alone = df.where("vec_id = 3")
        assert search(alone, alone).collect() == []


def test_large_and_tiny_components(spark):
    """Exact beyond doubles and 64-bit sums; a score that 64 bits cannot hold raises; cosines do not overflow."""
    big = [(0, [2.0**21] * 4, 0), (1, [2.0**20 + 0.25] * 4, 0), (2, [2.0**19] * 4, 1), (3, [2.0**19, 2.0**19, 2.0**19 - 1, 2.0**19], 1)]
    df = spark.createDataFrame(big, SCHEMA)
    assert sorted(map(tuple, negatives.mine(df, df).collect())) == brute_negatives(big, big) != []
    over = spark.createDataFrame([(0, [2.0**30] * 4, 0), (1, [2.0**30] * 4, 0)], SCHEMA)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        negatives.mine(over, over).collect()
    far = spark.createDataFrame([(0, [1e200, 1e200], 0), (1, [1e-200, 2e-200], 0), (2, [1.0, 0.0], 0)], SCHEMA)
    got = {(r.query_id, r.vec_id): r.score for r in crosspolytope.nearest(far, far, probes=4).collect()}
    assert abs(got[0, 1] - 3 / np.sqrt(10)) < 1e-12 and abs(got[0, 2] - np.sqrt(0.5)) < 1e-12


def test_samples_are_bounded_at_any_size(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = bounded_sample(df, "k", 100).collect()
    assert len(got) == 100 == len(set(got))
    hashes = df.select("k", F.xxhash64("k", F.lit(17)).alias("h")).orderBy("h").limit(100)
    assert {r.k for r in got} == {r.k for r in hashes.collect()}
    assert bounded_sample(df, "k", 5000).count() == 5000
    repeated = df.withColumn("k", F.col("k") % 50)
    assert bounded_sample(repeated, "k", 100).count() == 5000
    assert bounded_sample(repeated, "k", 10).select("k").distinct().count() == 10
    # far beyond the size at which a limit in 2**20 parts was rounded down to nothing
    for bound, total in ((1_000, 11 * 10**8), (20_000, 22 * 10**12)):
        share = (lower_share(bound, total) + 2**63) / 2**64
        assert bound < share * total < 1.5 * bound + 200
