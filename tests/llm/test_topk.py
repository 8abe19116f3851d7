import numpy as np
import pytest
from answerframe.llm import shards, topk
from answerframe.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=5):
    def ints(rows):
        out = []
        for i, v in rows:
            if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
                continue
            out.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
        return out

    out = []
    for q, x in ints(queries):
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in ints(rows) if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    out = QUERIES["op8_top_products"](spark, sf_small)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0])


@pytest.mark.parametrize("seed", range(3))
def test_blocks_ties_and_odd_vectors(spark, seed, monkeypatch):
    """Small blocks, few distinct values, uneven lengths of vectors, many equal rows, nulls and infinities."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 5)
    monkeypatch.setattr(topk, "LEADING", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(shards, "SHARD_BYTES", 1 << 23 if seed == 0 else 1500)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 210)]
    rows += [(210, None), (211, [1.0, None]), (212, [float("nan")] * 6), (213, [float("inf")] + [0.0] * 5), (214, []), (215, [3.0]), (None, [9.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 10 in (0, 4)]
    got = topk.top_k(df, spark.createDataFrame(queries, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries)


def test_few_candidates_and_empty_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0])], SCHEMA)
    assert sorted(map(tuple, topk.top_k(one, one).collect())) == [(0, 1, 50, 512 * 256 + 256 * 512), (50, 1, 0, 512 * 256 + 256 * 512)]
    none = one.where("false")
    assert topk.top_k(none, none).collect() == [] and topk.top_k(one, none).collect() == []
    alone = one.where("vec_id = 0")
    assert topk.top_k(alone, alone).collect() == []


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, [float(i)]) for i in range(9)], SCHEMA)
    odd = df.select(*[F.lit(1).alias(n) for n in ("id", "x", "norm", "score", "EMBEDDING", "a.b")], "*")
    assert sorted(topk.top_k(odd, odd).collect()) == sorted(topk.top_k(df, df).collect())


def test_large_components_are_exact_or_raise(spark):
    """No component is cut off; products beyond doubles are exact; what 64 bits cannot hold raises and does not wrap."""
    rows = [(0, [2.0**21] * 4), (50, [2.0**21, 2.0**21, 2.0**21, 2.0**20]), (2, [2.0**20] * 4), (3, [2.0**20, 2.0**20, 2.0**20, 2.0**20 + 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == want
    over = spark.createDataFrame([(i, [2.0**20] * 128) for i in range(2)], SCHEMA)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(over, over).collect()


def test_queries_of_many_dimensions_stop_early(spark, monkeypatch):
    """512 dimensions, many shards, long vectors far ahead: only shards that can reach a floor see a query."""
    monkeypatch.setattr(shards, "SHARD_BYTES", 1 << 17)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 512)) * np.where(np.arange(400) < 40, 10, 0.01)[:, None]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.float32(x))]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = sorted(map(tuple, topk.top_k(df, spark.createDataFrame(asked, SCHEMA)).collect()))
    assert got == brute(rows, asked)
