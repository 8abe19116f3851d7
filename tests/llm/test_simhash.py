import numpy as np
import pytest
import xxhash
from answerframe.llm import simhash
from answerframe.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    """doc → (fingerprint, smallest reachable id), by comparing everything with everything."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[: i + 1] ^ values[i]) <= 3).tolist():
            root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, f, ids.get(top(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def got(df):
    return sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in df.select("doc_id", "fp", "component_id").collect()), key=str)


def test_query_equals_brute_force(spark, some_docs, sf_small):
    rows = [(r.doc_id, r.text) for r in some_docs.collect()]
    out = QUERIES["op4_simhash"](spark, sf_small).collect()
    want = [(d, f"{f:016x}", c) for d, f, c in plain_groups(rows)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_edges_and_clashing_columns(odd_docs, edge_docs):
    want = plain_groups([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert got(simhash.near_groups(odd_docs)) == want


def test_empty_table(edge_docs):
    assert simhash.near_groups(edge_docs.where("false")).collect() == []


def test_xxhash_equals_spark(spark):
    a = "ça va bien"
    got_ = spark.sql(f"select xxhash64('{a}')").first()[0] & (1 << 64) - 1
    assert got_ == xxhash.xxh64_intdigest(a.encode(), 42)


@pytest.mark.parametrize("spread", [3, 9, 40])
def test_links_of_clouds(spark, spread, monkeypatch):
    """Dense and loose clouds of values, with small shards and blocks: same components as brute force."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = set()
    for k in range(1500):
        v = int(centres[k % 6])
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            v ^= 1 << int(b)
        values.add(v)
    values = np.array(sorted(values), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    i, j = simhash._walk(values, 3)
    k = np.arange(len(values))
    for _ in range(len(values)):
        low = np.minimum(k[i], k[j])
        new = k.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == k).all():
            break
        k = new
    mine = [root.get(v, v) for v in values.view(np.int64).tolist()]
    pairs = set(zip(mine, k.tolist(), strict=True))
    assert len(pairs) == len(set(mine)) == len(set(k.tolist()))


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(1)
    values = np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64) | np.uint64(5)
    values = np.unique(values)
    a, b = simhash.links_between(values, None)
    assert len(a) == len(values) - 1 or len(a) <= 8 * len(values)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    out = simhash.components(edges).collect()
    assert len(out) == 401 and len({r.root for r in out}) == 1
