import random

import corpus_pipeline
import numpy as np
import pytest
from answerframe.llm import resemblance, simhash


def plain_shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(rows, similarity=0.8):
    """id → smallest id that texts alike reach, by comparing everything with everything."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, low, high):
    """A copy with words replaced whose similarity lies in the range."""
    while True:
        copy = list(words)
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**9)}"
        if low <= jaccard(plain_shingles(" ".join(words)), plain_shingles(" ".join(copy))) < high:
            return copy


def planted(low, high, n=40, first=0):
    rng = random.Random(f"{low}")
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 250))]
        rows += [(first + 2 * k, " ".join(words)), (first + 2 * k + 1, " ".join(edited(rng, words, low, high)))]
    return rows


@pytest.mark.parametrize("low", [0.8, 0.85, 0.9, 0.95])
def test_stage_drops_planted_copies(spark, make, sf_small, low):
    rows = planted(low, low + 0.05)
    out = corpus_pipeline.one_of_each_group(spark, make(rows), sf_small)
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _ in rows if d % 2 == 0]


def test_stage_keeps_what_is_less_alike(spark, make, sf_small):
    rows = planted(0.7, 0.79)
    out = corpus_pipeline.one_of_each_group(spark, make(rows), sf_small)
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _ in rows]


@pytest.mark.parametrize("block_rows", [256, 7])
def test_groups_equal_brute_force(make, monkeypatch, block_rows):
    """Chains and dense groups of edits of one text, odd and short texts, small blocks and sketch blocks."""
    monkeypatch.setattr(resemblance, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(resemblance, "SKETCH_ROWS", 2 * block_rows)
    monkeypatch.setattr(resemblance, "MEMBERS_SENT", 200 if block_rows > 7 else 3)
    monkeypatch.setattr("answerframe.llm.common.HOT_KEYS", 5)
    monkeypatch.setattr(resemblance, "CELLS", 1000)
    rng = random.Random(block_rows)
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d e f", "A b c d\te f", "word " * 3000, "word " * 20]
    for length in (60, 150):
        words = [f"w{rng.randrange(50)}" for _ in range(length)]
        for _ in range(40):
            texts.append(" ".join(words))
            words[rng.randrange(length)] = f"new{rng.randrange(10**9)}"
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in resemblance.similar_groups(make(rows)).collect()}
    assert got == plain_groups(rows)


def close_pairs(n=12):
    """Pairs of long texts that differ in the last word alone, and whose SimHash fingerprints lie within three bits."""
    rng, rows = random.Random(3), []
    while len(rows) < 2 * n:
        words = [f"w{rng.randrange(4000)}" for _ in range(400)]
        pair = [" ".join(words), " ".join([*words[:-1], "other"])]
        a, b = (simhash.fingerprint_of(resemblance.shingles(t)) for t in pair)
        if (a ^ b).bit_count() <= 3:
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    return rows


def test_stage_finds_copies_by_simhash(spark, make, sf_small, monkeypatch):
    """Without any band, the vantage-point trees still bring copies within three bits together."""
    monkeypatch.setattr(resemblance, "keys_of", lambda least: np.zeros(0, np.uint64))
    rows = close_pairs()
    out = corpus_pipeline.one_of_each_group(spark, make(rows), sf_small)
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _ in rows if d % 2 == 0]


def test_near_fingerprints_alone_link_nothing(spark, make):
    """Sets given the same or near fingerprints by hand are candidates; their shingles decide."""
    rows = planted(0.5, 0.79, n=4) + [(8, "a text of its own"), (9, "")]
    made = []
    for d, t in rows:
        found = resemblance.shingles(t)
        made.append((d, d, len(found), [5, 5, 4, -1][d % 4] if d < 8 else 0, [], b""))
    sets = spark.createDataFrame(made, "fp long, first long, n long, simhash long, keys array<long>, sketch binary")
    root = {r.node: r.root for r in resemblance.components(resemblance.near_fingerprints(sets)).collect()}
    assert set(root) == {0, 1, 2, 3, 4, 5, 6, 7, 8}
    assert len({root[d] for d in (0, 1, 2, 4, 5, 6, 8)}) == 1 and root[3] == root[7] != root[0]
    assert resemblance.links(make(rows), sets, 5, 0.8).count() == 0


def test_fingerprint_of_hashes():
    tokens = [f"w{i}".encode() for i in range(70)]
    hashes = resemblance.shingles(" ".join(t.decode() for t in tokens), 3)
    assert simhash.fingerprint_of(hashes) == simhash.fingerprint(tokens, 3)
    assert simhash.fingerprint_of(hashes[:0]) == 0


def test_bands_miss_almost_nothing():
    bands = resemblance.n_bands(0.8)
    assert (1 - 0.8**resemblance.BAND) ** bands <= resemblance.MISSED
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):  # 80 of 100 shingles shared
        x = rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = (resemblance.band_keys(np.sort(s), bands) for s in (x[:90], x[10:]))
        missed += not (a == b).any()
    assert missed == 0


def templates(n, shared, own, seed=0):
    """Texts of one template: so many words shared by all and so many of their own, in one run each."""
    rng = random.Random(seed)
    head = [f"t{rng.randrange(10**6)}" for _ in range(shared)]
    return [(k, " ".join(head + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for k in range(n)]


def test_templates_do_not_chain(make, monkeypatch):
    """Texts at a similarity of 0.5 share bands by chance; sketches part them before sets are shuffled."""
    monkeypatch.setattr(resemblance, "BLOCK_ROWS", 16)
    rows = templates(300, 84, 40)
    close = templates(40, 100, 8, seed=1)  # alike at 0.85
    rows += [(1000 + k, t) for k, t in close]
    docs = make(rows)
    got = {r.doc_id: r.component_id for r in resemblance.similar_groups(docs).collect()}
    assert got == {d: min(d, 1000) for d, _ in rows}
    bands = resemblance.n_bands(0.8)
    made = []
    for k, t in rows:
        found = resemblance.shingles(t)
        least = resemblance.minima(found, bands)
        made.append((k, k, len(found), resemblance.keys_of(least).view(np.int64).tolist(), (least & 255).astype(np.uint8).tobytes()))
    sets = docs.sparkSession.createDataFrame(made, "fp long, first long, n long, keys array<long>, sketch binary")
    left = {r.doc_id: r.blocks for r in resemblance.candidates(sets, 0.8).collect()}
    assert set(left) >= set(range(1000, 1040)) and sum(d < 1000 for d in left) <= 10


def test_chain_of_many_candidates(spark):
    """100,000 sets in one chain come out as one component, in plans that do not grow."""
    edges = spark.range(100_000).selectExpr("id AS a", "id + 1 AS b")
    out = resemblance.components(edges)
    assert out.agg({"root": "count"}).first()[0] == 100_001 and out.select("root").distinct().count() == 1
