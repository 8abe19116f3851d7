import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from answerframe.llm import packing
from answerframe.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "it's we'll\nbe 12 34", "x y z", "tab\there", "\n", " ", "",
    "<|endoftext|> and <|endoftext|>\n<|endoftext|>", "été 漢字 😀\n😀 !!! ...", "a\rb c", "a\x1cb c", "a　b c d",
]


def test_tokenizer_equals_the_library(some_docs):
    texts = ODD + [r.text for r in some_docs.collect()]
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    cut = packing.TextTokenizer(PATH)
    assert cut.fast is not None
    assert [x.tolist() for x in cut(texts)] == whole


@pytest.mark.parametrize("seed", range(20))
def test_tokenizer_equals_the_library_on_random_text(seed):
    rng = random.Random(seed)
    signs = "abz ABZ \n\t\r'’.,!?-_()09½²éñß漢字😀\u0301\u00ad\x00\x1b\x7f\u200d\ufffd\U000e0001" + "".join(
        chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F800)])) for _ in range(30)
    )
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in packing.TextTokenizer(PATH)(texts)]
    assert [t for t, a, b in zip(texts, got, whole, strict=True) if a != b] == []


@pytest.mark.parametrize("blank", [" ", "\n", " \t\r\n"])
def test_very_long_runs_of_blanks(blank):
    n = 2_000_000 // len(blank)
    texts = [f"before{blank * n}after", blank * n, f"a{blank * (packing.LONG_RUN // len(blank) - 1)}b", "a b"]
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.TextTokenizer(PATH)(texts)] == whole


def test_other_kinds_of_files_use_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.TextTokenizer(path)
    assert cut.fast is None
    assert [x.tolist() for x in cut(ODD)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]


def check(rows, docs, tokens=1024):
    """Each id in exactly one piece, sequences without gaps; returns the padding and all tokens."""
    ids = Tokenizer.from_file(PATH)
    full = [(d, [*ids.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs]
    want = defaultdict(int)
    got = defaultdict(int)
    for d, x in full:
        want[d] += len(x)
    for r in rows:
        got[r.doc_id] += r.length
        assert r.length >= 1 and r.start >= 0
    assert got == want
    by_doc = defaultdict(list)
    for d, x in full:
        by_doc[d].append(np.array(x, "<u4"))
    for r in rows:
        assert any(
            len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            for x in by_doc[r.doc_id]
        )
    for d, x in by_doc.items():
        if len(x) == 1:
            mine = sorted((r.start, r.length) for r in rows if r.doc_id == d)
            assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
        n = s[-1][0] + s[-1][1]
        assert n <= tokens
        padding += 0 if n & (n - 1) == 0 else tokens - n
    return padding, sum(want.values())


def test_query_places_each_token_once(spark, some_docs, sf_small):
    rows = QUERIES["op6_packing"](spark, sf_small).collect()
    padding, total = check(rows, [(r.doc_id, r.text) for r in some_docs.collect()])
    assert padding <= 0.002 * total


def test_edges_and_clashing_columns(odd_docs, edge_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert packing.pack_documents(edge_docs.where("false"), PATH).collect() == []


def test_ids_come_along(some_docs):
    rows = packing.pack_documents(some_docs, PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limits", [{}, {"segments": 4}, {"loss": 300}, {"segments": 3, "loss": 500, "pool": 5}])
def test_limits_hold_together(seed, limits):
    rng = np.random.default_rng(seed)
    packer = packing.Packer(pool=limits.pop("pool", 16), **limits) if limits else packing.Packer(pool=16)
    examples = []
    for k in range(150):
        n = int(rng.integers(1, 60 if k % 9 else 3000))
        examples.append(packing.Example(k, np.arange(n, dtype=np.uint32), rng.random(n) < 0.6))
    for e in examples:
        packer.add(e)
    packer.finish()
    pieces = packer.drain()
    count = defaultdict(lambda: np.zeros(3))
    for p in pieces:
        count[p.sequence] += (p.length, 1, np.count_nonzero(p.example.loss[p.start : p.start + p.length]))
    assert all((c <= packer.limits).all() for c in count.values())
    for e in examples:
        mine = sorted((p.start, p.length) for p in pieces if p.example.key == e.key)
        assert mine[0][0] == 0 and sum(n for _, n in mine) == len(e.ids)
    if not limits:
        assert all(c[0] == 1024 or int(c[0]) & (int(c[0]) - 1) == 0 for c in count.values())
