import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from answerframe.llm import alignment
from answerframe.llm.queries import QUERIES
from tokenizers import Tokenizer

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain_tokens():
    first, second = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    first.encode_special_tokens = True

    def tokens(text):
        """(id, start, end) of the tokens of A and of B, by the libraries' own offsets and pieces."""
        letters = alignment.byte_alphabet()
        a = [(t.ids, t.tokens) for t in [first.encode(" " + text, add_special_tokens=False)]][0]
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(*a, strict=True)]
        b = []
        for i in second.encode(text):
            p = second.id_to_piece(i)
            byte = len(p) == 6 and p.startswith("<0x") and p.endswith(">")
            b.append((i, bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode()))
        if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            return [], []
        out = []
        for side in (a, b):
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    return tokens


def brute(rows, tokens):
    """All measures by comparing every token of A with every token of B."""
    found, counts = [], Counter()
    for d, text in rows:
        a, b = tokens(text) if text else ([], [])
        links = [(i, j) for i, x, y in a for j, s, t in b if max(x, s) < min(y, t)]
        both = sorted({y for _, _, y in a} & {t for _, _, t in b})
        groups, at = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, x, y in side if at <= x and y <= end) for side in (a, b)))
            at = end
        counts.update(set(links))
        found.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    out = [
        (d, a, b, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(w.encode()).hexdigest() if w else "")
        for d, a, b, g, links, w in found
    ]
    return sorted(out, key=repr), counts


ODD = [
    "a", " a", "a ", "  two  blanks ", "\n\n\tlines\r\n", "été naïve 漢字 😀👩‍👩‍👧", "▁ taken for a blank", "x▁y", "<|endoftext|> plain",
    "<s> and </s> <unk> <0x41>", " odd blank​", "\x00nul\x00", "!!!???...---", "1234567890" * 5, "ﬁ ligature ① ½", "aaaaaaaaaaaaaaaaaaaaaaaaa", "naïve", "don't can't I'll",
]


def check(out, rows, tokens):
    want, counts = brute(rows, tokens)
    assert out.documents.columns == NAMES
    assert sorted(map(tuple, out.documents.collect()), key=repr) == want
    assert {(r.a_id, r.b_id): r["count"] for r in out.pairs.collect()} == dict(counts)


@pytest.mark.parametrize("head", [400_000, 3, 1])
def test_equals_brute_force(make, some_docs, plain_tokens, monkeypatch, head):
    """Odd and repeated texts; few or most pairs broadcast; hot texts cut into copies."""
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    monkeypatch.setattr("answerframe.llm.common.HOT_KEYS", 4)
    rows = [(r.doc_id, r.text[:700]) for r in some_docs.orderBy("doc_id").limit(25).collect()]
    rows += list(enumerate(ODD, 1000)) + [(2000 + k, "a copy of a text") for k in range(30)]
    rows += [(3000, None), (3001, ""), (None, "no id"), (None, "no id"), (3002, "one"), (3002, "one")]
    check(alignment.align_documents(make(rows), *FILES), rows, plain_tokens)


def test_query_equals_brute_force_without_links(spark, sf_small, some_docs, plain_tokens):
    """Every document of the small table, measured from its token ends alone."""
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, sf_small).collect()}
    assert set(got) == set(texts)
    for d in sorted(texts)[::7]:
        a, b = plain_tokens(texts[d])
        ends = [{e for _, _, e in side} for side in (a, b)]
        assert (got[d].n_a, got[d].n_b) == (len(a), len(b))
        assert (got[d].n_groups, got[d].n_links) == (len(ends[0] & ends[1]), len(ends[0] | ends[1]))
        assert 0 < got[d].n_best <= got[d].n_links <= got[d].count_sum


def test_groups_long_texts_and_other_columns(edge_docs, odd_docs, make):
    plain = alignment.align_documents(edge_docs, *FILES).documents
    odd = alignment.align_documents(odd_docs, *FILES, with_groups=True).documents
    key = lambda r: repr(r[:8])
    odd = sorted(odd.collect(), key=key)
    assert [r[:8] for r in odd] == [tuple(r) for r in sorted(plain.collect(), key=key)]
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in odd if r.groups)
    long = "wordy text and more " * 60_000  # longer than what is handled at once
    [r] = alignment.align_documents(make([(1, long)]), *FILES).documents.collect()
    assert r.n_groups > 0 and r.count_sum == r.n_links


def test_empty_tables(edge_docs):
    none = alignment.align_documents(edge_docs.where("false"), *FILES)
    assert none.documents.collect() == [] and none.pairs.collect() == []
    nulls = alignment.align_documents(edge_docs.where("text IS NULL"), *FILES)
    assert [tuple(r) for r in nulls.documents.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
