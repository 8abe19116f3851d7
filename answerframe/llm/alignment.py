"""Alignment of two tokenizers' tokens over the same bytes.

A text is split by a byte-level BPE file (A, over a space and the text) and by a SentencePiece model (B, which adds that
space itself). Both splits cover the same bytes. Offsets at which tokens of both end cut them into groups, and each stretch
between two neighbouring token ends of either kind lies in exactly one token of A and one of B: it is a link. So the links
of a text are the distinct token ends, found by marking bytes.

Texts are shuffled whole and equal ones meet, so each distinct text is tokenised once, however often it occurs. A text's
linked id pairs are stored once with its number of occurrences, which weighs the pairs' document counts. Counts go back to the texts
in two ways. Pairs that each hold 1/``HEAD_PAIRS`` of all cells (text, pair) are few by definition; they are broadcast
and settled where the cells lie. Cells of the other pairs, none of which is hot, are shuffled to the table of counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import blocks, join_counted, longs, pick, share, stored, strings
from .packing import TextTokenizer

#: Pairs whose counts are broadcast, at most (17 bytes each).
HEAD_PAIRS = 400_000


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers and the bytes of their tokens. Special tokens' strings in a text are plain text."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        self.first = TextTokenizer(vocabulary)
        self.first.tokenizer.encode_special_tokens = True
        self.first.special = []
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        vocab = self.first.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(n)]
        self.n = n

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    @property
    def pair_base(self) -> int:
        """The pair of ids a and b has the number ``a * pair_base + b``."""
        return len(self.bytes_b)

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text; none where the bytes of either are not those of a space and the text."""
        first = self.first([" " + t for t in texts])
        second = [np.array(x, np.int64) for x in self.second.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            same = t and all(
                b"".join(map(table.__getitem__, ids[k].tolist())) == whole
                for table, ids in ((self.bytes_a, first), (self.bytes_b, second))
            )
            if not same:
                first[k] = second[k] = none
        return first, second

    def align(self, texts: list[str]) -> Aligned:
        first, second = self.ids(texts)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (first, second))
        a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64) for ids in (first, second))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        at = np.flatnonzero(mark)
        in_a, in_b, both = mark[at] & 1, mark[at] >> 1, mark[at] == 3
        i, j = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
        owner = np.repeat(np.arange(len(texts)), n_a)[i]
        groups = np.bincount(owner[both], minlength=len(texts))
        links = np.bincount(owner, minlength=len(texts))
        # distinct pairs of each text, with how often they are linked in it
        pair, size = a[i] * self.pair_base + b[j], len(self.bytes_a) * self.pair_base
        cells, times = np.unique(owner * size + pair, return_counts=True)
        cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * size)
        # tokens in the order in which groups are written
        group_ends = at[both]
        of_a, of_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        before_a = np.concatenate(([0], np.cumsum(np.bincount(of_a, minlength=len(group_ends)))))
        before_b = np.concatenate(([0], np.cumsum(np.bincount(of_b, minlength=len(group_ends)))))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[of_a]] = a + self.n * (mark[ends_a] == 3)
        order[np.arange(len(b)) + before_a[of_b + 1]] = b + 2 * self.n * (mark[ends_b] == 3)
        stops = np.cumsum(n_a + n_b)
        written = [
            b"".join(map(self.written.__getitem__, order[k - m : k].tolist()))[:-1]
            for k, m in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)
        ]
        return Aligned(n_a, n_b, groups, links, written, cells % size, times, cuts)


@dataclass
class Aligned:
    """Measures of some texts; the pairs of text k and how often each is linked are those from ``cuts[k]`` to ``cuts[k + 1]``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray
    times: np.ndarray
    cuts: np.ndarray


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def aligned_texts(texts: DataFrame, vocabulary: str, pieces: str, with_groups: bool) -> DataFrame:
    """Measures and linked pairs of each row of ``text, n``, which are distinct texts; ``key`` is the text's SHA-256."""

    def run(batches):
        aligner = Aligner(vocabulary, pieces)
        for batch in batches:
            every, n = batch.column(0).to_pylist(), batch.column(1)
            for x, y in blocks([len(t) for t in every]):
                found = aligner.align(every[x:y])
                columns = [
                    pa.array([hashlib.sha256(t.encode()).digest() for t in every[x:y]], pa.binary()),
                    n.slice(x, y - x),
                    *(longs(getattr(found, c)) for c in COUNTS),
                    strings([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]),
                    lists(found.pairs, found.cuts, pa.int64()),
                    lists(found.times, found.cuts, pa.int64()),
                ]
                if with_groups:
                    columns.append(strings([g.decode() for g in found.groups]))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key binary, n long, " + ", ".join(f"{c} long" for c in COUNTS)
    schema += ", groups_sha256 string, pairs array<long>, times array<long>" + (", groups string" if with_groups else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return texts.mapInArrow(run, schema)


def head_measures(texts: DataFrame, head: DataFrame) -> DataFrame:
    """``texts`` with ``n_best, count_sum`` over the pairs in ``head``; ``pairs, times`` keep the others."""
    table = head.select("pair", "count", "best").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    shared = share(texts.sparkSession, tuple(table.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
    kept = [c for c in texts.columns if c not in ("pairs", "times")]

    def run(batches):
        pair, count, best = shared()
        for batch in batches:
            lists_ = batch.column(len(kept))
            flat, times = lists_.flatten().to_numpy(), batch.column(len(kept) + 1).flatten().to_numpy()
            cuts = np.concatenate(([0], np.cumsum(lists_.value_lengths().to_numpy())))
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            found = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            at = at[found]
            upto = np.concatenate(([0], np.cumsum(found)))[cuts]
            total = np.concatenate(([0], np.cumsum(count[at] * times[found])))
            good = np.concatenate(([0], np.cumsum(best[at] * times[found])))
            rest = (cuts - upto, ~found)
            columns = [
                *batch.columns[: len(kept)],
                longs(np.diff(good[upto])),
                longs(np.diff(total[upto])),
                lists(flat[rest[1]], rest[0], pa.int64()),
                lists(times[rest[1]], rest[0], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [f"{c} {k}" for c, k in texts.dtypes if c in kept]
    schema = ", ".join([*kinds, "n_best long", "count_sum long", "pairs array<long>", "times array<long>"])
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return texts.select(*kept, "pairs", "times").mapInArrow(run, schema)


@dataclass
class Alignment:
    """``pairs``: ``a_id, b_id, count`` of each linked id pair, and whether the count is the highest of its ``a_id``;
    ``documents``: the measures of each row."""

    pairs: DataFrame
    documents: DataFrame


def align_documents(docs: DataFrame, vocabulary: str, pieces: str, with_groups: bool = False) -> Alignment:
    """Align both tokenizers over every whole text of ``docs`` (``doc_id, text``).

    Measures of a row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, if asked for, ``groups``
    as they are hashed. ``n_best`` are links whose pair's count, ties included, is the highest of its id of A; ``count_sum`` adds
    the counts of all links. A pair's count is the number of rows with it, so copies and repeated rows count each; a row
    with a null id is a row like any other. Texts that are null or empty, and those that a tokenizer cannot give
    back byte by byte (as with U+2581), have no tokens: zeros and ''. A text of any length is aligned whole, in
    memory in proportion to its length. An empty table gives empty ones. Other columns are not looked at.

    ``vocabulary`` (``tokenizers``) and ``pieces`` (SentencePiece) are files that every executor has.
    """
    rows = pick(docs, "doc_id", "text")
    whole = rows.where("text != ''")
    texts = whole.groupBy("text").agg(F.count("*").alias("n"))
    made = aligned_texts(texts, vocabulary, pieces, with_groups)
    made = stored(made.withColumn("text_no", F.monotonically_increasing_id()))
    base = Aligner(vocabulary, pieces).pair_base

    cells = made.select("n", F.explode("pairs").alias("pair"))
    counts = cells.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("cells"))
    counts = checkpoint(counts.withColumn("a_id", F.expr(f"pair div {base}")))
    # one row an id of A: never more than its vocabulary has
    highest = counts.groupBy("a_id").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "a_id").withColumn("best", F.col("count") == F.col("highest"))
    counts = checkpoint(counts.select("pair", "count", "cells", "best"))
    total = counts.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    hot = F.col("cells") * HEAD_PAIRS >= total

    settled = stored(head_measures(made, counts.where(hot)))
    rest = settled.select("text_no", F.explode(F.arrays_zip("pairs", "times")).alias("c")).select("text_no", "c.pairs", "c.times")
    found = rest.join(counts.where(~hot).withColumnRenamed("pair", "pairs"), "pairs")
    more = found.groupBy("text_no").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("count") * F.col("times")).alias("more_sum"),
    )
    zero = F.lit(0).cast("long")
    names = [*COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    measured = settled.drop("pairs", "times").join(more, "text_no", "left")
    measured = measured.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", zero))
    measured = measured.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", zero))
    measured = stored(measured.select("key", "n", *names))
    keyed = whole.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    with_text = join_counted(keyed, measured, "key", "n").select("doc_id", *names)
    blank = [F.lit("").alias(c) if c.startswith("groups") else zero.alias(c) for c in names]
    without = rows.where("text IS NULL OR text = ''").select("doc_id", *blank)
    ids = counts.select(F.expr(f"pair div {base}").alias("a_id"), F.expr(f"pair % {base}").alias("b_id"), "count", "best")
    return Alignment(ids, with_text.unionByName(without))
