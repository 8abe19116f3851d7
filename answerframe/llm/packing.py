"""Packing token sequences by vector bin packing.

A piece of an example has three sizes: tokens, segments (one) and loss-bearing tokens. A sequence has a limit on each. Full
sequences are cut off the front of long examples. The remainders wait in a pool of bounded size, and the
open sequence takes the one with the largest dot product of its sizes with the room that is left, among those that fit. If none
fits, a remainder is cut so that it fills the room. Sequences are padded to the token limit, except those
whose length is a power of two; so the few tokens that a task has left at its end are cut into powers of two and need no padding.

A task packs the examples it has read, in its own order, without any shuffle. A sequence's number is the task's
number and a running number, so a task that is run again gives the same sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, pick

TOKENS = 1024
#: Segments a sequence may hold.
SEGMENTS = 256
#: Remainders that wait for a place.
POOL = 512
SEPARATOR = 0
# Fixed value: how byte-level tokenizers cut a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK_AHEAD = r"\s+(?!\S)|"
TWO_BLANKS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: Blanks that regular-expression engines do not agree on.
ODD_BLANKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Blanks in a row from which on a text goes through the library: ``tiktoken`` gives up on runs of about a million.
LONG_RUN = 100_000
BLANKS = re.compile(r"[ \t\n\r]+")
TASK_BITS = 40


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` blanks meet; looks at each run once."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text))


class TextTokenizer:
    """Token ids of whole texts under a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary and merges are handed to the faster merge loop of ``tiktoken``, which gives the same ids if
    merges are numbered in their order. Texts with a special token's string, an unusual blank or a very long run of
    blanks, and all texts of a file of another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast, self.special = _merge_loop(json.load(file))

    def _loop(self, text: str):
        """The merge loop for a text: with a simpler split if no blanks meet; None if the library must do it."""
        if self.fast is None or ODD_BLANKS.search(text) or any(s in text for s in self.special):
            return None
        single, general = self.fast
        if not any(pair in text for pair in TWO_BLANKS) and text.strip() == text:
            return single
        return None if has_long_run(text) else general

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        loops = [self._loop(t) for t in texts]
        rest = [t for t, loop in zip(texts, loops, strict=True) if loop is None]
        whole = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [
            np.array(next(whole).ids, np.uint32) if loop is None else loop.encode_to_numpy(t, disallowed_special=())
            for t, loop in zip(texts, loops, strict=True)
        ]


def _merge_loop(spec: dict):
    """Two ``tiktoken`` encodings of the same vocabulary and the special strings; None if the file is of another kind.

    The first one is for texts in which every blank stands alone: looking ahead then changes nothing.
    """
    import tiktoken

    special = [t["content"] for t in spec.get("added_tokens", [])]
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not usual or model.get("type") != "BPE" or spec.get("normalizer") or model.get("dropout"):
        return None, special
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None, special
    # byte-level files write printable bytes as themselves and the others, in order, from code point 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in special}
    patterns = SPLIT.replace(LOOK_AHEAD, ""), SPLIT
    return tuple(tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in patterns), special


@dataclass
class Example:
    key: int | None
    ids: np.ndarray
    loss: np.ndarray  # whether each token bears loss
    start: int = 0
    end: int | None = None

    def __post_init__(self):
        self.end = len(self.ids) if self.end is None else self.end

    def __len__(self) -> int:
        return self.end - self.start


@dataclass
class Piece:
    example: Example
    start: int
    length: int
    sequence: int
    offset: int

    @property
    def ids(self) -> np.ndarray:
        return self.example.ids[self.start : self.start + self.length]


class Packer:
    """Places examples into sequences under limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.tokens, self.pool_size = tokens, pool
        self.pool: list[Example] = []
        self.demand = np.zeros((pool + 2, 3))  # sizes of what waits, one row each
        self.relative = np.zeros((pool + 2, 3))  # the same as shares of the limits
        self.sequence = 0
        self.room = self.limits.copy()
        self.offset = 0
        self.open: list[Piece] = []
        self.closed: list[Piece] = []

    def drain(self) -> list[Piece]:
        """The pieces of the sequences that were closed since the last call."""
        out, self.closed = self.closed, []
        return out

    def _next(self) -> None:
        self.closed += self.open
        self.open = []
        self.sequence += 1
        self.offset, self.room = 0, self.limits.copy()

    def _place(self, e: Example, length: int) -> None:
        self.open.append(Piece(e, e.start, length, self.sequence, self.offset))
        self.room -= (length, 1, np.count_nonzero(e.loss[e.start : e.start + length]))
        self.offset += length
        e.start += length
        if self.room[0] < 1 or self.room[1] < 1:
            self._next()

    def _fits(self, e: Example, most: int) -> int:
        """Tokens of the example, ``most`` at most, that the room takes."""
        n = int(min(len(e), most, self.room[0]))
        if n and np.count_nonzero(e.loss[e.start : e.start + n]) > self.room[2]:
            n = int(np.searchsorted(np.cumsum(e.loss[e.start : e.start + n]), self.room[2], "right"))
        return n

    def add(self, example: Example) -> None:
        """Cut full sequences off, keep the remainder waiting; place one if the pool is full."""
        while len(example) >= self.tokens:
            n = self._fits(example, self.tokens)
            if n:
                self._place(example, n)
            else:
                self._next()
        if len(example):
            self._measure(len(self.pool), example)
            self.pool.append(example)
        while len(self.pool) > self.pool_size:
            self._take()

    def _measure(self, at: int, e: Example) -> None:
        self.demand[at] = len(e), 1, np.count_nonzero(e.loss[e.start : e.end])
        self.relative[at] = self.demand[at] / self.limits

    def _take(self) -> None:
        """Place the waiting example with the largest dot product, or a cut of the largest one."""
        n = len(self.pool)
        demand = self.demand[:n]
        product = self.relative[:n] @ (self.room / self.limits)
        product[(demand > self.room).any(axis=1)] = -1
        best = int(product.argmax())
        if product[best] < 0:
            best = int(demand[:, 0].argmax())
        e = self.pool[best]
        k = self._fits(e, self.tokens)
        if not k:
            self._next()
            k = self._fits(e, self.tokens)
        self._place(e, k)
        if len(e):
            self._measure(best, e)
        else:
            last = self.pool.pop()
            if best < n - 1:
                self.pool[best] = last
                self.demand[best], self.relative[best] = self.demand[n - 1], self.relative[n - 1]

    def finish(self) -> None:
        """Place what waits; the last open sequence is cut anew into sequences with powers of two for lengths."""
        while self.pool:
            self._take()
        left = deque(Example(p.example.key, p.example.ids, p.example.loss, p.start, p.start + p.length) for p in self.open)
        self.open, self.offset, self.room = [], 0, self.limits.copy()
        while left:
            wanted = 1 << (sum(map(len, left)).bit_length() - 1)
            while wanted and left:
                n = self._fits(left[0], wanted)
                if not n:  # another limit is met first
                    break
                at = self.sequence
                self._place(left[0], n)
                wanted -= n
                if not len(left[0]):
                    left.popleft()
                if self.sequence != at:
                    break
            if self.offset:
                self._next()


def examples(rows: list[tuple[int | None, str]], tokenizer: TextTokenizer) -> Iterator[Example]:
    """Tokenised texts, each followed by the separator, which bears no loss."""
    for (key, _), ids in zip(rows, tokenizer([t for _, t in rows]), strict=True):
        loss = np.ones(len(ids) + 1, bool)
        loss[-1] = False
        yield Example(key, np.append(ids, np.uint32(SEPARATOR)), loss)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False, **limits) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    ``vocabulary`` is a tokenizer file that every executor has. Each document, a null text as an empty one, ends
    with id 0, so it has one token at least. Repeated rows are documents of their own.
    """

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        tokenizer, packer = TextTokenizer(vocabulary), Packer(**limits)
        task = TaskContext.get().partitionId() << TASK_BITS

        def made(pieces: list[Piece]) -> pa.RecordBatch:
            ids = [p.ids.astype("<u4") for p in pieces]
            columns = [
                [p.example.key for p in pieces],
                [p.start for p in pieces],
                [p.length for p in pieces],
                [zlib.crc32(i.tobytes()) for i in ids],
                [len(p.example.ids) for p in pieces],
                [task + p.sequence for p in pieces],
                [p.offset for p in pieces],
            ]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(k, t or "") for k, t in zip(keys, texts, strict=True)]
            for a, b in blocks([len(t) for _, t in rows]):
                for e in examples(rows[a:b], tokenizer):
                    packer.add(e)
                yield made(packer.drain())
        packer.finish()
        yield made(packer.drain())

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
