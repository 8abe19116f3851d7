"""Document fingerprints by consistent weighted sampling.

A text is its lower-cased words, each weighted by how often it occurs. For each of ``SAMPLES`` sample numbers and each
word, random variables that depend on the word and the number alone are drawn: ``r`` and ``c`` from Gamma(2, 1) and
``b`` from the uniform distribution. With ``t = floor(ln w / r + b)`` the word's value is ``c exp(-r (t - b) - r)``; the word with the
smallest value is the sample, together with its ``t``. Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones.

``r b`` and ``r (1 - b)`` are two independent exponentials, so they are drawn in place of ``r`` and ``b``: with uniform
``u`` and ``v``, ``r = -ln(u v)``, ``r b = -ln u``, and the value is ``c v exp(-r t)``. A word that occurs once has ``t = 0``.

A value and its sample are kept as one 64-bit number (the positive value's bits in the upper half), so the
smallest number of a text's words is its sample. Numbers of a (word, weight) are made once and reused.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import doubles, longs, partitions_for, pick, strings

SAMPLES = 128
#: (word, weight) pairs whose numbers a task keeps.
TABLE_ROWS = 49_152
#: Pairs of a text compared at once.
PAIRS_AT_ONCE = 8_192
EMPTY = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)


def mix32(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of each unsigned 32-bit number, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def uniform(bits: np.ndarray) -> np.ndarray:
    """The upper 24 of 32 random bits as a number in (0, 1)."""
    bits >>= np.uint32(8)
    out = bits.astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-24)
    return out


def sample_numbers(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """``len(words) x SAMPLES`` numbers: value in the upper, word and ``t`` hashed in the lower 32 bits."""
    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    low, high = ids.astype(np.uint32)[:, None], (ids >> np.uint64(32)).astype(np.uint32)[:, None]
    turn = np.arange(1, SAMPLES + 1, dtype=np.uint32)[None, :] * np.uint32(0x9E3779B9)
    base = mix32(low + turn)
    base ^= high
    draw = lambda k, of: uniform(mix32(of + np.uint32(k * 0x632BE5AB & 0xFFFFFFFF)))
    v = draw(0, base)
    value = draw(1, base)
    value *= draw(2, base)
    np.log(value, out=value)
    value *= v
    np.negative(value, out=value)
    t = np.zeros((len(words), 1), np.uint32)
    more = np.flatnonzero(weights > 1)
    if len(more):
        u = draw(3, base[more])
        r = -np.log(u * v[more])
        steps = np.floor((np.log(weights[more]).astype(np.float32)[:, None] - np.log(u)) / r)
        value[more] *= np.exp(-r * steps)
        t = np.zeros(value.shape, np.uint32)
        t[more] = steps.astype(np.uint32)
    sample = mix32(mix32(low ^ (t * np.uint32(0x9E3779B9))) ^ high)
    out = value.view(np.uint32).astype(np.uint64)
    out <<= np.uint64(32)
    out |= sample
    return out


class Sampler:
    """Fingerprints of texts; numbers of (word, weight) pairs are kept in a table of bounded size."""

    def __init__(self):
        self.table = np.zeros((TABLE_ROWS, SAMPLES), np.uint64)
        self.rows: dict[tuple[bytes, int], int] = {}

    def _places(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        new = [p for p in pairs if p not in self.rows]
        if len(self.rows) + len(new) > TABLE_ROWS:
            self.rows, new = {}, pairs
        if new:
            first = len(self.rows)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            made = sample_numbers([w for w, _ in new], np.array([n for _, n in new], float))
            self.table[first : first + len(new)] = made
        return np.fromiter(map(self.rows.__getitem__, pairs), np.int64, len(pairs))

    def __call__(self, text: str) -> np.ndarray:
        """``SAMPLES`` 32-bit samples; all ones for a text without a word."""
        pairs = list(Counter(text.lower().encode("utf-8", "surrogatepass").split()).items())
        if not pairs:
            return EMPTY
        best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(pairs), PAIRS_AT_ONCE):
            found = self.table[self._places(pairs[a : a + PAIRS_AT_ONCE])].min(axis=0)
            best = np.minimum(best, found)
        return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an unbiased estimate of the generalised Jaccard similarity."""
    return float(np.mean(a == b))


def digits(samples: np.ndarray) -> str:
    return samples.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[list]], schema: str) -> DataFrame:
    """Apply ``fn`` to (id, text, next text) of all rows in the order of (id, text); the last row meets the first.

    Ids are cut into ranges of about equal numbers of rows; the first row of a range is also sent to the range before it.
    So the texts are shuffled once, and a task streams through its sorted ranges.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)))  # nulls come first
    rows = pick(docs, "doc_id", "text").select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions_for(rows)
    ids = rows.select("key").repartitionByRange(parts, "key")
    lows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low"))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort([r["low"] for r in lows.collect()]).astype(np.int64))
    n = max(1, len(shared.value))

    @pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        """Twice the range's number, one more for a row that begins its range."""
        starts, values = shared.value, key.to_numpy(np.int64)
        at = np.searchsorted(starts, values, "right") - 1
        return pd.Series(2 * at + (starts[at] == values))

    own = rows.withColumn("place", place("key")).select(
        "doc_id", "key", "text", F.expr("CAST(place DIV 2 AS INT)").alias("range"), (F.col("place") % 2).alias("begins")
    )
    turns = F.when(F.col("begins") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = own.select("*", F.explode(turns).alias("guest")).select(
        "doc_id", "key", "text", ((F.col("range") + F.lit(n) - F.col("guest")) % n).cast("int").alias("range"), "guest"
    )
    sorted_ = both.repartitionById(n, "range").sortWithinPartitions("range", "guest", "key", "text")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        def pairs():
            held = None
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest"))
                for row in zip(*columns, strict=True):
                    if held is not None and held[2] == row[2]:
                        yield held[0], held[1], row[1]
                    held = None if row[3] else row

        for columns in fn(pairs()):
            yield pa.RecordBatch.from_arrays(columns, names)

    return sorted_.mapInArrow(run, schema)


FIELDS = {
    "doc_id": longs,
    "n_chars": longs,
    "edited_sha256": strings,
    "fingerprint": strings,
    "edited_fingerprint": strings,
    "near_edited": doubles,
    "near_next": doubles,
}


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of each row's whole text; null counts as empty, and empty texts are all alike."""

    def run(batches):
        sampler = Sampler()
        for batch in batches:
            made = [digits(sampler(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), strings(made)], ["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to it and to the next document.

    Rows are ordered by id (nulls first), rows of one id by text. A table of one row has itself as the next one.
    """

    def run(pairs):
        sampler, rows, size = Sampler(), [], 0
        text, own = None, None
        for id_, now, following in pairs:
            own = sampler(now) if text is None or now != text else own
            changed = edited(now, following)
            other, after = sampler(changed), sampler(following)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((id_, len(now), digest, digits(own), digits(other), likeness(own, other), likeness(own, after)))
            text, own = following, after
            size += 1
            if size >= 500:
                yield [make(c) for make, c in zip(FIELDS.values(), zip(*rows, strict=True), strict=True)]
                rows, size = [], 0
        if rows:
            yield [make(c) for make, c in zip(FIELDS.values(), zip(*rows, strict=True), strict=True)]

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs, run, schema)
