"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

The reference-count table holds, for each line key, in how many documents it occurs. Keys are 128-bit
hashes of the stripped lower-cased line. Adding documents adds their counts, deleting documents subtracts
them, so any history of insertions and deletions leaves the table a fresh count would give.

The keys at or above the threshold are inserted into cuckoo filters, one for each hash shard, with 32-bit
fingerprints. A filter may also answer yes for a rarer key. Every key that occurs is in the exact table,
so those rare keys are found by probing the table once; this short list of exceptions makes the
filters' answer exact. A document pass then needs no shuffle. Filters are kept with a deletion and
an insertion for each key that crosses the threshold.

Filters and exceptions are broadcast only if the number of bytes they take, counted first, is below a
bound; beyond it lines meet the exact table in a join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import longs, map_arrow, pick, strings, with_private_names

BLANKS = " \t\n\x0b\x0c\r"
UPPER_TO_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SLOTS = 4
MAX_KICKS = 500
SHARD_KEYS = 200_000
SALTS = 16
#: Bytes of filters and exceptions that may be broadcast.
MAX_BROADCAST = 48_000_000
KEY = ["hi", "lo"]


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else [""]


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(UPPER_TO_LOWER)


def hashes(lines: list[str], min_chars: int = 1) -> list[int | None]:
    """128-bit key of each line; None for a key of fewer than ``min_chars`` code points."""
    digest = xxhash.xxh3_128_intdigest
    keys = [line_key(x) for x in lines]
    return [digest(k.encode("utf-8", "surrogatepass")) if len(k) >= min_chars else None for k in keys]


class CuckooFilter:
    """Set of 64-bit numbers pairs with insert, delete and contains; four slots of 32 bits a bucket."""

    def __init__(self, capacity: int):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.slots = np.zeros((buckets, SLOTS), np.uint32)

    def _place(self, hi: int, lo: int) -> tuple[int, int, int]:
        mask = len(self.slots) - 1
        mark = (int(hi) & 0xFFFFFFFF) or 1
        first = int(lo) & mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (len(self.slots) - 1))

    def insert(self, hi: int, lo: int) -> None:
        mark, a, b = self._place(hi, lo)
        for k in (a, b):
            free = np.flatnonzero(self.slots[k] == 0)
            if len(free):
                self.slots[k, free[0]] = mark
                return
        k = b
        for turn in range(MAX_KICKS):
            place = (mark + turn) % SLOTS
            mark, self.slots[k, place] = int(self.slots[k, place]), mark
            k = self._other(k, mark)
            free = np.flatnonzero(self.slots[k] == 0)
            if len(free):
                self.slots[k, free[0]] = mark
                return
        raise OverflowError("the filter is full; build the shard anew with a larger capacity")

    def delete(self, hi: int, lo: int) -> bool:
        mark, a, b = self._place(hi, lo)
        for k in (a, b):
            found = np.flatnonzero(self.slots[k] == mark)
            if len(found):
                self.slots[k, found[0]] = 0
                return True
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        mark = (hi.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        mark[mark == 0] = 1
        first = lo.astype(np.uint64) & mask
        other = first ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & mask)
        rows = self.slots[first.astype(np.int64)], self.slots[other.astype(np.int64)]
        return (rows[0] == mark[:, None]).any(axis=1) | (rows[1] == mark[:, None]).any(axis=1)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        new = cls.__new__(cls)
        new.slots = np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy()
        return new


def filled(pairs: list[tuple[int, int]]) -> CuckooFilter:
    """A filter holding the pairs; doubled in size until they all find a place."""
    capacity = len(pairs)
    while True:
        out = CuckooFilter(capacity)
        try:
            for hi, lo in pairs:
                out.insert(hi, lo)
            return out
        except OverflowError:
            capacity = 2 * capacity + SLOTS


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``hi, lo, n_docs``: each line key and in how many rows of ``docs`` it occurs.

    Tasks add up their own documents before the shuffle, so a line found everywhere is one row a batch.
    """

    def run(batch):
        seen = Counter()
        for text in batch.column(0).to_pylist():
            seen.update({*hashes(split_lines(text), min_chars)} - {None})
        hi, lo = halves(seen)
        return [longs(hi), longs(lo), longs(list(seen.values()))]

    rows = map_arrow(pick(docs, "text"), run, "hi long, lo long, n_docs long")
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"))


def halves(keys) -> tuple[np.ndarray, np.ndarray]:
    """The two signed 64-bit halves of 128-bit keys."""
    data = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in keys), "<i8").reshape(-1, 2)
    return data[:, 1], data[:, 0]


def whole(hi: int, lo: int) -> int:
    return (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1


def _shard(n_shards: int):
    return F.pmod(F.shiftright("hi", 32), F.lit(n_shards))


@dataclass
class LineIndex:
    """Reference counts and filters; every change returns a new index.

    ``counts`` is ``hi, lo, n_docs`` with positive counts. ``filters`` is ``shard, n_keys, cuckoo``, one row for
    each shard that has a frequent key.
    """

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    n_shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        return cls._of(checkpoint(line_counts(docs, min_chars)), min_docs, min_chars)

    @classmethod
    def _of(cls, counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        hot = counts.where(F.col("n_docs") >= min_docs)
        n_shards = 1 + hot.count() // SHARD_KEYS
        return cls(counts, checkpoint(_make_filters(hot, n_shards)), min_docs, min_chars, n_shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents inserted before; the rest is as if they had never been there."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        part = line_counts(docs, self.min_chars)
        both = self.counts.select(*KEY, "n_docs", F.lit(0).cast("long").alias("change")).unionByName(
            part.select(*KEY, F.lit(0).cast("long").alias("n_docs"), (sign * F.col("n_docs")).alias("change"))
        )
        merged = checkpoint(
            both.groupBy(*KEY).agg(F.sum("n_docs").alias("before"), F.sum("change").alias("change"))
        )
        after = F.col("before") + F.col("change")
        counts = merged.select(*KEY, after.alias("n_docs")).where("n_docs > 0")
        was, now = F.col("before") >= self.min_docs, after >= self.min_docs
        crossed = merged.where(was != now).select(_shard(self.n_shards).alias("shard"), *KEY, now.alias("add"))
        filters = checkpoint(_change_filters(self.filters, crossed))
        if filters.where("cuckoo IS NULL").limit(1).count():  # a shard is full
            return LineIndex._of(counts, self.min_docs, self.min_chars)
        return LineIndex(counts, filters, self.min_docs, self.min_chars, self.n_shards)

    def apply(self, docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
        """``docs`` with frequent lines removed from ``text``; adds ``n_lines`` and ``n_dropped`` as last columns.

        Other columns stay, also those named like the new ones. A null or empty text is one
        empty line, which has no key and stays. Repeated rows count as so many documents.
        """
        size = self.filters.agg(F.coalesce(F.sum(F.length("cuckoo")), F.lit(0))).first()[0]
        if size > max_broadcast:
            return self._apply_by_join(docs)
        context = docs.sparkSession.sparkContext
        held = {r["shard"]: bytes(r["cuckoo"]) for r in self.filters.collect()}
        filters, n_shards, min_chars = context.broadcast(held), self.n_shards, self.min_chars
        rare = self.counts.where(F.col("n_docs") < self.min_docs).select(*KEY)
        mistaken = checkpoint(_passing(rare, filters, n_shards))
        if 100 * mistaken.count() + size > max_broadcast:
            return self._apply_by_join(docs)
        wrong = context.broadcast({whole(r["hi"], r["lo"]) for r in mistaken.collect()})

        def frequent_of(known: dict[int, bool], keys: list[list[int | None]]):
            new = list({h for k in keys for h in k} - {None} - known.keys())
            if new:
                hi, lo = halves(new)
                found = in_filters(hi, lo, _loaded(filters), n_shards)
                known.update(zip(new, (bool(f) and k not in wrong.value for f, k in zip(found, new, strict=True)), strict=True))
            return [{h for h in k if h is not None and known[h]} for k in keys]

        return _drop_lines(docs, frequent_of, min_chars)

    def _apply_by_join(self, docs: DataFrame) -> DataFrame:
        """The same result for more frequent keys than a broadcast may hold.

        Distinct keys of a document meet the exact table; only a document's frequent keys come back to it.
        Each key is joined under salts, so a line found in most documents is not one task's work.
        """
        renamed, names = with_private_names(docs)
        at = f"c{names.index('text')}"
        numbered = checkpoint(renamed.withColumn("row", F.monotonically_increasing_id()))
        min_chars = self.min_chars

        def keys(batch):
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            found = [(r, h) for r, t in zip(ids, texts, strict=True) for h in {*hashes(split_lines(t), min_chars)} - {None}]
            hi, lo = halves([h for _, h in found])
            return [longs([r for r, _ in found]), longs(hi), longs(lo)]

        hot = self.counts.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        pairs = map_arrow(numbered.select("row", at), keys, "row long, hi long, lo long")
        spread = hot.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        found = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, [*KEY, "salt"])
        frequent = found.groupBy("row").agg(F.collect_list(F.struct(*KEY)).alias("frequent"))
        joined = numbered.join(frequent, "row", "left").drop("row").toDF(*names, "frequent")
        return _drop_lines(joined, None, min_chars)


def _loaded(filters) -> dict[int, CuckooFilter]:
    return {k: CuckooFilter.load(v) for k, v in filters.value.items()}


def in_filters(hi: np.ndarray, lo: np.ndarray, held: dict[int, CuckooFilter], n_shards: int) -> np.ndarray:
    """Whether each key's shard says that it holds the key."""
    shard = (hi >> 32) % n_shards
    out = np.zeros(len(hi), bool)
    for k, cuckoo in held.items():
        mine = np.flatnonzero(shard == k)
        out[mine] = cuckoo.contains(hi[mine], lo[mine])
    return out


def _passing(keys: DataFrame, filters, n_shards: int) -> DataFrame:
    """The keys that some filter claims to hold."""

    def run(batch):
        hi, lo = (batch.column(i).to_numpy() for i in (0, 1))
        found = in_filters(hi, lo, _loaded(filters), n_shards)
        return [longs(hi[found]), longs(lo[found])]

    return map_arrow(keys, run, "hi long, lo long")


def _drop_lines(docs: DataFrame, frequent_of, min_chars: int) -> DataFrame:
    """Remove lines by ``frequent_of(known, keys)``, or by the last column, a list of keys, if that is None."""
    renamed, names = with_private_names(docs)
    if frequent_of is None:
        names = names[:-1]
    at = names.index("text")

    def run(batches):
        known: dict[int, bool] = {}
        for batch in batches:
            kept, counts, dropped = [], [], []
            rows = [split_lines(t) for t in batch.column(at).to_pylist()]
            keys = [hashes(r, min_chars) for r in rows]
            if frequent_of:
                gone = frequent_of(known, keys)
            else:
                gone = [{whole(p["hi"], p["lo"]) for p in out or ()} for out in batch.column(len(names)).to_pylist()]
            for lines, key, out in zip(rows, keys, gone, strict=True):
                left = [x for x, h in zip(lines, key, strict=True) if h not in out]
                kept.append("\n".join(left))
                counts.append(len(lines))
                dropped.append(len(lines) - len(left))
            if len(known) > 200_000:
                known = {}
            columns = [strings(kept) if i == at else batch.column(i) for i in range(len(names))]
            made = [*columns, longs(counts), longs(dropped)]
            yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    n = len(names)
    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(renamed.dtypes[:n])] + [f"c{n} long, c{n + 1} long"])
    return renamed.mapInArrow(run, schema).toDF(*names, "n_lines", "n_dropped")


def _make_filters(hot: DataFrame, n_shards: int) -> DataFrame:
    def run(key, part):
        cuckoo = filled(list(zip(part["hi"].tolist(), part["lo"].tolist(), strict=True)))
        return pd.DataFrame({"shard": [key[0]], "n_keys": [len(part)], "cuckoo": [cuckoo.dump()]})

    keyed = hot.select(_shard(n_shards).alias("shard"), *KEY)
    return keyed.groupBy("shard").applyInPandas(run, "shard long, n_keys long, cuckoo binary")


def _change_filters(filters: DataFrame, crossed: DataFrame) -> DataFrame:
    """Delete and insert the keys that crossed the threshold; a shard without room gets a null filter."""

    def run(key, old, change):
        cuckoo = CuckooFilter.load(old["cuckoo"][0]) if len(old) else CuckooFilter(2 * len(change))
        n = int(old["n_keys"][0]) if len(old) else 0
        data = None
        try:
            for hi, lo, add in change.sort_values("add")[[*KEY, "add"]].itertuples(index=False):
                if add:
                    cuckoo.insert(hi, lo)
                else:
                    cuckoo.delete(hi, lo)
                n += 1 if add else -1
            data = cuckoo.dump()
        except OverflowError:
            pass
        return pd.DataFrame({"shard": [key[0]], "n_keys": [n], "cuckoo": [data]})

    both = filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
    return both.applyInPandas(run, "shard long, n_keys long, cuckoo binary")
