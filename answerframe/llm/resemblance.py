"""Groups of texts whose word shingles are alike: SimHash trees and MinHash bands find candidates, whole shingle sets decide.

Texts are sets of word shingles, and two are linked if their Jaccard similarity reaches a bound. Each set has the 64-bit
SimHash of ``simhash``, whose vantage-point trees find all pairs within three bits. That is the close half of the search: at a
similarity of 0.8 about ten bits differ, and trees over halves of 32 bits do not narrow a search that wide. So
each set also gets minima under many hash functions, taken together in bands. The number of bands
follows from the bound: a pair just at it shares no band with a chance of ``MISSED``, a pair above it with less.

Sets that share bands or near fingerprints, directly or through others, form a cluster. Texts far less alike than the bound often share a band by
chance and may chain many texts of one template together. So a cluster too large for one task is first cut by sketches, one
byte a minimum: sets are compared by the share of bytes that agree, in blocks of ``SKETCH_ROWS``, and only sets within ``MARGIN`` of
the bound stay linked (five deviations of that share's error, a chance of 3e-7 for a pair just at the bound). What is left is compared
exactly. Only clusters' members are shuffled, block pair by block pair with a task of its own, so neither fingerprints, bands nor sketches
link anything by themselves. Equal sets are collapsed first, and a task returns a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, fits_broadcast
from .common import join_counted, longs, map_arrow, partitions_for, pick
from .simhash import components, fingerprint_of, smallest_ids, words
from .simhash import links as fingerprint_links

SHINGLE, SIMILARITY = 5, 0.8
SEED = 42
#: Minima in a band, and the chance that a pair just at the bound shares no band.
BAND, MISSED = 6, 1e-6
#: Members of a block of a large cluster, and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 500_000
#: Sets of a block that is compared by sketches, and how far below the bound sketches still link.
SKETCH_ROWS, MARGIN = 1_024, 0.12
#: Members that are sent to the texts, at most; more are shuffled with them.
MEMBERS_SENT = 100_000
#: Numbers handled at once inside a task.
CELLS = 4_000_000


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; a shorter text is one shingle, one without a word none."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    pairs = zip(starts[: max(1, len(tokens) - n + 1)].tolist(), ends[min(n, len(tokens)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[i:j], seed) for i, j in pairs], np.uint64))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)


def n_bands(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(min(similarity, 0.999) ** BAND))))


def minima(found: np.ndarray, bands: int) -> np.ndarray:
    """Least values of a set, ``BAND`` a band; 32-bit hashes of it multiplied by odd numbers are the functions."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**31, bands * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full(bands * BAND, 2**32 - 1, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    step = max(1, CELLS // len(factors))
    for a in range(0, len(short), step):
        np.minimum(least, (factors[:, None] * short[None, a : a + step]).min(axis=1), out=least)
    return least.reshape(bands, BAND)


def keys_of(least: np.ndarray) -> np.ndarray:
    """A number for each band of minima."""
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least)], np.uint64)


def band_keys(found: np.ndarray, bands: int) -> np.ndarray:
    return keys_of(minima(found, bands))


def alike(sets: list[np.ndarray], first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links across members that are ``first`` and the others, or among all of them.

    Shingles of one member alone are only counted; the others are multiplied out, so many at once.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    term = np.concatenate(([0], np.cumsum(every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    shared = np.bincount(term)[term] > 1 if len(every) else np.zeros(0, bool)
    owner, term = owner[shared], term[shared]
    if len(term):
        term = np.concatenate(([0], np.cumsum(term[1:] != term[:-1])))
    common = np.zeros((n, n), np.float32 if sizes.max(initial=0) < 2**24 else np.float64)
    step = max(1, CELLS // n)
    for a in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        i, j = np.searchsorted(term, [a, a + step])
        held = np.zeros((n, step), common.dtype)
        held[owner[i:j], term[i:j] - a] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common.astype(np.int64)
    near = common.astype(np.int64) >= similarity * union - 1e-9 * union
    if not first.all():
        near &= first[:, None] != first[None, :]
    return forest(near)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of a graph given as a square of marks."""
    left, right, open_ = [], [], np.arange(len(near))
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            reached = open_[near[at, open_]]
            left.append(np.full(len(reached), at))
            right.append(reached)
            queue.extend(reached.tolist())
            open_ = open_[~near[at, open_]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def alike_sketches(sketches: list[bytes], first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``alike``, by the share of bytes that agree: the similarity, and 1/256 of the rest by chance."""
    table = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1).T
    same = np.zeros((len(sketches), len(sketches)), np.uint16)
    for column in np.ascontiguousarray(table):
        same += column[:, None] == column[None, :]
    near = same >= len(table) * (similarity + (1 - similarity) / 256)
    if not first.all():
        near &= first[:, None] != first[None, :]
    return forest(near)


def in_blocks(rows: DataFrame, compare) -> DataFrame:
    """``a, b``: the links that ``compare`` finds among the ``fp, value`` of each ``root``, each pair of its ``blocks`` in a task.

    ``compare(values, first)`` is given the values of one block, all ``first``, or of two, and returns positions.
    """
    own = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["root", "low", "high"]
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp", "value")
    # sorted through, so that a task that is run again finds the same forest
    sorted_ = dealt.repartition(partitions_for(rows), *group).sortWithinPartitions(*group, "fp")

    def run(batches):
        def found(held):
            fp, own, values = ([x for part in held for x in part[k]] for k in range(3))
            fp, own = np.array(fp, np.int64), np.array(own)
            i, j = compare(values, own == own[0])
            return pa.RecordBatch.from_arrays([longs(np.minimum(fp[i], fp[j])), longs(np.maximum(fp[i], fp[j]))], ["a", "b"])

        held, key = [], None
        for batch in batches:
            root, low, high, own, fp = (batch.column(k).to_numpy() for k in range(5))
            new = np.flatnonzero((np.diff(root) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                if i == j:
                    continue
                if held and key != (root[i], low[i], high[i]):
                    yield found(held)
                    held = []
                key = (root[i], low[i], high[i])
                part = batch.column(5).slice(i, j - i)
                values = part.to_pylist() if pa.types.is_binary(part.type) else [x.values.to_numpy().view(np.uint64) for x in part]
                held.append((fp[i:j], own[i:j], values))
        if held:
            yield found(held)

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def with_blocks(member: DataFrame) -> DataFrame:
    """Members of clusters with the number of ``blocks`` that their cluster's exact comparison is cut into."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = checkpoint(member.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("members")))
    return join_counted(member, sizes.where("members > 1"), "root", "members")


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """``a, b``: links that connect all sets ``fp, n, simhash`` whose SimHash fingerprints are equal or near."""
    some = sets.where("n > 0").select("fp", "simhash")
    marks = checkpoint(some.groupBy("simhash").agg(F.min("fp").alias("hub"), F.count("*").alias("held")))
    same = join_counted(some, checkpoint(marks.where("held > 1")), "simhash", "held").where("hub != fp")
    near = fingerprint_links(marks.select(F.col("simhash").alias("fp")))
    for end in ("a", "b"):
        hub = marks.select(F.col("simhash").alias(end), F.col("hub").alias(f"hub_{end}"))
        near = near.join(hub.hint("merge"), end)
    return same.select(F.col("hub").alias("a"), F.col("fp").alias("b")).unionByName(near.selectExpr("hub_a AS a", "hub_b AS b"))


def candidates(sets: DataFrame, similarity: float, near: DataFrame | None = None) -> DataFrame:
    """``doc_id, fp, root, blocks``: clusters of the sets that may be alike, by their bands and the links ``near``."""
    keys = sets.select("fp", F.explode("keys").alias("band"))
    least = keys.groupBy("band").agg(F.min("fp").alias("a"), F.max("fp").alias("most"), F.count("*").alias("held"))
    least = checkpoint(least.where("a != most").select("band", "a", "held"))
    star = join_counted(keys, least, "band", "held").where("a != fp").select("a", F.col("fp").alias("b"))
    star = (star if near is None else star.unionByName(near)).distinct()

    def members(edges: DataFrame, of: DataFrame) -> DataFrame:
        joined = of.join(components(edges).withColumnRenamed("node", "fp").hint("merge"), "fp")
        return checkpoint(with_blocks(joined.select(F.col("first").alias("doc_id"), "fp", "n", "sketch", "root")))

    found = members(star, sets)
    large = found.where("blocks > 1")
    # blocks for sketches follow from those for sets, which are smaller
    again = F.ceil(F.col("blocks") * BLOCK_ROWS / SKETCH_ROWS).cast("int")
    alike_ = in_blocks(
        large.select("fp", "root", again.alias("blocks"), F.col("sketch").alias("value")),
        lambda values, first: alike_sketches(values, first, similarity - MARGIN),
    )
    cut = members(alike_, large.select("fp", F.col("doc_id").alias("first"), "n", "sketch"))
    columns = ["doc_id", "fp", "root", "blocks"]
    return checkpoint(found.where("blocks = 1").select(columns).unionByName(cut.select(columns)))


def links(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: links between the sets ``fp, first, n, simhash, keys, sketch`` of ``docs`` that connect all that are alike."""
    member = candidates(sets, similarity, near_fingerprints(sets))

    def hashed(batch):
        found = [shingles(t, shingle).view(np.int64) for t in batch.column(3).to_pylist()]
        return [*(batch.column(k) for k in range(3)), pa.array(found, pa.list_(pa.int64()))]

    small = fits_broadcast(member, MEMBERS_SENT)
    texts = docs.join(F.broadcast(member) if small else member.hint("merge"), "doc_id").select("fp", "root", "blocks", "text")
    sets_of = map_arrow(texts, hashed, "fp long, root long, blocks int, value array<long>")
    return in_blocks(sets_of, lambda values, first: alike(values, first, similarity))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of each row of ``docs``; the smallest id that texts alike reach.

    Ids must be unique and not null. All texts without a word, null ones too, are alike; one with fewer words than a
    shingle is one shingle. Repeated and very long texts are taken whole. An empty table gives an empty one.
    """
    docs, bands = pick(docs, "doc_id", "text"), n_bands(similarity)

    def signed(batch):
        found = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
        fps, marks = (np.array([key(f) for f in found], np.uint64).view(np.int64) for key in (set_key, fingerprint_of))
        least = [minima(f, bands) if len(f) else np.zeros((0, BAND), np.uint32) for f in found]
        keys = [keys_of(m).view(np.int64) for m in least]
        sketches = [(m & 0xFF).astype(np.uint8).tobytes() for m in least]
        held = [longs(fps), longs([len(f) for f in found]), longs(marks), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        return [batch.column(0), *held]

    rows = checkpoint(map_arrow(docs, signed, "doc_id long, fp long, n long, simhash long, keys array<long>, sketch binary"))
    # equal sets have equal keys, so tasks keep one of them before the shuffle
    values = [F.first(c).alias(c) for c in ("simhash", "keys", "sketch")]
    held = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"), *values)
    sets = checkpoint(held)
    found = components(links(docs, sets.drop("copies"), shingle, similarity))
    by_fp = smallest_ids(sets.select("fp", "first", F.col("copies").alias("n")), found)
    return join_counted(rows.select("doc_id", "fp"), by_fp, "fp", "n").select("doc_id", "component_id")
