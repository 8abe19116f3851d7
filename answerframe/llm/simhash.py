"""SimHash fingerprints and exact near-duplicate groups through vantage-point trees.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their 32-bit
halves. So each half gets a vantage-point tree over Hamming distance and is searched with radius one. A node
sends a half nearer to its vantage point than its cut inside, the others outside. By the triangle inequality a half
at distance ``d`` from the vantage point only has neighbours between ``d - 1`` and ``d + 1``; so a shard on the outside
must also see the halves exactly on the cut, and no others. Each shard then compares its members exactly.

Trees are built on the driver from a bounded sample of halves; sample and number of shards only decide how even the
shards are, never what is found. Every fingerprint is indexed. A shard with too many members is split
into blocks, and each pair of blocks is compared by a task of its own. A shard returns a spanning forest of its links,
not all pairs. Components of the links are found by contraction in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import join_counted, longs, map_arrow, pick, share, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Members of a shard aimed at, and members of a block of a shard that has more.
SHARD_ROWS, BLOCK_ROWS = 2_000, 8_000
#: Halves the trees are built from, and shards of a tree, at most.
MAX_SAMPLE, MAX_SHARDS = 100_000, 50_000
CANDIDATES = 24
HASHES_AT_ONCE = 65_536


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(tokens: list[bytes], n: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes of the ``n``-word shingles, repeats included."""
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(tokens) - n + 1)
    last = ends[min(n, len(tokens)) - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, np.int64)
    for a in range(0, k, HASHES_AT_ONCE):
        pairs = zip(starts[a : min(k, a + HASHES_AT_ONCE)].tolist(), last[a : a + HASHES_AT_ONCE].tolist(), strict=False)
        ones += bit_counts(np.array([digest(joined[i:j], seed) for i, j in pairs], "<u8"))
    return _over_half(ones, k)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, k: int) -> int:
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > k).tolist()))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes; 0 of none."""
    parts = (bit_counts(hashes[a : a + HASHES_AT_ONCE]) for a in range(0, len(hashes), HASHES_AT_ONCE))
    return _over_half(sum(parts, np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of each row: the whole text's fingerprint as a signed 64-bit number; 0 without a word."""

    def run(batch):
        made = [fingerprint(words(t)) for t in batch.column(1).to_pylist()]
        return [batch.column(0), longs(np.array(made, np.uint64).view(np.int64))]

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, fp long")


# --- vantage-point trees -------------------------------------------------------------------------------


class VantageTree:
    """Splits 32-bit values by distance to vantage points; leaves are numbered shards.

    Node ``i`` sends a value at distance below ``cut[i]`` to ``inner[i]``, others to ``outer[i]``; a child
    number below zero is leaf ``-1 - number``. Without a node, all values are in leaf 0.
    """

    def __init__(self, point, cut, inner, outer, n_leaves: int):
        self.point, self.cut = np.array(point, np.uint32), np.array(cut, np.int64)
        self.inner, self.outer = np.array(inner, np.int64), np.array(outer, np.int64)
        self.n_leaves = n_leaves

    @classmethod
    def build(cls, sample: np.ndarray, n_shards: int, seed: int = 7) -> VantageTree:
        """Cut the largest part again and again until there are ``n_shards``, or none can be cut."""
        rng = np.random.default_rng(seed)
        point, cut, inner, outer, leaves = [], [], [], [], 0
        least = max(2, len(sample) // max(1, 2 * n_shards))

        def grow(part: np.ndarray, shards: int) -> int:
            nonlocal leaves
            best = _best_cut(part, rng) if shards > 1 and len(part) > least else None
            if best is None:
                leaves += 1
                return -leaves
            at = len(point)
            vantage, limit = best
            point.append(vantage), cut.append(limit), inner.append(0), outer.append(0)
            d = distance(part, vantage)
            inside, outside = part[d < limit], part[d >= limit - 1]
            share = len(inside) / (len(inside) + len(outside))
            first = min(shards - 1, max(1, round(shards * share)))
            inner[at] = grow(inside, first)
            outer[at] = grow(outside, shards - first)
            return at

        if len(sample):
            grow(sample, n_shards)
        return cls(point, cut, inner, outer, max(1, leaves))

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of values and a shard for each: the one it lies in and those it is on the boundary of."""
        if not len(self.point):
            return np.arange(len(values)), np.zeros(len(values), np.int64)
        found_at, found_leaf = [], []
        waiting = [(0, np.arange(len(values)))]
        while waiting:
            node, at = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                found_at.append(at)
                found_leaf.append(np.full(len(at), -1 - node))
                continue
            d = distance(values[at], self.point[node])
            waiting.append((self.inner[node], at[d < self.cut[node]]))
            waiting.append((self.outer[node], at[d >= self.cut[node] - 1]))
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found_leaf)


def distance(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ values.dtype.type(point)).astype(np.int64)


def _best_cut(part: np.ndarray, rng) -> tuple[int, int] | None:
    """Vantage point and cut with the smallest work: squared sizes of both sides, the boundary in both."""
    best, found = float(len(part)) ** 2 * 0.9, None
    for vantage in rng.choice(part, min(CANDIDATES, len(part)), replace=False):
        n = np.bincount(distance(part, vantage), minlength=34)
        below = np.cumsum(n)  # at a distance of at most d
        inside = below[:-1]  # cut at d + 1
        outside = len(part) - below[:-1] + n[:-1]
        work = inside.astype(float) ** 2 + outside.astype(float) ** 2
        work[(inside == 0) | (outside >= len(part))] = np.inf
        k = int(work.argmin())
        if work[k] < best:
            best, found = work[k], (int(vantage), k + 1)
    return found


# --- links within shards --------------------------------------------------------------------------------


def links_between(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links within ``a`` (``b`` is None) or across ``a`` and ``b``.

    Few links are returned as they are. A dense group is walked breadth first, so that its members leave the
    values still to be compared as soon as they are reached.
    """
    everything = a if b is None else np.concatenate([a, b])
    left, right, n = [], [], 0
    step = max(1, 4_000_000 // max(1, len(everything)))
    for k in range(0, len(a), step):
        others = a[k:] if b is None else b
        near = np.bitwise_count(a[k : k + step, None] ^ others[None, :]) <= radius
        if b is None:
            near[:, : len(near)] &= np.triu(np.ones((len(near), min(len(near), near.shape[1])), bool), 1)
        i, j = np.nonzero(near)
        left.append(i + k)
        right.append(j + (k if b is None else len(a)))
        n += len(i)
        if n > 8 * len(everything):
            return _walk(everything, radius)
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def _walk(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all links within ``values``, breadth first."""
    open_ = np.arange(len(values))
    left, right = [], []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue:
            at = queue.pop()
            near = np.bitwise_count(values[open_] ^ values[at]) <= radius
            reached = open_[near]
            if len(reached):
                left.append(np.full(len(reached), at))
                right.append(reached)
                queue.extend(reached.tolist())
                open_ = open_[~near]
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def halves(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(32)).astype(np.uint32), u.astype(np.uint32)]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between the values of ``distinct`` (one column ``fp``, no repeats) that connect all that are near."""
    spark = distinct.sparkSession
    n = distinct.count()
    portion = min(1.0, MAX_SAMPLE / max(1, n))
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(2**20)) < int(portion * 2**20) + 1).limit(2 * MAX_SAMPLE)
    sample = np.array(drawn.toPandas()["fp"].sort_values(), np.int64)
    n_shards = int(min(MAX_SHARDS, 1 + n // SHARD_ROWS))
    trees = [VantageTree.build(half, n_shards) for half in halves(sample)]
    shared = share(spark, trees)

    def place(batch):
        fp = batch.column(0).to_numpy()
        out = []
        for k, (tree, half) in enumerate(zip(shared(), halves(fp), strict=True)):
            at, leaf = tree.shards(half)
            out.append((fp[at], 2 * leaf + k))
        return [longs(np.concatenate(x)) for x in zip(*out, strict=True)]

    members = checkpoint(map_arrow(distinct, place, "fp long, shard long"))
    large = {
        r["shard"]: -(-r["count"] // BLOCK_ROWS)
        for r in members.groupBy("shard").count().where(F.col("count") > BLOCK_ROWS).collect()
    }
    sizes = spark.sparkContext.broadcast(large)

    def deal(batch):
        """A member of a large shard goes to every pair of blocks its own block is in."""
        fp, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        blocks = np.array([sizes.value.get(s, 1) for s in shard.tolist()], np.int64)
        own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
        at = np.repeat(np.arange(len(fp)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        return [longs(fp[at]), longs(shard[at]), longs(low), longs(high), longs(own[at])]

    dealt = map_arrow(members, deal, "fp long, shard long, low long, high long, own long")
    group = ["shard", "low", "high"]
    n_parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    # sorted through, so that a task that is run again finds the same forest
    sorted_ = dealt.repartition(n_parts, *group).sortWithinPartitions(*group, "fp")

    def compare(batches):
        def found(parts):
            fp, low, high, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            values = fp.view(np.uint64)
            if low[0] == high[0]:
                i, j = links_between(values, None)
                return fp[i], fp[j]
            first = own == low[0]
            a, b = fp[first], fp[~first]
            i, j = links_between(a.view(np.uint64), b.view(np.uint64))
            both = np.concatenate([a, b])
            return both[i], both[j]

        held, key = [], None
        for batch in batches:
            fp, shard, low, high, own = (batch.column(i).to_numpy() for i in range(5))
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                if i == j:
                    continue
                if key is not None and key != (shard[i], low[i], high[i]):
                    yield _pair_batch(*found(held))
                    held = []
                key = (shard[i], low[i], high[i])
                held.append((fp[i:j], low[i:j], high[i:j], own[i:j]))
        if held:
            yield _pair_batch(*found(held))

    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(np.minimum(a, b)), longs(np.maximum(a, b))], ["a", "b"])


# --- components -----------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b``: one root for all nodes of a component.

    Each round points every node at the first of itself and its neighbours in an order drawn anew for the round, and
    replaces the ends of the edges by what they point at. The random order makes also long chains shrink by a
    constant share a round. Where nodes have got to is kept as one table, so plans stay as short as the first. Merge joins
    keep all tables off the driver. Tables are written rather than checkpointed: a checkpoint carries over the constraints of its
    plan, and those of a loop multiply until planning takes all the driver has.
    """
    edges = stored(edges.select("a", "b").where("a != b"))
    found, turn = None, 0
    while not edges.isEmpty():
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(draw("b")).alias("m"))
        to = stored(least.select("a", F.least("m", draw("a"))["n"].alias("to")))
        if found is None:
            found = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            on = found.join(to.select(F.col("a").alias("root"), "to").hint("merge"), "root", "left")
            found = stored(on.select("node", F.coalesce("to", "root").alias("root")))
        one = edges.join(to.hint("merge"), "a").select(F.col("to").alias("x"), "b")
        two = one.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        moved = two.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges, turn = stored(moved.distinct()), turn + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def smallest_ids(distinct: DataFrame, root: DataFrame) -> DataFrame:
    """``fp, component_id, n`` of each row of ``distinct`` (``fp, first, n``): the smallest ``first`` of its component.

    ``root`` names the component of each value that has a link. Both joins deal the rows of a giant component to many tasks.
    """
    named = distinct.join(root.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    named = checkpoint(named.select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    return checkpoint(join_counted(named, checkpoint(smallest), "root", "members").select("fp", "component_id", "n"))


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``; the smallest id that near fingerprints reach.

    Texts without a word, null ones too, have fingerprint 0 and are linked like any other. Null ids are ignored as smallest id
    unless a component has no other. Repeated rows are kept. A text of any length is read whole. An empty table gives an
    empty one; other columns are not looked at.
    """
    rows = checkpoint(fingerprints(docs))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    by_fp = smallest_ids(distinct, components(links(distinct.select("fp"))))
    return join_counted(rows, by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def hex_digits(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
