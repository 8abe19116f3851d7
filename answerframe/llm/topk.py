"""Exact top-k inner products of norm-sorted vectors.

Vectors are turned into integers first. Their second moments (one small matrix, summed in Spark) give an SVD basis
in which the first coordinates carry most of an inner product. Candidates are range-partitioned by descending norm into shards
of bounded size, and a shard is processed in that order in blocks. For a block and a query, ``|q| * |longest|`` bounds all
products (the rest of the shard is skipped), then the partial product over the first rotated coordinates plus the Cauchy-Schwarz
bound ``|rest of q| * |rest of x|`` of the others bounds each one. What is left is multiplied in integers, so results are exact.

The shard of the longest vectors is searched first and gives every query a floor. In a second job a query goes on only to those shards
whose longest vector can still reach its floor; they are a run from the front. Neither queries nor candidates pass through the
driver, which learns one norm a shard (8 bytes for every 8 MB of vectors).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, map_arrow, partitions_for, share, stored
from .shards import finite_vectors, integers, largest, matrix, number_of_shards, numbered, products, search_shards

#: Candidates compared at once, and rotated coordinates that are multiplied first.
ROW_BLOCK, LEADING = 2_048, 24
#: Queries of a block that meets the longest vectors.
QUERY_BLOCK = 512
FOUND = "no long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """``no, id, x, norm``: ``floor(256 * component)`` of each vector that takes part, as doubles that hold the integers.

    A null id or vector, or one with a null or non-finite component, takes no part. A vector without components does;
    its products are 0.
    """
    rows = finite_vectors(vectors, key, values).select("id", integers().alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    return numbered(rows.withColumn("norm", F.sqrt(square)))


def second_moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of x xᵀ over all vectors: one row of ``dims`` numbers for each coordinate."""

    def run(batch):
        x = matrix(batch.column(0), dims)
        m = x.T @ x
        return [longs(np.arange(dims)), pa.array(list(m), pa.list_(pa.float64()))]

    part = map_arrow(vectors.select("x"), run, "at long, sums array<double>")
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims)]
    out = np.zeros((dims, dims))
    for r in part.groupBy("at").agg(*sums).collect():
        out[r[0]] = r[1:]
    return out


def split(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rotated[..., :LEADING], np.sqrt((rotated[..., LEADING:] ** 2).sum(axis=-1))


class NormSorted:
    """Rows of a shard by descending norm, with their leading rotated coordinates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray, k: int):
        norm = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.ids, self.x, self.norm, self.basis, self.k = ids[order], x[order], norm[order], basis, k
        self.lead, self.rest = split(self.x @ basis)

    def best(self, own: int, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows that reach the floor; a query's own id is none."""
        lead, rest = split(query @ self.basis)
        length = float(np.sqrt(query @ query))
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(self.ids), ROW_BLOCK):
            most = length * self.norm[a]
            slack = 1e-6 * (1 + most)
            if floor is not None and most + slack < floor:
                break
            rows = slice(a, a + ROW_BLOCK)
            able = self.ids[rows] != own
            if floor is not None:
                able &= self.lead[rows] @ lead + rest * self.rest[rows] + slack >= floor
            at = np.flatnonzero(able) + a
            if not len(at):
                continue
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, products(self.x[at], query, most)])
            top = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[top], scores[top]
            if len(top) == self.k:
                floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        return ids, scores

    def search(self, ids: np.ndarray, x: np.ndarray, more: pa.Array) -> pa.RecordBatch:
        """``more``: the query's number and, if known, its floor."""
        found = []
        for own, query, (no, *floor) in zip(ids.tolist(), x, more.to_pylist(), strict=True):
            names, scores = self.best(own, query, floor[0] if floor else None)
            found.append((np.full(len(names), no), np.full(len(names), own), names, scores))
        columns = [longs(np.concatenate([f[j] for f in found])) for j in range(4)] if found else [longs([])] * 4
        return pa.RecordBatch.from_arrays(columns, ["no", "query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", values: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query row.

    A query's own id is no candidate. Equal scores go to the smaller id. A candidate that occurs in several rows may be
    found as often, and each row of a repeated query is asked for itself. Fewer candidates than ``k`` give fewer rows,
    empty tables none. Null ids take no part; shorter vectors are filled up with zeros; other columns are not looked at.
    Components may be of any size: products are exact, and one that 64 bits cannot hold raises.
    """
    rows, asked = integer_vectors(vectors, key, values), integer_vectors(queries, key, values)
    spark, dims = rows.sparkSession, largest(rows, asked)
    n_shards = number_of_shards(rows.count(), dims)
    basis = np.linalg.eigh(second_moments(rows, dims))[1][:, ::-1] if dims else np.zeros((0, 0))
    by_norm = rows.repartitionByRange(n_shards, F.col("norm").desc(), "id", "no")
    by_norm = stored(by_norm.select("id", "x", "norm", F.spark_partition_id().cast("long").alias("shard"), F.array().cast("array<long>").alias("more")))
    norms = sorted(map(tuple, by_norm.groupBy("shard").agg(F.max("norm")).collect()))
    if not norms:
        return ranked(spark.createDataFrame([], FOUND), k)
    numbers, most = np.array([s for s, _ in norms]), np.array([m for _, m in norms])
    parts = max(partitions_for(rows), len(norms))

    def search(to_ask: DataFrame, candidates: DataFrame) -> DataFrame:
        return search_shards(candidates, to_ask, lambda ids, x, more: NormSorted(ids, x, basis, k), FOUND, parts, dims)

    first = int(numbers[0])
    # the first shard is copied for each block of queries, so that no task gets them all
    n_blocks = 1 + asked.count() // QUERY_BLOCK
    block = F.pmod(F.xxhash64("no"), F.lit(n_blocks).cast("long")).alias("shard")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("shard")
    front = by_norm.where(F.col("shard") == first).select("id", "x", "more", blocks)
    head = stored(search(asked.select("no", "id", "x", F.array("no").alias("more"), block), front))
    floors = head.groupBy("no").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    known = asked.join(floors.select("no", "floor"), "no", "left")
    shared = share(spark, (numbers, most))

    def onward(batches):
        numbers, most = shared()
        for batch in batches:
            floor = batch.column(1).to_numpy(zero_copy_only=False).astype(float)  # null: every shard
            norm = batch.column(2).to_numpy()
            reach = norm * (1 + 1e-6)
            last = [int(np.searchsorted(-most * r, -(f - 1), "right")) if f == f else len(most) for f, r in zip(floor, reach, strict=True)]
            shards = [numbers[1:n].tolist() for n in last]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.list_(pa.int64()))], ["no", "shards"])

    routes = known.select("no", "floor", "norm").mapInArrow(onward, "no long, shards array<long>")
    routes = routes.select("no", F.explode("shards").alias("shard"))
    more = F.when(F.col("floor").isNull(), F.array("no")).otherwise(F.array("no", "floor"))
    to_ask = known.join(routes, "no").withColumn("more", more)
    rest = search(to_ask, by_norm.where(F.col("shard") != first))
    return ranked(head.unionByName(rest), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
