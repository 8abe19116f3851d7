"""Smoothed TF-IDF and its truncated SVD, every tall factor kept as a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import count_runs
from ..session import discard, written
from .joins import join_vocabulary
from .terms import term_counts, trim_docfreq, vocabulary

#: Numbers that the cells of one part may ask for, four each.
PART_NUMBERS = 8_000_000
#: Columns of a block beside the wanted ones, which speed up the iteration.
SPARE = 2
#: The column that ``counted`` adds.
COUNTS = "_term_counts"


def _numbers(column, width: int) -> np.ndarray:
    """A list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    edges = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(matrix).ravel()))


def _orthonormal(gram: np.ndarray, least: float = 0.0) -> np.ndarray:
    """``W`` for which ``Z·W`` has orthonormal columns, given ``ZᵀZ``. Directions without length, or of ``least`` at most, are left out."""
    length = np.sqrt(np.maximum(np.diag(gram), 0.0))
    some = np.flatnonzero(length > max(1e-12 * length.max(initial=0.0), least))
    scaled = gram[np.ix_(some, some)] / np.outer(length[some], length[some])
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    kept = values > 1e-12 * values.max(initial=0.0)
    out = np.zeros((len(gram), int(kept.sum())))
    out[some] = vectors[:, kept] / length[some][:, None] / np.sqrt(values[kept])
    return out


class TfidfSvd:
    """Smoothed, unit-length TF-IDF followed by an uncentred truncated SVD.

    ``fit`` learns vocabulary, document frequencies and right singular vectors, all of them tables in the shared
    folder. ``transform`` adds ``text_features`` (``array<double>`` of length ``k``; zeros for a null or empty text, one
    without a known term, and components beyond the matrix's rank). ``id_col`` tells texts apart and must be unique.
    Both take texts or what ``counted`` made of them, where each text is counted once for all calls.

    The SVD is a block Lanczos iteration. Its newest block has one row a term. Texts are dealt into parts by a hash of
    their id; a step sends each term's row to the parts that hold the term, where ``AᵀA`` times the block is made of the
    part's texts, and sums it by term. A frequent term thus costs one row a part, not one a text. All blocks stay as
    columns of one table, and each new one is made orthogonal to all of them. The driver holds matrices of as many rows and
    columns as there are columns in that table. The iteration ends when no wanted singular value moved by more than
    ``tolerance`` of the largest, or nothing new is found.
    """

    def __init__(
        self,
        tokens: Column,
        id_col: str,
        k: int = 2,
        min_df: int = 1,
        iterations: int = 30,
        tolerance: float = 1e-6,
        seed: int = 77,
    ):
        self.tokens, self.id_col, self.k, self.min_df = tokens, id_col, k, min_df
        self.iterations, self.tolerance, self.seed = iterations, tolerance, seed
        self.components: DataFrame | None = None
        self.singular_values: np.ndarray | None = None

    def counted(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` (or all) of ``df`` with the term counts of its texts, stored; for several calls of ``fit`` and ``transform``."""
        return written(df.select(*(keep or df.columns), count_runs(self.tokens).alias(COUNTS)))

    def _cells(self, df: DataFrame) -> DataFrame:
        if COUNTS in df.columns:
            return df.select(self.id_col, F.inline(COUNTS))
        return term_counts(df, [self.id_col], self.tokens)

    def fit(self, df: DataFrame) -> TfidfSvd:
        cells = self._cells(df)
        kept = trim_docfreq(vocabulary(cells), self.min_df)
        idf = F.log((1 + df.agg(F.count("*")).scalar()) / (1 + F.col("doc_count"))) + 1
        # numbers follow a stored table, so that they stay
        vocab = written(
            kept.select("term", "doc_count", idf.alias("idf"), F.monotonically_increasing_id().alias("term_no"))
        )
        terms, n_cells = vocab.agg(F.count("*"), F.coalesce(F.sum("doc_count"), F.lit(0))).first()
        width = min(self.k + SPARE, terms)
        if width == 0:
            return self._keep(vocab, np.zeros(0), F.array().cast("array<double>"))
        docs, routing = self._parts(cells, vocab, 4 * n_cells)
        first = [F.xxhash64("term", F.lit(self.seed), F.lit(j)) / F.lit(2.0**63) for j in range(width)]
        state, before = vocab.select("term_no", F.array(*first).alias("q")), np.zeros(0)
        # the orthonormal vectors are the table's columns times ``basis``; column ``width + i`` is the image of vector i
        basis, image, done = self._extended(state, np.zeros((width, 0)), np.eye(width))[0], np.zeros((0, 0)), 0
        for step in range(self.iterations):
            sums = self._gram_times(docs, routing, state, basis[:, done:])
            longer = written(state.join(sums, "term_no").select("term_no", F.concat("q", "z").alias("q")))
            if step:
                discard(state)
            state, fresh = longer, basis.shape[1] - done
            basis = np.vstack([basis, np.zeros((fresh, done + fresh))])
            made = np.vstack([np.zeros((len(basis) - fresh, fresh)), np.eye(fresh)])
            grown, overlap = self._extended(state, basis, made)
            image = np.block([[image, overlap[:done]], [overlap[:done].T, overlap[done:]]])
            done += fresh
            values, vectors = np.linalg.eigh((image + image.T) / 2)
            values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
            top, chosen = np.sqrt(values[: self.k]), basis @ vectors[:, : self.k]
            settled = len(top) == len(before) and np.abs(top - before).max() <= self.tolerance * top[0]
            if settled or grown.shape[1] == done:
                break
            before, basis = top, grown
        docs.unpersist()
        kept = self._keep(vocab.join(self._turn(state, chosen), "term_no"), top, F.col("q"))
        discard(state)
        return kept

    def _parts(self, cells: DataFrame, vocab: DataFrame, numbers: int) -> tuple[DataFrame, DataFrame]:
        """The texts' unit vectors, dealt into parts, and which part holds which term."""
        spark = cells.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(tasks, -(-numbers // PART_NUMBERS))
        found = join_vocabulary(cells, vocab, "doc_count", ["term"])
        raw = F.col("n") * F.col("idf")
        lists = found.groupBy(self.id_col).agg(
            F.collect_list(F.struct("term_no", raw.alias("w"))).alias("c"), F.sqrt(F.sum(raw * raw)).alias("length")
        )
        docs = written(
            lists.select(
                F.pmod(F.xxhash64(self.id_col), F.lit(parts)).alias("part"),
                F.col("c.term_no").alias("terms"),
                F.transform("c.w", lambda w: w / F.col("length")).alias("weights"),
            )
        )
        routing = written(docs.select("part", F.explode("terms").alias("term_no")).distinct())
        # the texts stay where they are from step to step; lost blocks are read again from the table
        return docs.repartition(tasks, "part").persist(StorageLevel.DISK_ONLY), routing

    @staticmethod
    def _turn(state: DataFrame, columns: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                q = _numbers(batch.column(1), len(columns)) @ columns
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(q)], ["term_no", "q"])

        return state.select("term_no", "q").mapInArrow(run, "term_no long, q array<double>")

    @staticmethod
    def _gram(state: DataFrame, columns: np.ndarray) -> np.ndarray:
        """``XᵀX`` of the table's columns times ``columns``."""

        def gram(batches):
            total = 0.0
            for batch in batches:
                q = _numbers(batch.column(0), len(columns)) @ columns
                total = total + q.T @ q
            rows = [total.ravel()] if isinstance(total, np.ndarray) else []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["g"])

        cells = state.select("q").mapInArrow(gram, "g array<double>").select(F.posexplode("g").alias("at", "x"))
        sums = sorted(cells.groupBy("at").agg(F.sum("x")).collect())
        return np.array([r[1] for r in sums]).reshape(columns.shape[1], columns.shape[1])

    def _extended(self, state: DataFrame, basis: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``basis`` and the directions of ``made`` that it lacks, orthonormal to rounding; and the products of both."""
        held, first, least = basis.shape[1], None, 0.0
        for turn in range(4):
            gram = self._gram(state, np.hstack([basis, made]))
            overlap, own = gram[:held, held:], gram[held:, held:]
            if first is None:
                first, least = overlap, 1e-10 * np.sqrt(own.max(initial=0.0))
            off = max(np.abs(overlap).max(initial=0.0), np.abs(own - np.eye(len(own))).max(initial=0.0))
            if turn > 1 and off < 1e-12:
                break
            made = made - basis @ overlap
            if turn or not held:
                # the lengths seen before the first removal say nothing about what is left
                made = made @ _orthonormal(own - overlap.T @ overlap, least if turn < 2 else 0.0)
            if not made.shape[1]:
                break
        return np.hstack([basis, made]), first

    def _gram_times(self, docs, routing, state, columns: np.ndarray) -> DataFrame:
        """``(term_no, z)`` with the rows of ``AᵀA·Q``, Q the table's columns times ``columns``."""
        block = columns.shape[1]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            lists = left["terms"].combine_chunks()
            terms, weights = lists.flatten().to_numpy(), left["weights"].combine_chunks().flatten().to_numpy()
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            numbers = right["term_no"].combine_chunks().to_numpy()
            order = np.argsort(numbers)
            numbers, q = numbers[order], _numbers(right["q"], block)[order]
            at = np.searchsorted(numbers, terms)
            out = {"term_no": numbers}
            for j in range(block):
                y = np.bincount(rows, weights * q[at, j], len(lists))
                out[f"z{j}"] = np.bincount(at, weights * y[rows], len(numbers))
            return pa.table(out)

        sent = routing.join(self._turn(state, columns), "term_no").select("part", "term_no", "q")
        schema = "term_no long, " + ", ".join(f"z{j} double" for j in range(block))
        part = docs.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, schema)
        return part.groupBy("term_no").agg(F.array(*[F.sum(f"z{j}") for j in range(block)]).alias("z"))

    def _keep(self, terms: DataFrame, values: np.ndarray, vector: Column) -> TfidfSvd:
        """Store ``term, doc_count, idf, v``; each component's largest entry (ties: first term) is made positive."""
        kept = written(terms.select("term", "doc_count", "idf", vector.alias("v")))
        signs = []
        if len(values):
            entry = [F.col("v")[j] for j in range(len(values))]
            # max_by of the absolute value; equal ones are told apart by the term
            largest = kept.agg(*[F.max(F.struct(F.round(F.abs(e), 9), "term", F.signum(e).alias("s"))).alias(f"s{j}") for j, e in enumerate(entry)])
            signs = [x["s"] or 1.0 for x in largest.first()]
        padded = [F.col("v")[j] * F.lit(s) for j, s in enumerate(signs)] + [F.lit(0.0)] * (self.k - len(signs))
        self.components = kept.select("term", "doc_count", "idf", F.array(*padded).alias("v"))
        self.singular_values = np.concatenate([values, np.zeros(self.k - len(values))])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cells = self._cells(df)
        found = join_vocabulary(cells, self.components, "doc_count", ["term"])
        raw = F.col("n") * F.col("idf")
        sums = found.groupBy(F.col(self.id_col).alias("_id")).agg(
            F.sqrt(F.sum(raw * raw)).alias("_length"), *[F.sum(raw * F.col("v")[j]).alias(f"_v{j}") for j in range(self.k)]
        )
        vector = F.array(*[F.coalesce(F.col(f"_v{j}") / F.col("_length"), F.lit(0.0)) for j in range(self.k)])
        joined = df.join(sums, df[self.id_col].eqNullSafe(sums["_id"]), "left")
        return joined.select(*[df[c] for c in df.columns if c != COUNTS], vector.alias("text_features"))
