"""Term counts, vocabularies, pruning, weighting and document-term forms.

Term rows are long, ``(id, term, n)``, or ``(id, field, term, n)`` when several
texts per respondent are counted at once. Counting happens inside the text's own
row; only the vocabulary is shuffled, after a map-side partial count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.stem import stem_word
from ..functions.tokens import count_runs, words
from ..session import checkpoint, written
from .joins import join_vocabulary, lookup

#: Tokens whose n-grams are counted at once inside a task; a longer text is alone.
TOKENS_AT_ONCE = 200_000
#: Cells of a block of texts, about, whose weights a task makes.
BLOCK_CELLS = 1 << 20
#: Terms of all blocks that a task looks up together, about.
RANGE_TERMS = 1 << 20
#: Words a task remembers in their new form.
WORDS_HELD = 400_000


def answer_rows(df: DataFrame, id_col: str, text_cols: Sequence[str]) -> DataFrame:
    """Wide answers to long ``(id, field, text)`` rows; null answers are dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in text_cols])
    return df.select(id_col, F.inline(pairs)).where(F.col("text").isNotNull())


def term_counts(df: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """Rows ``(keys…, term, n)`` of a token array column. No shuffle."""
    return df.select(*keys, F.inline(count_runs(tokens)))


def word_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return term_counts(df, [id_col], words(text_col))


def ngram_counts(
    df: DataFrame, id_col: str, text_col: str, n_min: int = 1, n_max: int = 5, windows: bool = False
) -> DataFrame:
    """Counts of word n-grams joined by ``_``. ``windows`` gives them as ``gram_windows``, for a vocabulary only."""
    if windows:
        return gram_windows(df, words(text_col), n_min, n_max)
    return gram_counts(df, [id_col], words(text_col), n_min, n_max)


def gram_counts(
    df: DataFrame,
    keys: Sequence[str],
    tokens: Column,
    n_min: int,
    n_max: int,
    sep: str = "_",
    reword: Callable[[str], str] | None = None,
) -> DataFrame:
    """Rows ``(keys…, term, n)`` of each text's n-grams, orders ``n_min..n_max``. No shuffle.

    The same cells as ``term_counts`` of ``ngrams``. Grams are numbers while they are counted, about ``TOKENS_AT_ONCE`` tokens
    of whole texts at once, and a gram is spelt out once for all its places there. ``reword`` replaces each distinct word
    before it is counted.
    """
    rows = df.select(*keys, tokens.alias("_tokens"))
    names = [*keys, "term", "n"]
    schema = StructType([*rows.schema.fields[:-1], StructField("term", StringType()), StructField("n", LongType())])

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            lists = batch.column(len(keys))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.large_string())
            if reword:
                flat = _reworded(flat, reword, known)
            ends = np.cumsum(lengths)
            a = 0
            while a < len(lengths):
                start = ends[a] - lengths[a]
                b = max(a + 1, int(np.searchsorted(ends, start + TOKENS_AT_ONCE, "right")))
                held = flat.slice(start, ends[b - 1] - start)
                found = list(_counted_grams(held, np.repeat(np.arange(a, b), lengths[a:b]), n_min, n_max, sep))
                if len(found) > 1:
                    # a text's cells of all orders lie together
                    row, n = (np.concatenate([f[i] for f in found]) for i in (0, 2))
                    order = np.argsort(row, kind="stable")
                    found = [(row[order], pa.concat_arrays([f[1] for f in found]).take(pa.array(order)), n[order])]
                for row, term, n in found:
                    for k in range(0, len(row), TOKENS_AT_ONCE):
                        at = pa.array(row[k : k + TOKENS_AT_ONCE])
                        made = [term[k : k + TOKENS_AT_ONCE].cast(pa.string()), pa.array(n[k : k + TOKENS_AT_ONCE], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *made], names)
                a = b

    return rows.mapInArrow(run, schema)


def _reworded(tokens: pa.Array, reword: Callable[[str], str], known: dict[str, str]) -> pa.Array:
    """``tokens`` with each distinct one replaced; ``known`` holds those met before."""
    coded = tokens.dictionary_encode()
    found = coded.dictionary.to_pylist()
    made = [known.get(w) for w in found]
    if len(known) > WORDS_HELD:
        known.clear()
    for i, w in enumerate(found):
        if made[i] is None:
            made[i] = known[w] = reword(w)
    return pa.array(made, pa.large_string()).take(coded.indices)


def stem_counts(df: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """Rows ``(keys…, stem, n)`` of a token array column; rows of equal keys are one.

    A text's stems are counted in its task, where each distinct word of many texts is stemmed once.
    """
    cells = gram_counts(df, keys, tokens, 1, 1, reword=stem_word).withColumnRenamed("term", "stem")
    return cells.groupBy(*keys, "stem").agg(F.sum("n").alias("n"))


def gram_windows(df: DataFrame, tokens: Column, n_min: int, n_max: int, sep: str = "_") -> DataFrame:
    """Rows ``(window, marks, n)``: all n-grams of all texts in at most one row a token. No shuffle.

    The ``n_max`` words from a place on (fewer at a text's end) begin with the grams of all orders there. Bit ``k - 1`` of
    ``marks`` says that the gram of ``k`` words is the first of its kind in its text, so texts are counted without their
    ids; ``n`` such places are one row. Words must hold neither ``sep`` nor a character up to the blank, which parts them here.
    """
    rows = df.select(tokens.alias("_tokens"))
    orders = {"n_min": n_min, "n_max": n_max, "sep": sep}
    schema = StructType(
        [StructField("window", StringType(), metadata=orders), StructField("marks", LongType()), StructField("n", LongType())]
    )

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.large_string())
            ends = np.cumsum(lengths)
            a = 0
            while a < len(lengths):
                start = ends[a] - lengths[a]
                b = max(a + 1, int(np.searchsorted(ends, start + TOKENS_AT_ONCE, "right")))
                held = flat.slice(start, ends[b - 1] - start)
                for part in _windows(held, np.repeat(np.arange(b - a), lengths[a:b]), ends[a:b] - start, n_max):
                    yield pa.RecordBatch.from_arrays(part, ["window", "marks", "n"])
                a = b

    return rows.mapInArrow(run, schema)


def _windows(tokens: pa.Array, row: np.ndarray, ends: np.ndarray, n_max: int):
    """``window, marks, n`` of tokens whose ``row`` ascends and whose rows stop at ``ends``."""
    if not len(tokens):
        return
    coded = tokens.dictionary_encode()
    one, words_held = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    gram, grams, before = one, words_held, 0
    window, marks = one.copy(), np.zeros(len(row), np.int64)
    at = np.arange(len(row))
    for n in range(1, n_max + 1):
        if n > 1:
            before += grams
            at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else at[:0]
            if not len(at):
                break
            pair = pa.array(gram[at] * words_held + one[at + n - 1]).dictionary_encode()
            gram, grams = np.full(len(row), -1, np.int64), len(pair.dictionary)
            gram[at] = pair.indices.to_numpy()
            window[at] = before + gram[at]
        # codes are given as they appear: the first place of a gram in its row raises the highest code so far
        seen = np.maximum.accumulate(pa.array(row[at] * grams + gram[at]).dictionary_encode().indices.to_numpy())
        marks[at[np.diff(seen, prepend=-1) > 0]] |= 1 << (n - 1)
    same = pa.array(window << n_max | marks).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(same), prepend=-1) > 0)
    n = np.bincount(same)
    for k in range(0, len(first), TOKENS_AT_ONCE):
        place = first[k : k + TOKENS_AT_ONCE]
        size = np.minimum(n_max, ends[row[place]] - place)
        edges = np.concatenate([[0], np.cumsum(size)])
        held = tokens.take(pa.array(np.repeat(place - edges[:-1], size) + np.arange(edges[-1])))
        spelt = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), held), pa.scalar(" ", pa.large_string())).cast(pa.string())
        order = pc.sort_indices(spelt)
        yield [spelt.take(order), pa.array(marks[place]).take(order), pa.array(n[k : k + TOKENS_AT_ONCE]).take(order)]


def _counted_grams(tokens: pa.Array, row: np.ndarray, n_min: int, n_max: int, sep: str):
    """``row, term, n`` of the distinct n-grams of each row, order by order; ``row`` ascends."""
    if not len(tokens):
        return
    coded = tokens.dictionary_encode()
    one, word = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    gram, spelt, found = one, word, []
    for n in range(1, n_max + 1):
        if n > 1:
            # a gram of n - 1 words at i, and the word after it, if the text goes on so far
            left = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
            if not len(left):
                break
            pair = pa.array(gram[left] * len(word) + one[left + n - 1]).dictionary_encode()
            values = pair.dictionary.to_numpy()
            spelt = pc.binary_join_element_wise(
                spelt.take(pa.array(values // len(word))), word.take(pa.array(values % len(word))), pa.scalar(sep, pa.large_string())
            )
            gram = np.full(len(row), -1, np.int64)
            gram[left] = pair.indices.to_numpy()
        if n >= n_min:
            at = np.flatnonzero(gram >= 0)
            found.append(_runs(row[at] * len(spelt) + gram[at], None, spelt))
    if len(found) > 1 and pc.any(pc.match_substring(word, sep)).as_py():
        # other words may join to the same gram: rows are counted again by its letters
        rows, terms, ns = ([f[i] for f in found] for i in range(3))
        both = pa.concat_arrays(terms).dictionary_encode()
        key = np.concatenate(rows) * len(both.dictionary) + both.indices.to_numpy().astype(np.int64)
        found = [_runs(key, np.concatenate(ns), both.dictionary)]
    yield from found


def _runs(key: np.ndarray, n: np.ndarray | None, spelt: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows, terms and how often of the keys ``row * len(spelt) + gram``; each key counts ``n`` times, or once."""
    coded = pa.array(key).dictionary_encode()
    values = coded.dictionary.to_numpy()
    total = np.bincount(coded.indices.to_numpy(), n, len(values)).astype(np.int64)
    return values // len(spelt), spelt.take(pa.array(values % len(spelt))), total


def drop_listed(cells: DataFrame, listed: DataFrame) -> DataFrame:
    """Stop-word removal: anti join against a word table (column ``term``)."""
    return lookup(cells, listed.select("term").distinct(), "term", "left_anti")


def keep_listed(cells: DataFrame, listed: DataFrame) -> DataFrame:
    """Semi join against a word table (column ``term``)."""
    return lookup(cells, listed.select("term").distinct(), "term", "left_semi")


def vocabulary(cells: DataFrame, by: Sequence[str] = (), min_docfreq: int = 1) -> DataFrame:
    """``(by…, term, term_count, doc_count)`` of terms in at least ``min_docfreq`` texts. Partial counts run before the shuffle.

    ``cells`` may also be ``gram_windows``: they are sorted once, and the grams of all orders are runs of common beginnings.
    """
    if "window" in cells.columns:
        return _window_vocabulary(cells, min_docfreq)
    found = _counted(cells, by)
    return found if min_docfreq <= 1 else trim_docfreq(found, min_docfreq)


def _counted(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "term").agg(
        F.sum("n").alias("term_count"), F.count("*").alias("doc_count")
    )


def _window_vocabulary(windows: DataFrame, min_docfreq: int) -> DataFrame:
    """The vocabulary of ``gram_windows``. Only grams of enough texts, and those that rows read later may continue, go on to be summed."""
    orders = windows.schema["window"].metadata
    n_min, n_max, sep = orders["n_min"], orders["n_max"], orders["sep"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= TOKENS_AT_ONCE:
                yield from _runs_of_words(pa.Table.from_batches(held), n_min, n_max, sep, min_docfreq)
                held, size = [], 0
        if size:
            yield from _runs_of_words(pa.Table.from_batches(held), n_min, n_max, sep, min_docfreq)

    ordered = windows.repartitionByRange("window").sortWithinPartitions("window")
    runs = ordered.mapInArrow(run, "term string, term_count long, doc_count long")
    found = runs.groupBy("term").agg(F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"))
    return trim_docfreq(found, min_docfreq)


def _runs_of_words(windows: pa.Table, n_min: int, n_max: int, sep: str, min_docfreq: int):
    """``term, term_count, doc_count`` of sorted windows. The first and the last gram of an order may be only a part."""
    parts = pc.split_pattern(windows["window"].combine_chunks(), " ")
    marks, n = (windows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("marks", "n"))
    lengths = parts.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    word = np.full((len(lengths), n_max), -1, np.int32)
    word[row, np.arange(len(row)) - starts[row]] = parts.flatten().dictionary_encode().indices.to_numpy()
    new = np.arange(len(lengths)) == 0
    for k in range(1, n_max + 1):
        new[1:] |= word[1:, k - 1] != word[:-1, k - 1]
        if k < n_min:
            continue
        at = np.flatnonzero(new)
        count, texts = np.add.reduceat(n, at), np.add.reduceat(n * (marks >> (k - 1) & 1), at)
        keep = texts >= min_docfreq
        keep[[0, -1]] = True
        keep &= word[at, k - 1] >= 0
        term = pc.binary_join(pc.list_slice(parts.take(pa.array(at[keep])), 0, k), sep)
        yield pa.RecordBatch.from_arrays([term, pa.array(count[keep]), pa.array(texts[keep])], ["term", "term_count", "doc_count"])


def trim_docfreq(vocab: DataFrame, min_docfreq: int = 2) -> DataFrame:
    """Terms that occur in at least ``min_docfreq`` texts."""
    return vocab.where(F.col("doc_count") >= min_docfreq)


def prune_vocabulary(
    vocab: DataFrame, docs: DataFrame, term_count_min: int = 25, doc_proportion_max: float = 0.90
) -> DataFrame:
    """Terms frequent enough overall and not in too large a share of the texts."""
    share = F.col("doc_count") / docs.agg(F.count("*")).scalar()
    return vocab.withColumn("doc_share", share).where(
        (F.col("term_count") >= term_count_min) & (F.col("doc_share") <= doc_proportion_max)
    )


def keep_vocabulary(cells: DataFrame, vocab: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells whose term is in a (pruned) vocabulary."""
    kept = vocab.select(*by, "term", "doc_count")
    return join_vocabulary(cells, kept, "doc_count", [*by, "term"]).drop("doc_count")


def tfidf_log10(
    cells: DataFrame, docs: DataFrame, by: Sequence[str] = (), vocab: DataFrame | None = None
) -> DataFrame:
    """``n * log10(N / df)`` without smoothing. Texts are counted once: their cells are written before the vocabulary is made of them."""
    if vocab is None:
        cells = written(cells)
    found = join_vocabulary(
        cells,
        (vocabulary(cells, by) if vocab is None else vocab).select(*by, "term", "doc_count"),
        "doc_count",
        [*by, "term"],
        stored=vocab is None,
        whole=vocab is None,
    )
    total = docs.agg(F.count("*")).scalar()
    return found.withColumn("weight", F.col("n") * F.log10(total / F.col("doc_count"))).drop(
        "doc_count"
    )


def tfidf_smooth_l2(cells: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``n * (ln((1+N)/(1+df)) + 1)``, then each text scaled to unit length; ``cells`` are ``id, term, n``.

    Texts are counted once and packed into blocks of whole texts, in which a cell is the place of its term in the block's sorted
    terms. A block asks for the document frequencies of each of its terms once, range of terms by range, and gets numbers
    back in the order of the terms. No cell is shuffled by its term, and none by its text unless a text's cells lie in several blocks.
    """
    cells = cells.select(id_col, "term", "n")
    spark, total = cells.sparkSession, docs.count()
    blocks = written(_blocks_of(cells, id_col))
    made = blocks.select("block", "n_terms").collect()
    slots = spark.createDataFrame([(b, i) for i, b in enumerate(sorted(r["block"] for r in made))], "block long, slot int")
    split = bool(blocks.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").limit(1).count())
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("ids", "lengths", "terms", "at", "n")]
    asked = _doc_counts(blocks, sum(r["n_terms"] for r in made))
    both = blocks.select("block", F.lit(-1).alias("range"), "ids", "lengths", "terms", "at", "n", F.lit(None).cast("binary").alias("df"))
    both = both.unionByName(asked.select("block", "range", *none, "df")).join(F.broadcast(slots), "block").drop("block")
    schema = StructType([*cells.schema.fields, StructField("tfidf", DoubleType())])

    def weigh(batches):
        block, counts = None, {}
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                if at < 0:
                    block = batch.slice(i, 1)
                else:
                    counts[at] = _spread_out(batch.column(6)[i].as_py())
        if block is None:
            return
        ids = block.column(1).flatten()
        lengths, steps, n = (_spread_out(block.column(c)[0].as_py()) for c in (2, 4, 5))
        terms, df = _spelt(block.column(3)[0].as_py()), np.concatenate([counts[r] for r in sorted(counts)])
        owner, at = np.repeat(np.arange(len(lengths)), lengths), _places(steps, lengths)
        weight = n * (np.log((1.0 + total) / (1.0 + df)) + 1.0)[at]
        if not split:
            weight /= np.sqrt(np.bincount(owner, weight * weight, len(lengths)))[owner]
        for k in range(0, len(at), TOKENS_AT_ONCE):
            part = slice(k, k + TOKENS_AT_ONCE)
            columns = [ids.take(pa.array(owner[part])), terms.take(pa.array(at[part])).cast(pa.string()), pa.array(n[part]), pa.array(weight[part])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    dealt = both.select("range", "ids", "lengths", "terms", "at", "n", "df", "slot").repartitionById(max(1, len(made)), "slot")
    found = dealt.drop("slot").mapInArrow(weigh, schema)
    if split:
        norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(id_col)))
        found = found.withColumn("tfidf", F.col("tfidf") / norm)
    return found


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers, their bytes by place, compressed."""
    planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _spread_out(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _letters(terms: pa.LargeStringArray) -> bytes:
    """Terms in order as compressed lengths and letters."""
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    letters = terms.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if ends[-1] > ends[0] else pa.py_buffer(b"")
    lengths = _squeezed(np.diff(ends))
    return len(lengths).to_bytes(8, "little") + lengths + pa.Codec("zstd", 9).compress(letters, asbytes=True)


def _spelt(packed: bytes) -> pa.LargeStringArray:
    end = 8 + int.from_bytes(packed[:8], "little")
    ends = np.concatenate([[0], np.cumsum(_spread_out(packed[8:end]))]).astype(np.int64)
    letters = pa.decompress(packed[end:], int(ends[-1]), "zstd")
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), letters)


def _places(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of cells from the steps between those of a text."""
    total, starts = np.cumsum(steps), np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - steps[starts], lengths)


def _blocks_of(cells: DataFrame, id_col: str) -> DataFrame:
    """``block, ids, lengths, n_terms, terms, at, n`` of about ``BLOCK_CELLS`` cells of whole texts, as far as their cells come together.

    ``terms`` are the block's terms in order; ``at`` the steps from place to place of each text's cells, ``n`` their counts.
    """

    def codes(ids):
        coded = ids.dictionary_encode("encode")
        return (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy()

    def packed(table, block):
        table = table.combine_chunks()
        ids, terms, n = (table.column(i).combine_chunks() if isinstance(table.column(i), pa.ChunkedArray) else table.column(i) for i in range(3))
        heads = np.flatnonzero(np.diff(codes(ids), prepend=-1))
        lengths = np.diff(np.append(heads, len(ids)))
        coded = terms.cast(pa.large_string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[coded.indices.to_numpy()]
        by_text = np.lexsort((at, np.repeat(np.arange(len(heads)), lengths)))
        at, n = at[by_text], n.to_numpy()[by_text]
        steps = np.diff(at, prepend=0)
        steps[heads] = at[heads]
        values = [[block], [ids.take(pa.array(heads))], [_squeezed(lengths)], [len(order)], [_letters(coded.dictionary.take(pa.array(order)))], [_squeezed(steps)], [_squeezed(n)]]
        kinds = [pa.int64(), None, pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(v, k) if k else pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), v[0]) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "lengths", "n_terms", "terms", "at", "n"])

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BLOCK_CELLS:
                continue
            table = pa.Table.from_batches(held)
            new = np.flatnonzero(np.diff(codes(table.column(0))))
            if len(new):
                cut = int(new[-1]) + 1
                yield packed(table.slice(0, cut), block)
                block, table = block + 1, table.slice(cut).combine_chunks()
                held, size = table.to_batches(), len(table)
        if size:
            yield packed(pa.Table.from_batches(held), block)

    kind = cells.schema[id_col].dataType
    names = {"block": LongType(), "ids": ArrayType(kind), "lengths": BinaryType(), "n_terms": LongType(), "terms": BinaryType(), "at": BinaryType(), "n": BinaryType()}
    return cells.mapInArrow(run, StructType([StructField(k, v) for k, v in names.items()]))


def _doc_counts(blocks: DataFrame, asked: int) -> DataFrame:
    """``block, range, df``: in how many cells each of a block's terms occurs in all blocks, by ranges of about ``RANGE_TERMS`` asked terms."""
    spark, ranges = blocks.sparkSession, -(-asked // RANGE_TERMS)
    bounds: list[str] = []
    if ranges > 1:
        step = max(1, RANGE_TERMS // 64)

        def some(batches):
            for batch in batches:
                for packed in batch.column(0):
                    terms = _spelt(packed.as_py())
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(range(0, len(terms), step))).cast(pa.string())], ["term"])

        # they say only where ranges end
        seen = sorted(r[0] for r in blocks.select("terms").mapInArrow(some, "term string").collect())
        bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)})

    def ask(batches):
        for batch in batches:
            for i in range(len(batch)):
                terms, lengths = _spelt(batch.column(1)[i].as_py()), _spread_out(batch.column(2)[i].as_py())
                found = np.bincount(_places(_spread_out(batch.column(3)[i].as_py()), lengths), minlength=len(terms))
                cuts = [0, *(bisect_left(terms, b, key=lambda t: t.as_py()) for b in bounds), len(terms)]
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        values = [[batch.column(0)[i].as_py()], [r], [_letters(terms.slice(a, b - a))], [_squeezed(found[a:b])]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["block", "range", "terms", "df"])

    def answer(batches):
        held = [(b, r, _spelt(t), _spread_out(n)) for batch in batches for b, r, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not held:
            return
        place = pa.chunked_array([h[2] for h in held]).combine_chunks().dictionary_encode().indices.to_numpy()
        found = np.bincount(place, np.concatenate([h[3] for h in held])).astype(np.int64)[place]
        end = 0
        for block, r, terms, _ in held:
            end += len(terms)
            values = [[block], [r], [_squeezed(found[end - len(terms) : end])]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["block", "range", "df"])

    sent = blocks.select("block", "terms", "lengths", "at").mapInArrow(ask, "block long, range int, terms binary, df binary")
    return sent.repartitionById(len(bounds) + 1, "range").mapInArrow(answer, "block long, range int, df binary")


def top_terms(weights: DataFrame, id_col: str, weight_col: str, k: int = 10) -> DataFrame:
    """The ``k`` heaviest terms of every text, ties by term."""
    order = Window.partitionBy(id_col).orderBy(F.col(weight_col).desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_zero_variance(
    cells: DataFrame,
    docs: DataFrame,
    by: Sequence[str] = (),
    freq_cut: float = 95 / 5,
    unique_cut: float = 10,
    weighted: bool = False,
) -> DataFrame:
    """Per term: how one-sided its column of counts is, zeros included, and ``nzv``.

    The column is never built: its non-zero values come from a histogram of the
    cells and the zero bucket is ``N - df``. ``weighted`` judges the log10 TF-IDF
    column, where a term of every text is all zeros.
    """
    keys = [*by, "term"]
    total = docs.agg(F.count("*")).scalar()
    buckets = cells.groupBy(*keys, "n").agg(F.count("*").alias("held"))
    order = Window.partitionBy(*keys).orderBy(F.col("held").desc(), "n")
    ranked = buckets.withColumn("rank", F.row_number().over(order))
    shape = ranked.groupBy(*keys).agg(
        F.sum("held").alias("doc_count"),
        F.count("*").alias("values"),
        F.max(F.when(F.col("rank") == 1, F.col("held"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("held"))).alias("second"),
    )
    zeros = total - F.col("doc_count")
    shape = shape.select(
        *keys,
        "doc_count",
        (F.col("values") + (zeros > 0).cast("int")).alias("distinct_values"),
        F.greatest("first", zeros).alias("top"),
        F.when(zeros >= F.col("first"), F.col("first"))
        .otherwise(F.greatest(F.when(zeros > 0, zeros), F.col("second")))
        .alias("next"),
    )
    single = F.col("distinct_values") == 1
    if weighted:
        single = single | (F.col("doc_count") == total)
    freq_ratio = F.col("top") / F.col("next")
    percent = 100 * F.col("distinct_values") / total
    return shape.select(
        *keys,
        "doc_count",
        freq_ratio.alias("freq_ratio"),
        percent.alias("percent_unique"),
        (single | F.coalesce((freq_ratio > freq_cut) & (percent <= unique_cut), F.lit(False))).alias(
            "nzv"
        ),
    )


def likely_varied(
    cells: DataFrame,
    docs: DataFrame,
    by: Sequence[str] = (),
    freq_cut: float = 95 / 5,
    unique_cut: float = 10,
) -> DataFrame:
    """Cells of the terms that may pass the near-zero-variance test, written out once.

    A term of ``df`` texts has a ratio of at least ``(N - df) / df`` and at most
    ``df + 1`` values, so rare terms fail without a look at their histogram. What
    is left is at most ``freq_cut + 1`` times a text's usual number of terms.
    """
    total = docs.agg(F.count("*")).scalar()
    df = F.col("doc_count")
    rare = (df * (freq_cut + 1) < total) & (100 * (df + 1) <= unique_cut * total)
    return checkpoint(keep_vocabulary(cells, vocabulary(cells, by).where(~rare), by))


def number_terms(
    vocab: DataFrame, by: Sequence[str] = (), buckets: int = 1024
) -> DataFrame:
    """Give every distinct term a dense index ``0..V-1`` without a global sort.

    Terms fall into hash buckets; a bucket's start is the running total of the
    bucket sizes (at most ``buckets`` rows), and terms are numbered inside it.
    """
    vocab = checkpoint(vocab)  # read twice below
    hashed = vocab.withColumn("_bucket", F.pmod(F.xxhash64(*by, "term"), F.lit(buckets)))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy(*by, "term")
    return (
        hashed.join(F.broadcast(starts), "_bucket")
        .withColumn("term_index", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def sparse_rows(
    cells: DataFrame,
    vocab: DataFrame,
    id_col: str,
    value_col: str = "n",
    by: Sequence[str] = (),
) -> DataFrame:
    """One sparse vector per text, as ``(id, indices, values)`` arrays in index order.

    ``vocab`` carries ``term``, ``term_index`` and ``doc_count``. A text's cells
    are all one row holds, so the collected lists are as long as its vocabulary.
    """
    placed = join_vocabulary(
        cells, vocab.select(*by, "term", "term_index", "doc_count"), "doc_count", [*by, "term"]
    )
    pairs = F.array_sort(
        F.collect_list(F.struct("term_index", F.col(value_col).cast("double").alias("value")))
    )
    return (
        placed.groupBy(id_col)
        .agg(pairs.alias("pairs"))
        .select(
            id_col,
            F.col("pairs.term_index").alias("indices"),
            F.col("pairs.value").alias("values"),
        )
    )


def lemmatise(cells: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace terms by their lemma from a ``(term, lemma)`` table; others stay as they are."""
    found = lookup(cells, lemmas.select("term", "lemma"), "term", "left")
    keys = [c for c in cells.columns if c not in ("term", "n")]
    return (
        found.withColumn("term", F.coalesce("lemma", "term"))
        .groupBy(*keys, "term")
        .agg(F.sum("n").alias("n"))
    )


def wide_counts(
    df: DataFrame, id_col: str, tokens: Column, terms: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One count column per named term, for a vocabulary short enough for columns.

    Map-only: the text's own counts of the named terms become a map and each column looks one term up. Other terms never
    enter the map, because a lookup reads it from its start.
    """
    named = F.filter(tokens, lambda t: t.isin(list(terms)))
    counts = df.select(id_col, F.map_from_entries(count_runs(named)).alias("counts"))
    return counts.select(
        id_col,
        *[
            F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0)).alias(f"{prefix}{t}")
            for t in terms
        ],
    )
