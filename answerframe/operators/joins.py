"""Joins of term rows with term tables that hold up under hot terms.

A term such as "the" can sit in a third of all rows, so a plain shuffle join on
the term would send them all to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, fits_broadcast, written

#: Terms broadcast as the head; any other term holds less than 1/HEAD_TERMS of all cells.
HEAD_TERMS = 100_000
#: Cells of one term that a task should get at most.
TERM_CELLS = 1_000_000
SALTS = 64
VOCABULARY_ROWS, VOCABULARY_CHARS = 1_000_000, 32_000_000


def join_vocabulary(
    cells: DataFrame, vocab: DataFrame, freq_col: str, on: list[str], stored: bool = False, whole: bool = False
) -> DataFrame:
    """Inner join of ``cells`` with a vocabulary that is unique on ``on``.

    The vocabulary is written to the checkpoint folder once, as it is an aggregate
    over all texts and read several times here. One proven small is broadcast.
    ``freq_col`` is how many cells an entry matches. Beyond a broadcast the cells are read several times too, so
    they are written, unless they are ``stored`` already. A ``whole`` vocabulary holds every cell's term, so its
    ``freq_col`` says how many cells a term has, and they are not counted again.
    """
    vocab = checkpoint(vocab)
    if fits_broadcast(vocab, VOCABULARY_ROWS, VOCABULARY_CHARS):
        return cells.join(F.broadcast(vocab), on).select(*cells.columns, *_others(vocab, on))
    counts = vocab.select(*on, F.col(freq_col).alias("_cells")) if whole else None
    return _head_tail_join(cells if stored else written(cells), vocab, on, counts)


def _others(df: DataFrame, on: list[str]) -> list[str]:
    return [c for c in df.columns if c not in on]


def _head_tail_join(
    cells: DataFrame, vocab: DataFrame, on: list[str], counts: DataFrame | None = None
) -> DataFrame:
    """Settle the hottest terms by a broadcast, shuffle only the cells of the others.

    The head is chosen from the cells themselves, because a pruned vocabulary has lost
    just the hottest terms: at most ``HEAD_TERMS`` terms can each hold 1/``HEAD_TERMS`` of all
    cells, kept or not. Cells of head terms are kept or dropped where they are. A term of the tail is cut
    into as many tasks as its largest possible number of cells asks for.
    """
    values = _others(vocab, on)
    if counts is None:
        counts = checkpoint(cells.groupBy(*on).agg(F.count("*").alias("_cells")))
    total = counts.agg(F.coalesce(F.sum("_cells"), F.lit(0))).scalar()
    hot = counts.where(F.col("_cells") * HEAD_TERMS >= total).select(*on)
    entry = vocab.select(*on, F.struct(*values).alias("_entry"))
    head = checkpoint(hot.join(entry, on, "left"))
    settled = cells.join(F.broadcast(head), on).where(F.col("_entry").isNotNull())
    settled = settled.select(*cells.columns, *[F.col("_entry")[v].alias(v) for v in values])
    most = counts.agg(F.coalesce(F.sum("_cells"), F.lit(0))).first()[0] // HEAD_TERMS
    salts = 1 + int(most // TERM_CELLS)
    tail = cells.join(F.broadcast(head.select(*on)), on, "left_anti")
    rest = entry.join(F.broadcast(head.select(*on)), on, "left_anti")
    keys = on
    if salts > 1:
        keys = [*on, "_salt"]
        tail = tail.withColumn("_salt", F.pmod(F.xxhash64(*cells.columns), F.lit(salts)))
        each = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
        rest = rest.withColumn("_salt", F.explode(each))
    found = tail.join(rest, keys)
    return settled.unionByName(
        found.select(*cells.columns, *[F.col("_entry")[v].alias(v) for v in values])
    )


def lookup(cells: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``cells`` with a lexicon-like table that is unique on ``on``.

    A table proven small is broadcast. A larger one is copied once per salt and
    joined on term and salt, which cuts a hot term into ``SALTS`` tasks.
    """
    if fits_broadcast(table):
        return cells.join(F.broadcast(table), on, how)
    salted = cells.withColumn("_salt", F.pmod(F.xxhash64(*cells.columns), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = copies.withColumn("_salt", F.col("_salt").cast("long"))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
