"""Polarity with negation, amplification and clause borders.

Rule: a clause ends at ``, ; :``. Around each polar word of weight ``p`` (four
words before, two after, same clause) count negators ``n``, amplifiers ``a`` and
de-amplifiers ``d``. For odd ``n`` the amplifiers work as de-amplifiers. Score
``p * (-1)^n * (1 + 0.8 a - min(0.8 d, 1))``; a sentence is the sum over its
words divided by the root of their number. A text is the sum of its sentences
over ``count(non-zero) + sqrt(ln(1 + count(zero)))``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import CLAUSE_END, SENTENCE_END, words
from .joins import lookup

BEFORE, AFTER, STEP = 4, 2, 0.8


def valence_table(polarity: DataFrame, shifters: DataFrame) -> DataFrame:
    """One row per word: its polarity weight and its shifter kind, if any."""
    polar = polarity.groupBy(F.col("word").alias("term")).agg(F.sum("weight").alias("weight"))
    kinds = shifters.groupBy(F.col("word").alias("term")).agg(F.max("kind").alias("kind"))
    return polar.join(kinds, "term", "full")


def shifter_sentiment(
    df: DataFrame,
    id_col: str,
    text_cols: Sequence[str],
    polarity: DataFrame,
    shifters: DataFrame,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One polarity column per text column, 0 for texts without polar words.

    Only lexicon words and one anchor row per text reach the shuffle, where the
    window over word positions sees the neighbours it needs. One hash partitioning
    by respondent serves the window and both aggregates.
    """
    names = list(text_cols) if names is None else list(names)
    fields = F.array(
        *[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(text_cols)]
    )
    texts = df.select(id_col, F.inline(fields))
    sentences = F.split(F.lower("text"), SENTENCE_END)
    pieces = texts.select(id_col, "field", F.posexplode(sentences).alias("sent", "sentence")).where(
        F.col("sentence").rlike(r"\p{L}")
    )
    clauses = pieces.select(
        id_col,
        "field",
        "sent",
        F.size(words("sentence")).alias("n_words"),
        F.posexplode(F.split("sentence", CLAUSE_END)).alias("clause", "part"),
    )
    tokens = clauses.select(
        id_col, "field", "sent", "clause", "n_words", F.posexplode(words("part")).alias("pos", "term")
    )
    hits = lookup(tokens, valence_table(polarity, shifters), "term", "inner").select(
        id_col, "field", "sent", "clause", "n_words", "pos", "weight", "kind"
    )
    sentence_total = F.size(F.filter(sentences, lambda s: s.rlike(r"\p{L}")))
    anchors = texts.select(
        id_col,
        "field",
        F.lit(-1).alias("sent"),
        F.lit(-1).alias("clause"),
        F.coalesce(sentence_total, F.lit(0)).alias("n_words"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("string").alias("kind"),
    )
    rows = hits.unionByName(anchors).repartition(id_col)
    near = (
        Window.partitionBy(id_col, "field", "sent", "clause")
        .orderBy("pos")
        .rangeBetween(-BEFORE, AFTER)
    )

    def around(kind: str):
        return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(near)

    seen = rows.select(
        id_col,
        "field",
        "sent",
        "n_words",
        "weight",
        around("negator").alias("neg"),
        around("amplifier").alias("amp"),
        around("deamplifier").alias("deamp"),
    )
    odd = F.col("neg") % 2 == 1
    amp = F.when(odd, 0).otherwise(F.col("amp"))
    deamp = F.col("deamp") + F.when(odd, F.col("amp")).otherwise(0)
    score = (
        F.col("weight")
        * F.when(odd, -1).otherwise(1)
        * (1 + STEP * amp - F.least(STEP * deamp, F.lit(1.0)))
    )
    scored = seen.groupBy(id_col, "field", "sent").agg(
        F.max("n_words").alias("n_words"), F.sum(score).alias("total")
    )
    mark = F.col("sent") == -1
    x = F.when(~mark, F.coalesce("total", F.lit(0.0)) / F.sqrt("n_words"))
    per_text = scored.groupBy(id_col, "field").agg(
        F.sum(x).alias("total"),
        F.sum(F.when(x != 0, 1).otherwise(0)).alias("polar"),
        F.max(F.when(mark, F.col("n_words"))).alias("sentences"),
    )
    weight = F.col("polar") + F.sqrt(F.log(1.0 + F.col("sentences") - F.col("polar")))
    value = F.when(F.col("polar") > 0, F.col("total") / weight).otherwise(0.0)
    return per_text.groupBy(id_col).agg(
        *[F.max(F.when(F.col("field") == i, value)).alias(n) for i, n in enumerate(names)]
    )
