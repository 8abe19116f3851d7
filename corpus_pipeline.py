"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Each stage reads what its predecessor kept as a stored table and returns a DataFrame. All but the last return the columns of
``documents``. Rows are told apart by their place in the stored table, so ids may repeat or be null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from answerframe.llm import linededup, mixing, packing, quality, resemblance
from answerframe.llm.common import documents
from answerframe.session import checkpoint, checkpoint_folder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by place and ``row``, a number of their own.

    Numbers depend on how the scan is cut, so they are given once and kept: whatever reads the table sees the same.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return checkpoint(plain.withColumn("row", F.monotonically_increasing_id()))


def _of_rows(rows: DataFrame, docs: DataFrame, *names: str, **made: Column) -> DataFrame:
    """The named columns of numbered rows and those made of them, with the row number as ``doc_id``."""
    columns = [F.col(f"c{docs.columns.index(n)}").alias(n) for n in names]
    return rows.select(F.col("row").alias("doc_id"), *columns, *[c.alias(n) for n, c in made.items()])


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. Nulls are values of its views; an empty table stays empty."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    plain = scored.toDF(*[f"c{i}" for i in range(len(scored.columns))])
    kept = plain.where(F.col(f"c{len(scored.columns) - 1}"))
    return kept.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten or more of them; ``n_chars`` follows the text. A null text becomes an empty one."""
    cleaned = linededup.LineIndex.build(docs).apply(docs)
    plain = cleaned.toDF(*[f"c{i}" for i in range(len(cleaned.columns))])
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars")
    columns = [
        F.length(f"c{text}").cast("long").alias(f"c{i}") if i == chars else F.col(f"c{i}")
        for i in range(len(docs.columns))
    ]
    return plain.select(*columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Two are near if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more: SimHash fingerprints in vantage-point
    trees find the pairs within three bits, MinHash bands those that differ in more, whole sets decide. All texts without a word are one
    group. Among equal ids the first row stays; a null id stays only if its group has no other.
    """
    rows = _numbered(docs)
    groups = resemblance.similar_groups(_of_rows(rows, docs, "text")).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("group")
    )
    ids = rows.select("row", F.col(f"c{docs.columns.index('doc_id')}").alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    first = groups.join(ids, "row").groupBy("group").agg(F.min_by("row", order).alias("row")).select("row")
    return rows.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; drawn by id and text, wherever a row lies."""
    rows = _numbered(docs)
    content = F.xxhash64(*[f"c{docs.columns.index(n)}" for n in ("doc_id", "text")])
    mixed = mixing.mix(_of_rows(rows, docs, "text", "source", content=content), draw_by="content")
    taken = mixed.where("repeats > 0").select(F.col("doc_id").alias("row"), "repeats")
    repeated = rows.join(taken, "row").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return repeated.drop("row", "repeats", "turn").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed into sequences of at most 1024 tokens, with their token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_common_lines),
    ("near-dedup", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Models, fingerprints, bands, seeded choices and token ids cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again by the next.

    A stage's copy goes as soon as the next stage is written; the last one is what the result reads.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
