"""The driver's tables in the roles the survey data would play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ANSWERS
from ..session import spread

# Share of the sources per split label, by name.
DEV_SOURCES = ["src14", "src15", "src16"]
TEST_SOURCES = ["src17", "src18", "src19"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive turns of a conversation as one respondent's five answers.

    The key is (conversation, block of five turns), so a long conversation is
    many respondents, each made of at most five rows. The partition count is
    stated, because texts are cheap in bytes and dear in work: merging the
    partitions by size would leave most cores idle.
    """
    turns = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100_000 + F.floor(F.col("turn") / 5)).alias("respondent_id"),
        (F.col("turn") % 5).alias("slot"),
        "text",
    )
    parts = max(turns.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    return turns.repartition(parts, "respondent_id").groupBy("respondent_id").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("text"))).alias(c) for i, c in enumerate(ANSWERS)]
    )


def labelled_split(df: DataFrame) -> DataFrame:
    """Add the ``Dataset`` label of a document from its source."""
    label = (
        F.when(F.col("source").isin(DEV_SOURCES), "Dev")
        .when(F.col("source").isin(TEST_SOURCES), "Test")
        .otherwise("Train")
    )
    return df.withColumn("Dataset", label)
