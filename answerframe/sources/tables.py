"""Readers and writers: responses, question keys, features, submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ANSWERS
from ..operators.columns import unpivot

TRAITS = ["E", "A", "O", "C", "N"]
TARGETS = [f"{t}_Scale_score" for t in TRAITS]
# The question key lists its prompts in answer order.
QUESTION_ORDER = ["A", "C", "E", "N", "O"]

RESPONSES = T.StructType(
    [T.StructField("Respondent_ID", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ANSWERS]
    + [T.StructField(c, T.DoubleType()) for c in TARGETS]
    + [T.StructField("Dataset", T.StringType())]
)

# Free text holds quotes and line breaks; empty text and missing text differ.
QUOTING = {"header": True, "quote": '"', "escape": '"'}
EXACT = {"nullValue": r"\N", "emptyValue": ""}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, missing: str = "NA"
) -> DataFrame:
    """A headered CSV with multi-line quoted text.

    Columns are matched by header name; with a schema, one pass and no type
    guessing. Parquet is the format for big data: a quoted multi-line CSV file
    cannot be split between tasks.
    """
    options = QUOTING | {"multiLine": True, "nullValue": missing, "emptyValue": ""}
    if schema is None:
        return spark.read.csv(path, inferSchema=True, **options)
    names = spark.read.csv(path, **options).columns
    known = {f.name: f for f in schema.fields}
    absent = [n for n in known if n not in names]
    if absent:
        raise ValueError(f"columns missing in {path}: {absent}")
    in_file = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.csv(path, schema=in_file, **options).select(*known)


def read_responses(spark: SparkSession, path: str, missing: str = "NA") -> DataFrame:
    """The respondent table, from CSV or parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(RESPONSES).parquet(path)
    return read_csv(spark, path, RESPONSES, missing)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The one-row question key as ``(trait, question)`` rows."""
    schema = T.StructType([T.StructField(t, T.StringType()) for t in QUESTION_ORDER])
    return unpivot(read_csv(spark, path, schema), QUESTION_ORDER, "trait", "question")


def read_features(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, format: str = "parquet"
) -> DataFrame:
    """A stored feature table, or the chosen columns of it."""
    df = (
        spark.read.parquet(path)
        if format == "parquet"
        else spark.read.csv(path, inferSchema=True, multiLine=True, **QUOTING, **EXACT)
    )
    return df if columns is None else df.select(*columns)


def write_features(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a feature table. CSV keeps null and empty text apart and holds nested values as JSON."""
    if format == "parquet":
        df.write.parquet(path)
        return
    columns = [
        F.to_json(vector_to_array(c) if kind == "vector" else F.col(c)).alias(c)
        if kind.startswith(("array", "struct", "map", "vector"))
        else F.col(c)
        for c, kind in df.dtypes
    ]
    df.select(*columns).write.csv(path, quoteAll=True, **QUOTING, **EXACT)


def submission(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions ``(Respondent_ID, trait, pred)`` laid out as the template asks.

    Every template row stays; a respondent without a prediction keeps blanks.
    """
    wide = predictions.groupBy("Respondent_ID").agg(
        *[F.max(F.when(F.col("trait") == t, F.col("pred"))).alias(f"{t}_Pred") for t in TRAITS]
    )
    return template.select("Respondent_ID").join(wide, "Respondent_ID", "left")
