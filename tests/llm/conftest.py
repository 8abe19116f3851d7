import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, over several partitions."""

    def build(rows, parts=3):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return build


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, None),
    (4, "one", "en", "b"),
    (5, "Only One line, twice.\nOnly One line, twice.", "en", "b"),
    (5, "Only One line, twice.\nOnly One line, twice.", "en", "b"),
    (6, "été naïve 漢字 😀 ! 12345", "fr", None),
    (7, "word " * 30000, "en", "c"),
    (None, "no id here", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(make):
    return make(EDGE)


@pytest.fixture(scope="session")
def odd_docs(edge_docs):
    """The edge rows with more columns, some named like columns the operators make or use inside."""
    names = "fp component_id score lang_pred n_lines n_dropped key draw size row shard hi lo c0 TEXT a.b start"
    return with_columns(edge_docs, names.split())


@pytest.fixture(scope="session")
def stored_odd_docs(edge_docs):
    """The same for tables that can be stored, where names may not differ in case alone."""
    return with_columns(edge_docs, "fp component_id score keep row group repeats turn key draw size hi lo c0 c1 id".split())


def with_columns(df, names):
    return df.select("*", *[F.lit(k).cast("int").alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def sf_small():
    return SMALL
