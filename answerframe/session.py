"""Session helpers: settings, input spreading, checkpoints and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files go when the DataFrame that holds them does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites of every column are only worth their cost while debugging
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "answerframe") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for data kept between jobs, shared by driver and executors.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local-mode
    session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small input over all cores; leave an input with enough partitions alone.

    A file with a single row group is read by one task whatever its size, which
    would run every map-only expression on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def fits_broadcast(df: DataFrame, max_rows: int = 200_000, max_chars: int = 8_000_000) -> bool:
    """True if ``df`` is proven small. Reads at most ``max_rows + 1`` rows of it."""
    chars = [F.length(c) for c, kind in df.dtypes if kind == "string"]
    width = sum(chars[1:], chars[0]) if chars else F.lit(0)
    rows, size = (
        df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    )
    return rows <= max_rows and size <= max_chars


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, is compressed, and starts a plan of its own.

    In a loop this is the cheaper cut: a checkpointed DataFrame carries its plan's constraints into the next round.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made and ``df`` reads, in whatever store it lies; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
