"""Session defaults for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "skeinwork", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session with AQE on and UTC pinned; ``conf`` overrides single settings."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir`` where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='skeinwork-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/skeinwork/{label}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Three tasks a core, or all shuffle partitions where those are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt over ``tasks``.

    For small rows that are costly to work on: adaptive execution counts bytes, so it would give them to a task or two.
    """
    return df.repartition(tasks(df.sparkSession), *columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that later steps don't compute it again."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
