"""Rows as files that a file stream takes in the order of a column, one range of it in each file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skeinwork.session import work_dir

_OLDEST = 10**12


def ordered_files(rows: DataFrame, column: str, n: int) -> str:
    """The folder of at most ``n`` files, written by one job; a range's file is older than the next range's.

    A file stream takes files by their time, so the times are set in the order of the ranges, one second apart: a call
    to the file system for each file, whatever its size.
    """
    spark = rows.sparkSession
    path = work_dir(spark, "ranges")
    rows.repartitionByRange(n, column).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath().toString()) for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for k, part in enumerate(parts):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(part), _OLDEST + 1000 * k, -1)
    return path
