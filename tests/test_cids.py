"""Columns over content ids and keys: the edges."""

from pyspark.sql import functions as F

from skeinwork.functions import cids


def test_common_prefix_of_equal_and_contained_texts(spark):
    rows = [("a/b", "a/b", 3), ("", "", 0), ("", "x", 0), ("ab", "abc", 2), ("abc", "ab", 2), ("abx", "aby", 2), ("x", "y", 0), ("aé", "aè", 2), ("é", "é", 2)]
    pairs = spark.createDataFrame(rows, "a string, b string, want int")
    got = pairs.select("a", "b", "want", cids.common_prefix(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r["a"], r["b"], r["got"]) for r in got] == [(r["a"], r["b"], r["want"]) for r in got]
