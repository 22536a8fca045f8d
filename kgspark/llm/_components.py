"""Connected components by alternating large and small stars (Kiveris and others, 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._spark import drop_path, scratch, store


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """edges: a, b with a > b. Large: each node ties its larger neighbours to its least; small: its smaller ones."""
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written, so that a node of many neighbours is met in a join whose partitions Spark can split.
    path = scratch(spark, "least")
    store(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low")), path)
    met = both.join(spark.read.parquet(path).hint("merge"), F.col("u") == F.col("node"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("low").alias("b")), F.struct(F.col("v").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct(), [path]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (numbers, in any order). Gives node, root (the smallest node that can be reached) for each node that has an edge to another."""
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch(spark, "edges")
        store(df, path)
        df = spark.read.parquet(path)
        return df, path, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path, mark = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while mark[0]:
        old, old_path, old_mark = now, path, mark
        big, used = _star(old, True)
        big, big_path, _ = stored(big)
        small, more = _star(big, False)
        now, path, mark = stored(small)
        for p in (*used, *more, old_path, big_path):
            drop_path(spark, p)
        if mark == old_mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
