"""Serialisation: lines of N-Triples and N-Quads, without duplicates, and without triples that are also quads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.lower import Relation


def quads(result: Relation | DataFrame) -> DataFrame:
    """subject, predicate, object, graph as text; graph is NULL in the default graph."""
    return result.text() if isinstance(result, Relation) else result


def finalised(result: Relation | DataFrame) -> DataFrame:
    """Distinct rows; of equal subject, predicate and object, those of the default graph go if there is one of a named graph."""
    rows, key = quads(result), ["subject", "predicate", "object"]
    if isinstance(result, Relation) and result.default_only:
        return rows.distinct()
    # One aggregate and one shuffle, instead of a join with itself: a triple's graphs, as a set.
    grouped = rows.groupBy(*key).agg(F.collect_set("graph").alias("graphs"))
    none = F.array(F.lit(None).cast("string"))
    return grouped.select(*key, F.explode(F.when(F.size("graphs") > 0, F.col("graphs")).otherwise(none)).alias("graph"))


def ntriples(rows: DataFrame) -> DataFrame:
    """A column `line`; graphs are left out."""
    return rows.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("line")).distinct()


def nquads(result: Relation | DataFrame) -> DataFrame:
    return finalised(result).select(F.concat_ws(" ", "subject", "predicate", "object", "graph", F.lit(".")).alias("line"))


def lines(result: Relation | DataFrame, name: str) -> DataFrame:
    """By the name's extension: .nq is N-Quads; .nt, .ttl, .turtle and others are N-Triples."""
    return nquads(result) if name.endswith(".nq") else ntriples(quads(result))


def write(result: Relation | DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of parts; Parquet if the name ends so. single_file: one local file, for small results."""
    if path.endswith(".parquet"):
        finalised(result).write.mode("overwrite").parquet(path)
    elif single_file:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            for row in lines(result, path).toLocalIterator():
                f.write(row["line"] + "\n")
    else:
        lines(result, path).write.mode("overwrite").text(path)
