"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Rows without an id are known by their text's hash where ids are needed; their id stays null. Of equal rows the second stage keeps one; rows of one id
and different texts stay. Ties go to the smallest id and then to the text's hash. Null and empty texts are clean documents, and near copies of one another.
An empty table, or a stage that leaves nothing, gives no rows. Very long texts are taken whole by each stage. Columns of documents beyond the id and the text are
carried along under their names; the last stage's own columns take the place of any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import ship
from kgspark.llm import decontaminate, near_copies, secret_scan, source_mix, toxicity
from kgspark.llm._spark import kept, table

#: Names that no column of documents has.
KEY, OWN = "__row_key", "__row_own"


def _key() -> Column:
    """The id, or a number beyond all ids from the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below 0.5."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out("label_id"))
    return toxicity.toxicity(docs, model, keep=docs.columns).where("predicted = 0").select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the document of the smallest id (and text's hash)."""
    ship(spark)
    keyed = docs.withColumn(KEY, _key())
    found = near_copies.near_copies(keyed.select(KEY, "text"), KEY)
    first = kept(found.groupBy("group").agg(F.min(F.struct(KEY, "own")).alias("first")).select(F.col("first")[KEY].alias("first_key"), F.col("first.own").alias("first_own")), "first")
    own = F.xxhash64(F.col(KEY), F.col("text").cast("string"))
    keyed = keyed.withColumn(OWN, own)
    return keyed.join(first.hint("merge"), (F.col(KEY) == F.col("first_key")) & (F.col(OWN) == F.col("first_own")), "left_semi").dropDuplicates([KEY, OWN]).drop(KEY, OWN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    ship(spark)
    keyed = docs.withColumn(KEY, _key())
    found = decontaminate.contamination(keyed.select(KEY, "text"), table(spark, sf_dir, "benchmark"), KEY)
    bad = kept(found.where(F.size("items") > 0).select(F.col(KEY).alias("bad_key")).distinct(), "contaminated")
    return keyed.join(bad.hint("merge"), F.col(KEY) == F.col("bad_key"), "left_anti").drop(KEY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for each block of it that a shard draws, in the shards' shuffled order, with size, source_size, target, taken (its words in all shards), shard, nth (the pass) and words (those of this row)."""
    keyed = docs.withColumn(KEY, _key())
    plan = source_mix.mix(keyed, KEY, keep=docs.columns)
    plan = kept(plan.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])).drop("row", "source"), "plan")
    added = ["size", "source_size", "target", "taken", "shard", "nth", "words"]
    rows = source_mix.mixed(plan, KEY)
    return rows.select(*(F.col("kept")[c].alias(c) for c in docs.columns if c not in added), *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: A trained stage is not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
