"""What the operators share on Spark's side."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset (local tests), a temporary one is made."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="kgspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/kgspark-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Results that read them, and have not been written, end."""
    drop_path(spark, _own_dir(spark))


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the plans that are run within it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tidy(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, an action's shuffle files go when the action ends, and not when the driver next collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def store(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes df as Parquet."""
    with tidy(df.sparkSession):
        df.write.mode(mode).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    store(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what kept() has written for df, when all that reads it has been written."""
    drop_path(df.sparkSession, df.kept_at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
