"""Shared-folder tables and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frames import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return shared_folder(spark, name)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage of df: a Parquet table in the shared folder, read again.

    Later stages then survive the loss of any executor without computing df twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python by 4 MB, not 64, unless the user has set a size.

    Executor and worker each hold a batch for every running task. The setting counts when
    a job runs, also one that the caller starts, so it stays with the session.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, "4m")


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing needs any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
