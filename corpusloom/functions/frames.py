"""Helpers over whole DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def union_by(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Union of parts, dealt by keys.

    A union of inputs that are dealt alike counts as dealt by their keys, yet adaptive
    execution may have joined the partitions of each input differently (seen on Spark
    4.1.2: one key's rows in two groups). Dealing the rows again is what a grouping by
    keys needs anyway.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition(*keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that later uses do not compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session that names no such folder gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="spark-corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


class Versions:
    """A table in numbered versions below root; a version stands once it is written whole.

    A batch that runs again writes the same number from the same version before it, so a
    replay changes nothing. ``keep`` is how many versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _folder(self, number: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root if number is None else f"{self.root}/{number:012d}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, number: int) -> bool:
        path, fs = self._folder(number)
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def numbers(self) -> list[int]:
        path, fs = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit() and self._marked(int(n)))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last version, or the last before a number; None where there is none."""
        found = [n for n in self.numbers() if before is None or n < before]
        return self.spark.read.parquet(self._folder(found[-1])[0].toString()) if found else None

    def write(self, table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(self._folder(number)[0].toString())
        for old in [n for n in self.numbers() if n <= number][: -self.keep]:
            path, fs = self._folder(old)
            fs.delete(path, True)
