"""Sharded tables with size-tiered compaction and versioned manifests.

* ``append`` writes arrivals as small immutable shards (Parquet files) and commits a
  manifest that adds them.
* ``compact`` puts the manifest's shards into tiers by size; where a tier holds at least
  ``fan_in`` shards below the target, they are merged into files of about the target
  size and a manifest is committed that has the new files in place of the old. Read
  partitions are joined and written as they are read, so no row is shuffled.
* A commit writes only what it changes, a small table (path, rows, bytes, tier, added, gone);
  a version is the sum of the changes up to it. The table is written aside and renamed to
  its version, which is atomic where a rename is (HDFS, local disks; not on object stores).
  A version that is there already is never replaced: the writer takes the next one, and a
  merge whose shards another writer has meanwhile replaced is given up. Readers use one
  version and are not disturbed.
* A writer leaves a note (an intent) before its first file and takes it away after its
  commit. ``vacuum`` deletes files that no kept version names, but none under a note
  younger than a day, and sums older changes up into one table.

* Every shard's schema stands in its manifest row, and a version is read with the union of
  its shards' schemas: a column that came later is null in older shards, and a column that
  became wider (int to long, float to double ...) is cast there. An arrival whose columns
  cannot be widened into one type is refused before anything of it is written, and so is one
  that another writer's commit has made misfit. Merged shards have the union's schema.

The driver lists the paths that it reads, as Spark's own file index does; files of the
target size keep that list short. Rows are kept as they are, with all columns, nulls, empty
texts and repeats; an empty arrival commits its schema and no shards. Only DataFrame
functions are used.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path

MANIFEST = "path string, rows long, bytes long, tier int, added int, gone boolean, schema string"
FLOOR_BYTES, FAN_IN, TARGET_BYTES = 64 << 10, 4, 64 << 20
#: After so many seconds a writer that left its note is taken for dead.
STALE = 86_400


#: Types that the next one of their row holds without loss.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("int", "double"), ("smallint", "double"), ("tinyint", "double"), ("tinyint", "float"), ("smallint", "float"), ("date", "timestamp_ntz"))
#: So often a commit that fails for no visible reason is tried again.
TRIES = 20


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type of the two that holds both without loss, None if neither does."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":  # a column of nulls only
        return a
    if x == "void":
        return b
    for row in WIDER:
        if x in row and y in row:
            return a if row.index(x) > row.index(y) else b
    return None


def united(schemas: list[T.StructType]) -> T.StructType:
    """All columns of schemas in the order of their first coming, each of its widest type."""
    out: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            kind = wider(out[f.name], f.dataType) if f.name in out else f.dataType
            if kind is None:
                raise ValueError(f"column {f.name} is {out[f.name].simpleString()} in the table and {f.dataType.simpleString()} in the arrival")
            out[f.name] = kind
    return T.StructType([T.StructField(n, k) for n, k in out.items()])


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list:
        path, fs = self._path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(m[1]) for n, _ in self._names("manifests") if (m := re.fullmatch(rf"{kind}(\d+)", n)))

    def versions(self) -> list[int]:
        """Versions that can be read."""
        base = max(self._numbers("sum"), default=0)
        return [v for v in self._numbers("v") if v >= base]

    def manifest(self, version: int | None = None) -> DataFrame:
        """Rows of the shards of a version, the last one by default."""
        found = self.versions()
        version = found[-1] if version is None and found else version or 0
        base = max((v for v in self._numbers("sum") if v <= version), default=0)
        parts = [f"{self.root}/manifests/v{v:08d}" for v in found if base < v <= version]
        if base:
            parts.append(f"{self.root}/manifests/sum{base:08d}")
        if not parts:
            return self.spark.createDataFrame([], MANIFEST)
        changes = self.spark.read.schema(MANIFEST).parquet(*parts)
        return changes.groupBy("path").agg(*[F.max(c).alias(c) for c in ("rows", "bytes", "tier", "added", "gone", "schema")]).where("not gone")

    def commit(self, changes: DataFrame, holds: Callable[[], bool] = lambda: True) -> int | None:
        """Make changes the next version that is free; None if holds() no longer does."""
        aside = f"manifests/aside-{uuid.uuid4().hex}"
        changes.coalesce(1).write.parquet(f"{self.root}/{aside}")
        source, fs = self._path(aside)
        failed = 0
        while failed < TRIES:
            version = max([*self._numbers("v"), *self._numbers("sum")], default=0) + 1
            if not holds():
                fs.delete(source, True)
                return None
            target, _ = self._path(f"manifests/v{version:08d}")
            if fs.exists(target) or not fs.rename(source, target):
                failed += not fs.exists(target)  # a version that is there now is another writer's
                continue
            nested, _ = self._path(f"manifests/v{version:08d}/{source.getName()}")
            if not fs.exists(nested):
                return version
            fs.rename(nested, source)  # another writer was first, and the folder went into its own
        raise OSError(f"{source} cannot be renamed")

    @contextmanager
    def _intent(self, kind: str):
        """Folder of a write, under a note that it is in flight. A failed write's files go."""
        name = f"{kind}-{uuid.uuid4().hex}"
        note, fs = self._path(f"intents/{name}")
        fs.create(note, True).close()
        try:
            yield f"{self.root}/data/{name}"
        except BaseException:
            fs.delete(self._path(f"data/{name}")[0], True)
            raise
        finally:
            fs.delete(note, False)

    def _tier(self):
        """Tier of a file: powers of fan_in from the smallest size; -1 at the target size."""
        small = F.floor(F.log(F.greatest(F.col("bytes") / FLOOR_BYTES, F.lit(1.0))) / F.log(F.lit(float(self.fan_in)))).cast("int")
        return F.when(F.col("bytes") * 4 >= self.target_bytes * 3, -1).otherwise(small)

    def _shards(self, folder: str, version: int, schema: T.StructType) -> DataFrame:
        """Manifest rows of the files in folder; one without rows that tells the schema where there are none."""
        rows = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        sums = rows.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        told = [F.lit(version).alias("added"), F.lit(False).alias("gone"), F.lit(schema.json()).alias("schema")]
        found = sums.select("path", "rows", "bytes", self._tier().alias("tier"), *told)
        if found.take(1):
            return found
        return self.spark.range(1).select(F.lit(f"none-{uuid.uuid4().hex}").alias("path"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("bytes"), F.lit(-1).alias("tier"), *told)

    def schema(self, version: int | None = None) -> T.StructType:
        """Union of the schemas of a version's shards, in the order in which they came."""
        found = self.manifest(version).groupBy("schema").agg(F.min("added").alias("added")).orderBy("added", "schema").collect()  # a row for each schema
        return united([T.StructType.fromJson(json.loads(r["schema"])) for r in found])

    def _rows(self, shards: DataFrame, schema: T.StructType) -> DataFrame:
        """The rows of shards, in columns of schema."""
        paths: dict[str, list[str]] = {}
        for r in shards.where("rows > 0").select("path", "schema").collect():
            paths.setdefault(r["schema"], []).append(r["path"])
        out = self.spark.createDataFrame([], schema)
        for k, (own, files) in enumerate(sorted(paths.items())):
            kind = T.StructType.fromJson(json.loads(own))
            there = {f.name for f in kind.fields}
            cells = [(F.col(f"`{f.name}`") if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
            part = self.spark.read.schema(kind).parquet(*files).select(*cells)
            out = out.unionByName(part) if k else part
        return out

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Add rows as shards; arrival names a column whose values are arrivals of their own."""
        kind = (rows.drop(arrival) if arrival else rows).schema
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])

        def fits() -> bool:
            united([self.schema(), kind])
            return True

        fits()
        with self._intent("arrivals") as folder:
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(arrival) if arrival else writer).parquet(folder)
            return self.commit(self._shards(folder, max(self.versions(), default=0) + 1, kind), fits)

    def compact(self) -> int:
        """Merge tiers until none holds fan_in shards that fewer files can hold; the version
        that stands then. Every merge lessens the number of files, so it ends."""
        while True:
            shards = self.manifest()
            tiers = shards.where("tier >= 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            tiers = tiers.withColumn("files", F.ceil(F.col("bytes") / self.target_bytes)).where((F.col("n") >= self.fan_in) & (F.col("files") < F.col("n")))
            lowest = tiers.orderBy("tier").first()
            if lowest is None:
                return max(self.versions(), default=0)
            old = shards.where(F.col("tier") == lowest["tier"])
            schema = self.schema()
            with self._intent("merged") as folder:
                self._rows(old, schema).coalesce(lowest["files"]).write.option("compression", "zstd").parquet(folder)
                still = lambda: self.manifest().join(old.select("path"), "path", "left_semi").count() == lowest["n"]
                gone = old.withColumn("gone", F.lit(True)).select(*[c.split()[0] for c in MANIFEST.split(", ")])
                if self.commit(gone.unionByName(self._shards(folder, max(self.versions()) + 1, schema)), still) is None:
                    self._path("data")[1].delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version), self.schema(version))

    def vacuum(self, keep: int = 1) -> None:
        """Delete the files that none of the last ``keep`` versions names, and older versions.

        Files are listed before notes, and notes before versions, so a write that commits
        meanwhile is seen either in flight or committed.
        """
        path, fs = self._path("data")
        files = fs.listFiles(path, True) if fs.exists(path) else None
        found = []
        while files is not None and files.hasNext():
            file = files.next().getPath()
            if file.getName().endswith(".parquet"):
                found.append(file)
        live = {n for n, at in self._names("intents") if at / 1000 > time.time() - STALE}
        versions = self.versions()[-keep:]
        kept = {r["path"].rsplit("/", 1)[-1] for v in versions for r in self.manifest(v).select("path").collect()}
        for file in found:
            if file.getName() not in kept and not any(f"/{name}/" in file.toString() for name in live):
                fs.delete(file, False)
        if versions and versions[0] > max(self._numbers("sum"), default=0):
            aside = f"manifests/aside-{uuid.uuid4().hex}"
            self.manifest(versions[0]).write.parquet(f"{self.root}/{aside}")
            if not fs.rename(self._path(aside)[0], self._path(f"manifests/sum{versions[0]:08d}")[0]):
                return
            for v in self._numbers("v"):
                if v < versions[0]:
                    fs.delete(self._path(f"manifests/v{v:08d}")[0], True)
            for v in self._numbers("sum")[:-1]:
                fs.delete(self._path(f"manifests/sum{v:08d}")[0], True)


def shard(docs: DataFrame, arrivals: int = 8) -> ShardedTable:
    """A compacted sharded table of docs in the shared folder.

    Rows arrive in slices by a hash of the id, as they would day by day.
    """
    table = ShardedTable(docs.sparkSession, scratch_path(docs.sparkSession, "shards"))
    name = f"arrival-{uuid.uuid4().hex}"  # no column of docs
    table.append(docs.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), name)
    table.compact()
    table.vacuum()
    return table


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
