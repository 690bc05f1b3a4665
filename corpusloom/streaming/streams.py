"""Incremental imports, embeddings and graph updates as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.frames import Versions, written
from corpusloom.operators import graph as gx
from corpusloom.sources import ingest

FILES = "file_path string, file_name string, modified timestamp, value string"
Embedder = Callable[[list[str]], list[list[float]]]


def file_stream(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.json", "*.txt", "*.md"), per_batch: int | None = None, archive: str | None = None) -> DataFrame:
    """Whole files below folder, each once, of whatever age; at most per_batch in a batch.

    The paths that were read are kept in the checkpoint; archive moves the files there when
    they are done, which keeps the folder and its listing short.
    """
    reader = spark.readStream.option("maxFileAge", "36500d")  # by default, files a week older than the newest are passed over
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    # given as an argument: text() sets the option anew from its default
    stream = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}").text(folder, wholetext=True)
    return stream.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def dedupe_files(files: DataFrame, delay: str | None = "7 days") -> DataFrame:
    """Each path and checksum once.

    A file counts from when it arrives, whatever its own time: the watermark follows the
    batches' clock, so no file is late, and a path and checksum is forgotten ``delay`` after
    it arrived. Without a delay it is kept for ever.
    """
    keyed = ingest.checksum_files(files)
    if delay is None:
        return keyed.dropDuplicates(["file_path", "checksum"])
    arrived = keyed.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(["file_path", "checksum"]).drop("arrived")


def stream_import(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give the new files of each batch, checksummed and routed, to sink."""
    routed = ingest.detect_source(ingest.checksum_files(file_stream(spark, folder)))
    return routed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DOCUMENT = "source_type string, source_name string, reference string, title string, content string, tradition string, metadata string, embedding_status string"


class ImportedTables:
    """Documents and manifests that a stream of files is imported into, batch by batch.

    A batch writes a version of the documents, the rows that it changed and, last, its
    manifests; each has the batch's number. What a batch reads is from before its number, so
    one that runs again after a failure, at whatever step, leaves what one run leaves.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/documents")
        self.attempts = Versions(spark, f"{self.root}/manifests", keep=1 << 30)

    def documents(self) -> DataFrame:
        """Documents of the last batch whose manifests are written."""
        done = self.attempts.numbers()
        table = self.versions.read(done[-1] + 1) if done else None
        return self.spark.createDataFrame([], DOCUMENT) if table is None else table

    def manifests(self, before: int | None = None) -> DataFrame:
        """Attempts of all batches, or of those before a number."""
        paths = [f"{self.root}/manifests/{n:012d}" for n in self.attempts.numbers() if before is None or n < before]
        none = self.spark.createDataFrame([], "file_path string, checksum string, importer string, status string")
        return self.spark.read.parquet(*paths) if paths else none

    def import_batch(self, files: DataFrame, number: int, importers: tuple[ingest.Importer, ...] = ingest.IMPORTERS) -> None:
        before = self.versions.read(number)
        existing = self.spark.createDataFrame([], DOCUMENT) if before is None else before
        upserted, attempts = ingest.import_sources(files, existing, self.manifests(number), importers)
        upserted = written(upserted, "upserted")
        self.versions.write(upserted.drop("status"), number)
        changed = ingest.changed_documents(upserted).select(ingest.document_key().alias("doc_id"), "content")
        changed.write.mode("overwrite").parquet(f"{self.root}/changed/batch={number}")
        self.attempts.write(attempts, number)

    def changes(self) -> DataFrame:
        """Stream of (doc_id, content) of imported and changed documents, and of no others."""
        schema = "doc_id string, content string, batch int"
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/changed")


def stream_import_documents(spark: SparkSession, folder: str, checkpoint: str, tables: ImportedTables, importers: tuple[ingest.Importer, ...] = ingest.IMPORTERS, files_per_batch: int = 1000) -> StreamingQuery:
    """Import the new files below folder into tables, some at a time, with a manifest for each."""
    files = file_stream(spark, folder, per_batch=files_per_batch)
    batch = lambda rows, number: tables.import_batch(rows, number, importers)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_documents(docs: DataFrame, embedder: Embedder, dims: int, tries: int = 3, pauses: tuple[float, ...] = (1, 5, 15), batch: int = 100) -> DataFrame:
    """docs (doc_id, content) to (doc_id, embedding, embedding_status, embedding_error).

    Texts go to embedder in batches; one that fails every try, or gives wrong vectors,
    marks its own rows failed and leaves the others.
    """

    def one(texts: list[str]) -> tuple[list, str | None]:
        import time

        error = None
        for i in range(tries):
            try:
                out = embedder(texts)
                if len(out) != len(texts):
                    raise ValueError(f"{len(texts)} vectors expected, got {len(out)}")
                return out, None
            except Exception as e:
                error = str(e)
                if i + 1 < tries:
                    time.sleep(pauses[min(i, len(pauses) - 1)])
        return [None] * len(texts), error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                vectors, error = one(part["content"].fillna("").tolist())
                rows = []
                for doc_id, v in zip(part["doc_id"], vectors, strict=True):
                    wrong = error or (None if v is not None and len(v) == dims and all(x == x and abs(x) != float("inf") for x in v) else f"{dims} finite values expected")
                    rows.append((doc_id, None if wrong else list(map(float, v)), "failed" if wrong else "ready", wrong))
                yield pd.DataFrame(rows, columns=["doc_id", "embedding", "embedding_status", "embedding_error"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, embedding array<double>, embedding_status string, embedding_error string")


def stream_embed(changed: DataFrame, embedder: Embedder, dims: int, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the embeddings of changed documents to the table at root."""

    def batch(rows: DataFrame, number: int) -> None:
        made = embed_documents(rows, embedder, dims, **options).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").parquet(f"{root}/batch={number}")  # a batch that runs again replaces itself

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The embeddings at root, of a document that was embedded again the last one only."""
    rows = spark.read.parquet(root)
    last = F.max_by(F.struct("embedding", "embedding_status", "embedding_error"), "batch")
    return rows.groupBy("doc_id").agg(last.alias("v")).select("doc_id", "v.*")


def stream_graph_update(changed: DataFrame, read_docs: Callable[[], DataFrame], edges: Versions, checkpoint: str, resolvers: tuple[gx.Resolver, ...] = gx.RESOLVERS) -> StreamingQuery:
    """Build the outgoing edges of changed documents anew, a version of the edges a batch.

    changed has the doc_id of every document that came, changed or went. Each batch reads
    the version before its own number and writes its own, so what is read is never
    overwritten and a batch that runs again changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        docs = read_docs()
        before = edges.read(number)
        if before is None:
            before = gx.resolve_references(docs.limit(0), docs.limit(0), resolvers)
        edges.write(gx.update_graph(gx.without_sources(before, rows), docs, rows.select("doc_id"), resolvers), number)

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
