"""Streaming jobs: new files once, failures marked, edges kept up to date."""

import json
import os
import time

from pyspark.sql import functions as F

from corpusloom.functions.frames import Versions
from corpusloom.sources import ingest as ig
from corpusloom.streaming import streams as sm


def test_stream_import_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "bible.json").write_text(json.dumps({"books": []}))

    def sink(rows, number):
        rows.select("file_name", "importer", "checksum").withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for name in (None, "catechism.json"):
        if name:
            (folder / name).write_text("{}")
        sm.stream_import(spark, str(folder), str(tmp_path / "cp"), sink).awaitTermination()
    got = {(r.file_name, r.importer) for r in spark.read.parquet(out).collect()}
    assert got == {("bible.json", "bible"), ("catechism.json", "catechism")}
    assert spark.read.parquet(out).count() == 2


def test_dedupe_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    files = sm.dedupe_files(sm.file_stream(spark, str(folder)), None)
    q = files.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 1


def test_embedding_failures_keep_the_rest(spark):
    docs = spark.createDataFrame([(i, "bad" if i == 7 else "ok") for i in range(10)], "doc_id int, content string").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[0.1, 0.2] for _ in texts]

    got = {r.doc_id: (r.embedding_status, r.embedding_error) for r in sm.embed_documents(docs, embedder, 2, tries=2, pauses=(0,), batch=5).collect()}
    assert [got[i][0] for i in range(10)] == ["ready"] * 5 + ["failed"] * 5 and got[7][1] == "no"
    wrong = sm.embed_documents(docs, lambda t: [[0.1] for _ in t], 2, tries=1).first()
    assert wrong.embedding_status == "failed"


def test_stream_embed_and_graph(spark, tmp_path):
    source = str(tmp_path / "changed")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, content string").write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id int, content string").parquet(source)
    sm.stream_embed(stream(), lambda t: [[1.0]] * len(t), 1, str(tmp_path / "emb"), str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "emb")).where("embedding_status = 'ready'").count() == 2
    docs = spark.createDataFrame([(1, "catechism", "CCC 1", '{"internal_references":["CCC 2"]}'), (2, "catechism", "CCC 2", "{}")], "doc_id int, source_type string, reference string, metadata string")
    edges = Versions(spark, str(tmp_path / "edges"))
    sm.stream_graph_update(stream(), lambda: docs, edges, str(tmp_path / "cp2")).awaitTermination()
    assert [(r.source_id, r.target_id) for r in edges.read().collect()] == [(1, 2)] and edges.numbers() == [0]
    gone = docs.where("doc_id = 2")  # document 1 goes, and its edges with it
    spark.createDataFrame([(1, "a")], "doc_id int, content string").write.mode("append").parquet(source)
    sm.stream_graph_update(stream(), lambda: gone, edges, str(tmp_path / "cp2")).awaitTermination()
    assert edges.read().collect() == [] and edges.numbers() == [0, 1] and edges.read(1).count() == 1


def test_old_files_are_not_late(spark, tmp_path):
    """A file that was last changed a month ago arrives once, after newer ones were read."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def read():
        files = sm.dedupe_files(sm.file_stream(spark, str(folder)), "1 day").select("file_name", "value")
        files.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.file_name for r in spark.read.parquet(out).collect())

    (folder / "new.txt").write_text("x")
    assert read() == ["new.txt"]
    (folder / "old.txt").write_text("y")
    os.utime(folder / "old.txt", (time.time() - 30 * 86_400,) * 2)
    assert read() == ["new.txt", "old.txt"]
    assert read() == ["new.txt", "old.txt"]


def test_import_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "catechism.txt").write_text("One.\n\nTwo.\n")
    (folder / "bible.json").write_text("{broken")
    tables = sm.ImportedTables(spark, str(tmp_path / "library"))
    run = lambda: sm.stream_import_documents(spark, str(folder), str(tmp_path / "cp"), tables, files_per_batch=1).awaitTermination()
    told = lambda: {r.file_path.rsplit("/", 1)[1]: (r.status, r.error_message, r.total_records) for r in tables.manifests().collect()}
    run()
    assert told() == {"catechism.txt": ("completed", "", 2), "bible.json": ("failed", "json", 0)} and tables.manifests().count() == 2
    assert sorted(r.content for r in tables.documents().collect()) == ["One.", "Two."]
    # the last batch runs again, as after a failure before its commit: nothing changes
    last = tables.attempts.numbers()[-1]
    again = [r.file_path for r in spark.read.parquet(f"{tables.root}/manifests/{last:012d}").collect()]
    files = ig.scan_sources(spark, str(folder)).where(F.col("file_path").isin(*again))
    before = sorted(map(tuple, tables.documents().collect()))
    tables.import_batch(files, last)
    assert tables.manifests().count() == 2 and sorted(map(tuple, tables.documents().collect())) == before

    def vectors():
        sm.stream_embed(tables.changes(), lambda t: [[float(len(x))] for x in t], 1, str(tmp_path / "emb"), str(tmp_path / "cp2")).awaitTermination()
        made = spark.read.parquet(str(tmp_path / "emb"))
        return made.count(), sorted(r.embedding[0] for r in sm.latest_vectors(spark, str(tmp_path / "emb")).collect())

    assert vectors() == (2, [4.0, 4.0])
    (folder / "later").mkdir()  # a file source reads a path once; the document is known by the file's name
    (folder / "later" / "catechism.txt").write_text("One.\n\nTwo, changed.\n\nThree.")
    run()
    assert vectors() == (4, [4.0, 6.0, 13.0])  # only the changed and the new one were embedded again
