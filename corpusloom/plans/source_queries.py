"""Queries of files, importers, manifests and streams.

Their files are made by Spark from all rows of ``documents`` and lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import adapters as ad
from corpusloom.functions.frames import Versions, shared_folder
from corpusloom.operators import evaluation as ev
from corpusloom.sources import ingest as ig
from corpusloom.streaming import streams as sm

from . import search_queries as sq
from .catalogue import query

TEXTS = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
LINE = "doc_id long, text string"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return ad.read(spark, sf, "documents").select("doc_id", "lang", "source", "text")


def _text_files(spark: SparkSession, sf: str) -> str:
    """Text files of JSON lines, a thousand documents to a file."""
    folder = shared_folder(spark, "files")
    _docs(spark, sf).select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.option("maxRecordsPerFile", 1000).text(folder)
    return folder


def _read_back(files: DataFrame) -> DataFrame:
    """doc_id and text digest of the lines of whole files."""
    lines = files.select(F.explode(F.split("value", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", LINE).alias("d")).select("d.doc_id", F.md5(F.col("d.text").cast("binary")).alias("text_md5"))


def _payloads(docs: DataFrame, payload) -> DataFrame:
    """A JSON file for each document, as scan_sources gives them."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".json"))
    return docs.select("doc_id", name.alias("file_path"), name.alias("file_name"), F.current_timestamp().alias("modified"), F.to_json(payload).alias("value"))


def _mixed_payloads(docs: DataFrame):
    """By doc_id: a verse, two paragraphs (some of one number), something else, broken JSON,
    and text files of two kinds."""
    id_, told = F.col("doc_id"), F.col("doc_id").cast("string")
    verse = F.struct(F.lit("John").alias("book"), (id_ % 5).alias("chapter"), F.concat(F.lit("t"), told).alias("translation"), F.array(F.struct(F.lit(1).alias("verse"), "text")).alias("verses"))
    more = F.struct((id_ + F.floor(id_ / 6) % 2).alias("number"), F.lit("more").alias("content"))
    paragraphs = F.struct(F.concat(F.lit("c"), told).alias("catechism"), F.array(F.struct(id_.alias("number"), F.col("text").alias("content")), more).alias("paragraphs"))
    kinds = (
        ("doc-", ".json", F.to_json(verse)), ("doc-", ".json", F.to_json(paragraphs)), ("doc-", ".json", F.lit('{"other": 1}')),
        ("Douay-", ".json", F.concat(F.lit('{"verses": '), F.coalesce("text", F.lit("")))), ("catechism-", ".txt", F.coalesce("text", F.lit(""))), ("Church-Father-", ".md", F.coalesce("text", F.lit(""))),
    )
    out = None
    for k, (before, after, value) in enumerate(kinds):
        name = F.concat(F.lit(before), told, F.lit(after))
        part = docs.where(id_ % 6 == k).select("doc_id", name.alias("file_path"), name.alias("file_name"), F.current_timestamp().alias("modified"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(13)"
_MIXED = rf"""d AS (
  SELECT doc_id, doc_id % 6 AS kind, ['doc-', 'doc-', 'doc-', 'Douay-', 'catechism-', 'Church-Father-'][doc_id % 6 + 1] || doc_id || ['.json', '.json', '.json', '.json', '.txt', '.md'][doc_id % 6 + 1] AS file_path,
    (trim(coalesce(text, ''), {_ENDS}) = '')::INT AS blank,
    len(list_filter(string_split_regex(trim(coalesce(text, ''), {_ENDS}), '\n\s*\n'), lambda x: trim(x, {_ENDS}) <> '')) AS parts,
    CASE doc_id % 6 WHEN 0 THEN doc_id % 5 < 1 WHEN 1 THEN doc_id // 6 % 2 = 0 ELSE doc_id % 6 = 3 END::INT AS wrong FROM documents),
e AS (SELECT *, CASE WHEN kind = 2 THEN 0 WHEN kind = 3 THEN 1 ELSE blank + wrong END AS errors FROM d)"""


@query("s1_scan_sources", TEXTS)
def s1(spark, sf):
    return _read_back(ig.scan_sources(spark, _text_files(spark, sf)))


@query("s2_detect_source", "SELECT doc_id, ['bible', 'catechism', NULL, 'bible', 'catechism', 'church_fathers'][doc_id % 6 + 1] AS importer FROM documents")
def s2(spark, sf):
    return ig.detect_source(_mixed_payloads(_docs(spark, sf))).select("doc_id", "importer")


@query("s5_write_manifests", """SELECT 'doc-' || doc_id AS file_path, sha256(text) AS checksum, lang AS importer, unnest(['running', CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'completed' END]) AS status FROM documents""")
def s5(spark, sf):
    files = _docs(spark, sf).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.col("lang").alias("importer"))
    root = shared_folder(spark, "manifests")
    ig.write_manifests(ig.running_manifests(files), root)
    done = F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("completed")
    ig.write_manifests(files.select("file_path", "checksum", "importer", done.alias("status"), F.current_timestamp().alias("started_at")), root)
    return spark.read.parquet(root).select("file_path", "checksum", "importer", "status")


@query("s6_read_bible_json", """WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS verse FROM documents)
SELECT source AS book, doc_id AS chapter, verse, md5(line) AS text_md5, verse - 1 AS position FROM l""")
def s6(spark, sf):
    verses = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("verse"), x.alias("text")))
    payload = F.struct(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), verses.alias("verses"))
    read = ig.read_bible_json(_payloads(_docs(spark, sf), payload))
    return read.select("book", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "position")


@query("s7_read_catechism_json", """SELECT coalesce(source, 'catechism') AS source_name, 'CCC ' || doc_id AS reference, coalesce(lang, 'CCC ' || doc_id) AS title, md5(text) AS content_md5,
  '["CCC ' || (doc_id + 1) || '"]' AS internal_references FROM documents""")
def s7(spark, sf):
    other = F.concat(F.lit("CCC "), (F.col("doc_id") + 1).cast("string"))
    own = F.concat(F.lit("CCC "), F.col("doc_id").cast("string"))
    paragraph = F.struct(F.col("doc_id").alias("number"), F.col("lang").alias("title"), F.col("text").alias("content"), F.array(own, other).alias("ccc_references"))
    read = ig.read_catechism_json(_payloads(_docs(spark, sf), F.struct(F.col("source").alias("catechism"), F.array(paragraph).alias("paragraphs"))))
    return read.select("source_name", "reference", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.get_json_object("metadata", "$.internal_references").alias("internal_references"))


@query("s8_read_fathers_json", """WITH l AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT source AS source_name, doc_id || '.' || n AS reference, CASE WHEN n % 2 = 0 THEN 'even' ELSE doc_id || '.' || n END AS title, md5(line) AS content_md5, lang AS language, CASE WHEN n % 2 = 0 THEN 'own' ELSE 'payload' END AS volume FROM l""")
def s8(spark, sf):
    number = lambda i: F.concat_ws(".", F.col("doc_id").cast("string"), (i + 1).cast("string"))
    even = lambda i, x: F.when((i + 1) % 2 == 0, F.lit(x))
    sections = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(number(i).alias("reference"), even(i, "even").alias("title"), x.alias("content"), even(i, "own").alias("volume")))
    payload = F.struct(F.col("source").alias("author"), F.lit("work").alias("work"), F.col("lang").alias("language"), F.lit("payload").alias("volume"), sections.alias("sections"))
    read = ig.read_fathers_json(_payloads(_docs(spark, sf), payload))
    told = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return read.select("source_name", "reference", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), told("language"), told("volume"))


@query("s16_save_evaluation", """SELECT doc_id AS query_id, doc_id % 2 = 0 AS hit, (doc_id % 2 = 0)::INT::DOUBLE AS precision, (doc_id % 2 = 0)::INT::DOUBLE AS recall,
  CASE WHEN doc_id % 2 = 0 THEN round(1 / (doc_id % 3 + 1), 6) ELSE 0 END::DOUBLE AS reciprocal_rank, (SELECT count(*) FROM documents) AS questions FROM documents""")
def s16(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("query_id"), F.coalesce("source", F.lit("?")).alias("reference"))
    runs = ev.evaluate_queries(docs.withColumn("rank", F.col("query_id") % 3 + 1), docs.withColumn("reference", F.when(F.col("query_id") % 2 == 0, F.col("reference")).otherwise("none")))
    root = shared_folder(spark, "evaluation")
    ev.save_evaluation(runs, ev.summarize(runs), {"k": 3}, root)
    return spark.read.parquet(f"{root}/runs").crossJoin(spark.read.parquet(f"{root}/summaries").select("questions"))  # one summary row


_ATTEMPTS = """SELECT file_path, CASE WHEN errors > 0 THEN 'failed' ELSE 'completed' END AS status, n::BIGINT AS total_records, CASE WHEN errors > 0 THEN 0 WHEN old THEN 1 ELSE n END::BIGINT AS created_records,
  (errors = 0 AND old)::BIGINT AS updated_records, 0::BIGINT AS skipped_records, CASE WHEN errors > 0 THEN greatest(n, errors) ELSE 0 END::BIGINT AS failed_records"""
_RECORDS = "CASE WHEN kind < 2 THEN 2 WHEN kind = 3 THEN 0 ELSE parts END AS n"


def _told(attempts: DataFrame) -> DataFrame:
    return attempts.select("file_path", "status", *[F.col(f"{c}_records").cast("long").alias(f"{c}_records") for c in ("total", "created", "updated", "skipped", "failed")])


@query("t10_import_sources", f"""WITH {_MIXED}, s AS (SELECT *, {_RECORDS}, kind = 1 AND doc_id % 4 = 1 AS old FROM e WHERE kind <> 2 AND doc_id % 7 <> 0)
{_ATTEMPTS} FROM s""")
def t10(spark, sf):
    """Some files were imported before, and some paragraphs are there with other titles."""
    docs = _docs(spark, sf)
    raw = _mixed_payloads(docs)
    done = ig.detect_source(ig.checksum_files(raw.where("doc_id % 7 = 0"))).withColumn("status", F.lit("completed"))
    none = F.lit(None).cast("string")
    id_ = F.col("doc_id").cast("string")
    existing = docs.where("doc_id % 6 = 1 and doc_id % 4 = 1").select(
        F.lit("catechism").alias("source_type"), F.concat(F.lit("c"), id_).alias("source_name"), F.concat(F.lit("CCC "), id_).alias("reference"),
        F.lit("old").alias("title"), F.col("text").alias("content"), F.lit("catholic").alias("tradition"), none.alias("metadata"), F.lit("ready").alias("embedding_status"))
    _, attempts = ig.import_sources(raw.drop("doc_id"), existing, done)
    return _told(attempts)


@query("t11_verify_sources", f"""WITH {_MIXED}
SELECT file_path, CASE WHEN kind = 2 THEN 'unsupported' WHEN errors > 0 THEN 'failed' ELSE 'verified' END AS status, errors::BIGINT AS errors FROM e""")
def t11(spark, sf):
    return ig.verify_sources(_mixed_payloads(_docs(spark, sf))).select("file_path", "status", F.size("errors").cast("long").alias("errors"))


def _imported(spark: SparkSession, sf: str) -> sm.ImportedTables:
    """Files of JSON and text for all documents, imported in two batches, of which the second
    ran again after it was done."""
    folder, tables = shared_folder(spark, "sources"), sm.ImportedTables(spark, shared_folder(spark, "library"))
    raw = _mixed_payloads(_docs(spark, sf)).drop("doc_id")
    raw.select("file_path", "file_name", "value").repartition("file_path").write.parquet(folder)
    files = lambda k: spark.read.parquet(folder).where(F.pmod(F.xxhash64("file_path"), F.lit(2)) == k).withColumn("modified", F.current_timestamp())
    for number in (0, 1, 1):
        tables.import_batch(files(number), number)
    return tables


@query("x1_import_batches", f"""WITH {_MIXED}, s AS (SELECT *, {_RECORDS}, FALSE AS old FROM e WHERE kind <> 2)
{_ATTEMPTS} FROM s""")
def x1_batches(spark, sf):
    """One manifest for each file, also of batches that ran twice."""
    return _told(_imported(spark, sf).manifests())


@query("t10_embed_imported", f"""WITH {_MIXED}, s AS (SELECT * FROM e WHERE kind <> 2 AND errors = 0)
SELECT count(*) FILTER (WHERE kind = 0) * 2 + count(*) FILTER (WHERE kind = 1) * 2 + coalesce(sum(parts) FILTER (WHERE kind > 3), 0) AS documents,
  count(*) FILTER (WHERE kind = 0) * 2 + count(*) FILTER (WHERE kind = 1) * 2 + coalesce(sum(parts) FILTER (WHERE kind > 3), 0) AS vectors,
  0::BIGINT AS without_vector, 0::BIGINT AS wrong FROM s""")
def t10_embed(spark, sf):
    """Every imported document has the vector of its content; two counts stand in for a model's."""
    tables, root = _imported(spark, sf), shared_folder(spark, "embedded")
    sm.stream_embed(tables.changes(), lambda texts: [[len(t), t.count(" ")] for t in texts], 2, root, shared_folder(spark, "progress")).awaitTermination()
    vectors = sm.latest_vectors(spark, root).select("doc_id", "embedding").withColumn("has", F.lit(1))
    both = tables.documents().select(ig.document_key().alias("doc_id"), "content").withColumn("is", F.lit(1)).join(vectors, "doc_id", "full")
    blanks = F.length("content") - F.length(F.replace("content", F.lit(" "), F.lit("")))
    right = F.array(F.length("content").cast("double"), blanks.cast("double")) == F.col("embedding")
    return both.agg(F.count("is").alias("documents"), F.count("has").alias("vectors"), F.count_if(F.col("has").isNull()).alias("without_vector"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong"))


@query("x1_stream_import", TEXTS)
def x1(spark, sf):
    root = shared_folder(spark, "imported")
    sink = lambda rows, number: rows.write.mode("overwrite").parquet(f"{root}/batch={number}")
    sm.stream_import(spark, _text_files(spark, sf), shared_folder(spark, "progress"), sink).awaitTermination()
    return _read_back(spark.read.parquet(root))


@query("x2_stream_embed", "SELECT doc_id, [length(text), length(text) - length(replace(text, ' ', ''))]::DOUBLE[] AS embedding, 'ready' AS embedding_status FROM documents")
def x2(spark, sf):
    """Vectors of two counts stand in for a model's."""
    root, changed = shared_folder(spark, "embedded"), shared_folder(spark, "changed")
    docs = _docs(spark, sf).select("doc_id", F.col("text").alias("content"))
    docs.write.parquet(changed)
    sm.stream_embed(spark.readStream.schema(docs.schema).parquet(changed), lambda texts: [[len(t), t.count(" ")] for t in texts], 2, root, shared_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(root).select("doc_id", "embedding", "embedding_status")


@query("x4_dedupe_files", TEXTS)
def x4(spark, sf):
    """Every file arrives twice."""
    root = shared_folder(spark, "files-once")
    files = sm.file_stream(spark, _text_files(spark, sf))
    once = sm.dedupe_files(files.unionByName(files)).select("value")
    once.writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start(root).awaitTermination()
    return _read_back(spark.read.parquet(root))


@query("x3_stream_graph_update", sq.GRAPH_SQL_OF_DOCUMENTS)
def x3(spark, sf):
    """All documents come, in several batches; then the references of half of them change."""
    changed, progress = shared_folder(spark, "changed"), shared_folder(spark, "progress")
    edges = Versions(spark, shared_folder(spark, "edges"))
    ids = _docs(spark, sf).select("doc_id")
    for part, docs in ((ids.repartition(3), sq.citing(spark, sf, 8)), (ids.where("doc_id % 8 < 4").repartition(2), sq.citing(spark, sf))):
        part.write.mode("append").parquet(changed)
        stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(changed)
        sm.stream_graph_update(stream, lambda docs=docs: docs, edges, progress).awaitTermination()
    return edges.read().select("source_id", "target_id")
