"""The given tables in the document model of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_TYPES = ("bible_verse", "bible_chapter", "catechism", "church_father")
TRADITIONS = ("catholic", "orthodox", "protestant", "jewish", "islamic")

#: The same mapping for DuckDB.
DOCUMENTS_SQL = """docs AS (
  SELECT d.doc_id, ['bible_verse', 'bible_chapter', 'catechism', 'church_father'][(doc_id % 4)::INT + 1] AS source_type,
    source AS source_name, ['catholic', 'orthodox', 'protestant', 'jewish', 'islamic'][(doc_id % 5)::INT + 1] AS tradition,
    'DOC ' || doc_id AS reference, string_split(text, chr(10))[1] AS title, text AS content,
    '{"language":"' || lang || '","chapter":' || (n_chars % 50) || ',"topics":["' || source || '"]}' AS metadata, lang, n_chars
  FROM documents d)"""
GRAPH_SQL = """nodes AS (SELECT 'P' || p_partkey AS node_id FROM part WHERE p_partkey % 10 <> 1 UNION ALL SELECT 'S' || s_suppkey FROM supplier),
edges AS (SELECT 'P' || l_partkey AS source_id, 'S' || l_suppkey AS target_id, l_returnflag AS relationship_type, l_orderkey * 10 + l_linenumber AS edge_id FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n).cast("int") + 1)
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        pick(SOURCE_TYPES, 4).alias("source_type"), F.col("source").alias("source_name"), pick(TRADITIONS, 5).alias("tradition"),
        F.concat(F.lit("DOC "), F.col("doc_id")).alias("reference"), F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("content"),
        F.concat(F.lit('{"language":"'), "lang", F.lit('","chapter":'), F.col("n_chars") % 50, F.lit(',"topics":["'), "source", F.lit('"]}')).alias("metadata"),
        "lang", "n_chars",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of the same id where there is one."""
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("vector").alias("embedding"))
    docs = documents(spark, sf_dir).join(own, "doc_id", "left")
    return docs.withColumn("embedding_status", F.when(F.col("embedding").isNotNull(), "ready").when(F.col("doc_id") % 7 == 0, "failed").otherwise("pending"))


EMBEDDED_SQL = (
    DOCUMENTS_SQL
    + """, emb AS (
  SELECT docs.*, e.embedding::DOUBLE[] AS embedding, CASE WHEN e.embedding IS NOT NULL THEN 'ready' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'pending' END AS embedding_status
  FROM docs LEFT JOIN embeddings e ON e.vec_id = docs.doc_id)"""
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: parts and suppliers, tied by order lines; a tenth of the parts is missing."""
    parts = read(spark, sf_dir, "part").where("p_partkey % 10 <> 1").select(F.concat(F.lit("P"), "p_partkey").alias("node_id"))
    suppliers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"))
    edges = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("target_id"),
        F.col("l_returnflag").alias("relationship_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
    )
    return parts.union(suppliers), edges


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("verse"),
        F.concat("l_returnflag", F.lit(" "), "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_suppkey").alias("note"),
    )


VERSES_SQL = "verses AS (SELECT l_orderkey AS chapter, l_linenumber AS verse, l_returnflag || ' ' || l_linestatus || ' ' || l_partkey AS text, l_suppkey AS note FROM lineitem)"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import attempts, from the events table."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    n = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("manifest_id"), F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("file_path"),
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 3).cast("string")).cast("binary")).alias("checksum"),
        F.concat(F.lit("importer"), F.col("user_id") % 4).alias("importer"), status.alias("status"), F.col("ts").alias("finished_at"), n.alias("failed_records"),
    )


MANIFESTS_SQL = """manifests AS (
  SELECT event_id AS manifest_id, 'file' || user_id AS file_path, md5(user_id || ':' || (event_id % 3)) AS checksum, 'importer' || (user_id % 4) AS importer,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS finished_at,
    json_extract_string(props, '$.k')::BIGINT AS failed_records
  FROM events)"""
