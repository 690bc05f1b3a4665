"""Filters, upserts, deletions and audits of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT, LONG = 80, 5000
#: Metadata keys that candidates can be filtered by, and the key that each reads.
CANDIDATE_FILTERS = {k: k for k in ("author", "book", "chapter", "language", "translation", "century", "topic")} | {"theological_topic": "topics"}


def filter_source(docs: DataFrame, source_type: str | None = None, source_types: list[str] | None = None, source_name: str | None = None, tradition: str | None = None) -> DataFrame:
    """AND of the filters that are set."""
    for column, value in (("source_type", source_type), ("source_name", source_name), ("tradition", tradition)):
        if value:
            docs = docs.where(F.col(column) == value)
    return docs.where(F.col("source_type").isin(source_types)) if source_types else docs


def filter_metadata(docs: DataFrame, **values) -> DataFrame:
    """Equality at JSON paths, compared as text."""
    for key, value in values.items():
        if value is not None:
            docs = docs.where(F.get_json_object("metadata", f"$.{key}") == str(value))
    return docs


def metadata_holds(metadata: Column, key: str, value: str) -> Column:
    """A list under key holds value, or a scalar equals it; false where key is absent."""
    item = F.get_json_object(metadata, f"$.{key}")
    listed = F.array_contains(F.from_json(item, "array<string>"), str(value))
    return F.coalesce(F.when(F.startswith(item, F.lit("[")), listed).otherwise(item == str(value)), F.lit(False))


def filter_candidates(candidates: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    for key, value in filters.items():
        if key in CANDIDATE_FILTERS and value not in (None, ""):
            candidates = candidates.where(metadata_holds(F.col("metadata"), CANDIDATE_FILTERS[key], str(value)))
    return candidates


def substring_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """LIKE over title, content, reference and source name, with constant score."""
    pattern = f"%{query}%"
    hit = F.lit(False)
    for c in ("title", "content", "reference", "source_name"):
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return docs.where(hit).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(limit)


def select_for_embedding(docs: DataFrame, retry_failed: bool = False, force: bool = False, limit: int | None = None, **source) -> DataFrame:
    docs = filter_source(docs, **source)
    if not force:
        docs = docs.where(F.col("embedding_status").isin(["pending", "failed"] if retry_failed else ["pending"]))
    ids = docs.select("doc_id").orderBy("doc_id")
    return ids if limit is None else ids.limit(limit)


def score_threshold(rows: DataFrame, least: float, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= least)


def project_document(docs: DataFrame) -> DataFrame:
    """Public columns; status pending where unset, timestamps in ISO-8601."""
    plain = ["doc_id", "source_type", "source_name", "tradition", "reference", "title", "content", "metadata"]
    out = [F.col(c) for c in plain] + [F.coalesce("embedding_status", F.lit("pending")).alias("embedding_status")]
    out += [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) for c in ("created_at", "updated_at") if c in docs.columns]
    return docs.select(*out)


def violations(docs: DataFrame, source_types: tuple[str, ...], traditions: tuple[str, ...]) -> DataFrame:
    """docs with the names of the rules that each row breaks."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    rules = [
        ("source_type", ~F.coalesce(F.col("source_type").isin(*source_types), F.lit(False))),
        ("tradition", F.col("tradition").isNotNull() & ~F.col("tradition").isin(*traditions)),
        ("reference_blank", blank("reference")), ("reference_long", F.length("reference") > 255),
        ("title_blank", blank("title")), ("title_long", F.length("title") > 255), ("content", blank("content")),
    ]
    if "embedding" in docs.columns:
        rules.append(("embedding", F.exists("embedding", lambda x: F.abs(x) > 1)))
    return docs.withColumn("violations", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])))


def validate_references(refs: DataFrame, canon: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """refs (book, chapter, verse, version) with canonical_book and valid.

    canon: (name, chapters), some tens of rows.
    """
    names = canon.select(F.lower("name").alias("__key"), F.col("name").alias("canonical_book"), F.col("chapters").alias("__chapters"))
    out = refs.join(names, F.lower(F.trim("book")) == F.col("__key"), "left")
    valid = F.col("canonical_book").isNotNull() & F.col("chapter").between(1, F.col("__chapters")) & (F.coalesce("verse", F.lit(1)) >= 1) & F.col("version").isin(*versions)
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("__key", "__chapters")


def grouped_search(query: str, groups: dict[str, tuple[DataFrame, str, str, int | None]]) -> DataFrame:
    """Case-insensitive contains over several tables, the first rows of each by id.

    groups: name to (table, id column, text column, most rows or None).
    """
    out = None
    for name, (table, id_col, text_col, most) in groups.items():
        text = F.col(text_col).cast("string")
        rows = table.where(F.contains(F.lower(text), F.lit(query.strip().lower()))).select(F.lit(name).alias("group"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
        rows = rows if most is None else rows.orderBy("id").limit(most)
        out = rows if out is None else out.unionByName(rows)
    return out


def list_documents(docs: DataFrame, reference_part: str | None = None, page: int = 1, size: int = 20, newest: str = "created_at", **source) -> DataFrame:
    docs = filter_source(docs, **source)
    if reference_part:
        docs = docs.where(F.contains("reference", F.lit(reference_part)))
    size = min(size, 100)
    return docs.orderBy(F.desc(newest), "doc_id").offset((page - 1) * size).limit(size)


def canonical_json(metadata: Column) -> Column:
    """JSON text with sorted keys, so that equal values are equal texts."""
    return F.to_json(F.try_parse_json(metadata))


KEY = ["source_type", "source_name", "reference"]


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the upsert, with status created, updated, skipped or kept.

    Rows match on source type, source name and reference. A null in incoming leaves the
    value that is there. A change makes the embedding pending again. Of incoming rows that
    repeat a key the last one stands, by file_path and position where there are such columns.
    """
    values = ["title", "content", "tradition", "metadata"]
    rest = [c for c in existing.columns if c not in [*KEY, *values, "embedding_status"]]
    later = F.struct(*[c for c in ("file_path", "position") if c in incoming.columns], F.xxhash64(*values))
    incoming = incoming.groupBy(*KEY).agg(F.max_by(F.struct(*values), later).alias("__v")).select(*KEY, "__v.*")
    right = incoming.select(*[F.col(c).alias(f"__{c}") for c in [*KEY, *values]], F.lit(True).alias("__new"))
    same_key = [F.col(c) == F.col(f"__{c}") for c in KEY]
    joined = existing.withColumn("__old", F.lit(True)).join(right, same_key, "full")
    view = lambda c, side: canonical_json(F.col(side + c)) if c == "metadata" else F.col(side + c)
    changed = F.lit(False)
    for c in values:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~view(c, "__").eqNullSafe(view(c, "")))
    status = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "kept").when(changed, "updated").otherwise("skipped")
    joined = joined.withColumn("status", status)
    merged = [F.coalesce(f"__{c}", c).alias(c) for c in [*KEY, *values]]
    embedding = F.when(F.col("status").isin("created", "updated"), F.lit("pending")).otherwise(F.col("embedding_status"))
    return joined.select(*merged, *rest, embedding.alias("embedding_status"), "status")


def import_counts(upserted: DataFrame, by: str = "source_name") -> DataFrame:
    states = ["created", "updated", "skipped", "failed"]
    return upserted.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates by doc_id; a supplied vector makes the row ready, other changes pending."""
    values = ["title", "content", "tradition", "metadata"]
    right = changes.select(F.col("doc_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in [*values, "embedding"]])
    joined = docs.join(right, F.col("doc_id") == F.col("__id"), "left")
    changed = F.lit(False)
    for c in values:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    status = F.when(F.col("__embedding").isNotNull(), "ready").when(changed, "pending").otherwise(F.col("embedding_status"))
    new = {c: F.coalesce(f"__{c}", c) for c in [*values, "embedding"]}
    return joined.withColumn("__status", status).withColumns(new).withColumn("embedding_status", F.col("__status")).select(*docs.columns)


def lookup_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def delete_documents(docs: DataFrame, edges: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents and edges that are left."""
    gone = ids.select(F.col(id_col).alias("__gone")).distinct()
    left = edges.join(gone, edges["source_id"] == gone["__gone"], "left_anti")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti"), left.join(gone, left["target_id"] == gone["__gone"], "left_anti")


# audits


def counts_by(docs: DataFrame, column: str) -> DataFrame:
    return docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def embedding_stats(docs: DataFrame) -> DataFrame:
    has = F.count_if(F.col("embedding").isNotNull())
    total = F.count("*")
    coverage = F.when(total == 0, 0.0).otherwise(F.round(has / total, 6))
    return docs.agg(total.alias("total"), has.alias("with_embedding"), (total - has).alias("without_embedding"), coverage.alias("coverage"))


def actual_dimensions(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    return docs.where(F.col(vector).isNotNull()).select(F.size(vector).alias("dimensions")).distinct()


def _length() -> Column:
    return F.length(F.trim(F.coalesce("content", F.lit(""))))


def content_stats(docs: DataFrame) -> DataFrame:
    n = _length()
    return docs.agg(F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < SHORT)).alias("very_short"), F.count_if(n > LONG).alias("very_long"))


def chunking_stats(docs: DataFrame) -> DataFrame:
    n = F.col("__n")
    return docs.withColumn("__n", _length()).groupBy("source_type").agg(
        F.count("*").alias("documents"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 2).alias("avg_length"),
        F.round(F.median(n), 2).alias("median_length"), F.count_if(n < SHORT).alias("short"), F.count_if(n > LONG).alias("long"),
    )


def audit_quality(docs: DataFrame) -> DataFrame:
    """(metric, n, percent) of missing values and embedding states."""
    missing = lambda key: F.coalesce(F.get_json_object("metadata", f"$.{key}"), F.lit("")) == ""
    rules = {"missing_content": _length() == 0, "missing_source_url": missing("source_url"), "missing_license": missing("license")}
    rules |= {f"embedding_{s}": F.col("embedding_status") == s for s in ("pending", "failed", "ready")}
    one = docs.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    stacked = one.unpivot(["total"], list(rules), "metric", "n")
    return stacked.select("metric", "n", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100 * F.col("n") / F.col("total"), 1)).alias("percent"))


def distinct_metadata_count(docs: DataFrame, key: str, within: str | None = None, column: str = "metadata", approximate: bool = False) -> DataFrame:
    value = F.get_json_object(column, f"$.{key}")
    count = (F.approx_count_distinct if approximate else F.count_distinct)(value).alias("n")
    return docs.groupBy(F.get_json_object(column, f"$.{within}").alias("within")).agg(count) if within else docs.agg(count)


def coverage_by_group(docs: DataFrame, group: str, kinds: dict[str, Column]) -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("group")).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))


def metadata_item_count(docs: DataFrame, key: str) -> DataFrame:
    return docs.agg(F.coalesce(F.sum(F.coalesce(F.json_array_length(F.get_json_object("metadata", f"$.{key}")), F.lit(0))), F.lit(0)).alias("items"))


def latest_manifest(manifests: DataFrame, by: str, completed_only: bool = True) -> DataFrame:
    rows = manifests.where("status = 'completed'") if completed_only else manifests
    newest = W.partitionBy(by).orderBy(F.desc("finished_at"), F.desc("manifest_id"))
    return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def source_status(manifests: DataFrame) -> DataFrame:
    """Per importer: attempts, share completed, last completed import, failed records."""
    done = F.col("status") == "completed"
    return manifests.groupBy("importer").agg(
        F.count("*").alias("attempts"), F.round(100 * F.count_if(done) / F.count("*"), 1).alias("completed_percent"),
        F.max(F.when(done, F.col("finished_at"))).alias("last_completed"),
        F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("failed_records"))), F.lit(0)).alias("failed_records"),
    )


def embedding_batch_summary(docs: DataFrame, ids: DataFrame) -> DataFrame:
    own = lookup_documents(docs, ids)
    state = lambda s: F.count_if(F.col("embedding_status") == s)
    return own.agg(F.count("*").alias("processed"), state("ready").alias("generated"), state("failed").alias("failures"))


FINDINGS = {  # fixed values: messages of the health report
    "coverage": "Embedding coverage is incomplete; vector and hybrid search cannot retrieve documents without embeddings.",
    "dimensions": "Documents contain multiple embedding dimensions.",
    "empty": "Some documents have empty content.",
    "short": "Some chunks are very short, which can weaken semantic retrieval context.",
    "none": "No obvious retrieval health problems were detected by automated checks.",
}


def health_findings(docs: DataFrame) -> DataFrame:
    """One row for each finding, or the row that says there is none."""
    one = embedding_stats(docs).crossJoin(content_stats(docs)).crossJoin(actual_dimensions(docs).agg(F.count("*").alias("dims")))  # one row each
    found = F.array_compact(F.array(
        F.when(F.col("coverage") < 0.95, F.lit(FINDINGS["coverage"])), F.when(F.col("dims") > 1, F.lit(FINDINGS["dimensions"])),
        F.when(F.col("empty") > 0, F.lit(FINDINGS["empty"])), F.when(F.col("very_short") > 0, F.lit(FINDINGS["short"])),
    ))
    return one.select(F.explode(F.when(F.size(found) == 0, F.array(F.lit(FINDINGS["none"]))).otherwise(found)).alias("finding"))


def report(docs: DataFrame) -> DataFrame:
    """(section, key, value) of counts, embeddings, content and findings."""
    rows = lambda section, df, key, value: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    out = None
    for c in ("source_type", "source_name", "tradition"):
        part = rows(c, counts_by(docs, c), "value", "n")
        out = part if out is None else out.unionByName(part)
    for name, one in (("embeddings", embedding_stats(docs).drop("coverage")), ("content", content_stats(docs))):
        out = out.unionByName(rows(name, one.unpivot([], one.columns, "k", "v"), "k", "v"))
    return out.unionByName(health_findings(docs).select(F.lit("findings").alias("section"), F.col("finding").alias("key"), F.lit("1").alias("value")))
