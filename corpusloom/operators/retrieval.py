"""The retrieval engine: candidates of all stages, fused, reranked and packed as context."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.frames import union_by, written

from . import documents as dx
from . import graph as gx
from . import search as sx


@dataclass(frozen=True)
class Profile:
    top_k: int = 10
    context_limit: int = 8
    token_budget: int = 2500
    use_vector: bool = True
    use_lexical: bool = True
    use_expansion: bool = True
    graph_depth: int = 1
    weights: dict[str, float] = field(default_factory=dict)

    def override(self, **values) -> Profile:
        return replace(self, **{k: v for k, v in values.items() if v is not None})


def _w(vector: float, lexical: float, graph: float, metadata: float, authority: float) -> dict[str, float]:
    return {"vector": vector, "lexical": lexical, "graph": graph, "metadata": metadata, "authority": authority}


# Named profiles.
PROFILES = {
    "ai_answer": Profile(10, 8, 2500, True, True, True, 1, _w(0.45, 0.25, 0.15, 0.10, 0.05)),
    "study_mode": Profile(12, 10, 3500, True, True, True, 2, _w(0.35, 0.25, 0.25, 0.10, 0.05)),
    "search": Profile(10, 10, 2000, True, True, False, 0, _w(0.50, 0.45, 0.0, 0.05, 0.0)),
    "cross_references": Profile(8, 12, 2200, False, True, True, 2, _w(0.0, 0.20, 0.60, 0.15, 0.05)),
    "research": Profile(20, 15, 5000, True, True, True, 2, _w(0.30, 0.30, 0.25, 0.10, 0.05)),
}
METADATA_NOTE = "Boosted because document metadata matches analyzed query topics or references."
AUTHORITY_NOTE = "Boosted because the source type is authoritative."


def candidates(rows: DataFrame, stage: str) -> DataFrame:
    """(query_id, doc_id, stage, score, path) of one stage."""
    path = F.col("path") if "path" in rows.columns else F.array().cast("array<string>")
    return rows.select("query_id", "doc_id", F.lit(stage).alias("stage"), F.col("score").cast("double").alias("score"), path.alias("path"))


def union_candidates(*parts: DataFrame) -> DataFrame:
    return union_by(["query_id", "doc_id"], *parts)


def fuse_candidates(rows: DataFrame, weights: dict[str, float], order: tuple[str, ...] = ("vector", "lexical", "graph")) -> DataFrame:
    """(query_id, doc_id, score, breakdown, stages, path): weighted sum of stage maxima."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    weight: Column = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("stage") == name, F.lit(w)).otherwise(weight)
    best = rows.groupBy("query_id", "doc_id", "stage").agg(F.max("score").alias("s"), F.max("path").alias("path"))
    best = best.withColumn("w", F.col("s") * weight).withColumn("place", place)
    ordered = F.array_sort(F.collect_list(F.struct("place", "stage", "s", "path")))
    grouped = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"), ordered.alias("__all"))
    paths = F.filter(F.transform("__all", lambda x: x["path"]), lambda p: F.size(p) > 0)
    breakdown = F.map_from_entries(F.transform("__all", lambda x: F.struct(x["stage"], x["s"])))
    return grouped.select("query_id", "doc_id", "score", breakdown.alias("breakdown"), F.transform("__all", lambda x: x["stage"]).alias("stages"), F.coalesce(F.get(paths, F.lit(0)), F.array().cast("array<string>")).alias("path"))


def authority(source_type: Column, other: float = 0.25) -> Column:
    return F.when(source_type.isin("bible_verse", "catechism", "church_father"), 1.0).when(source_type == "bible_chapter", 0.85).otherwise(other)


def rerank(fused: DataFrame, docs: DataFrame, analyzed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds metadata match and authority to the score, and says so in explanations."""
    rows = fused.join(docs.select("doc_id", "source_type", "reference", "metadata", "title", "content"), "doc_id").join(analyzed.select("query_id", "topics", "references"), "query_id")
    listed = F.coalesce(F.from_json(F.get_json_object("metadata", "$.topics"), "array<string>"), F.array().cast("array<string>"))
    category = F.get_json_object("metadata", "$.category")
    match = F.exists("topics", lambda t: F.array_contains(listed, t) | F.coalesce(category == t, F.lit(False))) | F.array_contains("references", F.col("reference"))
    m = F.when(F.coalesce(match, F.lit(False)), 1.0).otherwise(0.0)
    a = authority(F.col("source_type"))
    rows = rows.withColumn("__m", m).withColumn("__a", a)
    total = F.round(F.col("score") + F.col("__m") * weights.get("metadata", 0.0) + F.col("__a") * weights.get("authority", 0.0), 6)
    rows = rows.withColumn("score", total)
    extra = F.create_map(F.lit("metadata"), "__m", F.lit("authority"), "__a", F.lit("reranked"), "score")
    notes = F.array_compact(F.array(F.when(F.col("__m") > 0, F.lit(METADATA_NOTE)), F.when(F.col("__a") > 0, F.lit(AUTHORITY_NOTE))))
    return rows.withColumn("breakdown", F.map_concat("breakdown", extra)).withColumn("stages", F.array_append("stages", F.lit("rerank"))).withColumn("explanations", notes).drop("__m", "__a", "topics", "references")


def pack_context(ranked: DataFrame, limit: int, budget: int) -> DataFrame:
    """Rows that fit the budget, by score: the first always, later ones unless too long.

    ranked holds (query_id, doc_id, score, content); a query has as many rows as were
    fetched for it, so the fold is over a short list.
    """
    rows = ranked.withColumn("tokens", tx.estimate_tokens(F.col("content")))
    short = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "tokens")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{dict(ranked.dtypes)['doc_id']}>").alias("ids"))

    def step(state: Column, x: Column) -> Column:
        fits = (F.size(state["ids"]) == 0) | ((state["used"] + x["tokens"] <= budget) & (F.size(state["ids"]) < limit))
        return F.when(fits, F.struct((state["used"] + x["tokens"]).alias("used"), F.array_append(state["ids"], x["doc_id"]).alias("ids"))).otherwise(state)

    kept = rows.groupBy("query_id").agg(F.aggregate(short, start, step)["ids"].alias("ids"))
    return rows.join(kept.select("query_id", F.posexplode("ids").alias("position", "doc_id")), ["query_id", "doc_id"]).withColumn("position", F.col("position") + 1)


class StageCounts:
    """Rows of the stages of a retrieval, counted while it runs and not by jobs of their own.

    The counts are there once the result was computed whole.
    """

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def observed(self, stage: str, rows: DataFrame) -> DataFrame:
        self.stages[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return rows.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        return {stage: seen.get["rows"] for stage, seen in self.stages.items()}


def retrieve(queries: DataFrame, docs: DataFrame, vectors: DataFrame, edges: DataFrame | None = None, profile: Profile = PROFILES["ai_answer"], filters: dict[str, str] | None = None, source: dict | None = None, counts: StageCounts | None = None) -> DataFrame:
    """Context rows for a table of queries (query_id, query, vector).

    source (source_type, source_types, source_name, tradition) limits the documents before
    any ranking, filters the candidates of the searches by metadata. counts takes the number
    of rows of each stage while the result is computed. Analyzed queries are written to the
    shared folder, as every search uses them several times and they may be made of the texts
    of documents; so are candidates that are to be expanded in the graph.
    """
    seen = (lambda stage, rows: rows) if counts is None else counts.observed
    docs = dx.filter_source(docs, **(source or {}))
    analyzed = tx.expand_queries(tx.analyze_queries(queries))
    analyzed = written(analyzed.select("query_id", "query", *(["vector"] if profile.use_vector else []), "topics", "references", "expanded_query"), "queries")
    asked = analyzed.withColumn("query", F.col("expanded_query")) if profile.use_expansion else analyzed
    deep = sx.over_fetch(profile.top_k, profile.context_limit)
    parts = []
    if profile.use_vector:
        parts.append(candidates(sx.semantic_search(asked, vectors, deep, allowed=docs if source else None), "vector"))
        parts[-1] = seen("vector", parts[-1])
    if profile.use_lexical:
        parts.append(candidates(sx.lexical_search(asked.select("query_id", "query"), docs, deep), "lexical"))
        parts[-1] = seen("lexical", parts[-1])
    rows = union_candidates(*parts)
    if filters:
        allowed = dx.filter_candidates(docs, filters).select("doc_id")
        rows = seen("filtered", rows.join(allowed, "doc_id", "left_semi"))
    if profile.graph_depth > 0 and edges is not None:
        rows = written(rows, "candidates")  # as many rows as queries times the depth of the searches
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        seeds = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
        rows = union_candidates(rows, seen("graph", candidates(gx.expand_graph(seeds, edges, profile.graph_depth), "graph")))
    ranked = rerank(fuse_candidates(rows, profile.weights), docs, analyzed, profile.weights)
    if counts is not None:
        ranked = written(seen("ranked", ranked), "ranked")  # packing reads it twice
    return seen("context", pack_context(ranked, profile.context_limit, profile.token_budget))
