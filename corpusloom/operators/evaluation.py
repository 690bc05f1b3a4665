"""Retrieval evaluation: questions, metrics, strategies and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search as sx


def evaluate_queries(results: DataFrame, truth: DataFrame) -> DataFrame:
    """hit, precision, recall, reciprocal_rank of each question.

    results: (query_id, reference, rank); truth: (query_id, reference). Precision is over
    the rows retrieved; repeats count in it, in recall they count once.
    """
    truth = truth.select("query_id", "reference").distinct()
    expected = truth.groupBy("query_id").agg(F.count("*").alias("expected"))
    marked = results.join(truth.withColumn("relevant", F.lit(True)), ["query_id", "reference"], "left")
    seen = marked.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count_if("relevant").alias("good"),
        F.count_distinct(F.when(F.col("relevant"), F.col("reference"))).alias("found"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    out = expected.join(seen, "query_id", "left").fillna(0, ["retrieved", "good", "found"])
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    return out.select("query_id", (F.col("good") > 0).alias("hit"), part("good", "retrieved").alias("precision"), part("found", "expected").alias("recall"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("reciprocal_rank"))


def summarize(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda c, n: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(n)
    return runs.groupBy(*(by or [])).agg(F.count("*").alias("questions"), mean(F.col("hit").cast("int"), "hit_rate"), mean("precision", "mean_precision"), mean("recall", "mean_recall"), mean("reciprocal_rank", "mean_reciprocal_rank"))


def run_evaluation(ranked: DataFrame, truth: DataFrame, strategy: str) -> DataFrame:
    """Runs of one strategy; questions without expected references are left out."""
    return evaluate_queries(ranked, truth).withColumn("strategy", F.lit(strategy))


def compare_strategies(strategies: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Summary rows of several strategies' rankings."""
    out = None
    for name, ranked in strategies.items():
        part = run_evaluation(ranked, truth, name)
        out = part if out is None else out.unionByName(part)
    return summarize(out, ["strategy"])


def weight_grid(vector: DataFrame, lexical: DataFrame, truth: DataFrame, k: int, weights: tuple[float, ...] = (0.8, 0.7, 0.6)) -> DataFrame:
    """Summary of the weighted fusion for each vector weight; the lists are made once."""
    fused = {f"{w:.1f}": sx.weighted_fusion(vector, lexical, k, 0.0, w, round(1 - w, 6)).select("query_id", F.col("doc_id").alias("reference"), "rank") for w in weights}
    return compare_strategies(fused, truth)


def validate_questions(questions: DataFrame, documents: DataFrame, source_types: tuple[str, ...]) -> DataFrame:
    """questions with empty, duplicates, missing, bad_types, valid.

    questions: (question_id, question, expected, expected_source_types).
    """
    refs = questions.select("question_id", F.explode("expected").alias("reference"))
    counts = refs.groupBy("question_id", "reference").count()
    twice = counts.where("count > 1").groupBy("question_id").agg(F.sort_array(F.collect_list("reference")).alias("duplicates"))
    gone = counts.join(documents.select("reference").distinct(), "reference", "left_anti").groupBy("question_id").agg(F.sort_array(F.collect_list("reference")).alias("missing"))
    none = F.array().cast("array<string>")
    out = questions.join(twice, "question_id", "left").join(gone, "question_id", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("duplicates", "missing")}).withColumn("empty", F.size(F.coalesce("expected", none)) == 0)
    out = out.withColumn("bad_types", F.array_except(F.coalesce("expected_source_types", none), F.array(*map(F.lit, source_types))))
    return out.withColumn("valid", ~F.col("empty") & (F.size("duplicates") + F.size("missing") + F.size("bad_types") == 0))


def coverage_of_questions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, existing, missing, coverage_status) of intended references."""
    refs = questions.select("question_id", F.posexplode("intended").alias("pos", "reference"))
    known = documents.select("reference").distinct().withColumn("known", F.lit(True))
    rows = refs.join(known, "reference", "left")
    pick = lambda rule: F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct("pos", "reference")))), lambda x: x["reference"])
    one = rows.groupBy("question_id").agg(pick(F.col("known")).alias("existing"), pick(F.col("known").isNull()).alias("missing"))
    status = F.when(F.size("missing") == 0, "fully_covered").when(F.size("existing") > 0, "partially_covered").otherwise("unavailable")
    return one.withColumn("coverage_status", status)


def question_coverage(covered: DataFrame) -> DataFrame:
    states = ["fully_covered", "partially_covered", "unavailable"]
    return covered.agg(F.count("*").alias("total"), *[F.count_if(F.col("coverage_status") == s).alias(s) for s in states], F.count_if(F.size("existing") > 0).alias("evaluable"))


def expected_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, reference, exists, source_type, source_name, content_length) for each intended reference."""
    first = documents.groupBy("reference").agg(F.min_by(F.struct("source_type", "source_name", F.length("content").alias("n")), "doc_id").alias("d"))
    rows = questions.select("question_id", F.explode("intended").alias("reference")).join(first, "reference", "left")
    return rows.select("question_id", "reference", F.col("d").isNotNull().alias("exists"), F.col("d.source_type").alias("source_type"), F.col("d.source_name").alias("source_name"), F.coalesce("d.n", F.lit(0)).alias("content_length"))


def assign_rank(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Ranked rows with the flag expected. results: (query_id, doc_id, score)."""
    ranked = sx.top_k_per_query(results, k)
    flag = truth.select("query_id", F.col("reference").alias("doc_id")).distinct().withColumn("expected", F.lit(True))
    return ranked.join(flag, ["query_id", "doc_id"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))


def score_ranges(rows: DataFrame, columns: tuple[str, ...] = ("vector", "lexical", "combined")) -> DataFrame:
    """(query_id, kind, low, high) of each score column."""
    long = rows.unpivot(["query_id"], list(columns), "kind", "score")
    return long.groupBy("query_id", "kind").agg(F.min("score").alias("low"), F.max("score").alias("high"))


def ordered_questions(questions: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    rows = questions.where(F.col("category") == category) if category else questions
    rows = rows.orderBy("category", "question")
    return rows.limit(limit) if limit else rows


def diagnose(strategies: dict[str, DataFrame], truth: DataFrame, k: int) -> DataFrame:
    """Ranked tables of several strategies, one under the other."""
    out = None
    for name, rows in strategies.items():
        part = assign_rank(rows.select("query_id", "doc_id", "score"), truth, k).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def save_evaluation(runs: DataFrame, summary: DataFrame, configuration: dict, root: str) -> None:
    """Append runs and the summary with its configuration as JSON text."""
    import json

    runs.write.mode("append").parquet(f"{root}/runs")
    summary.withColumn("configuration", F.lit(json.dumps(configuration, sort_keys=True))).write.mode("append").parquet(f"{root}/summaries")
