"""Citations, prompts, completions, checks and confidence of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

from .retrieval import authority

#: The instruction that goes before every question, in this library's words.
SYSTEM = "Answer only from the supplied context. Cite sources using bracketed citation numbers like [1]. If evidence is insufficient, say so clearly. Do not fabricate references."
# The prompt's parts and the warnings.
TEMPLATE = "Question:\n{question}\n\nRetrieved context:\n{context}\n\nAnswer with citations:"
NO_EVIDENCE = "I do not have enough retrieved evidence to answer that confidently."
EMPTY, UNCITED, NO_SOURCES, DOUBTFUL = "Provider returned an empty response.", "Answer does not contain bracketed citations.", "No retrieved citations were available.", "Answer contains hallucination or prompt-failure indicators."


def build_citations(context: DataFrame) -> DataFrame:
    """context rows numbered 1.. in the order of their scores."""
    return context.withColumn("number", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def build_prompts(questions: DataFrame, citations: DataFrame, history: DataFrame | None = None, system: str = SYSTEM, template: str = TEMPLATE) -> DataFrame:
    """(query_id, context, messages, estimated_tokens).

    history: (query_id, turn, role, content).
    """
    block = F.concat(F.lit("["), "number", F.lit("] "), "reference", F.lit(" ("), "source_type", F.lit(") "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    blocks = citations.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
    out = questions.join(blocks, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    user = F.replace(F.replace(F.lit(template), F.lit("{question}"), F.col("query")), F.lit("{context}"), F.col("context"))
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    past = F.array().cast("array<struct<role:string,content:string>>")
    if history is not None:
        turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: message(x["role"], x["content"]))
        out = out.join(history.groupBy("query_id").agg(turns.alias("history")), "query_id", "left")
        past = F.coalesce("history", past)
    messages = F.concat(F.array(message(F.lit("system"), F.lit(system))), past, F.array(message(F.lit("user"), user)))
    return out.select("query_id", "query", "context", messages.alias("messages"), tx.estimate_tokens(F.concat_ws(" ", F.lit(system), user)).alias("estimated_tokens"))


@dataclass(frozen=True)
class Completion:
    """What a provider says: the text, and the model and token counts where it tells them."""

    text: str
    model: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


Provider = Callable[[list[list[dict]]], list["str | Completion"]]
_COMPLETED = "answer string, provider_warning string, model string, prompt_tokens long, completion_tokens long"


def complete_prompts(prompts: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(query_id, answer, provider_warning, model, prompt_tokens, completion_tokens).

    provider maps a batch of messages to texts or completions. Without one the answer is the
    fixed text for missing evidence; a provider that raises gives that text and a warning for
    the rows of the batch. Token counts that are not told are null.
    """
    if provider is None:
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _COMPLETED.split(", ")[1:]]
        return prompts.select("query_id", F.lit(NO_EVIDENCE).alias("answer"), *none)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = [a if isinstance(a, Completion) else Completion(a) for a in provider([[dict(m) for m in row] for row in batch["messages"]])]
                if len(answers) != len(batch):
                    raise ValueError("one answer for each prompt is expected")
                warning = None
            except Exception as e:
                answers, warning = [Completion(NO_EVIDENCE)] * len(batch), f"Provider failed: {e}"
            counts = {c: pd.array([getattr(a, c) for a in answers], "Int64") for c in ("prompt_tokens", "completion_tokens")}
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy(), "answer": [a.text for a in answers], "provider_warning": [warning] * len(batch), "model": [a.model for a in answers], **counts})

    kind = dict(prompts.dtypes)["query_id"]
    return prompts.select("query_id", "messages").mapInPandas(run, f"query_id {kind}, {_COMPLETED}")


def validate_answers(answers: DataFrame, answer: str = "answer", citations: str = "citations") -> DataFrame:
    """Adds valid and warnings. citations is the number of citations."""
    a, n = F.coalesce(F.col(answer), F.lit("")), F.col(citations)
    warnings = F.array_compact(F.array(
        F.when(F.trim(a) == "", F.lit(EMPTY)), F.when((n > 0) & ~a.rlike(r"\[\d+\]"), F.lit(UNCITED)),
        F.when(n == 0, F.lit(NO_SOURCES)), F.when(a.rlike(tx.INDICATORS), F.lit(DOUBTFUL)),
    ))
    return answers.withColumn("valid", F.trim(a) != "").withColumn("warnings", warnings)


def score_answers(answers: DataFrame, answer: str = "answer", citations: str = "citations") -> DataFrame:
    """Adds citation_coverage, faithfulness, completeness."""
    marks = F.length(answer) - F.length(F.replace(F.col(answer), F.lit("["), F.lit("")))
    coverage = F.when(F.col(citations) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), marks / F.col(citations)), 4))
    return answers.withColumn("citation_coverage", coverage).withColumn("faithfulness", F.when(F.size("warnings") == 0, 1.0).otherwise(0.75)).withColumn("completeness", F.when(tx.words(F.col(answer)) > 12, 1.0).otherwise(0.5))


def confidence(citations: DataFrame, graph_results: DataFrame | None = None) -> DataFrame:
    """(query_id, retrieval_score, citation_coverage, source_authority, graph_support, confidence).

    citations: (query_id, score, source_type); graph_results: (query_id, graph_results).
    """
    one = citations.groupBy("query_id").agg(F.avg(F.least(F.lit(1.0), "score")).alias("r"), F.least(F.lit(1.0), F.count("*") / 3).alias("c"), F.avg(authority(F.col("source_type"), 0.35)).alias("a"))
    if graph_results is not None:
        one = one.join(graph_results.select("query_id", F.least(F.lit(1.0), F.col("graph_results") / 2).alias("g")), "query_id", "left")
    else:
        one = one.withColumn("g", F.lit(0.0))
    one = one.withColumn("g", F.coalesce("g", F.lit(0.0)))
    total = F.round(F.least(F.lit(1.0), 0.45 * F.col("r") + 0.25 * F.col("c") + 0.20 * F.col("a") + 0.10 * F.col("g")), 4)
    return one.select("query_id", F.round("r", 4).alias("retrieval_score"), F.round("c", 4).alias("citation_coverage"), F.round("a", 4).alias("source_authority"), F.round("g", 4).alias("graph_support"), total.alias("confidence"))


def answer(questions: DataFrame, context: DataFrame, provider: Provider | None = None, history: DataFrame | None = None) -> DataFrame:
    """Answers of a table of questions from their context rows."""
    cited = build_citations(context)
    prompts = build_prompts(questions, cited, history)
    done = complete_prompts(prompts, provider)
    counts = cited.groupBy("query_id").agg(F.count("*").alias("citations"), F.count_if(F.array_contains("stages", "graph")).alias("graph_results"))
    out = done.join(counts, "query_id", "left").fillna(0, ["citations", "graph_results"])
    sure = confidence(cited, counts)
    return score_answers(validate_answers(out)).join(sure.select("query_id", "confidence"), "query_id", "left").fillna(0.0, ["confidence"])
