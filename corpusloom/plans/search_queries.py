"""Queries of search, graph, evaluation, answers and study."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import adapters as ad
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.functions.frames import shared_folder
from corpusloom.operators import answers as an
from corpusloom.operators import evaluation as ev
from corpusloom.operators import graph as gx
from corpusloom.operators import retrieval as rt
from corpusloom.operators import search as sx
from corpusloom.operators import study as st

from .catalogue import query
from .document_queries import long_

DOCS, GRAPH, VERSES = ad.DOCUMENTS_SQL, ad.GRAPH_SQL, ad.VERSES_SQL
K = 10

# Queries: every vector whose id is divisible by 100 asks with its vector; the text of the
# same document's second and third word is the query string.
ASK_SQL = r"""asks AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label,
  array_to_string((list_filter(regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿ]+'), lambda x: length(x) > 3))[1:2], ' ') AS query FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0)"""


def asks(spark, sf):
    words = F.filter(sx.tokens(F.col("text")), lambda w: F.length(w) > 3)
    v = ad.vectors(spark, sf).where("vec_id % 100 = 0")
    return v.join(ad.read(spark, sf, "documents"), F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("query_id"), "vector", "label", F.array_join(F.slice(words, 1, 2), " ").alias("query"))


def held(spark, sf):
    return ad.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vector")


COS = "round(list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(v, v)), 6)"
VECTOR_SQL = ASK_SQL + f""", scored AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) AS score FROM asks, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {3 * K})"""

POSTINGS_SQL = r"""fields AS (SELECT doc_id, unnest([reference, title, source_name, content]) AS body, unnest([1.0, 1.0, 0.4, 0.2])::DOUBLE AS weight, unnest([0, 1, 2, 3]) AS f FROM docs),
postings AS (SELECT doc_id, weight, unnest(regexp_extract_all(lower(body), '[a-z0-9à-öø-ÿ]+')) AS token, f * 1000000 + unnest(range(len(regexp_extract_all(lower(body), '[a-z0-9à-öø-ÿ]+')))) AS pos FROM fields)"""
LEXICAL_SQL = POSTINGS_SQL + f""", terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9à-öø-ÿ]+'))) AS token, len(list_distinct(regexp_extract_all(query, '[a-z0-9à-öø-ÿ]+'))) AS n_terms FROM asks),
occ AS (SELECT query_id, doc_id, token, pos, weight, n_terms, row_number() OVER w AS i, sum(1 / weight) OVER w AS inverse FROM postings JOIN terms USING (token) WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
sofar AS (SELECT *, max(i) OVER (PARTITION BY query_id, doc_id, token ORDER BY pos) AS own,
  (SELECT max(o2.i) FROM occ o2 WHERE o2.query_id = occ.query_id AND o2.doc_id = occ.doc_id AND o2.i < occ.i AND o2.token <> occ.token) AS other FROM occ),
ends AS (SELECT *, CASE WHEN n_terms = 1 THEN i WHEN other IS NOT NULL THEN least(i, other) END AS s FROM sofar),
covers AS (SELECT * FROM ends WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, s ORDER BY i) = 1),
ranks AS (SELECT c.query_id, c.doc_id, sum(CASE WHEN c.n_terms = 1 THEN c.weight ELSE (c.i - c.s + 1) / (c.inverse - b.inverse + 1 / b.weight) / (1 + greatest((c.pos - b.pos) - (c.i - c.s), 0)) END) AS rank
  FROM covers c JOIN occ b ON b.query_id = c.query_id AND b.doc_id = c.doc_id AND b.i = c.s GROUP BY 1, 2),
boost AS (SELECT query_id, doc_id, CASE WHEN lower(reference) = query THEN 10 ELSE 0 END + CASE WHEN contains(lower(reference), query) THEN 5 ELSE 0 END + CASE WHEN contains(lower(source_name), query) THEN 2 ELSE 0 END AS boost FROM asks, docs),
lex0 AS (SELECT query_id, doc_id, round(coalesce(rank, 0) + coalesce(boost, 0), 6) AS score FROM boost LEFT JOIN ranks USING (query_id, doc_id) WHERE rank IS NOT NULL OR boost > 0),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex0 QUALIFY rank <= {3 * K})"""
FUSED_SQL = f"""nv AS (SELECT query_id, doc_id, round(greatest(score, 0) / max(score) OVER (PARTITION BY query_id), 6) AS score FROM vec),
nl AS (SELECT query_id, doc_id, round(greatest(score, 0) / max(score) OVER (PARTITION BY query_id), 6) AS score FROM lex),
merged AS (SELECT query_id, doc_id, coalesce(nv.score, 0.0::DOUBLE) AS vector, coalesce(nl.score, 0.0::DOUBLE) AS lexical FROM nv FULL JOIN nl USING (query_id, doc_id)),
fused AS (SELECT *, round(0.7::DOUBLE * vector + 0.3::DOUBLE * lexical, 6) AS combined FROM merged),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, doc_id) AS rank FROM fused QUALIFY rank <= {K})"""


def vec(spark, sf):
    return sx.semantic_search(asks(spark, sf).select("query_id", "vector"), held(spark, sf), 3 * K)


def lex(spark, sf):
    return sx.lexical_search(asks(spark, sf).select("query_id", "query"), ad.documents(spark, sf), 3 * K)


@query("h1_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h1(spark, sf):
    v = ad.vectors(spark, sf)
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("w"))
    return v.join(b, F.col("vec_id") == F.col("a")).select("a", "b", vx.cosine(F.col("vector"), F.col("w")).alias("score"))


@query("j7_semantic_search", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, score, rank FROM vec")
def j7(spark, sf):
    return vec(spark, sf).select("query_id", "doc_id", "score", *long_("rank"))


@query("f6_score_threshold", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, score FROM vec WHERE score >= 0.3")
def f6(spark, sf):
    return sx.top_k_per_query(sx.semantic_search(asks(spark, sf), held(spark, sf), 3 * K, 0.3), 3 * K).select("query_id", "doc_id", "score")


@query("t6_ann_search")
def t6(spark, sf):
    return sx.ann_search(asks(spark, sf).select("query_id", "vector"), held(spark, sf), K)


@query("t2_build_postings", f"WITH {DOCS}, {POSTINGS_SQL} SELECT token, doc_id, pos, weight FROM postings")
def t2(spark, sf):
    return sx.build_postings(ad.documents(spark, sf)).select("token", "doc_id", *long_("pos"), "weight")


@query("t3_query_terms", "SELECT query_id, 'word' AS kind, term, dense_rank() OVER (PARTITION BY query_id ORDER BY g) AS \"group\" FROM (SELECT c_custkey AS query_id, unnest(string_split(lower(c_name || ' ' || c_mktsegment), ' ')) AS term, unnest(range(len(string_split(c_name || ' ' || c_mktsegment, ' ')))) AS g FROM customer)")
def t3(spark, sf):
    q = ad.read(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("query"))
    return sx.query_terms(q).select("query_id", "kind", "term", *long_("group"))


@query("w7_cover_density", f"WITH {DOCS}, {ASK_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, round(rank, 6) AS rank FROM ranks")
def w7(spark, sf):
    q = asks(spark, sf).select("query_id", "query")
    terms = sx.search_terms(q)
    hits = sx.occurrences(q, sx.build_postings(ad.documents(spark, sf), only=sx.vocabulary(terms)), terms=terms)
    return sx.cover_density(hits, 2).select("query_id", "doc_id", F.round("rank", 6).alias("rank"))


@query("t1_lexical_search", f"WITH {DOCS}, {ASK_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, score, rank FROM lex")
def t1(spark, sf):
    return lex(spark, sf).select("query_id", "doc_id", "score", *long_("rank"))


# parts of references: one to six characters from anywhere in every hundredth document's own

PARTS_SQL = """asks AS (SELECT query_id, query FROM (SELECT doc_id AS query_id, trim(substr(lower(reference), (1 + doc_id // 100 % 5)::INT, (1 + doc_id // 100 % 6)::INT), ' ') AS query FROM docs WHERE doc_id % 100 = 0))"""


def parts_asked(spark, sf):
    n = F.floor(F.col("doc_id") / 100)
    part = F.trim(F.substr(F.lower("reference"), (1 + n % 5).cast("int"), (1 + n % 6).cast("int")))
    return ad.documents(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), part.alias("query"))


@query("t1_partial_words", f"WITH {DOCS}, {PARTS_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, score, rank FROM lex")
def t1_parts(spark, sf):
    return sx.lexical_search(parts_asked(spark, sf), ad.documents(spark, sf), 3 * K).select("query_id", "doc_id", "score", *long_("rank"))


@query("t1_stored_index", f"WITH {DOCS}, {ASK_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, score, rank FROM lex")
def t1_stored(spark, sf):
    """The index is written once, and only what the queries ask for is read of it."""
    docs = ad.documents(spark, sf)
    index = sx.LexicalIndex(spark, shared_folder(spark, "lexical-index"), 16).build(docs)
    return sx.lexical_search(asks(spark, sf).select("query_id", "query"), docs, 3 * K, index=index).select("query_id", "doc_id", "score", *long_("rank"))


# queries with a phrase, alternatives and an unwanted word, made of words of the documents

SYNTAX_SQL = r"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿ]+') AS t FROM documents WHERE doc_id % 100 = 0),
bodies AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(reference), '[a-z0-9à-öø-ÿ]+'), ' ') || ' | ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9à-öø-ÿ]+'), ' ') || ' | ' || array_to_string(regexp_extract_all(lower(source_name), '[a-z0-9à-öø-ÿ]+'), ' ') || ' | ' || array_to_string(regexp_extract_all(lower(content), '[a-z0-9à-öø-ÿ]+'), ' ') || ' ' AS b FROM docs)"""


@query("t1_search_syntax", f"WITH {DOCS}, {SYNTAX_SQL} SELECT w.doc_id AS query_id, d.doc_id FROM words w JOIN bodies d ON len(t) >= 6 AND (contains(b, ' ' || t[1] || ' ' || t[2] || ' ') OR contains(b, ' ' || t[3] || ' ')) AND contains(b, ' ' || t[4] || ' ') AND NOT contains(b, ' ' || t[6] || ' ')")
def t1_syntax(spark, sf):
    t = sx.tokens(F.col("text"))
    q = ad.read(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), t.alias("t")).where("size(t) >= 6")
    asked = F.format_string('"%s %s" or %s %s -%s', *[F.col("t")[i] for i in (0, 1, 2, 3, 5)])
    return sx.lexical_matches(q.select("query_id", asked.alias("query")), ad.documents(spark, sf))


def _only(sql: str) -> str:
    """A query's SQL over the documents of two source types and one tradition."""
    return sql.replace("FROM documents d)", "FROM documents d WHERE doc_id % 4 IN (0, 2) AND doc_id % 5 = 0)").replace("FROM embeddings))", "FROM embeddings WHERE vec_id % 4 IN (0, 2) AND vec_id % 5 = 0 AND vec_id IN (SELECT doc_id FROM documents)))")


FILTERS = {"source_types": ["bible_verse", "catechism"], "tradition": "catholic"}


@query("t4_filtered_search", _only(f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL} SELECT query_id, doc_id, combined, rank FROM hybrid"))
def t4_filtered(spark, sf):
    return sx.hybrid_search(asks(spark, sf), ad.documents(spark, sf), held(spark, sf), K, filters=FILTERS).select("query_id", "doc_id", "combined", *long_("rank"))


@query("h2_normalize_scores", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, round(greatest(score, 0) / max(score) OVER (PARTITION BY query_id), 6) AS score FROM vec")
def h2(spark, sf):
    return sx.normalize_scores(vec(spark, sf)).select("query_id", "doc_id", "score")


@query("j11_merge_rankings", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, coalesce(vec.score, 0.0::DOUBLE) AS vector, coalesce(lex.score, 0.0::DOUBLE) AS lexical FROM vec FULL JOIN lex USING (query_id, doc_id)")
def j11(spark, sf):
    return sx.merge_rankings(vec(spark, sf), lex(spark, sf))


@query("t4_hybrid_search", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL} SELECT query_id, doc_id, vector, lexical, combined, rank FROM hybrid")
def t4(spark, sf):
    return sx.hybrid_search(asks(spark, sf), ad.documents(spark, sf), held(spark, sf), K).select("query_id", "doc_id", "vector", "lexical", "combined", *long_("rank"))


@query("h3_weighted_fusion", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL} SELECT query_id, doc_id, combined FROM fused")
def h3(spark, sf):
    return sx.weighted_fusion(vec(spark, sf), lex(spark, sf), 1000).select("query_id", "doc_id", "combined")


@query("k2_over_fetch", f"WITH {VECTOR_SQL} SELECT query_id, count(*) AS fetched FROM vec GROUP BY 1")
def k2(spark, sf):
    asked = asks(spark, sf).select("query_id", "vector")
    return sx.semantic_search(asked, held(spark, sf), sx.over_fetch(K)).groupBy("query_id").agg(F.count("*").alias("fetched"))


@query("k1_top_k_per_query", "SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def k1(spark, sf):
    rows = ad.read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return sx.top_k_per_query(rows, 3).select("query_id", "doc_id", *long_("rank"))


# evaluation: relevant are the vectors with the same label

TRUTH_SQL = "truth AS (SELECT a.vec_id AS query_id, b.vec_id AS reference FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def truth(spark, sf):
    v = ad.vectors(spark, sf)
    b = v.select(F.col("vec_id").alias("reference"), F.col("label").alias("l"))
    return v.where("vec_id % 100 = 0").join(b, (F.col("label") == F.col("l")) & (F.col("vec_id") != F.col("reference"))).select(F.col("vec_id").alias("query_id"), "reference")


def _runs_sql(ranked: str, name: str = "runs") -> str:
    return f"""{name} AS (SELECT query_id, coalesce(good, 0) > 0 AS hit, coalesce(round(good / retrieved, 6), 0) AS precision, coalesce(round(found / expected, 6), 0) AS recall, coalesce(round(1 / first, 6), 0) AS reciprocal_rank
  FROM (SELECT query_id, count(*) AS expected FROM truth GROUP BY 1) LEFT JOIN (
    SELECT r.query_id, count(*) AS retrieved, count(t.reference) AS good, count(DISTINCT t.reference) AS found, min(r.rank) FILTER (WHERE t.reference IS NOT NULL) AS first FROM ({ranked}) r LEFT JOIN truth t ON t.query_id = r.query_id AND t.reference = r.reference GROUP BY 1) USING (query_id))"""


def _summary_sql(runs: str) -> str:
    return f"count(*) AS questions, round(avg(hit::INT), 6) AS hit_rate, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank FROM {runs}"


def _refs(df):
    return df.select("query_id", F.col("doc_id").alias("reference"), "rank")


@query("a15_evaluate_queries", f"WITH {VECTOR_SQL}, {TRUTH_SQL}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM vec')} SELECT * FROM runs")
def a15(spark, sf):
    return ev.evaluate_queries(_refs(vec(spark, sf)), truth(spark, sf))


@query("a16_summarize_evaluation", f"WITH {VECTOR_SQL}, {TRUTH_SQL}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM vec')} SELECT {_summary_sql('runs')}")
def a16(spark, sf):
    return ev.summarize(ev.evaluate_queries(_refs(vec(spark, sf)), truth(spark, sf)))


@query("a17_compare_strategies", f"""WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL}, {TRUTH_SQL}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM vec', 'rv')}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM lex', 'rl')}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM hybrid', 'rh')}
SELECT 'vector' AS strategy, {_summary_sql('rv')} UNION ALL SELECT 'lexical', {_summary_sql('rl')} UNION ALL SELECT 'hybrid', {_summary_sql('rh')}""")
def a17(spark, sf):
    v, x = vec(spark, sf), lex(spark, sf)
    ranked = {"vector": v, "lexical": x, "hybrid": sx.weighted_fusion(v, x, K)}
    return ev.compare_strategies({n: _refs(r) for n, r in ranked.items()}, truth(spark, sf))


def _grid_sql(w: float) -> str:
    n = f"g{int(w * 10)}"
    return f"{n} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round({w}::DOUBLE * vector + {round(1 - w, 6)}::DOUBLE * lexical, 6) DESC, doc_id) AS rank FROM merged QUALIFY rank <= {K}), {_runs_sql(f'SELECT query_id, doc_id AS reference, rank FROM {n}', 'r' + n)}"


@query("a17_weight_grid", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL}, {TRUTH_SQL}, {', '.join(_grid_sql(w) for w in (0.8, 0.7, 0.6))} " + " UNION ALL ".join(f"SELECT '{w:.1f}' AS strategy, {_summary_sql(f'rg{int(w * 10)}')}" for w in (0.8, 0.7, 0.6)))
def a17b(spark, sf):
    return ev.weight_grid(vec(spark, sf), lex(spark, sf), truth(spark, sf), K)


@query("t8_run_evaluation", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL}, {TRUTH_SQL}, {_runs_sql('SELECT query_id, doc_id AS reference, rank FROM hybrid')} SELECT *, 'hybrid' AS strategy FROM runs")
def t8(spark, sf):
    ranked = sx.weighted_fusion(vec(spark, sf), lex(spark, sf), K)
    return ev.run_evaluation(_refs(ranked), truth(spark, sf), "hybrid")


@query("a20_score_ranges", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {FUSED_SQL} SELECT query_id, kind, min(score) AS low, max(score) AS high FROM (UNPIVOT (SELECT query_id, vector, lexical, combined FROM hybrid) ON vector, lexical, combined INTO NAME kind VALUE score) GROUP BY 1, 2")
def a20(spark, sf):
    return ev.score_ranges(t4(spark, sf))


@query("w1_assign_rank", f"WITH {VECTOR_SQL}, {TRUTH_SQL} SELECT v.query_id, doc_id, score, rank, t.reference IS NOT NULL AS expected FROM vec v LEFT JOIN truth t ON t.query_id = v.query_id AND t.reference = v.doc_id WHERE rank <= {K}")
def w1(spark, sf):
    return ev.assign_rank(vec(spark, sf).drop("rank"), truth(spark, sf), K).select("query_id", "doc_id", "score", *long_("rank"), "expected")


@query("w5_first_relevant_rank", f"WITH {VECTOR_SQL}, {TRUTH_SQL} SELECT v.query_id, min(rank) AS first_rank FROM vec v JOIN truth t ON t.query_id = v.query_id AND t.reference = v.doc_id GROUP BY 1")
def w5(spark, sf):
    ranked = ev.assign_rank(vec(spark, sf).drop("rank"), truth(spark, sf), 3 * K)
    return ranked.where("expected").groupBy("query_id").agg(F.min("rank").cast("long").alias("first_rank"))


@query("t12_diagnose", f"""WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {TRUTH_SQL}, b AS (SELECT *, 'vector' AS strategy FROM vec UNION ALL SELECT *, 'lexical' FROM lex)
SELECT b.query_id, doc_id, score, rank, t.reference IS NOT NULL AS expected, strategy FROM b LEFT JOIN truth t ON t.query_id = b.query_id AND t.reference = b.doc_id WHERE rank <= {K}""")
def t12(spark, sf):
    return ev.diagnose({"vector": vec(spark, sf), "lexical": lex(spark, sf)}, truth(spark, sf), K).select("query_id", "doc_id", "score", *long_("rank"), "expected", "strategy")


# questions: a benchmark item expects documents of its own number, and of a number that is not there

QUESTIONS_SQL = """q AS (SELECT item_id AS question_id, text AS question, ['DOC ' || item_id, 'DOC ' || (item_id * 7), 'DOC ' || (item_id * 50)] AS refs, CASE WHEN item_id % 4 = 0 THEN ['catechism', 'blog'] ELSE ['catechism'] END AS types FROM benchmark),
r AS (SELECT question_id, unnest(refs) AS reference, unnest([0, 1, 2]) AS pos FROM q), rd AS (SELECT r.*, d.reference IS NOT NULL AS known FROM r LEFT JOIN docs d USING (reference))"""


def questions(spark, sf):
    ref = lambda n: F.concat(F.lit("DOC "), F.col("item_id") * n)
    refs = F.array(ref(1), ref(7), ref(50))
    types = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("catechism"), F.lit("blog"))).otherwise(F.array(F.lit("catechism")))
    return ad.read(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), refs.alias("expected"), refs.alias("intended"), types.alias("expected_source_types"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"))


@query("a18_validate_questions", f"""WITH {DOCS}, {QUESTIONS_SQL} SELECT q.question_id, coalesce((SELECT array_to_string(list(reference ORDER BY reference), '|') FROM (SELECT reference FROM r WHERE r.question_id = q.question_id GROUP BY 1 HAVING count(*) > 1)), '') AS duplicates,
  coalesce((SELECT array_to_string(list(DISTINCT reference ORDER BY reference), '|') FROM rd WHERE rd.question_id = q.question_id AND NOT known), '') AS missing, CASE WHEN question_id % 4 = 0 THEN 'blog' ELSE '' END AS bad_types FROM q""")
def a18(spark, sf):
    out = ev.validate_questions(questions(spark, sf), ad.documents(spark, sf), ad.SOURCE_TYPES)
    return out.select("question_id", *[F.array_join(c, "|").alias(c) for c in ("duplicates", "missing", "bad_types")])


_COVER_SQL = f"""WITH {DOCS}, {QUESTIONS_SQL}, c AS (SELECT question_id, coalesce(string_agg(reference, '|' ORDER BY pos) FILTER (WHERE known), '') AS existing, coalesce(string_agg(reference, '|' ORDER BY pos) FILTER (WHERE NOT known), '') AS missing,
  CASE WHEN bool_and(known) THEN 'fully_covered' WHEN bool_or(known) THEN 'partially_covered' ELSE 'unavailable' END AS coverage_status FROM rd GROUP BY 1)"""


@query("j13_coverage_of_questions", _COVER_SQL + " SELECT * FROM c")
def j13(spark, sf):
    out = ev.coverage_of_questions(questions(spark, sf), ad.documents(spark, sf))
    return out.select("question_id", F.array_join("existing", "|").alias("existing"), F.array_join("missing", "|").alias("missing"), "coverage_status")


@query("a19_question_coverage", _COVER_SQL + " SELECT count(*) AS total, count(*) FILTER (WHERE coverage_status = 'fully_covered') AS fully_covered, count(*) FILTER (WHERE coverage_status = 'partially_covered') AS partially_covered, count(*) FILTER (WHERE coverage_status = 'unavailable') AS unavailable, count(*) FILTER (WHERE existing <> '') AS evaluable FROM c")
def a19(spark, sf):
    return ev.question_coverage(ev.coverage_of_questions(questions(spark, sf), ad.documents(spark, sf)))


@query("j12_expected_documents", f"WITH {DOCS}, {QUESTIONS_SQL} SELECT question_id, r.reference, d.doc_id IS NOT NULL AS exists, source_type, source_name, coalesce(length(content), 0) AS content_length FROM r LEFT JOIN docs d USING (reference)")
def j12(spark, sf):
    return ev.expected_documents(questions(spark, sf), ad.documents(spark, sf)).withColumn("content_length", F.col("content_length").cast("long"))


@query("k3_ordered_questions", "SELECT item_id AS question_id FROM benchmark WHERE item_id % 3 = 1 ORDER BY text LIMIT 5")
def k3(spark, sf):
    return ev.ordered_questions(questions(spark, sf), "c1", 5).select("question_id")


# graph


@query("j3_disconnected_nodes", f"WITH {GRAPH}, more AS (SELECT node_id FROM nodes UNION ALL SELECT 'C' || c_custkey FROM customer) SELECT node_id FROM more WHERE node_id NOT IN (SELECT source_id FROM edges) AND node_id NOT IN (SELECT target_id FROM edges)")
def j3(spark, sf):
    """Customers are nodes as well; no edge of parts and suppliers touches them."""
    nodes, edges = ad.graph(spark, sf)
    customers = ad.read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"))
    return gx.disconnected_nodes(nodes.select("node_id").unionByName(customers), edges)


@query("j4_broken_edges", f"WITH {GRAPH} SELECT * FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes) OR target_id NOT IN (SELECT node_id FROM nodes)")
def j4(spark, sf):
    return gx.broken_edges(*ad.graph(spark, sf))


@query("a12_graph_stats", f"""WITH {GRAPH}, n AS (SELECT count(*) AS nodes FROM nodes), e AS (SELECT count(*) AS edges FROM edges)
SELECT nodes, edges, (SELECT count(*) FROM (SELECT 1 FROM edges GROUP BY source_id, target_id, relationship_type HAVING count(*) > 1)) AS duplicates,
  (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes) OR target_id NOT IN (SELECT node_id FROM nodes)) AS broken,
  (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT source_id FROM edges) AND node_id NOT IN (SELECT target_id FROM edges)) AS disconnected,
  round(2 * edges / nodes, 4) AS average_degree, round(edges / (nodes * (nodes - 1)), 6) AS density FROM n, e""")
def a12(spark, sf):
    return gx.graph_stats(*ad.graph(spark, sf))


# Seeds: every node whose number is divisible by 100.
SEEDS = "(SELECT node_id FROM nodes WHERE node_id LIKE '%00')"


def seeds(spark, sf):
    nodes, _ = ad.graph(spark, sf)
    return nodes.where("node_id like '%00'").select(F.col("node_id").alias("seed"))


@query("j5_related_documents", f"""WITH {GRAPH}, t AS (SELECT source_id AS seed, target_id AS other, relationship_type, edge_id FROM edges WHERE source_id IN {SEEDS} UNION ALL SELECT target_id, source_id, relationship_type, edge_id FROM edges WHERE target_id IN {SEEDS} AND source_id <> target_id),
l AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY edge_id DESC, other) AS r FROM t QUALIFY r <= 50) SELECT seed, relationship_type, string_agg(other, '|' ORDER BY r) AS related FROM l GROUP BY 1, 2""")
def j5(spark, sf):
    return gx.related_documents(seeds(spark, sf), ad.graph(spark, sf)[1]).select("seed", "relationship_type", F.array_join("related", "|").alias("related"))


_TRAVERSE = f"""WITH {GRAPH}, e AS (SELECT source_id, target_id, relationship_type, min(edge_id) AS edge_id FROM edges GROUP BY ALL), t AS (SELECT source_id AS seed, target_id AS other, * FROM e UNION ALL SELECT target_id, source_id, * FROM e),
one AS (SELECT seed, 1 AS level, other, edge_id, source_id, target_id, relationship_type FROM t WHERE seed IN {SEEDS}), f AS (SELECT DISTINCT seed, other AS node FROM one WHERE other <> seed),
two AS (SELECT f.seed, 2 AS level, t.other, edge_id, source_id, target_id, relationship_type FROM f JOIN t ON t.seed = f.node),
met AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY seed, edge_id ORDER BY level, other) = 1),
capped AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level, edge_id) <= 100)"""


def _unique_edges(spark, sf):
    return ad.graph(spark, sf)[1].groupBy("source_id", "target_id", "relationship_type").agg(F.min("edge_id").alias("edge_id"))


@query("j6_traverse", _TRAVERSE + " SELECT seed, level::BIGINT AS level, other, edge_id FROM capped")
def j6(spark, sf):
    return gx.traverse(seeds(spark, sf), _unique_edges(spark, sf), 2).select("seed", *long_("level"), "other", "edge_id")


@query("j15_expand_graph", _TRAVERSE + """, x AS (SELECT length(seed) AS query_id, seed, substr(seed, 2)::INT AS rank, CASE WHEN source_id = seed THEN target_id ELSE source_id END AS doc_id, level, edge_id, relationship_type
  FROM met QUALIFY row_number() OVER (PARTITION BY seed ORDER BY level, edge_id) <= 30)
SELECT query_id, doc_id, 0.7::DOUBLE AS score, seed || '>' || relationship_type || '>' || doc_id AS path FROM x QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, level, edge_id) = 1""")
def j15(spark, sf):
    c = seeds(spark, sf).select(F.length("seed").alias("query_id"), F.col("seed").alias("doc_id"), F.substr("seed", F.lit(2)).cast("int").alias("rank"))
    return gx.expand_graph(c, _unique_edges(spark, sf), 2).select(*long_("query_id"), "doc_id", "score", F.array_join("path", ">").alias("path"))


@query("j16_delete_documents", f"WITH {GRAPH}, gone AS (SELECT node_id FROM nodes WHERE node_id LIKE '%7') SELECT 'edge' AS kind, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT * FROM gone) AND target_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'node', count(*) FROM nodes WHERE node_id NOT IN (SELECT * FROM gone)")
def j16(spark, sf):
    nodes, edges = ad.graph(spark, sf)
    left, ties = gx_delete(nodes, edges, nodes.where("node_id like '%7'"))
    return ties.agg(F.lit("edge").alias("kind"), F.count("*").alias("n")).union(left.agg(F.lit("node"), F.count("*")))


def gx_delete(nodes, edges, gone):
    from corpusloom.operators.documents import delete_documents

    return delete_documents(nodes, edges, gone, "node_id")


# references: a document cites one before it of its own type, and one that is not there

NAMES = {"bible_verse": "Genesis 1:", "bible_chapter": "Exodus 2:", "catechism": "CCC ", "church_father": "Father "}
KEYS = {"bible_verse": "scripture_references", "bible_chapter": "scripture_references", "catechism": "catechism_references", "church_father": "church_father_references"}
EDGES = {"bible_verse": "related_verse", "bible_chapter": "scripture_reference", "catechism": "catechism_reference", "church_father": "church_father_reference"}
_by_type = lambda names: "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
CITING_SQL = f"""cites AS (SELECT doc_id, source_type, {_by_type(NAMES)} || (doc_id - back) AS cited FROM docs, (SELECT unnest([4, -100000]) AS back)),
named AS (SELECT doc_id, {_by_type(NAMES)} || doc_id AS reference FROM docs)"""


def citing(spark, sf, back=4):
    def of(values):
        out = F.lit(None)
        for k, v in values.items():
            out = F.when(F.col("source_type") == k, v).otherwise(out)
        return out

    name, docs = of(NAMES), ad.documents(spark, sf)
    told = F.concat(F.lit('{"'), of(KEYS), F.lit('":["'), name, F.col("doc_id") - back, F.lit('","'), name, F.col("doc_id") + 100000, F.lit('"]}'))
    return docs.select("doc_id", "source_type", F.concat(name, "doc_id").alias("reference"), told.alias("metadata"))


@query("j1_resolve_references", f"WITH {DOCS}, {CITING_SQL} SELECT c.doc_id AS source_id, n.doc_id AS target_id, {_by_type(EDGES)} AS relationship_type, cited AS reference FROM cites c JOIN named n ON n.reference = cited")
def j1(spark, sf):
    return gx.resolve_references(citing(spark, sf)).select("source_id", "target_id", "relationship_type", "reference")


def cited_edges(spark, sf):
    """Edges of the documents' references, told apart by both ends: a document may cite several."""
    return gx.resolve_references(citing(spark, sf)).withColumn("edge_id", F.struct("source_id", "target_id", "relationship_type"))


RESOLVER_OF = {"bible_verse": "scripture", "bible_chapter": "scripture", "catechism": "catechism", "church_father": "church_father"}


@query("j2_orphan_references", f"WITH {DOCS}, {CITING_SQL} SELECT c.doc_id, {_by_type(RESOLVER_OF)} AS resolver, cited AS reference FROM cites c ANTI JOIN named n ON n.reference = cited WHERE NOT regexp_matches(cited, '(CCC|:) ?-')")
def j2(spark, sf):
    return gx.orphan_references(citing(spark, sf))


#: Edges of all documents as they are now.
GRAPH_SQL_OF_DOCUMENTS = f"WITH {DOCS}, {CITING_SQL} SELECT doc_id AS source_id, doc_id - CASE WHEN doc_id % 8 < 4 THEN 4 ELSE 8 END AS target_id FROM docs WHERE doc_id - CASE WHEN doc_id % 8 < 4 THEN 4 ELSE 8 END IN (SELECT doc_id FROM docs)"


@query("t9_build_graph", GRAPH_SQL_OF_DOCUMENTS)
def t9(spark, sf):
    first = gx.resolve_references(citing(spark, sf, 8))  # the references of half of the documents have changed since
    docs = citing(spark, sf)
    return gx.update_graph(first, docs, docs.where("doc_id % 8 < 4")).select("source_id", "target_id")


# the engine


@query("u1_union_candidates", f"WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, 'vector' AS stage, score FROM vec UNION ALL SELECT query_id, doc_id, 'lexical', score FROM lex")
def u1(spark, sf):
    return rt.union_candidates(rt.candidates(vec(spark, sf), "vector"), rt.candidates(lex(spark, sf), "lexical")).drop("path")


@query("a21_fuse_candidates", f"""WITH {DOCS}, {VECTOR_SQL}, {LEXICAL_SQL} SELECT query_id, doc_id, round(coalesce(0.45::DOUBLE * vec.score, 0) + coalesce(0.25::DOUBLE * lex.score, 0), 6) AS score,
  CASE WHEN vec.doc_id IS NULL THEN 'lexical' WHEN lex.doc_id IS NULL THEN 'vector' ELSE 'vector,lexical' END AS stages FROM vec FULL JOIN lex USING (query_id, doc_id)""")
def a21(spark, sf):
    rows = rt.union_candidates(rt.candidates(vec(spark, sf), "vector"), rt.candidates(lex(spark, sf), "lexical"))
    return rt.fuse_candidates(rows, rt.PROFILES["ai_answer"].weights).select("query_id", "doc_id", "score", F.array_join("stages", ",").alias("stages"))


@query("h4_analyze_queries", r"""WITH u AS (SELECT conv_id, turn, trim(text) AS q FROM conversations WHERE role = 'user'), p AS (SELECT *, contains(q, '?') OR regexp_matches(q, '(?i)^(who|what|when|where|why|how|which)\b') AS is_question, len(regexp_extract_all(q, '[A-Za-z''-]+')) <= 4 AS short FROM u)
SELECT conv_id, turn, is_question, CASE WHEN is_question AND short THEN 'mixed_query,natural_language_question,keyword_query' WHEN is_question THEN 'natural_language_question' WHEN short THEN 'keyword_query' ELSE 'natural_language' END AS intents FROM p""")
def h4(spark, sf):
    q = ad.read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return tx.analyze_queries(q).select("conv_id", "turn", "is_question", F.array_join("intents", ",").alias("intents"))


@query("h5_expand_queries", "SELECT item_id, trim('On ' || CASE item_id % 3 WHEN 0 THEN 'Grace' ELSE 'nothing' END || ' ' || item_id) || CASE item_id % 3 WHEN 0 THEN ' justification gift of God sanctifying grace Romans 5:1 CCC 1996 CCC 1997' ELSE '' END AS expanded FROM benchmark")
def h5(spark, sf):
    q = ad.read(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", F.lit("On"), F.when(F.col("item_id") % 3 == 0, F.lit("Grace")).otherwise(F.lit("nothing")), F.col("item_id").cast("string")).alias("query"))
    return tx.expand_queries(tx.analyze_queries(q)).select("item_id", F.col("expanded_query").alias("expanded"))


def _fused(spark, sf):
    rows = rt.union_candidates(rt.candidates(vec(spark, sf), "vector"), rt.candidates(lex(spark, sf), "lexical"))
    return rt.fuse_candidates(rows, rt.PROFILES["ai_answer"].weights)


RERANK_SQL = f"""{DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, fz AS (SELECT query_id, doc_id, round(coalesce(0.45::DOUBLE * vec.score, 0) + coalesce(0.25::DOUBLE * lex.score, 0), 6) AS score FROM vec FULL JOIN lex USING (query_id, doc_id)),
rr AS (SELECT query_id, doc_id, round(score + 0.05::DOUBLE * CASE source_type WHEN 'bible_chapter' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score, content FROM fz JOIN docs USING (doc_id))"""


@query("h6_rerank", f"WITH {RERANK_SQL} SELECT query_id, doc_id, score FROM rr")
def h6(spark, sf):
    analyzed = tx.analyze_queries(asks(spark, sf))
    return rt.rerank(_fused(spark, sf), ad.documents(spark, sf), analyzed, rt.PROFILES["ai_answer"].weights).select("query_id", "doc_id", "score")


_TOPIC = next(iter(tx.EXPANSIONS))


@query("h6_rerank_boosted", f"WITH {RERANK_SQL} SELECT query_id, doc_id, round(score + 0.1::DOUBLE * (query_id % 200 = 0 AND doc_id % 3 < 2)::INT, 6) AS score, (query_id % 200 = 0 AND doc_id % 3 < 2) AS boosted FROM rr")
def h6_boosted(spark, sf):
    """Half of the queries name a topic, which is a topic or the category of most documents."""
    q = asks(spark, sf).withColumn("query", F.when(F.col("query_id") % 200 == 0, F.concat(F.lit(f"On {_TOPIC.lower()} and "), F.col("query"))).otherwise(F.lit("nothing")))
    told = F.when(F.col("doc_id") % 3 == 0, F.lit(f'{{"topics":["other","{_TOPIC}"]}}')).when(F.col("doc_id") % 3 == 1, F.lit(f'{{"category":"{_TOPIC}"}}')).otherwise(F.lit("{}"))
    ranked = rt.rerank(_fused(spark, sf), ad.documents(spark, sf).withColumn("metadata", told), tx.analyze_queries(q), rt.PROFILES["ai_answer"].weights)
    return ranked.select("query_id", "doc_id", "score", F.array_contains("explanations", rt.METADATA_NOTE).alias("boosted"))


PACK_SQL = """tk AS (SELECT query_id, doc_id, score, greatest(1, ceil(len(regexp_extract_all(content, '[A-Za-z''-]+')) * 1.35::DOUBLE))::INT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS i FROM rr),
fold(query_id, i, used, ids) AS (
  SELECT query_id, 1, tokens, [doc_id] FROM tk WHERE i = 1
  UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN f.used + t.tokens <= 2500 AND len(ids) < 8 THEN f.used + t.tokens ELSE f.used END, CASE WHEN f.used + t.tokens <= 2500 AND len(ids) < 8 THEN list_append(ids, t.doc_id) ELSE ids END FROM fold f JOIN tk t ON t.query_id = f.query_id AND t.i = f.i + 1)"""


@query("w6_pack_context", f"WITH RECURSIVE {RERANK_SQL}, {PACK_SQL} SELECT query_id, unnest(ids) AS doc_id, unnest(range(len(ids))) + 1 AS position FROM fold QUALIFY i = max(i) OVER (PARTITION BY query_id)")
def w6(spark, sf):
    ranked = rt.rerank(_fused(spark, sf), ad.documents(spark, sf), tx.analyze_queries(asks(spark, sf)), rt.PROFILES["ai_answer"].weights)
    return rt.pack_context(ranked, 8, 2500).select("query_id", "doc_id", *long_("position"))


CANDIDATE_SQL = "cand AS (SELECT query_id, doc_id, max(v) AS v, max(l) AS l FROM (SELECT query_id, doc_id, score AS v, NULL::DOUBLE AS l FROM vec UNION ALL SELECT query_id, doc_id, NULL, score FROM lex) GROUP BY 1, 2)"
RETRIEVE_SQL = f"""{DOCS}, {CITING_SQL}, {VECTOR_SQL}, {LEXICAL_SQL}, {CANDIDATE_SQL}, kept AS (SELECT cand.* FROM cand JOIN docs USING (doc_id) WHERE lang = 'en'),
ties AS (SELECT c.doc_id AS source_id, n.doc_id AS target_id FROM cites c JOIN named n ON n.reference = cited),
near AS (SELECT source_id AS seed, target_id AS other FROM ties UNION SELECT target_id, source_id FROM ties),
grown AS (SELECT DISTINCT query_id, other AS doc_id, 1 AS g FROM kept JOIN near ON seed = doc_id),
fz AS (SELECT query_id, doc_id, round(coalesce(0.45::DOUBLE * v, 0) + coalesce(0.25::DOUBLE * l, 0) + coalesce(0.15::DOUBLE * 0.85::DOUBLE * g, 0), 6) AS score FROM kept FULL JOIN grown USING (query_id, doc_id)),
rr AS (SELECT query_id, doc_id, round(score + 0.05::DOUBLE * CASE source_type WHEN 'bible_chapter' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score, content FROM fz JOIN docs USING (doc_id))"""


@query("t5_retrieve", f"WITH RECURSIVE {RETRIEVE_SQL}, {PACK_SQL} SELECT query_id, unnest(ids) AS doc_id FROM fold QUALIFY i = max(i) OVER (PARTITION BY query_id)")
def t5(spark, sf):
    edges = cited_edges(spark, sf)
    return rt.retrieve(asks(spark, sf), ad.documents(spark, sf), held(spark, sf), edges, rt.PROFILES["ai_answer"], {"language": "en"}).select("query_id", "doc_id")


@query("t5_stage_counts", f"""WITH RECURSIVE {RETRIEVE_SQL}, {PACK_SQL}, packed AS (SELECT ids FROM fold QUALIFY i = max(i) OVER (PARTITION BY query_id))
SELECT 'vector' AS stage, (SELECT count(*) FROM vec) AS n UNION ALL SELECT 'lexical', (SELECT count(*) FROM lex)
UNION ALL SELECT 'filtered', (SELECT count(*) FROM (SELECT doc_id FROM vec UNION ALL SELECT doc_id FROM lex) JOIN docs USING (doc_id) WHERE lang = 'en')
UNION ALL SELECT 'graph', (SELECT count(*) FROM grown) UNION ALL SELECT 'ranked', (SELECT count(*) FROM rr) UNION ALL SELECT 'context', (SELECT sum(len(ids))::BIGINT FROM packed)""")
def t5_counts(spark, sf):
    """Rows of every stage of t5_retrieve, counted while it is written."""
    counts = rt.StageCounts()
    edges = cited_edges(spark, sf)
    found = rt.retrieve(asks(spark, sf), ad.documents(spark, sf), held(spark, sf), edges, rt.PROFILES["ai_answer"], {"language": "en"}, counts=counts)
    found.write.parquet(shared_folder(spark, "context"))
    return spark.createDataFrame(list(counts.rows().items()), "stage string, n long")  # a row for each stage


# answers


def _context(spark, sf):
    return vec(spark, sf).where(F.col("rank") <= 3).join(ad.documents(spark, sf), "doc_id")


@query("w2_build_citations", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, rank AS number FROM vec WHERE rank <= 3")
def w2(spark, sf):
    return an.build_citations(vec(spark, sf).where(F.col("rank") <= 3)).select("query_id", "doc_id", *long_("number"))


@query("a24_confidence", f"""WITH {DOCS}, {VECTOR_SQL}, s AS (SELECT query_id, avg(least(1.0::DOUBLE, score)) AS r, least(1.0::DOUBLE, count(*) / 3) AS c, avg(CASE source_type WHEN 'bible_chapter' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) AS a FROM vec JOIN docs USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, round(least(1.0::DOUBLE, 0.45::DOUBLE * r + 0.25::DOUBLE * c + 0.2::DOUBLE * a), 4) AS confidence FROM s""")
def a24(spark, sf):
    return an.confidence(_context(spark, sf)).select("query_id", "confidence")


_S = an.SYSTEM.replace("'", "''")


@query("h16_build_prompts", f"""WITH {DOCS}, {VECTOR_SQL}, b AS (SELECT query_id, string_agg('[' || rank || '] ' || reference || ' (' || source_type || ') ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM vec JOIN docs USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, md5('Question:' || chr(10) || query || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || context || chr(10) || chr(10) || 'Answer with citations:') AS prompt_md5 FROM asks JOIN b USING (query_id)""")
def h16(spark, sf):
    prompts = an.build_prompts(asks(spark, sf), an.build_citations(_context(spark, sf)))
    return prompts.select("query_id", F.md5(F.element_at("messages", -1)["content"].cast("binary")).alias("prompt_md5"))


_W = [w.replace("'", "''") for w in (an.EMPTY, an.UNCITED, an.NO_SOURCES)]


@query("h17_validate_answers", rf"""SELECT conv_id, turn, trim(text) <> '' AS valid, CASE WHEN conv_id % 3 = 0 THEN '{_W[2]}' WHEN NOT regexp_matches(text, '\[\d+\]') THEN '{_W[1]}' ELSE '' END AS warnings FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' [1]' END AS t FROM conversations WHERE role = 'assistant') s(conv_id, turn, role, raw, text)""")
def h17(spark, sf):
    return an.validate_answers(_answers(spark, sf)).select("conv_id", "turn", "valid", F.array_join("warnings", "|").alias("warnings"))


def _answers(spark, sf):
    rows = ad.read(spark, sf, "conversations").where("role = 'assistant'")
    cited = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" [1]")))
    return rows.select("conv_id", "turn", cited.alias("answer"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(2).alias("citations"))


@query("h18_score_answers", r"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS citation_coverage, CASE WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS faithfulness, CASE WHEN len(regexp_extract_all(text, '[A-Za-z''-]+')) > 12 THEN 1.0 ELSE 0.5 END::DOUBLE AS completeness FROM conversations WHERE role = 'assistant'""")
def h18(spark, sf):
    return an.score_answers(an.validate_answers(_answers(spark, sf))).select("conv_id", "turn", "citation_coverage", "faithfulness", "completeness")


_A = an.NO_EVIDENCE.replace("'", "''")
ANSWER_SQL = f"""{DOCS}, {VECTOR_SQL}, {LEXICAL_SQL}, {CANDIDATE_SQL},
rr AS (SELECT query_id, doc_id, round(coalesce(0.5::DOUBLE * v, 0) + coalesce(0.45::DOUBLE * l, 0), 6) AS score, content FROM cand JOIN docs USING (doc_id)),
{PACK_SQL.replace("2500", "2000").replace("len(ids) < 8", "len(ids) < 10")},
used AS (SELECT query_id, unnest(ids) AS doc_id FROM fold QUALIFY i = max(i) OVER (PARTITION BY query_id)),
sums AS (SELECT query_id, count(*) AS n, avg(least(1.0::DOUBLE, score)) AS r, avg(CASE source_type WHEN 'bible_chapter' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) AS a FROM used JOIN rr USING (query_id, doc_id) JOIN docs USING (doc_id) GROUP BY 1)"""


@query("t7_answer", f"""WITH RECURSIVE {ANSWER_SQL} SELECT query_id, '{_A}' AS answer, coalesce(n, 0) AS citations, true AS valid, CASE WHEN n > 0 THEN '{an.UNCITED}' ELSE '{an.NO_SOURCES}' END AS warnings,
  coalesce(round(least(1.0::DOUBLE, 0.45::DOUBLE * r + 0.25::DOUBLE * least(1.0::DOUBLE, n / 3) + 0.2::DOUBLE * a), 4), 0) AS confidence FROM asks LEFT JOIN sums USING (query_id)""")
def t7(spark, sf):
    docs, q = ad.documents(spark, sf), asks(spark, sf)
    context = rt.retrieve(q, docs, held(spark, sf), None, rt.PROFILES["search"])
    return an.answer(q, context).select("query_id", "answer", "citations", "valid", F.array_join("warnings", "|").alias("warnings"), "confidence")


_SAID = "Evidence is in [1] and [2]."


@query("t7_answer_with_provider", f"""WITH RECURSIVE {ANSWER_SQL} SELECT query_id, '{_SAID}' AS answer, 'echo' AS model, 2::BIGINT AS prompt_tokens, 6::BIGINT AS completion_tokens, coalesce(n, 0) AS citations,
  CASE WHEN n > 0 THEN '' ELSE '{an.NO_SOURCES}' END AS warnings, CASE WHEN n > 0 THEN round(least(1.0::DOUBLE, 2 / n), 4) ELSE 0 END AS citation_coverage FROM asks LEFT JOIN sums USING (query_id)""")
def t7_provided(spark, sf):
    """A provider that answers every question alike, and tells its model and token counts."""
    context = rt.retrieve(asks(spark, sf), ad.documents(spark, sf), held(spark, sf), None, rt.PROFILES["search"])
    provider = lambda batch: [an.Completion(_SAID, "echo", len(messages), len(_SAID.split())) for messages in batch]
    told = an.answer(asks(spark, sf), context, provider)
    return told.select("query_id", "answer", "model", "prompt_tokens", "completion_tokens", "citations", F.array_join("warnings", "|").alias("warnings"), "citation_coverage")


# study


@query("a13_assemble_chapters", f"WITH {VERSES} SELECT chapter, string_agg('[' || verse || '] ' || text, ' ' ORDER BY verse, text) AS content, count(*) AS verse_count FROM verses GROUP BY 1")
def a13(spark, sf):
    return st.assemble_chapters(ad.verses(spark, sf), ["chapter"]).select("chapter", "content", *long_("verse_count"))


@query("a14_chapter_items", f"""WITH {VERSES}, i AS (SELECT chapter, verse, summary, unnest(['Verse ' || verse || ': ' || summary, 'note ' || note, 'Reference: r' || verse]) AS item, unnest([0, 1, 2]) AS p FROM (SELECT chapter, verse, text AS summary, note FROM verses)),
d AS (SELECT chapter, item, min(row(verse, summary, p)) AS first FROM i GROUP BY 1, 2) SELECT chapter, count(*) AS items, md5(string_agg(item, '|' ORDER BY item)) AS items_md5 FROM d GROUP BY 1""")
def a14(spark, sf):
    rows = ad.verses(spark, sf).select("chapter", "verse", F.col("text").alias("summary"), F.concat(F.lit("note "), "note").alias("details"), F.array(F.concat(F.lit("r"), "verse")).alias("references"))
    out = st.chapter_items(rows, ["chapter"])
    return out.select("chapter", F.size("items").cast("long").alias("items"), F.md5(F.array_join(F.array_sort("items"), "|").cast("binary")).alias("items_md5"))


REQUESTS_SQL = "req AS (SELECT o_orderkey AS chapter, (o_orderkey % 9)::INT AS verse FROM orders)"


def requests(spark, sf):
    return ad.read(spark, sf, "orders").select(F.col("o_orderkey").alias("chapter"), (F.col("o_orderkey") % 9).cast("int").alias("verse"))


@query("j8_study_payload", f"""WITH {VERSES}, c AS (SELECT chapter, count(*) AS verse_count FROM verses GROUP BY 1) SELECT chapter, verse_count, (SELECT count(*) FROM verses v WHERE v.chapter = c.chapter AND v.verse % 2 = 0) AS history, (SELECT count(*) FROM verses v WHERE v.chapter = c.chapter AND v.verse > 5) AS teachings FROM c JOIN orders ON o_orderkey = chapter WHERE o_orderstatus = 'F'""")
def j8(spark, sf):
    v = ad.verses(spark, sf)
    asked = ad.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chapter"))
    out = st.study_payload(asked, v, v.where("verse % 2 = 0"), v.where("verse > 5"), ["chapter"])
    return out.select("chapter", *long_("verse_count"), F.size("history").cast("long").alias("history"), F.size("teachings").cast("long").alias("teachings"))


@query("j9_lookup_with_fallback", f"WITH {VERSES}, {REQUESTS_SQL}, e AS (SELECT chapter, verse, min(text) AS text FROM verses GROUP BY 1, 2), l AS (SELECT chapter, text FROM e QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY verse, text) = 1) SELECT req.chapter, req.verse, coalesce(e.text, l.text) AS text, e.text IS NOT NULL AS exact FROM req LEFT JOIN e USING (chapter, verse) LEFT JOIN l ON l.chapter = req.chapter")
def j9(spark, sf):
    return st.lookup_with_fallback(requests(spark, sf), ad.verses(spark, sf), ["chapter"])


@query("j10_verse_lookup", f"WITH {VERSES}, {REQUESTS_SQL} SELECT chapter, verse, min(text) AS text FROM req JOIN verses USING (chapter, verse) GROUP BY 1, 2")
def j10(spark, sf):
    return st.verse_lookup(requests(spark, sf), ad.verses(spark, sf).select("chapter", "verse", "text"), ["chapter", "verse"])


@query("w3_check_ordering", f"""WITH {VERSES}, o AS (SELECT chapter, verse, note, text, row_number() OVER (PARTITION BY chapter ORDER BY note, verse, text) AS position FROM verses)
SELECT chapter, position, concat_ws(',', CASE WHEN verse <= lag(verse) OVER (PARTITION BY chapter ORDER BY position) THEN 'order' END, CASE WHEN count(*) OVER (PARTITION BY chapter, verse) > 1 THEN 'duplicate' END) AS errors FROM o""")
def w3(spark, sf):
    from pyspark.sql import Window as W

    v = ad.verses(spark, sf).withColumn("position", F.row_number().over(W.partitionBy("chapter").orderBy("note", "verse", "text")))
    rows = v.select(F.col("chapter").alias("file"), "position", F.col("verse").alias("canonical_order"), "verse", F.lit(1).alias("chapter"), F.col("verse").cast("string").alias("reference"), "text")
    return st.check_ordering(rows).select(F.col("file").alias("chapter"), *long_("position"), F.array_join("errors", ",").alias("errors"))
