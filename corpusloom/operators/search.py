"""Lexical, vector and hybrid search of query tables over document tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.frames import shared_folder, union_by, written
from corpusloom.functions.vectors import cosine
from . import documents as dx

# Field weights of reference and title, source name, content.
WEIGHTS = {"reference": 1.0, "title": 1.0, "source_name": 0.4, "content": 0.2}
TOKEN = "[a-z0-9à-öø-ÿ]+"
#: Tables of terms with no more rows than this are broadcast.
BROADCAST_ROWS = 100_000
#: Applied to each token of documents and queries alike, for instance a stemmer.
Normalizer = Callable[[Column], Column]


def top_k_per_query(rows: DataFrame, k: int, score: str = "score", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Best k rows of each query with their rank; ties go to the smaller doc id."""
    best = W.partitionBy(query).orderBy(F.desc(score), doc)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def over_fetch(k: int, context_limit: int = 0, multiplier: int = 3) -> int:
    return max(k, context_limit) * multiplier


# lexical


def tokens(text: Column, normalize: Normalizer | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return found if normalize is None else F.transform(found, normalize)


def build_postings(docs: DataFrame, weights: dict[str, float] = WEIGHTS, gap: int = 1_000_000, normalize: Normalizer | None = None, only: list[str] | None = None) -> DataFrame:
    """(token, doc_id, pos, weight); each field has its own range of positions.

    only, a bounded list of tokens, is looked for within the fields, so that other tokens
    never become rows.
    """

    def places(field: str, i: int, w: float) -> Column:
        told = F.transform(tokens(F.col(field), normalize), lambda t, p: F.struct(t.alias("token"), (p + F.lit(i * gap)).alias("pos"), F.lit(w).alias("weight")))
        told = told if only is None else F.filter(told, lambda x: x["token"].isin(*only))
        return F.coalesce(told, F.array().cast("array<struct<token:string,pos:int,weight:double>>"))

    every = F.concat(*[places(field, i, float(w)) for i, (field, w) in enumerate(weights.items())])
    return docs.select("doc_id", F.explode(every).alias("x")).select("x.token", "doc_id", "x.pos", "x.weight")


#: Queries with no more distinct tokens (or parts of references) than this are looked up as a
#: list that goes to every task; more are joined.
VOCABULARY = 10_000


def vocabulary(terms: DataFrame, column: str = "token") -> list[str] | None:
    """The distinct values of a column of query terms, None if they are more than VOCABULARY."""
    found = [r[0] for r in terms.select(column).where(F.col(column).isNotNull()).distinct().limit(VOCABULARY + 1).collect()]
    return sorted(found) if len(found) <= VOCABULARY else None


# parts of references

#: Characters of the parts by which a reference is looked up; shorter queries take shorter ones.
PART = 3


def parts_of(text: Column, sizes: Column | None = None) -> Column:
    """The distinct parts of up to PART characters of a lower-cased text, or those of one size."""
    low = F.lower(text)
    each = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n) if isinstance(n, int) else n))).otherwise(F.array().cast("array<string>"))
    found = each(sizes) if sizes is not None else F.concat(*[each(n) for n in range(1, PART + 1)])
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def reference_parts(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(part, doc_id, reference, source_name): an inverted file of the parts of references."""
    found = parts_of(F.col("reference"))
    return docs.select("doc_id", "reference", "source_name", F.explode(found if only is None else F.filter(found, lambda x: x.isin(*only))).alias("part"))


def query_parts(queries: DataFrame) -> DataFrame:
    """(q, part): the parts of each distinct query, all of one size."""
    q = F.lower(F.trim("query"))
    rows = queries.select(q.alias("q")).where("q <> ''").distinct()
    return rows.select("q", F.explode(parts_of(F.col("q"), F.least(F.length("q"), F.lit(PART)))).alias("part"))


def holding_reference(asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, source_name, exact) of the references that hold a query, wherever in them.

    A query is looked up by the part of it that fewest references have; what is found is
    compared with the whole query. Of the documents of one source name that hold it and
    nothing more, the first k by id are all that can rank, so a query of one character does
    not bring a row for each document.
    """
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "part").groupBy("q").agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    low = F.lower("reference")
    # a query that is one part is answered by its list, cut before it meets the queries
    lead = W.partitionBy("part", "source_name").orderBy("doc_id")
    first = parts.withColumn("r", F.row_number().over(lead)).where(F.col("r") <= k).drop("r").unionByName(parts.where(low == F.col("part")))
    short = first.join(rarest.where("q = part"), "part")
    long = parts.join(rarest.where("q <> part"), "part").where(F.contains(low, F.col("q")))
    found = short.unionByName(long).select("q", "doc_id", "source_name", (low == F.col("q")).alias("exact")).distinct()
    order = W.partitionBy("q", "source_name").orderBy("doc_id")
    return found.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) | F.col("exact")).drop("r")


class LexicalIndex:
    """Postings and parts of references, built once and written below root.

    Rows lie in buckets by a hash of their token, sorted by it, so a search reads the buckets
    of its queries' tokens and there the row groups that hold them. A token with a third of
    all rows is spread over many files. ``search`` needs no text of the corpus.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, token: str) -> Column:
        return F.pmod(F.hash(token), F.lit(self.buckets))

    def _write(self, rows: DataFrame, token: str, name: str) -> None:
        rows = rows.withColumn("bucket", self._bucket(token)).repartitionByRange("bucket", token, "doc_id").sortWithinPartitions("bucket", token, "doc_id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def build(self, docs: DataFrame, normalize: Normalizer | None = None) -> LexicalIndex:
        self._write(build_postings(docs, normalize=normalize), "token", "postings")
        self._write(reference_parts(docs), "part", "parts")
        return self

    def _read(self, name: str, token: str, only: list[str] | None, asked: DataFrame) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        if only is None:  # buckets are pruned by the join
            wanted = asked.select(token).distinct().withColumn("bucket", self._bucket(token))
            return rows.join(wanted, ["bucket", token], "left_semi").drop("bucket")
        if not only:
            return rows.limit(0).drop("bucket")
        buckets = [r[0] for r in self.spark.createDataFrame([(x,) for x in only], f"{token} string").select(self._bucket(token)).distinct().collect()]
        return rows.where(F.col("bucket").isin(*buckets) & F.col(token).isin(*only)).drop("bucket")

    def postings(self, terms: DataFrame) -> DataFrame:
        return self._read("postings", "token", vocabulary(terms), terms)

    def parts(self, asked: DataFrame) -> DataFrame:
        return self._read("parts", "part", vocabulary(asked, "part"), asked)


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, kind, term, group): bare words and phrases are wanted, -word is not.

    Terms of one group are alternatives (or); a phrase keeps its words together.
    """
    q = F.lower(F.col(query))
    pieces = F.regexp_extract_all(q, F.lit(r'-?"[^"]*"|-?[^\s"]+'), F.lit(0))
    rows = queries.select("query_id", F.posexplode(pieces).alias("pos", "piece"))
    order = W.partitionBy("query_id").orderBy("pos")
    rows = rows.withColumn("after_or", F.lag("piece").over(order) == "or")
    rows = rows.where("piece <> 'or'")
    group = F.sum(F.when(F.coalesce("after_or", F.lit(False)), 0).otherwise(1)).over(order)
    negated = F.startswith("piece", F.lit("-"))
    bare = F.regexp_replace("piece", r'^-|"', "")
    kind = F.when(negated, "not").when(F.contains("piece", F.lit('"')), "phrase").otherwise("word")
    return rows.select("query_id", kind.alias("kind"), F.trim(bare).alias("term"), group.cast("int").alias("group")).where("term <> ''")


def asked_terms(queries: DataFrame, normalize: Normalizer | None = None) -> DataFrame:
    """(query_id, t, size, alternative, term, n_terms): the alternatives of each query, t their tokens.

    term numbers the things that a document must hold, each in one of its alternatives; an
    alternative of several tokens is a phrase. term is -1 for what a document must not hold.
    """
    one = query_terms(queries).dropDuplicates(["query_id", "kind", "term"]).withColumn("t", tokens(F.col("term"), normalize)).where(F.size("t") > 0)
    asked = F.when(F.col("kind") != "not", F.col("group"))
    order = W.partitionBy("query_id", F.col("kind") == "not").orderBy("group")
    number = F.when(F.col("kind") == "not", -1).otherwise(F.dense_rank().over(order) - 1)
    n = F.size(F.collect_set(asked).over(W.partitionBy("query_id")))
    return one.select("query_id", "t", F.size("t").alias("size"), F.concat_ws(" ", "kind", "term").alias("alternative"), number.alias("term"), n.alias("n_terms"))


def search_terms(queries: DataFrame, normalize: Normalizer | None = None) -> DataFrame:
    """(query_id, token, place, size, alternative, term, n_terms): what to look up, place within the alternative."""
    return asked_terms(queries, normalize).select("*", F.posexplode("t").alias("place", "token")).drop("t")


def occurrences(queries: DataFrame, postings: DataFrame, normalize: Normalizer | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, term, pos, weight, n_terms) in the documents that match.

    A document matches if it holds every term and none that is unwanted; a query of
    unwanted terms alone matches nothing. Only documents with the term of a query that fewest
    have are looked at, so a frequent word meets no more of them than its rare companion.
    The postings are written once, as they are used three times.
    """
    terms = search_terms(queries, normalize) if terms is None else terms
    rows, longest = terms.agg(F.count("*"), F.max("size")).first()
    small = (lambda df: F.broadcast(df)) if rows <= BROADCAST_ROWS else (lambda df: df)
    postings = written(postings, "postings")
    counts = postings.groupBy("token").agg(F.count("*").alias("n"))
    priced = terms.where("term >= 0").join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    least = priced.groupBy("query_id", "term", "alternative").agg(F.min(F.struct("n", "token")).alias("x"))  # of a phrase its rarest token
    one = least.withColumn("all", F.sum("x.n").over(W.partitionBy("query_id", "term"))).withColumn("best", F.min(F.struct("all", "term")).over(W.partitionBy("query_id")))
    lead = one.where("term = best.term").select("query_id", F.col("x.token").alias("token"))
    near = postings.select("token", "doc_id").join(small(lead), "token").select("query_id", "doc_id").distinct()
    hits = near.join(small(terms), "query_id").join(postings, ["token", "doc_id"])
    spot = ["query_id", "doc_id", "term", "alternative"]
    if (longest or 1) > 1:  # all tokens of a phrase, one after the other in one field
        hits = hits.withColumn("pos", F.col("pos") - F.col("place"))
        hits = hits.groupBy(*spot, "size", "n_terms", "pos").agg(F.count_distinct("place").alias("found"), F.min("weight").alias("weight")).where("found = size")
    pair = W.partitionBy("query_id", "doc_id")  # one pass over the occurrences, without a join with themselves
    held = F.size(F.collect_set(F.when(F.col("term") >= 0, F.col("term"))).over(pair))
    told = hits.select("query_id", "doc_id", "term", "pos", "weight", "n_terms").withColumn("held", held).withColumn("bad", F.min("term").over(pair) < 0)
    return told.where("held = n_terms and not bad").drop("held", "bad")


def lexical_matches(queries: DataFrame, docs: DataFrame, normalize: Normalizer | None = None) -> DataFrame:
    """(query_id, doc_id) of the documents whose text matches, as for ``occurrences``.

    A document becomes one row with the numbers of the words and phrases asked for that it
    holds. It meets the queries by their term that fewest have and is compared in place, so
    neither places of words nor pairs of queries and documents are shuffled.
    """
    terms = written(asked_terms(queries, normalize).select("query_id", "term", "size", F.array_join("t", " ").alias("words")), "terms")
    numbers = written(terms.select("words").distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    sizes = sorted(r[0] for r in terms.select("size").distinct().collect())  # lengths of phrases
    small = (lambda df: F.broadcast(df)) if terms.count() <= BROADCAST_ROWS else (lambda df: df)
    told = docs.select("doc_id", *[F.coalesce(tokens(F.col(field), normalize), F.array().cast("array<string>")).alias(field) for field in WEIGHTS])
    # of each field its tokens, and the stretches of every length asked for
    stretches = lambda t, n: F.col(t) if n == 1 else F.transform(t, lambda x, i: F.array_join(F.slice(F.col(t), i + 1, F.lit(n)), " "))
    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *[stretches(t, n) for t in WEIGHTS for n in sizes]))
    found = told.select("doc_id", F.explode(every).alias("words")).join(small(numbers), "words")
    held = written(found.groupBy("doc_id").agg(F.collect_set("id").alias("ids")), "held")
    counts = held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    priced = terms.join(numbers, "words").join(counts, "id", "left").groupBy("query_id", "term").agg(F.collect_set("id").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    wanted = F.array_sort(F.collect_list(F.when(F.col("term") >= 0, F.struct("n", "term", "ids"))))
    asked = priced.groupBy("query_id").agg(wanted.alias("wanted"), F.max(F.when(F.col("term") < 0, F.col("ids"))).alias("unwanted")).where(F.size("wanted") > 0)
    lists = F.transform("wanted", lambda x: x["ids"])
    asked = asked.select("query_id", F.get(lists, F.lit(0)).alias("lead"), F.slice(lists, F.lit(2), F.size("wanted")).alias("rest"), "unwanted")
    near = held.select("doc_id", "ids", F.explode("ids").alias("id")).join(small(asked.select("*", F.explode("lead").alias("id"))), "id")
    once = (F.size("lead") == 1) | (F.get(F.array_intersect("lead", "ids"), F.lit(0)) == F.col("id"))  # of alternatives the first that is held
    right = F.forall("rest", lambda g: F.arrays_overlap(g, F.col("ids"))) & ~F.coalesce(F.arrays_overlap("unwanted", "ids"), F.lit(False))
    return near.where(once & right).select("query_id", "doc_id")


def cover_density(occurrences: DataFrame, most_terms: int) -> DataFrame:
    """(query_id, doc_id, rank) from (query_id, doc_id, term, pos, weight, n_terms).

    A cover is a shortest span that holds every term. It counts its occurrences divided
    by the sum of their inverse weights, less for other positions inside. At each
    occurrence the span begins at the earliest of the terms' last positions; of equal
    beginnings the first end is the shortest span.
    """
    doc = ["query_id", "doc_id"]
    order = W.partitionBy(*doc).orderBy("pos", "term")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = occurrences.withColumn("i", F.row_number().over(order)).withColumn("inverse", F.sum(1 / F.col("weight")).over(so_far))
    spot = F.struct("i", "pos", "inverse", "weight")
    last = [F.last(F.when(F.col("term") == j, spot), ignorenulls=True).over(so_far) for j in range(most_terms)]
    rows = rows.withColumn("last", F.array_compact(F.array(*last))).where(F.size("last") == F.col("n_terms"))
    rows = rows.withColumn("start", F.array_min("last"))
    first = W.partitionBy(*doc, F.col("start.i")).orderBy("i")
    covers = rows.withColumn("c", F.row_number().over(first)).where("c = 1")
    held = F.col("i") - F.col("start.i") + 1
    weighted = F.col("inverse") - F.col("start.inverse") + 1 / F.col("start.weight")
    noise = (F.col("pos") - F.col("start.pos")) - (held - 1)
    value = held / weighted / (1 + F.greatest(noise, F.lit(0)))
    return covers.groupBy(*doc).agg(F.sum(value).alias("rank"))


def filtered(docs: DataFrame, filters: dict | None) -> DataFrame:
    """docs that pass filters: source_type(s), source_name, tradition, or keys of metadata."""
    own = ("source_type", "source_types", "source_name", "tradition")
    given = filters or {}
    docs = dx.filter_source(docs, **{k: v for k, v in given.items() if k in own})
    return dx.filter_metadata(docs, **{k: v for k, v in given.items() if k not in own})


def lexical_search(queries: DataFrame, docs: DataFrame, k: int, postings: DataFrame | None = None, filters: dict | None = None, normalize: Normalizer | None = None, index: LexicalIndex | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query.

    Queries may hold "phrases", or, and -unwanted words. score = cover density + 10 if the
    reference is the query + 5 if the reference holds it + 2 if the source name holds it;
    any of these, or a match of the text, count. A reference may hold the query anywhere,
    parts of words included; an empty query is held by every one. Filters come before the
    ranking. With an index, made from docs or more, no text is read; else the fields of docs
    are searched for the queries' tokens.
    """
    docs = filtered(docs, filters)
    each = queries.select("query_id", "query")
    same = each.groupBy("query").agg(F.min("query_id").alias("first"))  # a text that is asked often is searched once
    queries = same.select(F.col("first").alias("query_id"), "query")
    terms, asked = search_terms(queries, normalize), query_parts(queries)
    if postings is None:
        postings = build_postings(docs, normalize=normalize, only=vocabulary(terms)) if index is None else index.postings(terms)
    parts = reference_parts(docs, vocabulary(asked, "part")) if index is None else index.parts(asked)
    if filters and index is not None:
        parts = parts.join(docs.select("doc_id"), "doc_id", "left_semi")
    if filters:
        postings = postings.join(docs.select("doc_id"), "doc_id", "left_semi")
    hits = occurrences(queries, postings, normalize, terms)
    q = F.lower(F.trim("query"))
    most, blank = queries.select(F.max(F.size(tokens(F.col("query")))), F.max(q == "")).first()
    pair = ["query_id", "doc_id"]
    text = cover_density(hits, most or 1)  # of one term: the sum of its weights
    contains = lambda c: F.contains(F.lower(F.col(c)), q)
    exact = F.when(F.lower("reference") == q, F.lit(10.0)).otherwise(F.lit(0.0))
    asks = queries.select("query_id", "query")
    # a source name that holds the query counts where it stands: no join by name of all that was found
    boost = F.when(contains("source_name"), F.lit(2.0)).otherwise(F.lit(0.0))
    told = text.join(docs.select("doc_id", "reference", "source_name"), "doc_id").join(asks, "query_id")
    told = told.select(*pair, (F.col("rank") + F.when(contains("reference"), exact + 5.0).otherwise(0.0) + boost).alias("score"))
    near = holding_reference(asked, parts, k).join(asks.withColumn("q", q), "q")
    near = near.select(*pair, (F.when(F.col("exact"), 15.0).otherwise(5.0) + boost).alias("score"))
    # names alone are matched against distinct values; of a name's documents the first k by id can rank
    by_name = asks.where(q != "").join(docs.select("source_name").distinct(), contains("source_name")).select("query_id", "source_name")
    first = W.partitionBy("source_name").orderBy("doc_id")
    lead = docs.select("doc_id", "source_name").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    only = lead.join(by_name, "source_name").select(*pair, F.lit(2.0).alias("score"))
    found = [told, near, only]
    if blank:  # every reference and every name holds an empty query: the same k documents are best for all of them
        whole = F.when(F.col("reference").isNotNull(), F.when(F.col("reference") == "", 15.0).otherwise(5.0)).otherwise(0.0) + F.when(F.col("source_name").isNotNull(), 2.0).otherwise(0.0)
        held = docs.select("doc_id", whole.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)
        found.append(asks.where(q == "").select("query_id").crossJoin(F.broadcast(held)))  # k rows
    # what a reference or a name gives is in the larger scores as well
    total = union_by(pair, *found).groupBy(*pair).agg(F.round(F.max("score"), 6).alias("score"))
    best = top_k_per_query(total, k).withColumnRenamed("query_id", "first")
    return best.join(each.join(same, "query").select("query_id", "first"), "first").select("query_id", "doc_id", "score", "rank")


# vectors


def _nearest(k: int, least: float | None):
    """One block of queries against one shard of vectors: the k best of each query."""
    import numpy as np
    import pandas as pd

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("doc_id", ignore_index=True)
            sizes, widths = held["vector"].map(len).to_numpy(), asked["q"].map(len).to_numpy()
            for width in np.unique(widths):  # cosine is over the shorter of two lengths
                group = asked[widths == width]
                for other in np.unique(sizes):
                    at = np.flatnonzero(sizes == other)
                    short = min(width, other)
                    q = np.stack(group["q"].to_list())[:, :short].astype(float)
                    v = np.stack(held["vector"].iloc[at].to_list())[:, :short].astype(float)
                    norm = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((v**2).sum(axis=1))
                    score = np.round(np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm > 0), 6) + 0.0
                    n = min(k, len(at))
                    enough = score >= np.partition(score, len(at) - n, axis=1)[:, [len(at) - n]]
                    if least is not None:
                        enough &= score >= least
                    row, col = np.nonzero(enough)
                    order = np.lexsort((col, -score[row, col], row))  # held is in order of ids
                    row, col = row[order], col[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[best], col[best]
                    out.append(pd.DataFrame({"query_id": group["query_id"].to_numpy()[row], "doc_id": held["doc_id"].to_numpy()[at[col]], "score": score[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    return run


def _dealt(asked: DataFrame, held: DataFrame, keys: list[str], k: int, least: float | None) -> DataFrame:
    schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id {dict(held.dtypes)['doc_id']}, score double"
    return top_k_per_query(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_nearest(k, least), schema), k)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("vector is not null and size(vector) > 0")


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, block: int = 512, shard: int = 4096, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors by cosine for each query.

    queries (query_id, vector), vectors (doc_id, vector); allowed (doc_id) limits the
    vectors before the ranking. Queries are dealt into blocks, vectors into shards of
    bounded size; a task multiplies one block with one shard and sends on only the k best
    of each query.
    """
    asked, held = _usable(queries), _usable(vectors if allowed is None else vectors.join(allowed.select("doc_id"), "doc_id", "left_semi"))
    blocks, shards = max(1, -(-asked.count() // block)), max(1, -(-held.count() // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = asked.select("query_id", F.col("vector").alias("q"), part("query_id", blocks).alias("b")).withColumn("s", every(shards))
    held = held.select("doc_id", "vector", part("doc_id", shards).alias("s")).withColumn("b", every(blocks))
    return _dealt(asked, held, ["b", "s"], k, least)


def _in_clusters(rows: DataFrame, id_col: str, centres: np.ndarray, n: int) -> DataFrame:
    """rows (id, vector) with the numbers of the n nearest centres of each; one product a batch."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            width = centres.shape[1]
            v = np.array([np.pad(np.asarray(x, float)[:width], (0, max(0, width - len(x)))) for x in frame["vector"]]).reshape(len(frame), width)
            near = np.argsort(-(np.nan_to_num(v) @ centres.T), axis=1, kind="stable")[:, :n]
            yield frame.assign(clusters=near.astype(np.int32).tolist())

    kinds = dict(rows.dtypes)
    return rows.select(id_col, "vector").mapInPandas(run, f"{id_col} {kinds[id_col]}, vector {kinds['vector']}, clusters array<int>")


class AnnIndex:
    """An inverted file of vectors, built once and written below root.

    Every vector lies in the cluster of its nearest centre, a folder of its own, with a code
    of one byte a component beside it; centres are learned from the ``sample`` vectors that
    come first by a hash of the id. A search reads the codes of the clusters that its queries
    look into, and the vectors themselves only of the best by their codes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, clusters: int = 16, sample: int = 20_000) -> AnnIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        vectors = _usable(vectors)
        drawn = vectors.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        found = [] if drawn.isEmpty() else KMeans(k=clusters, distanceMeasure="cosine", maxIter=20, seed=7).fit(drawn).clusterCenters()
        table = [(i, [float(x) for x in c / max(np.linalg.norm(c), 1e-300)]) for i, c in enumerate(found)] or [(0, [0.0])]
        self.spark.createDataFrame(table, "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")  # a row for each cluster
        largest = F.array_max(F.transform("vector", F.abs))
        code = F.transform("vector", lambda x: F.coalesce(F.round(127 * x / largest).try_cast("tinyint"), F.lit(0).cast("tinyint")))
        held = _in_clusters(vectors, "doc_id", self._centres(), 1).select("doc_id", "vector", F.when(largest > 0, code).otherwise(F.transform("vector", lambda x: F.lit(0).cast("tinyint"))).alias("code"), F.col("clusters")[0].alias("cluster"))
        held.repartition("cluster", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.mode("overwrite").partitionBy("cluster").parquet(f"{self.root}/vectors")
        return self

    def _centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.root}/centres").orderBy("cluster").collect()])

    def candidates(self, queries: DataFrame, k: int, probes: int = 12, times: int = 4, shard: int = 4096) -> DataFrame:
        """(query_id, doc_id, cluster): the times * k vectors of each query that are read,
        best by the codes of the probes nearest clusters. Large clusters are split into shards."""
        centres = self._centres()
        asked = _in_clusters(_usable(queries), "query_id", centres, min(probes, len(centres))).select("query_id", F.col("vector").alias("q"), F.explode("clusters").alias("cluster"))
        wanted = [r[0] for r in asked.select("cluster").distinct().collect()]  # numbers of clusters
        held = self.spark.read.parquet(f"{self.root}/vectors").where(F.col("cluster").isin(*wanted)).select("doc_id", F.col("code").alias("vector"), "cluster")
        sizes = F.broadcast(held.groupBy("cluster").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")))  # one row for each cluster
        held = held.join(sizes, "cluster").select("doc_id", "vector", "cluster", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int").alias("s"))
        asked = asked.join(sizes, "cluster").select("query_id", "q", "cluster", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
        return _dealt(asked, held, ["cluster", "s"], times * k, None).select("query_id", "doc_id")

    def search(self, queries: DataFrame, k: int, probes: int = 12, times: int = 4, shard: int = 4096) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best candidates by their exact cosines."""
        near = self.candidates(queries, k, probes, times, shard)
        held = self.spark.read.parquet(f"{self.root}/vectors").select("doc_id", "vector")
        rows = near.join(held, "doc_id").join(_usable(queries).select("query_id", F.col("vector").alias("q")), "query_id")
        scored = rows.select("query_id", "doc_id", F.round(cosine(F.col("q"), F.col("vector")), 6).alias("score"))
        return top_k_per_query(scored, k)


def ann_search(queries: DataFrame, vectors: DataFrame, k: int, clusters: int = 16, probes: int = 12, sample: int = 20_000, shard: int = 4096) -> DataFrame:
    """Approximate search by an index (``AnnIndex``) that is built for it in the shared folder.

    Vectors that lie in groups need few probes. Those of the test tables do not (the ten
    nearest have cosines of 0.32 to 0.42): there the codes of three quarters are read, and of
    the vectors 4 * k a query.
    """
    index = AnnIndex(queries.sparkSession, shared_folder(queries.sparkSession, "ann-index")).build(vectors, clusters, sample)
    return index.search(queries, k, probes, shard=shard)


# fusion


def normalize_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """max(0, score) / the query's maximum, all 0 where that is not positive."""
    best = F.max(score).over(W.partitionBy("query_id"))
    return rows.withColumn(score, F.when(best <= 0, 0.0).otherwise(F.round(F.greatest(F.col(score), F.lit(0.0)) / best, 6)))


def merge_rankings(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, doc_id, vector, lexical): in either list, 0 for the side that lacks it."""
    v = vector.select("query_id", "doc_id", F.col("score").alias("vector"))
    x = lexical.select("query_id", "doc_id", F.col("score").alias("lexical"))
    return v.join(x, ["query_id", "doc_id"], "full").fillna(0.0, ["vector", "lexical"])


def weighted_fusion(vector: DataFrame, lexical: DataFrame, k: int, least: float = 0.0, vector_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    merged = merge_rankings(normalize_scores(vector), normalize_scores(lexical))
    combined = F.round(vector_weight * F.col("vector") + lexical_weight * F.col("lexical"), 6)
    return top_k_per_query(merged.withColumn("combined", combined).where(F.col("combined") >= least), k, "combined")


Fusion = Callable[[DataFrame, DataFrame, int, float], DataFrame]


def hybrid_search(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, least: float = 0.0, fusion: Fusion = weighted_fusion,
    postings: DataFrame | None = None, filters: dict | None = None, normalize: Normalizer | None = None, index: LexicalIndex | None = None,
) -> DataFrame:
    """Vector and lexical search at three times the depth, fused. queries: query_id, query, vector."""
    deep = over_fetch(k)
    near = semantic_search(queries, vectors, deep, allowed=filtered(docs, filters) if filters else None)
    return fusion(near, lexical_search(queries, docs, deep, postings, filters, normalize, index), k, least)
