"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree, domain - language - source. A budget of tokens is passed down it:
at every node the children share the budget by weight, and a child whose whole subtree
has less than its share gives the rest to its siblings (water filling). What all
siblings together cannot use was never passed to their parent, so it went to the
parent's own siblings. Shortages thus move among siblings first, then among ancestors.

A leaf with n tokens can give ``max_epochs`` times n. Its share is whole epochs, then a
token-prefix of one more epoch in a seeded order (md5 of seed, epoch and id). The
prefix is found from token sums of 4096 slices of that order and then of the rows of
the one slice in which it ends, so no leaf is ever in one task however large it is.
All of it is DataFrame functions on integers.

Null sources and languages are leaves of their own (empty names). Null and empty texts
have no tokens. Rows with the same id come or go together. Rows are repeated once for
each epoch; ``epoch``, ``n_tokens`` and ``domain`` are added, replacing such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.frames import union_by

from .common import written

#: Target weights; what is not named has weight 10.
DOMAINS = {"0": 40, "1": 30, "2": 20, "3": 10}
LANGUAGES = {"en": 40, "de": 20, "fr": 20, "es": 20}
OTHER_WEIGHT = 10
SEED = "mix-1"
MAX_EPOCHS = 3
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Domain of a source: the number it ends with, modulo 4."""
    return (F.coalesce(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("0")).cast("long") % 4).cast("string")


def token_count(text: Column) -> Column:
    """Words between blanks and line ends."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \n\t\r]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes with ``share``: the parent's budget divided by weight w below capacity c."""
    order = W.partitionBy(*parent, "budget").orderBy(F.col("c") / F.col("w"), name)
    earlier, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*parent, "budget")
    zero = F.lit(0).cast("long")
    nodes = nodes.where("w > 0").withColumn("before", F.coalesce(F.sum("c").over(earlier), zero)).withColumn("rest", F.sum("w").over(onward))
    nodes = nodes.withColumn("full", F.col("c") * F.col("rest") <= F.col("w") * (F.col("budget") - F.col("before")))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), zero))
    nodes = nodes.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    return nodes.withColumn("share", F.when(F.col("full"), F.col("c")).otherwise(F.expr("(w * left) div open"))).drop("before", "rest", "full", "left", "open")


def leaf_budgets(leaves: DataFrame, numerator: int, denominator: int, max_epochs: int, domains: dict[str, int], languages: dict[str, int], sources: dict[str, int]) -> DataFrame:
    """(domain, lang, source, tokens, share) from (domain, lang, source, tokens)."""
    leaves = leaves.where("tokens > 0").withColumn("c", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("c").alias("c"))
    tops = langs.groupBy("domain").agg(F.sum("c").alias("c"))
    total = leaves.agg(F.expr(f"(sum(tokens) * {numerator}) div {denominator}").alias("budget"))
    tops = share(tops.crossJoin(F.broadcast(total)).withColumn("w", weight(F.col("domain"), domains)), [], "domain")  # total is one row
    langs = langs.join(tops.select("domain", F.col("share").alias("budget")), "domain").withColumn("w", weight(F.col("lang"), languages))
    langs = share(langs, ["domain"], "lang")
    leaves = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]).withColumn("w", weight(F.col("source"), sources))
    return share(leaves, ["domain", "lang"], "source").select(*LEAF, "tokens", "share")


def mix(
    docs: DataFrame, numerator: int = 3, denominator: int = 5, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
    domains: dict[str, int] = DOMAINS, languages: dict[str, int] = LANGUAGES, sources: dict[str, int] = {},  # noqa: B006
) -> DataFrame:
    """The rows of docs that the mixture takes, once for each epoch.

    The budget is numerator / denominator of the tokens of docs.
    """
    given = [c for c in docs.columns if c not in ("epoch", "n_tokens", "domain")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") if c.startswith("__") else F.col(f"`{c}`") for c in given])  # __ names are used here
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    leaf = {"__domain": domain_of(blank("source")), "__lang": blank("lang"), "__source": blank("source")}
    counted = docs.withColumns(leaf).withColumn("n_tokens", token_count(F.col("text")))
    named = [F.col(f"__{c}").alias(c) for c in LEAF]
    narrow = written(counted.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), *named, "n_tokens"), "mix-tokens")
    budgets = leaf_budgets(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), numerator, denominator, max_epochs, domains, languages, sources)
    budgets = written(budgets.withColumn("epochs", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")), "mix-budgets")

    key = lambda id_: F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs").cast("string"), id_).cast("binary"))
    drawn = narrow.join(budgets.select(*LEAF, "epochs", "rest"), LEAF).withColumn("key", key(F.col("id"))).withColumn("slice", F.substring("key", 1, 3))
    sums = drawn.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"), F.max("key").alias("last"))
    through = W.partitionBy(*LEAF).orderBy("slice")
    sums = written(sums.withColumn("upto", F.sum("sum").over(through)), "mix-slices")
    inside = sums.where("upto <= rest").groupBy(*LEAF).agg(F.max("last").alias("cut"))
    edge = sums.where("upto > rest and upto - sum <= rest").select(*LEAF, "slice", (F.col("upto") - F.col("sum")).alias("before"))
    # rows with equal keys count together, hence the range frame
    run = F.sum("n_tokens").over(W.partitionBy(*LEAF, "slice").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    last = drawn.join(edge, [*LEAF, "slice"]).withColumn("upto", F.col("before") + run).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    cuts = union_by(LEAF, inside, last).groupBy(*LEAF).agg(F.max("cut").alias("cut"))
    chosen = budgets.join(cuts, LEAF, "left").select(*[F.col(c).alias(f"__{c}") for c in LEAF], "epochs", F.coalesce("cut", F.lit("")).alias("cut"))
    chosen = written(chosen, "mix-cuts")

    own = key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    times = F.col("epochs") + (own <= F.col("cut")).cast("long")
    return (
        counted.join(chosen, list(leaf)).withColumn("__times", times).where("__times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
        .select(*[F.col(f"`in_{c}`").alias(c) if c.startswith("__") else F.col(f"`{c}`") for c in given], F.col("__domain").alias("domain"), "n_tokens", "epoch")
    )


def oracle(numerator: int = 3, denominator: int = 5, max_epochs: int = MAX_EPOCHS) -> str:
    """The SQL of ``mix`` with the default weights."""
    case = lambda column, weights: "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END" if weights else str(OTHER_WEIGHT)

    def level(name: str, nodes: str, parent: str, by: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_a AS (
  SELECT *, coalesce(sum(c) OVER ({part} ORDER BY c / w, {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
    sum(w) OVER ({part} ORDER BY c / w, {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_ FROM ({nodes})
), {name}_b AS (SELECT *, c * rest_ <= w * (budget - before_) AS full_ FROM {name}_a
), {name} AS (
  SELECT * EXCLUDE (before_, rest_, full_), CASE WHEN full_ THEN c ELSE (w * (budget - coalesce(sum(c) FILTER (WHERE full_) OVER ({part}), 0))) // (sum(w) FILTER (WHERE NOT full_) OVER ({part})) END::BIGINT AS share FROM {name}_b
)"""

    return f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    (coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), ''), '0')::BIGINT % 4)::VARCHAR AS domain,
    coalesce(len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')), 0)::BIGINT AS n_tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {max_epochs} AS c FROM t GROUP BY ALL HAVING sum(n_tokens) > 0
), langs AS (SELECT domain, lang, sum(c)::BIGINT AS c FROM leaf GROUP BY ALL
), tops AS (SELECT domain, sum(c)::BIGINT AS c FROM langs GROUP BY ALL
), total AS (SELECT (sum(tokens)::BIGINT * {numerator}) // {denominator} AS budget FROM leaf
),{level("top", f"SELECT *, {case('domain', DOMAINS)} AS w FROM tops, total", "", "domain")}
,{level("lng", f"SELECT langs.*, top.share AS budget, {case('lang', LANGUAGES)} AS w FROM langs JOIN top USING (domain)", "domain", "lang")}
,{level("src", f"SELECT leaf.*, lng.share AS budget, {case('source', {})} AS w FROM leaf JOIN lng USING (domain, lang)", "domain, lang", "source")}
, k AS (
  SELECT t.*, share // tokens AS epochs, share % tokens AS rest, md5('{SEED}|' || (share // tokens) || '|' || doc_id) AS key
  FROM t JOIN src USING (domain, lang, source)
), p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM p
"""


ORACLE = oracle()
