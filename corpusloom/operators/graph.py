"""Reference graphs: resolving, upkeep, diagnostics and traversal of edge tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.frames import union_by


@dataclass(frozen=True)
class Resolver:
    """Which metadata lists to read, which references to take, where they point."""

    name: str
    keys: tuple[str, ...]
    supported: str
    target_types: tuple[str, ...]
    edge_type: str
    unless: str | None = None
    special: tuple[tuple[str, str | None, str], ...] = field(default=())
    """(source type, target type or None for any, edge type) that go before edge_type"""


# Reference patterns and edge types.
RESOLVERS = (
    Resolver("scripture", ("scripture_references", "cross_references"), r"^[1-3]?\s?[A-Za-z]+\s+\d+:\d+(?:[-–]\d+)?$", ("bible_verse", "bible_chapter"), "scripture_reference", special=(("bible_verse", "bible_verse", "related_verse"), ("church_father", None, "comments_on"))),
    Resolver("catechism", ("internal_references", "catechism_references", "cross_references"), r"^CCC\s+\d+$", ("catechism",), "catechism_reference"),
    Resolver("church_father", ("church_father_references", "cross_references"), r".", ("church_father",), "church_father_reference", unless=r"^(CCC |[1-3]?\s?[A-Za-z]+\s+\d+:\d+)"),
)


def _references(docs: DataFrame, resolver: Resolver) -> DataFrame:
    lists = [F.coalesce(F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in resolver.keys]
    rows = docs.select("doc_id", "source_type", F.explode(F.array_distinct(F.transform(F.concat(*lists), lambda x: F.trim(x)))).alias("reference"))
    keep = F.col("reference").rlike(resolver.supported)
    return rows.where(keep if resolver.unless is None else keep & ~F.col("reference").rlike(resolver.unless))


def _resolved(docs: DataFrame, targets: DataFrame, resolver: Resolver) -> DataFrame:
    """References with their target, null where there is none; of several the smallest id."""
    types = targets.where(F.col("source_type").isin(*resolver.target_types))
    index = types.groupBy(F.col("reference").alias("reference")).agg(F.min(F.struct("doc_id", "source_type")).alias("target"))
    return _references(docs, resolver).join(index, "reference", "left")


def resolve_references(docs: DataFrame, targets: DataFrame | None = None, resolvers: tuple[Resolver, ...] = RESOLVERS) -> DataFrame:
    """Edges (source_id, target_id, relationship_type, confidence, resolver, reference)."""
    out = None
    for r in resolvers:
        rows = _resolved(docs, docs if targets is None else targets, r).where(F.col("target").isNotNull() & (F.col("target.doc_id") != F.col("doc_id")))
        kind: Column = F.lit(r.edge_type)
        for source, target, name in reversed(r.special):
            rule = F.col("source_type") == source
            kind = F.when(rule if target is None else rule & (F.col("target.source_type") == target), F.lit(name)).otherwise(kind)
        part = rows.select(F.col("doc_id").alias("source_id"), F.col("target.doc_id").alias("target_id"), kind.alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit(r.name).alias("resolver"), "reference")
        out = part if out is None else out.unionByName(part)
    return out


def orphan_references(docs: DataFrame, targets: DataFrame | None = None, resolvers: tuple[Resolver, ...] = RESOLVERS) -> DataFrame:
    """(doc_id, resolver, reference) of supported references without a target."""
    out = None
    for r in resolvers:
        part = _resolved(docs, docs if targets is None else targets, r).where(F.col("target").isNull()).select("doc_id", F.lit(r.name).alias("resolver"), "reference").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def update_graph(edges: DataFrame, docs: DataFrame, selected: DataFrame | None = None, resolvers: tuple[Resolver, ...] = RESOLVERS) -> DataFrame:
    """Edges after the outgoing ones of selected documents (all by default) are built anew."""
    chosen = docs if selected is None else docs.join(selected.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = chosen.select(F.col("doc_id").alias("source_id")).distinct()
    kept = edges.join(ids, "source_id", "left_anti")
    made = resolve_references(chosen, docs, resolvers).dropDuplicates(["source_id", "target_id", "relationship_type"])
    return union_by(["source_id"], kept.select(*made.columns), made)


def without_sources(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that do not start at one of ids (doc_id), documents that are gone among them."""
    return edges.join(ids.select(F.col("doc_id").alias("source_id")).distinct(), "source_id", "left_anti")


def build_counts(before: DataFrame, after: DataFrame, orphans: DataFrame) -> DataFrame:
    key = ["source_id", "target_id", "relationship_type"]
    created = after.join(before, key, "left_anti").agg(F.count("*").alias("created"))
    removed = before.join(after, key, "left_anti").agg(F.count("*").alias("removed"))
    return created.crossJoin(removed).crossJoin(orphans.agg(F.count("*").alias("orphans")))  # one row each


def disconnected_nodes(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    ends = union_by([node], edges.select(F.col("source_id").alias(node)), edges.select(F.col("target_id").alias(node))).distinct()
    return nodes.select(node).join(ends, node, "left_anti")


def broken_edges(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """Edges that lack a source or a target."""
    known = nodes.select(F.col(node).alias("__n")).distinct()
    with_source = edges.join(known.withColumn("__s", F.lit(True)), F.col("source_id") == F.col("__n"), "left").drop("__n")
    both = with_source.join(known.withColumn("__t", F.lit(True)), F.col("target_id") == F.col("__n"), "left").drop("__n")
    return both.where("__s is null or __t is null").drop("__s", "__t")


def touching(seeds: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(seed, other, edge columns): edges at either end; a loop comes once."""
    edges = edges.where(F.col("relationship_type").isin(types)) if types else edges
    seeds = seeds.select(F.col("seed")).distinct()
    out = edges.join(seeds, F.col("source_id") == F.col("seed")).withColumn("other", F.col("target_id"))
    back = edges.where("source_id <> target_id").join(seeds, F.col("target_id") == F.col("seed")).withColumn("other", F.col("source_id"))
    return union_by(["seed"], out, back)


def related_documents(seeds: DataFrame, edges: DataFrame, types: list[str] | None = None, limit: int = 50, newest: str = "edge_id") -> DataFrame:
    """(seed, relationship_type, related): the newest edges of each seed, grouped by type."""
    order = W.partitionBy("seed").orderBy(F.desc(newest), "other")
    rows = touching(seeds, edges, types).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return rows.groupBy("seed", "relationship_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("related"))


def traverse(seeds: DataFrame, edges: DataFrame, depth: int = 1, types: list[str] | None = None, limit: int = 100, order_by: str = "edge_id") -> DataFrame:
    """(seed, level, other, edge columns): edges met breadth-first, each once for a seed.

    depth is clamped to 1 or 2; limit is the most edges of a seed, nearest first. order_by
    tells edges apart. A seed that has limit edges of its own goes no further. Of a node
    beyond, those of its first edges that can be among the limit are one list, cut before it
    meets the seeds, so a hub brings a seed no more than limit rows, however many edges it has.
    """

    def first_of(rows: DataFrame, key: str, most: int) -> DataFrame:
        """Each edge once, the first ones of each key, numbered."""
        nearest, order = W.partitionBy(key, order_by).orderBy("other"), W.partitionBy(key).orderBy(order_by)
        once = rows.withColumn("__o", F.row_number().over(nearest)).where("__o = 1").drop("__o")
        return once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)

    first = first_of(touching(seeds, edges, types), "seed", limit).withColumn("level", F.lit(1))
    met = first.drop("__n")
    if depth >= 2:
        own = W.partitionBy("seed")
        open_ = first.withColumn("__size", F.count("*").over(own)).where(F.col("__size") < limit)
        # edges between a seed and a node are the seed's own already, at most limit of them
        frontier = open_.where("other <> seed").groupBy("seed", F.col("other").alias("node")).agg(F.count("*").alias("__own"))
        nodes = frontier.select(F.col("node").alias("seed")).distinct()
        around = first_of(touching(nodes, edges, types).withColumnRenamed("seed", "node"), "node", 2 * limit)
        lists = around.groupBy("node").agg(F.collect_list(F.struct("__n", *[c for c in around.columns if c not in ("node", "__n")])).alias("__edges"))
        new = F.filter("__edges", lambda e: (e["__n"] <= F.col("__own") + limit) & (e["other"] != F.col("seed")))
        second = frontier.join(lists, "node").select("seed", F.explode(new).alias("e")).select("seed", "e.*").drop("__n")
        met = union_by(["seed"], met, second.withColumn("level", F.lit(2)))
    nearest = W.partitionBy("seed", order_by).orderBy("level", "other")
    once = met.withColumn("__o", F.row_number().over(nearest)).where("__o = 1").drop("__o")
    capped = W.partitionBy("seed").orderBy("level", order_by)
    return once.withColumn("__r", F.row_number().over(capped)).where(F.col("__r") <= limit).drop("__r")


def graph_stats(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    doubled = edges.groupBy("source_id", "target_id", "relationship_type").count().where("count > 1").agg(F.count("*").alias("duplicates"))
    broken = broken_edges(nodes, edges, node).agg(F.count("*").alias("broken"))
    alone = disconnected_nodes(nodes, edges, node).agg(F.count("*").alias("disconnected"))
    one = n.crossJoin(e).crossJoin(doubled).crossJoin(broken).crossJoin(alone)  # one row each
    degree = F.when(F.col("nodes") == 0, 0.0).otherwise(F.round(2 * F.col("edges") / F.col("nodes"), 4))
    density = F.when(F.col("nodes") < 2, 0.0).otherwise(F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6))
    return one.withColumn("average_degree", degree).withColumn("density", density)


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))


def expand_graph(candidates: DataFrame, edges: DataFrame, depth: int, types: list[str] | None = None, limit: int = 30) -> DataFrame:
    """(query_id, doc_id, score, path): what candidates lead to, each once for a query.

    candidates: (query_id, doc_id, rank). An edge that touches neither end of the
    candidate gives its source.
    """
    reached = traverse(candidates.select(F.col("doc_id").alias("seed")), edges, depth, types, limit)
    rows = candidates.select("query_id", F.col("doc_id").alias("seed"), "rank").join(reached, "seed")
    rows = rows.withColumn("doc_id", F.when(F.col("source_id") == F.col("seed"), F.col("target_id")).otherwise(F.col("source_id")))
    first = W.partitionBy("query_id", "doc_id").orderBy("rank", "level", "edge_id")
    rows = rows.withColumn("__f", F.row_number().over(first)).where("__f = 1")
    path = F.array(F.col("seed").cast("string"), F.col("relationship_type"), F.col("doc_id").cast("string"))
    return rows.select("query_id", "doc_id", F.lit(max(0.0, 1 - 0.15 * min(max(depth, 1), 2))).alias("score"), path.alias("path"))
