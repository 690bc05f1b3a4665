"""A Merkle manifest of a dataset, and a recursive query that ascends it from every leaf.

A row is a leaf, the SHA-256 of its columns; rows of one group (lang) make a tree, leaves by
id, and the groups' roots make the tree above, by group. Two consecutive nodes become their
hash, a last one alone becomes its own; a group of one leaf has that leaf as its root.

* Leaves are placed by one distributed sort; a group's places follow each other, so a leaf's
  number in its group is its place less the group's first. No window holds a whole group.
* Levels are built six at a time: 64 consecutive nodes are one group of a shuffle, whatever
  the size of the tree. Each node is written as a row that is linked to its ancestor at the
  end of those levels, with the siblings on the way there.
* A recursive query climbs these links from all leaves at once: each step appends the
  siblings to a proof and folds them with the hash that each leaf is claimed to have. The 64
  leaves of a lowest block climb as one row, as they share what is above it; the proof below
  follows from their hashes and is put before it at the end. A step so joins a sixty-fourth
  of the leaves' number of rows, and a tree of n leaves takes log2(n) / 6 steps.

Hashes travel as 32 bytes and are hashed as lowercase hex text. A null group sorts first, as
does a null id; rows of one id lie by their leaf hash, and equal rows next to each other.
Null columns are hashed as ``-``, all others as byte count, ``:`` and value, so a null, an
empty text and a text of ``-`` differ. Texts of any length are hashed whole. An empty table
gives no rows. Extra columns play no part. The session's limit of rows of a recursive
query (spark.sql.cteRecursionRowLimit) is lifted, as every block is a row of each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Levels that are built by one shuffle.
STRIDE = 6
#: Numbers of the tree of groups and of what is above its root.
TOP, ABOVE = -1, -2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["tree", "level", "idx", "up_tree", "up_level", "up_idx", "path", "up_hash"]


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, not for every time that it is named."""
    return F.transform(F.array(value), use)[0]


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (32 bytes) of a row's columns."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[told(c.cast("string")) for c in columns]).cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with place, their number from 0 in the given order; written to the shared folder.

    Parts are ranges of the order, and only their sizes, a row for each task, are summed up
    in one place.
    """
    at = F.monotonically_increasing_id()
    table = written(rows.orderBy(*order, F.spark_partition_id()).select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("seq")), name)
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = table.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return table.join(F.broadcast(parts), "part").withColumn("place", F.col("seq") + F.col("before")).drop("part", "seq", "before")


def levels(hashes: Column, steps: Column) -> Column:
    """Array of the levels (arrays of hex digests) from hashes on, steps levels upwards."""

    def above(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: _sha(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))

    upwards = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(upwards, F.array(hashes), lambda built, _: F.concat(built, F.array(above(F.element_at(built, -1)))))


def _path(built: Column, k: Column, stride: int) -> Column:
    """Siblings (32 bytes or null, whether on the left) of node k of the lowest level of built."""

    def beside(t: Column) -> Column:
        at = F.floor(k / F.pow(F.lit(2), t)).cast("int")
        left = at % 2 == 1
        return F.struct(F.unhex(F.get(F.get(built, t), F.when(left, at - 1).otherwise(at + 1))).alias("sibling"), left.alias("left"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(stride)), lambda t: t < F.size(built) - 1), beside)


def appended(path: Column) -> Column:
    """The siblings of path, one after the other."""
    none = F.unhex(F.lit(""))
    return F.aggregate(path, none, lambda p, step: F.concat(p, F.coalesce(step["sibling"], none)))


def climbed(path: Column, digest: Column) -> Column:
    """digest (32 bytes) folded with the siblings of path."""

    def fold(own: Column, step: Column) -> Column:
        beside = F.coalesce(_hex(step["sibling"]), F.lit(""))
        return _sha(F.when(step["left"], F.concat(beside, own)).otherwise(F.concat(own, beside)))

    return F.unhex(F.aggregate(path, _hex(digest), fold))


def blocks(nodes: DataFrame, level: int, carried: list[str], stride: int) -> DataFrame:
    """Blocks of 2**stride nodes (tree, n, top_idx, idx, hash, carried) of one level, linked upwards.

    n is the number of nodes in the tree at this level. Where it fits one block, the block's
    last node is the tree's root, which is node top_idx of the tree of groups.
    """
    row = F.struct("idx", "hash", *carried)
    found = nodes.groupBy("tree", "n", "top_idx", F.shiftright("idx", stride).alias("at")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = F.col("n") <= 1 << stride
    steps = F.when(whole, F.ceil(F.log2("n"))).otherwise(stride).cast("int")  # exact for the few sizes up to a block
    return found.select(
        "tree", F.lit(level).alias("level"), "at", "rows", whole.alias("whole"), steps.alias("steps"),
        F.when(whole, F.when(F.col("tree") == TOP, ABOVE).otherwise(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(whole, 0).otherwise(level + stride).alias("up_level"), F.when(whole, F.col("top_idx")).otherwise(F.col("at")).alias("up_idx"),
    )


def built_levels() -> Column:
    return levels(F.transform("rows", lambda r: _hex(r["hash"])), F.col("steps"))


def linked(found: DataFrame, stride: int) -> DataFrame:
    """A row for each node of the blocks: its ancestor at their end, and the siblings up to there."""

    def own(built: Column) -> Column:
        root = F.unhex(F.element_at(built, -1)[0])
        return F.transform("rows", lambda r, k: F.struct(r["idx"].alias("idx"), _path(built, k, stride).alias("path"), root.alias("up_hash")))

    kept = ["tree", "level", "whole", "up_tree", "up_level", "up_idx"]
    return found.select(*kept, F.explode(_once(built_levels(), own)).alias("r")).select(*kept, "r.idx", "r.path", "r.up_hash")


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, claimed: list[Column] | None = None, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(blocks of leaves, nodes), both written: leaves with their claimed hash, and the
    parent-linked rows of all levels that are kept above them.

    claimed are the columns that are to be verified, null for a row that claims nothing else.
    """
    other = F.lit(None).cast("binary") if claimed is None else F.when(claimed[0], leaf_hash(claimed[1:]))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf_hash([F.col(c) for c in columns]).alias("hash"), other.alias("claimed"))
    ordered = placed(hashed, [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("hash")], "leaves")
    trees = placed(ordered.groupBy("grp").agg(F.min("place").alias("tree"), F.count("*").alias("n")), [F.asc("tree")], "trees").withColumnRenamed("place", "top_idx")
    first = ordered.join(trees.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).withColumn("idx", F.col("place") - F.col("tree"))
    root = F.unhex(F.element_at(built_levels(), -1)[0])
    leaves = written(blocks(first, 0, ["doc_id", "claimed"], stride).withColumn("up_hash", root), "leaf-blocks")

    def ends(below: DataFrame, whole: bool) -> DataFrame:
        """Ends of the blocks of below: roots of whole trees, or nodes of the next level."""
        once = below if "rows" in below.columns else below.where(f"idx % {1 << stride} = 0")
        return once.where("whole" if whole else "not whole").select("tree", F.col("up_idx").alias("idx"), F.col("up_hash").alias("hash"))

    def upwards(below: DataFrame, level: int, most: int, sizes: Callable[[DataFrame, int], DataFrame]) -> list[DataFrame]:
        """Linked rows of the levels above below, the first of them at level."""
        kept = []
        while most > 1 << level:
            below = written(linked(blocks(sizes(ends(below, False), level), level, [], stride), stride), "linked-nodes")
            kept.append(below)
            level += stride
        return kept

    most = trees.agg(F.max("n").alias("n"), F.count("*").alias("trees")).first()
    if not most["trees"]:
        return leaves, linked(leaves, stride).select(*NODE)
    of_tree = lambda nodes, level: nodes.join(trees.select("tree", F.ceil(F.col("n") / (1 << level)).cast("long").alias("n"), "top_idx"), "tree")
    kept = upwards(leaves, stride, most["n"], of_tree)
    of_top = lambda nodes, level: nodes.select(F.lit(TOP).cast("long").alias("tree"), F.lit(-(-most["trees"] // (1 << level))).cast("long").alias("n"), F.lit(0).cast("long").alias("top_idx"), "idx", "hash")
    roots = ends(leaves, True)
    for k in kept:
        roots = roots.unionByName(ends(k, True))
    top = written(linked(blocks(of_top(roots, 0), 0, [], stride), stride), "linked-groups")
    kept += [top, *upwards(top, stride, most["trees"], of_top)]
    nodes = kept[0].select(*NODE)
    for k in kept[1:]:
        nodes = nodes.unionByName(k.select(*NODE))
    return leaves, nodes


#: A step: siblings are appended to the proof that the leaves of a block share, the hash that
#: each leaf is claimed to have is folded; the group's root and the root are taken along
#: where they are passed.
CLIMB = f"""
WITH RECURSIVE climb(tree, level, idx, leaves, steps, proof, subroot, root) AS (
  SELECT tree, level, idx, leaves, steps, proof, subroot, root FROM {{starts}}
  UNION ALL
  SELECT n.up_tree, n.up_level, n.up_idx, {{fold}}, c.steps, concat(c.proof, {{siblings}}),
    coalesce(c.subroot, CASE WHEN n.up_tree = {TOP} THEN n.up_hash END), CASE WHEN n.up_tree = {ABOVE} THEN n.up_hash END
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx
)
SELECT leaves AS rows, steps, proof, subroot, root FROM climb WHERE tree = {ABOVE}
"""
SIBLINGS = "aggregate(n.path, X'', (p, s) -> concat(p, coalesce(s.sibling, X'')))"
FOLD = """transform(c.leaves, x -> named_struct('doc_id', x.doc_id, 'hash', x.hash, 'folded',
  unhex(aggregate(n.path, lower(hex(x.folded)), (own, s) -> sha2(CASE WHEN s.left THEN concat(lower(hex(s.sibling)), own)
  ELSE concat(own, coalesce(lower(hex(s.sibling)), '')) END, 256)))))"""


def ascend(leaves: DataFrame, nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded) of every leaf, digests as bytes.

    proof holds the siblings from the leaf to the root, folded is the root that follows from
    the claimed hash of the leaf, or else its own.
    """
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    def first(built: Column) -> Column:
        return F.transform("rows", lambda r, k: F.struct(r["doc_id"].alias("doc_id"), r["hash"].alias("hash"), climbed(_path(built, k, stride), F.coalesce(r["claimed"], r["hash"])).alias("folded")))

    starts = leaves.select(
        F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), _once(built_levels(), first).alias("leaves"), "steps", F.unhex(F.lit("")).alias("proof"),
        F.when(F.col("up_tree") == TOP, F.col("up_hash")).alias("subroot"), F.lit(None).cast("binary").alias("root"),
    )
    ended = spark.sql(CLIMB.format(starts="{starts}", nodes="{nodes}", siblings=SIBLINGS, fold=FOLD), starts=starts, nodes=nodes)
    told = lambda built: F.transform("rows", lambda r, k: F.struct(r["doc_id"].alias("doc_id"), r["hash"].alias("leaf"), F.concat(appended(_path(built, k, stride)), "proof").alias("proof"), r["folded"].alias("folded")))
    return ended.select("subroot", "root", F.explode(_once(built_levels(), told)).alias("x")).select("x.doc_id", "x.leaf", "subroot", "root", "x.proof", "x.folded")


def tampered() -> list[Column]:
    """Whether a row is tampered with, and its columns then: n_chars is one more."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    return [hit, *[more if c == "n_chars" else F.col(c) for c in COLUMNS]]


def verified_rows(docs: DataFrame) -> DataFrame:
    """Manifest and proof of every row, and whether its tampered version is verified."""
    found = ascend(*build(docs, claimed=tampered()))
    return found.select(
        "doc_id", *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], _sha(_hex(F.col("proof"))).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


ORACLE = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS MATERIALIZED (
  SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) % 7 = 0 AS hit
  FROM documents, t
), l AS MATERIALIZED (
  SELECT doc_id, lang, leaf, coalesce(claimed, leaf) AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx FROM (
    SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
      CASE WHEN hit THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claimed FROM d)
), lower_levels(lang, level, h) AS (
  SELECT lang, 0, list(leaf ORDER BY idx) FROM l GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], ''))) FROM lower_levels WHERE len(h) > 1
), subroots AS (
  SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_idx, level AS height FROM lower_levels WHERE len(h) = 1
), upper_levels(level, h) AS (
  SELECT 0, list(subroot ORDER BY top_idx) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], ''))) FROM upper_levels WHERE len(h) > 1
), steps AS MATERIALIZED (
  SELECT l.doc_id, v.level AS step, (l.idx >> v.level) % 2 = 1 AS is_right, v.h[xor(l.idx >> v.level, 1) + 1] AS sibling FROM l JOIN lower_levels v ON l.lang IS NOT DISTINCT FROM v.lang WHERE len(v.h) > 1
  UNION ALL
  SELECT l.doc_id, s.height + v.level, (s.top_idx >> v.level) % 2 = 1, v.h[xor(s.top_idx >> v.level, 1) + 1] FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, upper_levels v WHERE len(v.h) > 1
), folds(doc_id, step, own) AS (
  SELECT doc_id, 0, claimed FROM l
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.is_right THEN s.sibling || f.own ELSE f.own || coalesce(s.sibling, '') END) FROM folds f JOIN steps s ON f.doc_id = s.doc_id AND f.step = s.step
), ended AS (
  SELECT doc_id, arg_max(own, step) AS folded_root FROM folds GROUP BY doc_id
), proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY doc_id
), r AS (SELECT h[1] AS root FROM upper_levels WHERE len(h) = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN ended e USING (doc_id) LEFT JOIN proofs p USING (doc_id), r
"""
