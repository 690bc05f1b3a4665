"""Exact top-k search by the three-phase uniform threshold algorithm.

The dimensions are split into parts, and a part gives each query one list of local scores:
a vector's score is the sum of its entries in all lists. Lists are held apart: a task has
one part of the dimensions of one block of queries and one shard of vectors.

1. The lists send their best entries, twenty times k of a part, at most five times k of a
   shard. The vectors that they name get their remaining scores from the other lists, and
   the k-th best whole score is a cutoff that is safe, as k vectors reach it. (Bounds from
   the least entries of the other lists, which spare that step, are useless for scores of
   either sign: half of all entries passed.)
2. Each list gets the cutoffs t of its queries and sends the entries of at least t / parts.
   A score that reaches t has such an entry in some list, so these are sufficient.
3. A vector that some lists named has its remaining scores asked for, from those lists
   only, unless they cannot lift it to the cutoff. Sums of all parts are exact.

A list sends its entries of a query as one row, and the lists of a block and a shard are put
together in one task, which sends on what reaches the cutoff: rows grow with the queries times
the shards, not with the entries.

Components are floor(scale * x), scores integers. Vectors that are null or hold a null or
non-finite component take no part; shorter vectors count as padded with zeros, and an
empty vector scores 0. Ties go to the smaller id, then to the smaller row. Rows are told
apart by place, not by id: rows that repeat an id are queries and candidates each of their
own, and a query is compared with every row but its own. Rows without an id take no part.
Products of components of 2**20 and more are computed in whole numbers of any size, and
parts are summed in them too. What a long cannot hold, a part's score or the whole, counts
as the largest (or least) long, so ranks stay right and only such scores are cut.

Of rows with equal vectors only the first k + 1 can be in an answer, so a vector with a
third of all rows brings no more than those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 2
LARGE, MOST = 2.0**20, (1 << 63) - 1
#: A cutoff below every score.
NONE = -(1 << 63)
#: What a list sends of a query, or is asked for: vectors with their local scores.
ENTRIES = "block int, shard int, part int, qrow long, t long, vrows array<long>, scores array<long>"
ASKED = "block int, shard int, part int, qrow long, t long, asked array<long>"
#: Best entries that the lists of a part send first, in multiples of k, and most of them that one shard sends.
FIRST, FIRST_OF_SHARD = 20, 5


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Components:
    """Integer components of many vectors; those of vectors with large ones are kept apart."""

    def __init__(self, raw: np.ndarray, scale: float):
        with np.errstate(over="ignore"):
            whole = np.floor(scale * raw)
        large = ~(np.abs(whole) < LARGE).all(axis=1) if raw.size else np.zeros(len(raw), bool)
        self.small, self.large, self.raw, self.scale = np.where(large[:, None], 0.0, whole), np.flatnonzero(large), raw, scale

    def whole(self, row: int) -> list[int]:
        return [math.floor(self.scale * x) if abs(x) < 2.0**53 else math.floor(self.scale) * int(x) for x in self.raw[row].tolist()]


def _product(a: list[int], b: list[int]) -> int:
    return max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b, strict=True))))


def local_scores(q: Components, low: int, high: int, v: Components) -> np.ndarray:
    """Exact local scores (int64) of the queries from low to high with every vector."""
    out = (q.small[low:high] @ v.small.T).astype(np.int64)
    for i in q.large[(q.large >= low) & (q.large < high)].tolist():
        own = q.whole(i)
        out[i - low] = [_product(own, v.whole(j)) for j in range(len(v.raw))]
    for j in v.large.tolist():
        own = v.whole(j)
        out[:, j] = [_product(q.whole(i), own) for i in range(low, high)]
    return out


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    lists = table[name].combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.int64), np.diff(np.asarray(lists.offsets)).astype(np.int64)


def _lists(schema: str, key, part: int, qrow: np.ndarray, t: np.ndarray, index: np.ndarray, *values: np.ndarray) -> pa.Table:
    """A row for each query of which there is a value; index, ascending, tells the query of each."""
    sizes = np.bincount(index, minlength=len(qrow))
    some = np.flatnonzero(sizes)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]), pa.int32())
    fixed = [pa.array(np.full(len(some), x), pa.int32()) for x in (key[0].as_py(), key[1].as_py(), part)]
    columns = [*fixed, pa.array(qrow[some], pa.int64()), pa.array(t[some], pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in values]]
    return pa.table(dict(zip([c.split()[0] for c in schema.split(", ")], columns, strict=True)))


def _entries(k: int, scale: float, phase: int, parts: int, shards: int):
    """One list (of a block, a shard and a part): what it sends in a phase."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        qrow, t = np.asarray(queries["qrow"], np.int64), np.asarray(queries["t"], np.int64)
        if queries.num_rows and vectors.num_rows:
            width = max(int(np.diff(np.asarray(c.combine_chunks().offsets)).max()) for c in (queries["q"], vectors["v"]))
            q, v = (Components(_matrix(c, width), scale) for c in (queries["q"], vectors["v"]))
            vrow = np.asarray(vectors["vrow"], np.int64)
            places = np.argsort(vrow)
            for low in range(0, len(qrow), 128):  # bounds the memory of the lists
                high = min(low + 128, len(qrow))
                if phase == 3:
                    asked, sizes = _flat(queries.slice(low, high - low), "asked")
                    rows = np.repeat(np.arange(high - low), sizes)
                    at = places[np.searchsorted(vrow[places], asked)]
                    score = np.einsum("ij,ij->i", q.small[low + rows], v.small[at]).astype(np.int64)
                    odd = np.flatnonzero(np.isin(low + rows, q.large) | np.isin(at, v.large))
                    score[odd] = [_product(q.whole(low + rows[o]), v.whole(at[o])) for o in odd.tolist()]
                else:
                    local = local_scores(q, low, high, v)
                    if phase == 2:
                        cutoff = -(-t[low:high] // parts)
                        wanted = (local >= cutoff[:, None]) | (t[low:high] == NONE)[:, None]
                    else:
                        wanted = np.zeros(local.shape, bool)
                        n = min(FIRST_OF_SHARD * k, math.ceil(FIRST * k / shards)) + 1  # one more, as the query's own row may be among them
                        n = min(n, len(vrow))
                        wanted[np.arange(high - low)[:, None], np.argpartition(-local, n - 1, axis=1)[:, :n]] = True
                    rows, at = np.nonzero(wanted & (vrow[None, :] != qrow[low:high, None]))
                    score = local[rows, at]
                out.append((low + rows, vrow[at], score))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return _lists(ENTRIES, key, key[2].as_py(), qrow, t, *found)

    return run


class Pairs:
    """Queries and vectors that some lists named: the sum of the known scores, and which parts are known."""

    def __init__(self, parts: int, *tables: pa.Table):
        qrow, t, part, vrow, score = ([] for _ in range(5))
        for table in tables:
            values, sizes = _flat(table, "vrows")
            for column, name in ((qrow, "qrow"), (t, "t"), (part, "part")):
                column.append(np.repeat(np.asarray(table[name], np.int64), sizes))
            vrow.append(values)
            score.append(_flat(table, "scores")[0])
        qrow, t, part, vrow, score = map(np.concatenate, (qrow, t, part, vrow, score))
        order = np.lexsort((vrow, qrow))
        qrow, t, part, vrow, score = (x[order] for x in (qrow, t, part, vrow, score))
        first = np.flatnonzero(np.concatenate([[True], (qrow[1:] != qrow[:-1]) | (vrow[1:] != vrow[:-1])])) if len(qrow) else np.zeros(0, int)
        bound = (1 << 61) // parts
        if len(score) and (np.abs(score).max() > bound or np.abs(t[t != NONE]).max(initial=0) > bound):
            score, t = score.astype(object), t.astype(object)  # whole numbers of any size
        self.parts, self.qrow, self.vrow, self.t = parts, qrow[first], vrow[first], t[first]
        self.known = np.add.reduceat(score, first) if len(first) else score
        self.missing = parts - np.add.reduceat(np.ones(len(part), int), first) if len(first) else part
        self.has = [np.add.reduceat((part == p).astype(int), first) > 0 if len(first) else part > 0 for p in range(parts)]
        self.open = np.asarray(self.t == NONE, bool)


def _asks(parts: int):
    """The vectors of which a list is asked for the scores that are missing, unless those cannot lift them to the cutoff."""

    def run(key: tuple[pa.Scalar, ...], entries: pa.Table) -> pa.Table:
        x = Pairs(parts, entries)
        cutoff = -(-x.t // parts)
        able = x.open | np.asarray(x.known + x.missing * (cutoff - 1) >= x.t, bool) if len(x.t) else x.open
        qrow, at, index = np.unique(x.qrow, return_index=True, return_inverse=True)
        t = x.t[at].astype(np.int64)
        return pa.concat_tables([_lists(ASKED, key, p, qrow, t, index[pick], x.vrow[pick]) for p in range(parts) for pick in [able & ~x.has[p]]])

    return run


def _best(k: int, parts: int):
    """The k best whole scores of each query in a shard; what a long cannot hold counts as the largest or NONE."""

    def run(key, entries: pa.Table, answers: pa.Table) -> pa.Table:
        x = Pairs(parts, entries, answers)
        score = np.array([max(NONE, min(MOST, s)) for s in x.known.tolist()], np.int64) if x.known.dtype == object else x.known
        order = np.lexsort((-np.maximum(score, -MOST), x.qrow))
        qrow, score = x.qrow[order], score[order]
        kept = np.arange(len(qrow)) - np.searchsorted(qrow, qrow) < k
        return pa.table({"qrow": pa.array(qrow[kept], pa.int64()), "score": pa.array(score[kept], pa.int64())})

    return run


def _reaching(parts: int):
    """The vectors whose whole score reaches the cutoff, the score in two longs."""

    def run(key, entries: pa.Table, answers: pa.Table) -> pa.Table:
        x = Pairs(parts, entries, answers)
        kept = (x.missing == 0) & (x.open | np.asarray(x.known >= x.t, bool))
        known = x.known[kept]
        return pa.table({"qrow": pa.array(x.qrow[kept], pa.int64()), "vrow": pa.array(x.vrow[kept], pa.int64()), "high": pa.array((known // (1 << 32)).astype(np.int64), pa.int64()), "low": pa.array((known % (1 << 32)).astype(np.int64), pa.int64())})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, block: int = 4096, shard: int = 8192, parts: int = PARTS,
) -> DataFrame:
    """The k best other rows for every row for which is_query holds.

    block and shard bound the queries and vectors that one task holds. The result has
    query_id, rank, vec_id, score and query_row, which tells queries of one id apart.
    """
    from .common import dropped, written

    usable = vectors.withColumn("__is_query", F.coalesce(is_query, F.lit(False)))
    columns = usable_vectors(usable, id_col, vector_col).columns
    flagged = usable.where("__is_query")
    rows = usable_vectors(usable.where("not __is_query"), id_col, vector_col).withColumn("is_query", F.lit(False))
    rows = rows.unionByName(usable_vectors(flagged, id_col, vector_col).withColumn("is_query", F.lit(True)))
    rows = written(rows.select(*columns, "is_query", F.monotonically_increasing_id().alias("row")), "vectors")
    total, asked, width = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v"))).first()
    shards, blocks = max(1, math.ceil(total / shard)), max(1, math.ceil(asked / block))
    edges = [round(p * (width or 0) / parts) for p in range(parts + 1)]
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pieces = lambda v: F.posexplode(F.array(*[F.slice(v, a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]))
    first = W.partitionBy("v").orderBy("vec_id", "row")
    able = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    held = able.select(F.col("row").alias("vrow"), spread(shards).alias("shard"), pieces(F.col("v")).alias("part", "v")).withColumn("block", every(blocks))
    queries = rows.where("is_query").select(F.col("row").alias("qrow"), spread(blocks).alias("block"), pieces(F.col("v")).alias("part", "q")).withColumn("shard", every(shards))

    made = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    def lists(asking: DataFrame, phase: int, name: str) -> DataFrame:
        names, extra = ["block", "shard", "part"], {"t": F.lit(NONE).cast("long"), "asked": F.array().cast("array<bigint>")}
        whole = asking.withColumns({c: x for c, x in extra.items() if c not in asking.columns})
        return kept(whole.groupBy(*names).cogroup(held.groupBy(*names)).applyInArrow(_entries(k, scale, phase, parts, shards), ENTRIES), name)

    def resolved(entries: DataFrame, name: str, task: Callable, schema: str) -> DataFrame:
        """What a task makes of the entries of a block and a shard and of the missing scores, which the lists are asked for."""
        ask = entries.groupBy("block", "shard").applyInArrow(_asks(parts), ASKED)
        answers = lists(queries.join(ask, ["block", "shard", "part", "qrow"]), 3, f"{name}-remaining")
        return entries.groupBy("block", "shard").cogroup(answers.groupBy("block", "shard")).applyInArrow(task, schema)

    best = lambda by: W.partitionBy("qrow").orderBy(*by)
    first_scores = resolved(lists(queries, 1, "best-entries"), "best", _best(k, parts), "qrow long, score long")
    ranked = first_scores.withColumn("n", F.row_number().over(best([F.desc("score")]))).where(F.col("n") <= k)
    # fewer than k vectors in all: every entry is wanted
    cutoffs = kept(ranked.groupBy("qrow").agg(F.when(F.count("*") >= k, F.min("score")).alias("t")).where("t is not null"), "cutoffs")

    bounded = queries.join(cutoffs, "qrow", "left").withColumn("t", F.coalesce("t", F.lit(NONE).cast("long")))
    scored = resolved(lists(bounded, 2, "sufficient-entries"), "sufficient", _reaching(parts), "qrow long, vrow long, high long, low long")
    scored = scored.withColumn("score", F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low"))
    label = lambda row, id_: rows.select(F.col("row").alias(row), F.col("vec_id").alias(id_))
    told = scored.select("qrow", "vrow", "score").join(label("vrow", "vec_id"), "vrow")
    ordered = told.withColumn("rank", F.row_number().over(best([F.desc("score"), "vec_id", "vrow"]))).where(F.col("rank") <= k)
    out = ordered.join(label("qrow", "query_id"), "qrow").select("query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit(MOST)), F.lit(-MOST)).cast("long").alias("score"), F.col("qrow").alias("query_row"))
    out = written(out, "answers")
    dropped(rows, *made)
    return out
