"""Approximate nearest neighbours by a permutation index: pivots in the order of nearness.

* Pivots are ``pivots`` (256) vectors that come first by a hash of their components; so many
  go to the driver and to every task, however large the table is. Every vector is indexed.
* A vector is represented by the order of the pivots, nearest first. The index has an
  inverted file for each pivot: the position that the pivot has in the order of each vector.
* A query looks into the files of its ``nearest`` (96) nearest pivots. The footrule distance
  of a vector is the sum, over these, of how far its position is from the query's.
* The ``width * sqrt(n)`` vectors of least distance, of n, are ranked anew by their exact
  inner products. The number that a recall asks for grows like the root: on the test tables
  0.95 takes 4.2, 4.7 and 4.8 times the root of 500, 2,000 and 10,256 vectors; width is 8.

Nearness is the largest inner product, in double precision. For the orders only, vectors are
divided by the largest norm M and get a further component sqrt(1 - |v / M| ** 2), so that a
nearer vector has a larger inner product whatever its length; queries get 0 there.

Vectors are dealt into shards by a hash; a row of the index is a shard of some 8,192 vectors
with all its pivots' files, so that a third of all rows in one place cannot be. A task
compares one block of queries with one shard and sends its best k + 1 of each query. That is
each query against all shards, in blocks: of a vector it reads 96 positions instead of its
components, which pays where a comparison is dear; inner products of few components are
cheaper done outright (see README).

Equal vectors are one entry of the index, with the first k + 1 of their rows by id, as no
more of them can be in an answer; their scores are equal to the last bit. Null and empty
vectors, zeros, those with a null or non-finite component, and rows without an id take no
part. Shorter vectors count as padded with zeros. Rows that repeat an id are queries and
candidates each of their own; a query is compared with every row but its own. Ties go to the
smaller id, then the smaller row. An empty table, or one without queries, gives no rows.
Extra columns, of whatever name, play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, written

PIVOTS, NEAREST, WIDTH = 256, 96, 8.0
BLOCK, SHARD = 4096, 8192
FOUND = "qrow long, cls long, first long, score double"


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, is_query, row) of the vectors that take part."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = F.coalesce(is_query, F.lit(False)).alias("is_query")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), asked)
    # -0.0 becomes 0.0, so that equal vectors are equal keys
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "is_query", F.monotonically_increasing_id().alias("row"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, initial=0.0)
    return largest * np.sqrt(((rows / np.where(largest > 0, largest, 1)[:, None]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Pivots:
    """Pivots, one to a row, with the further component; width is that of all vectors."""

    rows: np.ndarray
    most: float

    @staticmethod
    def of(vectors: np.ndarray, most: float) -> Pivots:
        return Pivots(Pivots._lifted(vectors, most), most)

    @staticmethod
    def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
        scaled = vectors / most
        return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))])

    def order(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Numbers of the pivots in the order of nearness to each vector."""
        near = (vectors / np.maximum(norms(vectors), 1e-300)[:, None]) @ self.rows[:, :-1].T if query else self._lifted(vectors, self.most) @ self.rows.T
        return np.argsort(-near, axis=1, kind="stable")

    def files(self, vectors: np.ndarray) -> np.ndarray:
        """The pivots' inverted files: a row for each pivot, its positions in the vectors' orders."""
        order = self.order(vectors)
        out = np.empty(order.shape, np.uint16)
        np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint16)[None, :], axis=1)
        return np.ascontiguousarray(out.T)


def footrule(files: np.ndarray, order: np.ndarray, nearest: int) -> np.ndarray:
    """Footrule distances of a shard's vectors from a query, over its nearest pivots."""
    out = np.zeros(files.shape[1], np.int32)
    apart = np.empty(files.shape[1], np.int16)
    for place, pivot in enumerate(order[:nearest].tolist()):
        np.subtract(files[pivot], place, out=apart, dtype=np.int16, casting="unsafe")
        np.abs(apart, out=apart)
        out += apart
    return out


@dataclass(frozen=True)
class PermutationIndex:
    """members: (cls, members) of equal vectors; shards: (shard, n, cls, first, vectors, files)."""

    rows: DataFrame
    members: DataFrame
    shards: DataFrame
    pivots: Pivots | None
    count: int


def build(rows: DataFrame, k: int, pivots: int = PIVOTS, shard: int = SHARD) -> PermutationIndex:
    """Index of rows (vec_id, v, is_query, row), written to the shared folder."""
    if pivots > 1 << 15:
        raise ValueError("positions are kept in 15 bits: at most 32768 pivots")
    rows = written(rows, "vectors")
    first = W.partitionBy("v").orderBy("vec_id", "row")
    able = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    member = F.struct("vec_id", "row")
    classes = able.groupBy("v").agg(F.array_sort(F.collect_list(member)).alias("members")).withColumn("cls", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    largest = F.array_max(F.transform("v", F.abs))
    norm = largest * F.sqrt(F.aggregate(F.transform("v", lambda x: (x / largest) * (x / largest)), F.lit(0.0), lambda a, x: a + x))
    count, width, most = classes.select(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    members = classes.select("cls", "members")
    schema = "shard int, n long, width int, cls binary, first binary, vectors binary, files binary"
    if not count:
        return PermutationIndex(rows, members, rows.sparkSession.createDataFrame([], schema), None, 0)
    chosen = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()  # pivots rows at most
    made = Pivots.of(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in chosen]), most)
    n_shards = max(1, math.ceil(count / shard))

    def file(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        v = matrix(table["v"], width)
        parts = [np.asarray(table["cls"], np.int64), np.asarray(table["first"], np.int64), v, made.files(v)]
        columns = [pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([len(v)], pa.int64()), pa.array([width], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
        return pa.table(columns, names=[c.split()[0] for c in schema.split(", ")])

    dealt = classes.select(F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int").alias("shard"), "cls", F.col("members")[0]["vec_id"].alias("first"), "v")
    return PermutationIndex(rows, members, written(dealt.groupBy("shard").applyInArrow(file, schema), "pivot-files"), made, count)


def _cell(k: int, made: Pivots, share: float, nearest: int):
    """One block of queries against one shard: the best k + 1 classes of each query."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and held.num_rows:
            n, width = held["n"][0].as_py(), held["width"][0].as_py()
            read = lambda c, kind: np.frombuffer(held[c][0].as_py(), kind)
            cls, first, v, files = read("cls", np.int64), read("first", np.int64), read("vectors", np.float64).reshape(n, width), read("files", np.uint16).reshape(-1, n)
            q, qrow = matrix(asked["v"], width), np.asarray(asked["row"])
            order = made.order(q, query=True)
            most = min(n, max(k + 1, math.ceil(share * n)))
            for i in range(len(q)):
                apart = footrule(files, order[i], nearest)
                near = np.argpartition(apart, most - 1)[:most] if most < n else np.arange(n)
                score = np.einsum("ij,j->i", v[near], q[i])
                best = np.lexsort((first[near], -score))[: k + 1]
                out.append((np.full(len(best), qrow[i]), cls[near[best]], first[near[best]], score[best]))
        kinds = (np.int64, np.int64, np.int64, np.float64)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in kinds]
        return pa.table(dict(zip([c.split()[0] for c in FOUND.split(", ")], columns, strict=True)))

    return run


def search(index: PermutationIndex, k: int, width: float = WIDTH, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score and query_row of the k nearest found for each query."""
    if index.pivots is None:
        return index.rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.col("row").alias("query_row"))
    asked = index.rows.where("is_query")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.select("row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = index.shards.withColumn("block", every)
    numbers = index.shards.select("shard").agg(F.max("shard")).first()[0] + 1
    dealt = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))))
    share = width * math.sqrt(index.count) / index.count
    cell = _cell(k, index.pivots, share, nearest)
    found = written(dealt.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(cell, FOUND), "nearest")
    best = W.partitionBy("qrow").orderBy(F.desc("score"), "first", "cls")
    kept = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    rows = kept.join(index.members, "cls").select("qrow", "score", F.explode("members").alias("m")).where("m.row <> qrow")
    ranked = W.partitionBy("qrow").orderBy(F.desc("score"), "m.vec_id", "m.row")
    told = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    ids = index.rows.where("is_query").select(F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"))
    return told.join(ids, "qrow").select("query_id", "rank", F.col("m.vec_id").alias("vec_id"), "score", F.col("qrow").alias("query_row"))


def nearest_found(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, nearest: int = NEAREST, width: float = WIDTH, block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """The k nearest other rows that the index finds for every row for which is_query holds."""
    index = build(usable(vectors, is_query, id_col, vector_col), k, pivots, shard)
    out = written(search(index, k, width, nearest, block), "answers")
    dropped(index.rows, index.members, index.shards)
    return out
