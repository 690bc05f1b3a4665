"""Packing token sequences into as few training sequences as possible.

Documents are tokenized once, ended by an end id and cut into pieces of at most one
sequence. How to pack depends on the lengths alone, so the plan is made on the table of
counts by length, which has at most ``capacity`` rows however large the corpus is:

* Martello-Toth reduction first: from the longest length down, a set of one or two
  pieces that provably dominates every other set with its longest piece is fixed, for
  as many pieces at once as the counts allow;
* what is left is packed best-fit decreasing, whole counts at a time.

The plan says, for each length, which ranks of its pieces go to which sequences. Spark
then ranks the pieces of a length (salted, so that one frequent length is spread) and
looks the ranks up.

Null and empty texts are one piece, the end id. Repeated rows are packed each on its
own. Columns other than id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import WordTokenizer

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows: list[tuple] = []
                ids_of = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes())))
                        if with_ids:
                            ids_of.append(cut.astype(np.int32))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Plan:
    """Bins of equal contents are kept as runs: first bin, number of bins, space used."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: v for k, v in counts.items() if v > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []
        """(length, first rank, end rank, pieces a bin, first bin, offset in the bin)"""

    def _put(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        rank = self.taken[length]
        self.intervals.append((length, rank, rank + bins * each, each, first, offset))
        self.taken[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def _new(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def reduce(self) -> None:
        """Martello-Toth: fix dominating sets, for each length from the longest down."""
        lengths = sorted(self.left)
        for x in sorted(self.left, reverse=True):
            while self.left.get(x):
                others = [k for k in lengths[: bisect.bisect_right(lengths, self.capacity - x)] if self.left.get(k, 0) > (k == x)]
                if not others:  # nothing goes with x
                    self._put(x, n := self.left[x], 1, self._new(n), 0)
                    break
                best = others[-1]
                # the smallest pieces tell how many can go with x at most
                small = [k for k in others[:3] for _ in range(min(3, self.left[k] - (k == x)))][:3]
                two = len(small) > 1 and x + small[0] + small[1] <= self.capacity
                three = len(small) > 2 and x + sum(small) <= self.capacity
                if x + best < self.capacity and two and (three or self._best_pair(others, self.capacity - x, x) > best):
                    break  # no dominating set of this size
                if best == x:
                    n = self.left[x] // 2
                    self._put(x, n, 2, self._new(n), 0)
                else:
                    n = min(self.left[x], self.left[best])
                    first = self._new(n)
                    self._put(x, n, 1, first, 0)
                    self._put(best, n, 1, first, x)

    def _best_pair(self, others: list[int], room: int, x: int) -> int:
        """Largest sum of two pieces that go with x."""
        low, high, best = 0, len(others) - 1, 0
        while low <= high:
            total = others[low] + others[high]
            if total > room or (low == high and self.left[others[low]] - (others[low] == x) < 2):
                high -= 1
                continue
            best = max(best, total)
            low += 1
        return best

    def best_fit(self) -> None:
        """Best-fit decreasing on what is left."""
        rooms: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, bins: int) -> None:
            if room and bins:
                if room not in runs:
                    runs[room] = []
                    bisect.insort(rooms, room)
                runs[room].append((first, bins))

        for x in sorted(self.left, reverse=True):
            while self.left.get(x):
                at = bisect.bisect_left(rooms, x)
                if at == len(rooms):
                    each = self.capacity // x
                    bins = max(1, self.left[x] // each)
                    each = min(each, self.left[x])
                    first = self._new(bins)
                    self._put(x, bins, each, first, 0)
                    keep(self.capacity - each * x, first, bins)
                    continue
                room = rooms[at]
                first, bins = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
                each = min(room // x, self.left[x])
                used = min(bins, self.left[x] // each)
                self._put(x, used, each, first, self.capacity - room)
                keep(room, first + used, bins - used)
                keep(room - each * x, first, used)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    out = Plan(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with the sequence and the offset that each goes to.

    with_ids adds the token ids of the piece; ``sequences`` then joins them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    run = _pieces(tokenizer_path or default_tokenizer(), capacity, end_id, with_ids)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    made = plan(counts, capacity)
    fields = "length long, low long, high long, each long, first long, base long"
    ranges = spark.createDataFrame(made.intervals, fields)
    salts = min(100_000, max(1, sum(counts.values()) // 2000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    step = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(ranges), (ranked["length"] == ranges["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .drop(ranges["length"])
        .select(
            *pieces.columns,
            (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("base") + F.pmod(step, F.col("each")) * F.col("length")).alias("offset"),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
