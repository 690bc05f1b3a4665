"""Near-duplicate documents by SetSketch registers.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Texts with
   equal sets form one class, so exact copies are carried on as a single row.
2. A class is sketched by SetSketch registers: per register the smallest of an
   exponential variable over the set, on a logarithmic scale and truncated. Registers
   of a union are the maxima, and two registers agree with about the similarity.
3. Bands of registers put classes into buckets. A few rounds link every bucket's
   members to one member of it, each round only across the components found so far;
   a last round compares every pair that still lies across components, blocks of
   members at a time. So a group of thousands of near copies costs a few rows for
   each member, and every pair that shares a bucket is looked at. Members that stay apart
   cost a number of rows that grows with the square of their bucket.
4. A pair's similarity is estimated jointly by maximum likelihood from the registers (in
   the last round then from the low bytes of 2048 more); what is more than three standard
   deviations below the threshold goes (by the normal law about one in a thousand of the pairs
   just above it), and all else is confirmed on the full sets.
5. Components come from label propagation over confirmed links; each round propagates its
   new links only, between the labels so far.

Sets hold 64-bit hashes of shingles; a word's hash has no structured collisions (see
``wordhash``). Nulls, empty texts and texts without words have an empty set and are linked
with nothing. Rows without an id take part like others: their component is the smallest id
that is reachable, null if there is none. Rows that repeat an id are each reported with the
component of their own text. Of a group of near duplicates ``without_near_duplicates``
keeps one row, even where rows repeat both id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, is_empty, small_batches, written
from .wordhash import mix, shingle_hashes, word_hashes

BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: More registers of which the low byte is kept, for a closer look at pairs in blocks.
FINE, FINE_MARGIN = 2048, 0.036
SLICE_BYTES = 1 << 20
#: Into so many parts rows of one class, or members of one bucket, are dealt for joins.
SALTS = 64
NO_ID = -(1 << 63)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an Arrow string column: first row, end row, UTF-8 bytes, offsets."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def register_coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts; a register's own do not depend on count."""
    drawn = np.random.default_rng(7919).integers(0, 1 << 32, size=(count, 2), dtype=np.uint64).astype(np.uint32)
    return drawn[:, :1] | np.uint32(1), drawn[:, 1:]


def set_sketch(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(factors), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for i in range(0, len(folded), 1024):
        block = folded[None, i : i + 1024] * factors
        block += shifts
        np.minimum(least, block.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets, from those of the sets."""
    return np.maximum(a, b)


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that name the set."""
    sums = np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)], dtype=np.uint64)
    return mix(sums + np.uint64(len(shingles))).tobytes()


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row of registers, the band's number in it."""
    rows = registers.shape[1] // bands
    parts = registers.reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(registers), 1))
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def _sketches(size: int, bands: int, rows: int, full: bool):
    """Arrow mapper: per text its class and, by full, the bands or registers and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = bands * rows
        factors, shifts = register_coefficients(coarse + (FINE if full else 0))
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                words, at = word_hashes(data, offsets)
                sets = [shingle_hashes(words[at[i] : at[i + 1]], size) for i in range(high - low)]
                filled = [i for i, s in enumerate(sets) if len(s)]
                sketch = np.zeros((len(sets), len(factors)), np.uint16)
                for i in filled:
                    sketch[i] = set_sketch(sets[i], factors, shifts)
                has = np.zeros(len(sets), bool)
                has[filled] = True
                keys = [class_key(s) if len(s) else None for s in sets]
                own = [batch.column(k).slice(low, high - low) for k in (0, 1)]
                columns = [*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())]
                if full:
                    columns.append(pa.array([r[:coarse].tobytes() for r in sketch], pa.binary()))
                    columns.append(pa.array([r[coarse:].astype(np.uint8).tobytes() for r in sketch], pa.binary()))
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                else:
                    counts = np.where(has, bands, 0)
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(sketch[has], bands).ravel())))
                names = ["id", "h", "n", "cls", "registers", "fine", "shingles"] if full else ["id", "h", "n", "cls", "bands"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers and set sizes.

    Counts of larger, smaller and equal registers have multinomial probabilities that
    depend on the similarity alone; it is found on a grid of 200 values.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = prob(u - v * grid), prob(v - u * grid)
    tiny = 1e-12
    likely = above[:, None] * np.log(np.maximum(up, tiny)) + below[:, None] * np.log(np.maximum(down, tiny)) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(grid)), likely.argmax(axis=1)]


def same_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal register bytes, less those equal by chance."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _estimates():
    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        unpack = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1)
        return pd.Series(joint_estimate(unpack(a), unpack(b), n_a.to_numpy(float), n_b.to_numpy(float)))

    return estimate


def likely_pairs(pairs: DataFrame, features: DataFrame, percent: int, margin: float) -> DataFrame:
    """Of pairs (a, b) those whose estimate is not far below the threshold."""
    light = features.select("cls", "n", "registers")
    return (
        pairs.join(light.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a")
        .join(light.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .withColumn("likely", _estimates()("r_a", "r_b", "n_a", "n_b"))
        .where(F.col("likely") >= percent / 100 - margin)
        .select("a", "b")
    )


def _blocks(bands: int, percent: int, margin: float):
    """Arrow mapper: two chunks of a bucket's members to the likely pairs across components.

    A pair that shares several buckets comes from that of its first shared band alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in batch.to_pylist():
                left = [m for m in row["members"] if m["chunk"] == row["i"]]
                right = left if row["i"] == row["j"] else [m for m in row["members"] if m["chunk"] == row["j"]]
                cls = [[m["cls"] for m in side] for side in (left, right)]
                names = {x: i for i, x in enumerate({m["label"] for side in (left, right) for m in side})}
                label = [np.array([names[m["label"]] for m in side]) for side in (left, right)]
                n = [np.array([m["n"] for m in side], float) for side in (left, right)]
                registers = [np.frombuffer(b"".join(m["registers"] for m in side), np.uint16).reshape(len(side), -1) for side in (left, right)]
                fine = [np.frombuffer(b"".join(m["fine"] for m in side), np.uint8).reshape(len(side), -1) for side in (left, right)]
                fits = 100 * np.minimum(n[0][:, None], n[1]) >= percent * np.maximum(n[0][:, None], n[1])
                fits &= label[0][:, None] != label[1]
                if row["i"] == row["j"]:
                    fits = np.triu(fits, 1)
                x, y = np.nonzero(fits)
                for low in range(0, len(x), 8192):
                    i, j = x[low : low + 8192], y[low : low + 8192]
                    a, b = registers[0][i], registers[1][j]
                    shared = (a == b).reshape(len(i), bands, -1).all(axis=2)
                    own = band_keys(registers[0][i[:1]], bands)[0] == row["bucket"]
                    first = shared.any(axis=1) & own[shared.argmax(axis=1)]
                    i, j, a, b = i[first], j[first], a[first], b[first]
                    if len(i):
                        near = joint_estimate(a, b, n[0][i], n[1][j]) >= percent / 100 - margin
                        near[near] = same_share(fine[0][i[near]], fine[1][j[near]]) >= percent / 100 - FINE_MARGIN
                        found += [(cls[0][k], cls[1][m]) for k, m in zip(i[near].tolist(), j[near].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.binary()), pa.array([max(f) for f in found], pa.binary())], names=["a", "b"])

    return run


def open_pairs(placed: DataFrame, features: DataFrame, bands: int, percent: int, margin: float, block: int) -> DataFrame:
    """All likely pairs (a, b) of bucket members that lie across components.

    placed has (bucket, cls, label) of buckets with several components. Members are dealt
    into chunks of about block; a component with so many members in a bucket has chunks of
    its own. Pairs of chunks are compared in numpy, one pair at a time, so a bucket of any
    size is many small tasks and pairs that are not likely are never rows. Chunks of one
    component are not compared with each other, so members of a large one are sent only to
    where the few others are.
    """
    own = placed.groupBy("bucket", "label").agg(F.count("*").alias("own"))
    large = F.col("own") >= block
    sizes = own.groupBy("bucket").agg(F.sum(F.when(large, 0).otherwise(F.col("own"))).alias("rest"))
    own = own.where(large)
    told = placed.join(own, ["bucket", "label"], "left").join(sizes, "bucket")
    part = F.pmod(F.xxhash64("cls", "bucket"), F.greatest(F.ceil(F.coalesce("own", "rest") / block), F.lit(1)))
    chunk = F.xxhash64(F.when(F.col("own").isNotNull(), F.col("label")).otherwise(F.lit(b"")), part)
    dealt = written(told.select("bucket", "cls", "label", chunk.alias("chunk")), "chunks")
    sums = dealt.groupBy("bucket", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = sums.select("bucket", F.col("chunk").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    cells = sums.withColumnRenamed("chunk", "i").join(other, "bucket").where("i <= j and not (low = high and low2 = high2 and low = low2)").select("bucket", "i", "j")
    asked = cells.withColumn("chunk", F.explode(F.array_distinct(F.array("i", "j"))))
    sent = dealt.join(asked, ["bucket", "chunk"]).join(features.select("cls", "n", "registers", "fine"), "cls")
    met = sent.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("chunk", "cls", "label", "n", "registers", "fine")).alias("members"))
    return met.mapInArrow(_blocks(bands, percent, margin), "a binary, b binary")


def confirmed(near: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets = features.select("cls", "n", "shingles")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return (
        near.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b")
        .where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that is reachable over links (a, b).

    Each step takes the smallest of a node's label, its neighbours' labels and its
    label's label. Tables are written in files of some hundred thousand rows, so that
    small ones cost few tasks and Spark may broadcast them, as their size allows.
    """
    files = max(1, -(-2 * links.count() // 200_000))
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).coalesce(files), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label"), F.lit(True).alias("moved")).coalesce(files), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = F.least("label", "near", "far")
        next_ = labels.drop("moved").join(seen, "node").join(jump, "label", "left").select("node", new.alias("label"), (new != F.col("label")).alias("moved"))
        next_ = written(next_.coalesce(files), "labels")
        dropped(labels)
        labels = next_
        if is_empty(labels.where("moved")):
            dropped(both)
            return labels.drop("moved")


def relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (node, label) after new links (a, b), which are propagated between labels only."""
    if labels is None:
        return components(found)
    of = lambda links, side: links.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left").withColumn(side, F.coalesce(f"{side}_label", side)).drop(f"{side}_label")
    between = of(of(found.select("a", "b"), "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    moved = components(written(between, "label-links"))
    far = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
    old = labels.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    new = moved.join(labels.select("node"), "node", "left_anti")
    return written(old.union(new), "all-labels")


def grouped_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80,
    bands: int = 32, rows: int = 6, rounds: int = 2, margin: float = 0.1, block: int = 256,
) -> DataFrame:
    """(id, h, n, first) for each row: h is a hash of the text, first the (id, h) of the
    first row of the row's group, by id with nulls last, and null for a text without words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sketches = written(docs.mapInArrow(_sketches(size, bands, rows, False), "id long, h long, n long, cls binary, bands array<long>"), "sketches")
    salt = F.pmod(F.xxhash64("id", "h"), F.lit(SALTS)).cast("int")
    spot = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = sketches.where("cls is not null").groupBy("cls").agg(F.min(spot).alias("spot"), F.first("bands").alias("bands"), F.collect_set(salt).alias("salts"))
    classes = written(classes, "classes")

    # members: classes that share a bucket with another class
    keyed = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("bucket")
    members = written(keyed.join(shared, "bucket", "left_semi").withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")), "members")
    known = lambda id_: F.coalesce(id_, F.lit(NO_ID))
    chosen = classes.join(members, "cls", "left_semi").select(known(F.col("spot.id")).alias("key"), F.col("spot.h").alias("h")).distinct()
    read = docs.withColumn("key", known(F.col("id"))).join(chosen, ["key", "h"], "left_semi").select("id", "h", "text")
    features = read.mapInArrow(_sketches(size, bands, rows, True), "id long, h long, n long, cls binary, registers binary, fine binary, shingles array<long>")
    features = written(features.where("cls is not null").drop("id", "h").dropDuplicates(["cls"]), "features")

    labels = None  # (node, label) of classes that have a link
    made = [sketches, classes, members, features]
    for round_ in range(rounds + 1):
        if labels is None:
            placed = members.withColumn("label", F.col("cls"))
        else:
            placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        open_ = placed.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.collect_set("part").alias("parts"),
            F.min(F.struct(F.xxhash64("cls", F.lit(round_)).alias("draw"), "cls", "label")).alias("centre"),
        ).where("low <> high")
        # a bucket's members meet its centre in several parts
        centres = open_.select("bucket", "centre", F.explode("parts").alias("part"))
        if round_ < rounds:
            pairs = placed.join(centres, ["bucket", "part"]).where("label <> centre.label").select(F.least("cls", "centre.cls").alias("a"), F.greatest("cls", "centre.cls").alias("b"))
            near = likely_pairs(pairs.distinct(), features, percent, margin)
        else:
            left = placed.join(centres.drop("centre"), ["bucket", "part"]).select("bucket", "cls", "label")
            near = open_pairs(left, features, bands, percent, margin, block)
        found = written(confirmed(near, features, percent), "found")
        made.append(found)
        if not is_empty(found):
            labels = relabelled(labels, found)
            made.append(labels)
    reach = classes.select("cls", "spot", "salts")
    if labels is not None:
        reach = reach.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        first = reach.groupBy("label").agg(F.min("spot").alias("first"))
        reach = reach.join(first, "label").select("cls", F.col("first").alias("spot"), "salts")
    reach = reach.select("cls", F.explode("salts").alias("salt"), F.struct("spot.id", "spot.h").alias("first"))
    # rows of one class lie in several parts; those without a set match nothing and are spread
    told = sketches.select("id", "h", "n", "cls").withColumn("salt", salt).join(reach, ["cls", "salt"], "left").select("id", "h", "n", "first")
    told = written(told, "groups")
    dropped(*made)
    return told


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80, **options) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept.

    size is the words of a shingle, percent the least similarity. With 32 bands of 6
    registers (the options ``bands`` and ``rows``) a pair at 0.8 shares a bucket with
    probability 0.9999. ``margin`` is more than three standard deviations of the estimate
    from 192 registers at 0.8.
    """
    found = grouped_rows(docs, id_col, text_col, size, percent, **options)
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest id.

    Rows are told apart by id and text, so of rows that share an id only those go whose own
    text repeats another. Of rows that repeat both, one stays, that of the smallest hash of
    its columns. Rows without words all stay.
    """
    found = grouped_rows(docs, id_col, text_col, size, percent, **options)
    key = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("__key")
    counted = found.where("first is not null").select(key, F.col("h").alias("__h"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("__stays"))
    told = counted.groupBy("__key", "__h").agg(F.max("__stays").alias("__stays"), F.count("*").alias("__n")).where("not __stays or __n > 1")
    keyed = docs.withColumns({"__key": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__h": F.xxhash64(text_col)})
    alone = keyed.join(told, ["__key", "__h"], "left_anti").select(*docs.columns)
    again = keyed.join(told.where("__stays").select("__key", "__h"), ["__key", "__h"], "left_semi")
    one = again.groupBy("__key", "__h").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return alone.unionByName(one.select("__row.*"))
