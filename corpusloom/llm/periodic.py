"""Runs of repeated words within a text, by recursive frequency splitting and a lag scan.

Words are the stretches between blanks (0x20, 0x09-0x0D), compared byte by byte. A run is a
stretch of words with smallest period q, of at least max(12, 2 * q) words, that no
neighbouring word extends. A text is searched in two steps, for all texts of a slice of a
batch at once:

1. Splitting. Every word of a run stands in it twice at least, as the run holds two periods.
   A word that occurs once in the current segment thus splits it; parts of fewer than 12
   words go, the others are looked at again until no word of theirs is too rare.
2. Lag scan. Two equal blocks of B words at distance q make a lag q likely, and the words
   around them are compared up to the first difference on either side. Lags from 2B to 4B
   are scanned from every B-th word only, with B doubled each time: words q apart agree over
   q words of a run at least, so over a whole block that begins at a multiple of B. Blocks
   are numbered by the numbers of their halves, so equal numbers are equal words, not equal
   hashes. A segment of n words costs some n log n steps per doubling, whatever it holds.

A lag that is a multiple of a run's period, between words of that run, finds the same
stretch and is passed over; where a stretch is found with several lags, the least is its
smallest period.

A null or empty text, or one of fewer than 12 words, has no runs; its words are kept. Rows
that repeat an id, and null ids, are rows of their own; an empty table gives an empty one.
Columns named runs or collapsed are replaced, all others are carried along. Rows are not
shuffled. A task holds an Arrow batch, a slice of about 4 MB of texts or one longer text,
and about 40 bytes for each word and doubling of the surviving segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, SLICE_BYTES = 12, 4 << 20
#: Pairs of blocks that are compared at once.
PAIRS = 1 << 22
RUNS = "array<struct<start:long,length:long,period:long>>"
BLANKS = r"[ \t\n\x0B\f\r]+"


def surviving_segments(ids: np.ndarray, docs: np.ndarray, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, segment numbers) of stable segments; ids and docs are of all words in order."""
    at, segment, done = np.arange(len(ids)), docs, []
    base = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, word, count = np.unique(segment.astype(np.int64) * base + ids[at], return_inverse=True, return_counts=True)
        often = count[word] > 1
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[~often]] = True
        stable = ~split[segment]
        if stable.any():
            done.append((at[stable], segment[stable]))
        often &= ~stable
        at, segment = at[often], segment[often]
        if len(at):
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
            segment = np.cumsum(first) - 1
            long = np.bincount(segment)[segment] >= least
            at, segment = at[long], segment[long]
    return done


class Blocks:
    """Numbers of the blocks of 1, 2, 4 ... words from each place: equal for equal blocks."""

    def __init__(self, words: np.ndarray, levels: int):
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        for j in range(levels):
            n, half = self.names[-1], 1 << j
            if len(n) <= half:
                break
            pairs = n[:-half] * (int(n.max()) + 1) + n[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        top = len(self.names) - 1
        self.steps = [top] * 8 + list(range(top - 1, -1, -1))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on are the same."""
        out = np.zeros(len(a), np.int64)
        for j in self.steps:
            n = self.names[j]
            inside = b + out < len(n)
            same = inside & (n[np.where(inside, a + out, 0)] == n[np.where(inside, b + out, 0)])
            out += same.astype(np.int64) << j
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and b are the same."""
        out = np.zeros(len(a), np.int64)
        for j in self.steps:
            n, size = self.names[j], 1 << j
            inside = a - out >= size
            same = inside & (n[np.where(inside, a - out - size, 0)] == n[np.where(inside, b - out - size, 0)])
            out += same.astype(np.int64) << j
        return out


def lag_scan(words: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, end, period) rows of the runs of words, whose segments end with words of their
    own; no segment has more than ``longest`` words."""
    levels = max(1, longest.bit_length() - 3)
    blocks = Blocks(words, levels)
    found = [np.zeros((0, 3), np.int64)]
    period, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # of a run around each word

    def told(a: np.ndarray, lag: np.ndarray) -> None:
        known = (period[a] > 0) & (lag % np.maximum(period[a], 1) == 0) & (a + lag < end[a])
        a, lag = a[~known], lag[~known]
        start, stop = a - blocks.behind(a, a + lag), a + lag + blocks.ahead(a, a + lag)
        enough = stop - start >= np.maximum(least, 2 * lag)
        runs = np.unique(np.stack([start, stop, lag], 1)[enough], axis=0)
        if len(runs):
            found.append(runs)
            sizes = runs[:, 1] - runs[:, 0]
            places = np.repeat(runs[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            ends, lags = np.repeat(runs[:, 1], sizes), np.repeat(runs[:, 2], sizes)
            wider = ends > end[places]
            end[places[wider]], period[places[wider]] = ends[wider], lags[wider]

    for j in range(1, levels + 1):
        if j >= len(blocks.names):
            break
        size, names = 1 << j, blocks.names[j]
        anchors = np.arange(0, len(names), size)
        low, lags = (1, 7) if j == 1 else (2 * size, 2 * size)
        padded = np.concatenate([names, np.full(low + lags, -1)])
        if j == 1:  # the least lags one by one, as a multiple of a lag may be among them
            for lag in range(low, low + lags):
                a = anchors[padded[anchors + lag] == names[anchors]]
                told(a, np.full(len(a), lag))
            continue
        beside = np.lib.stride_tricks.sliding_window_view(padded, lags)
        hits = []
        for part in np.array_split(anchors, max(1, len(anchors) * lags // PAIRS)):
            row, column = np.nonzero(beside[part + low] == names[part][:, None])
            hits.append((part[row], column + low))
        told(*(np.concatenate(x) for x in zip(*hits, strict=True)))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
    return runs[new]


def find_runs(ids: np.ndarray, docs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(place, length, period) rows of the runs of all texts, by place and period.

    ids tells equal words by equal numbers, docs numbers each word's text; places count the
    words of all texts.
    """
    out = [np.zeros((0, 3), np.int64)]
    for at, segment in surviving_segments(ids, docs, least):
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        sizes = np.diff(starts, append=len(at))
        grade = np.frexp(sizes)[1]  # segments of like length are scanned together
        for g in np.unique(grade):
            own = np.flatnonzero(grade == g)
            n = sizes[own] + 1  # and a word of its own after each
            begin = np.cumsum(n) - n
            spot = np.repeat(starts[own] - begin, n) + np.arange(n.sum())
            last = begin + n - 1
            words = ids[at[np.minimum(spot, len(at) - 1)]].astype(np.int64)
            words[last] = -1 - np.arange(len(own))
            runs = lag_scan(words, int(sizes[own].max()), least)
            if len(runs):
                shift = at[starts[own]] - begin
                place = runs[:, 0] + shift[np.searchsorted(begin, runs[:, 0], side="right") - 1]
                out.append(np.stack([place, runs[:, 1] - runs[:, 0], runs[:, 2]], 1))
    runs = np.concatenate(out)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text, or one row with more."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    low = 0
    while low < len(column):
        high = int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE_BYTES, side="right"))
        yield low, max(high, low + 1)
        low = max(high, low + 1)


def collapse(texts: list[bytes | None], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs (start, length, period) of each text, and its words without those that repeat a
    run's first period, joined by single blanks."""
    words = [(t or b"").split() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = pa.array([x for w in words for x in w], pa.large_binary())
    ids = np.asarray(flat.dictionary_encode().indices)
    runs = find_runs(ids, np.repeat(np.arange(len(words)), np.diff(offsets)), least)
    owner = np.searchsorted(offsets, runs[:, 0], side="right") - 1
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth)[:-1] == 0
    told: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, start, length, period in zip(owner.tolist(), (runs[:, 0] - offsets[owner]).tolist(), runs[:, 1].tolist(), runs[:, 2].tolist(), strict=True):
        told[i].append((start, length, period))
    left = [w if not r else list(compress(w, kept[offsets[i] : offsets[i + 1]].tolist())) for i, (w, r) in enumerate(zip(words, told, strict=True))]
    return told, [b" ".join(w).decode("utf-8", "replace") for w in left]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with runs (start, length, period; by start, then period) and the collapsed text
    in place of its text."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")])
    names = docs.columns
    at = names.index(text_col)
    others = [i for i in range(len(names)) if i != at]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _slices(batch.column(at)):
                part = batch.slice(low, high - low)
                runs, texts = collapse(part.column(at).cast(pa.large_binary()).to_pylist(), least)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in others], pa.array(rows, kind), pa.array(texts, pa.string())], names=[*[names[i] for i in others], "runs", "collapsed"])

    schema = T.StructType([docs.schema.fields[i] for i in others] + T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields)
    return docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by its id's CRC has its tail made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.array_remove(F.split("text", BLANKS, -1), "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), again)[0]).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    told = found.withColumn("b", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("(1000 * b.n) div (-b.p)").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
