"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three letters, a
blank at word edges), most frequent first. A document's own list is compared with each
profile by the out-of-place distance: for each of the document's n-grams the difference
of the two ranks, or the profile's length where the profile lacks it. The language with
the least distance wins; the score is how far the second one is behind, 0 to 1.

Profiles are learned from a bounded sample of labelled rows: at most ``sample`` documents
a language, whole texts, drawn by a hash of id and text, so a group of copies is drawn in
its proportion. The draw comes before any shuffle. Predictions read every whole text. The
profiles that tasks get have ``size`` rows a language.

``keep_identified`` takes a text for one in an unknown language if the winning profile has
less than ``FAMILIAR`` of its n-grams; predictions name the nearest language all the same.

A text that is null or has no letters is ``und`` with score 0; so is every text when
there is nothing to learn from. A row without an id is held in; ties go to the language
that sorts first. Labels, sources and ids are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SIZE = 400
SAMPLE = 1500
UNKNOWN = "und"
#: Least share of a text's n-grams, repetitions counted, that the winning profile has for
#: the text to be in that language. Held-out rows of sf0.1 have 0.68 to 0.95; sentences in
#: Finnish, Turkish and Polish and words of random letters have 0.37 to 0.50 against
#: profiles of English, German, French and Spanish, other scripts 0.
FAMILIAR = 0.55
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, 21 bits a code point, and their counts."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words or not any(map(str.isalpha, words)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift, blank = np.uint64(21), np.uint64(32)
    two = c[:-1] << shift | c[1:]
    three = two[:-1] << shift | c[2:]
    every = np.concatenate([c[c != blank], two, three[c[1:-1] != blank]])
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(first, append=len(every))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties in order of the n-gram."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed n-gram counts of a batch's texts, by language."""
    for batch in batches:
        found: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, []).append(grams(text))
        for lang, parts in found.items():
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])


def draw(rows: DataFrame, sample: int) -> DataFrame:
    """At most sample rows (lang, text) of each language of rows (id, lang, text).

    About twice as many are drawn where they lie, and of these the first in order of the
    draw are kept, so only the sample is moved. The counts that are broadcast have one row
    for each language, fewer than the profiles that the driver gets.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    own = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = rows.withColumn("draw", own).join(F.broadcast(counts), "lang").where(F.col("draw") * F.col("rows") < 2 * sample)
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    return near.select("lang", "text", place.alias("place")).where(F.col("place") <= sample).select("lang", "text")


def learn(labelled: DataFrame, size: int = SIZE, sample: int = SAMPLE, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Profiles (lang, gram, rank) with at most size rows a language."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    drawn = draw(known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), sample)
    total = drawn.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return total.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Ranks of all profiles' n-grams by language, for lookups in a task."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), column[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the text's n-grams that its profile has."""
        keys, counts = grams(text)
        own = ranked(keys, counts, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(apart, kind="stable")
        second = apart[order[1]] if len(order) > 1 else len(own) * self.size
        places = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        shared = (self.grams[places] == keys) & (self.ranks[places, order[0]] >= 0)
        return self.langs[order[0]], float(1 - apart[order[0]] / second) if second else 0.0, float(counts[shared].sum() / counts.sum())


def predict(docs: DataFrame, profiles: DataFrame, size: int = SIZE, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and familiar. Only the profiles go to the driver and the tasks."""
    small_batches(docs.sparkSession)
    model = Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()], size)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [model.predict(t) for t in part.column(at).to_pylist()]
                added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*names, "lang_pred", "score", "familiar"])

    kept = docs.drop("lang_pred", "score", "familiar")
    if kept.columns != names:
        return predict(kept, profiles, size, text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, size: int = SIZE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; held-out rows are not learned from."""
    profiles = learn(docs.where(~held_out()), size, sample)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(wanted, profiles, size).drop("text", "familiar")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least: float = 0.0, familiar: float = FAMILIAR) -> DataFrame:
    """docs without those that are no known language: undetermined, with too few of the
    winning profile's n-grams, below the least score or, where languages are named, of
    none of them. A null lang becomes the language found."""
    profiles = learn(docs.where(~held_out()))
    found = predict(docs, profiles)
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("familiar") >= familiar) & (F.col("score") >= least)
    if languages is not None:
        keep &= F.col("lang_pred").isin(languages)
    return found.where(keep).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)
