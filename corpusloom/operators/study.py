"""Chapters, context and lookups by composite key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_chapters(verses: DataFrame, keys: list[str], verse: str = "verse", text: str = "text", references: str | None = None) -> DataFrame:
    """One row a chapter: content "[n] text ...", verse_count, verses; references if there are any."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(verse).alias("verse"), F.col(text).alias("text"))))
    content = F.array_join(F.transform("verses", lambda v: F.concat(F.lit("["), v["verse"].cast("string"), F.lit("] "), v["text"])), " ")
    aggregates = [rows.alias("verses")]
    if references:
        lists = F.array_sort(F.collect_list(F.struct(F.col(verse).alias("verse"), F.coalesce(references, F.array().cast("array<string>")).alias("r"))))
        aggregates.append(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["r"]))).alias("references"))
    out = verses.groupBy(*keys).agg(*aggregates)
    return out.withColumn("content", content).withColumn("verse_count", F.size("verses"))


def chapter_items(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items): "Verse n: summary", details and references in order, without repeats.

    rows: keys, verse, summary, details, references.
    """
    own = F.array_compact(F.concat(
        F.array(F.concat(F.lit("Verse "), F.col("verse").cast("string"), F.lit(": "), F.col("summary")), F.col("details")),
        F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.concat(F.lit("Reference: "), r)),
    ))
    ordered = F.array_sort(F.collect_list(F.struct("verse", own.alias("own"))))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["own"]))).alias("items"))


def verse_lookup(requests: DataFrame, verses: DataFrame, keys: list[str], loose: list[str] | None = None) -> DataFrame:
    """Rows of verses at the requested keys; keys in loose may be null in a request, then
    the row that sorts first by them is taken."""
    loose = loose or []
    strict = [k for k in keys if k not in loose]
    right = verses.select(*[F.col(c).alias(f"__{c}") for c in verses.columns])
    rule = F.lit(True)
    for k in strict:
        rule = rule & (F.col(k) == F.col(f"__{k}"))
    for k in loose:
        rule = rule & (F.col(k).isNull() | (F.col(k) == F.col(f"__{k}")))
    rest = [c for c in verses.columns if c not in keys]
    hit = requests.join(right, rule)
    first = F.min(F.struct(*[F.col(f"__{k}") for k in loose], *[F.col(f"__{c}") for c in rest]))
    found = hit.groupBy(*requests.columns).agg(first.alias("__f"))
    return found.select(*requests.columns, *[F.col(f"__f.__{c}").alias(c) for c in rest])


def lookup_with_fallback(requests: DataFrame, rows: DataFrame, chapter: list[str], verse: str = "verse", value: str = "text") -> DataFrame:
    """requests with value of the exact verse, or else of the chapter's lowest verse, and exact."""
    exact = rows.groupBy(*chapter, verse).agg(F.min(value).alias("__exact"))
    lowest = rows.groupBy(*chapter).agg(F.min(F.struct(F.col(verse).alias("v"), F.col(value).alias("x"))).alias("__low"))
    out = requests.join(exact, [*chapter, verse], "left").join(lowest, chapter, "left")
    return out.select(*requests.columns, F.coalesce("__exact", "__low.x").alias(value), F.col("__exact").isNotNull().alias("exact"))


def study_payload(requests: DataFrame, verses: DataFrame, history: DataFrame, teachings: DataFrame, chapter: list[str]) -> DataFrame:
    """Chapter verses with history and teachings; chapters without verses are left out,
    missing context is an empty list."""
    chapters = assemble_chapters(verses, chapter)
    listed = lambda df, name: df.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias(name))
    out = requests.join(chapters, chapter).join(listed(history, "history"), chapter, "left").join(listed(teachings, "teachings"), chapter, "left")
    none = F.array().cast("array<struct<verse:int,text:string>>")
    return out.withColumns({c: F.coalesce(F.col(c).cast("array<struct<verse:int,text:string>>"), none) for c in ("history", "teachings")})


def check_ordering(verses: DataFrame, file: str = "file", position: str = "position") -> DataFrame:
    """verses (file, position, canonical_order, verse, chapter, reference, text) with the names of broken rules."""
    from pyspark.sql import Window as W

    order = W.partitionBy(file).orderBy(position)
    same = W.partitionBy(file, "reference")
    bad = F.array_compact(F.array(
        F.when((F.col("chapter") < 1) | (F.col("verse") < 1), F.lit("bad_number")),
        F.when(F.col("canonical_order") <= F.lag("canonical_order").over(order), F.lit("order")),
        F.when(F.count("*").over(same) > 1, F.lit("duplicate")),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("blank")),
    ))
    return verses.withColumn("errors", bad)
