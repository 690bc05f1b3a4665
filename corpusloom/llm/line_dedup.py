"""Removal of repeated passages by content-defined chunks of lines.

A text's lines are cut into chunks where the hash of the last two line hashes ends in
one of a few digits, so the same lines are cut alike wherever they stand. A line of
``long_words`` words or more is a chunk of its own. Chunks of several lines, and long
lines, that occur more than once in the corpus are removed wherever they are not the
first occurrence (smallest id, then place), after a comparison of their bytes with the
first one. Only DataFrame functions are used.

``dedup_passages``, the pipeline's stage, also removes repeated runs of lines that the
chunks miss because the lines around them differ.

Texts without a repeated chunk are left as they are, null and empty ones among them.
Rows that repeat both id and text are one document and get the same result; rows of one
id with different texts are documents of their own; a null id sorts first. Other columns
are carried along; ``removed_lines`` is added (a column of that name is replaced), and
``n_chars``, if there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns whose names begin with __ renamed, as such names are used here."""
    names = [c for c in docs.columns if c != "removed_lines"]
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}" if c.startswith("__") else c) for c in names]), names


def _given_back(out: DataFrame, names: list[str]) -> DataFrame:
    return out.select(*[F.col(f"`in_{c}`").alias(c) if c.startswith("__") else F.col(f"`{c}`") for c in names], "removed_lines")

LONG_WORDS = 25
#: First digits of a rolling hash after which a chunk ends: a fourth of all.
ENDS = ("0", "1", "2", "3")


def chunks(text: Column, long_words: int = LONG_WORDS, ends: tuple[str, ...] = ENDS) -> Column:
    """Array of (text, lines, whole, start) of the chunks of a text; whole: long or of several lines."""
    lines = F.split(text, "\n", -1)

    def cut(lines: Column) -> Column:
        marks = F.transform(lines, lambda x: F.struct(F.md5(x.cast("binary")).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1 >= long_words).alias("long")))
        return F.struct(lines.alias("lines"), marks.alias("marks"))

    def begin(at: Column, i: Column) -> Column:
        mark = lambda k: F.get(at["marks"], k)
        rolling = F.md5(F.concat(F.coalesce(mark(i - 2)["hash"], F.lit("")), mark(i - 1)["hash"]).cast("binary"))
        return (i == 0) | mark(i)["long"] | mark(i - 1)["long"] | F.substring(rolling, 1, 1).isin(*ends)

    def build(at: Column) -> Column:
        n = F.size(at["lines"])
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: begin(at, i))

        def chunk(start: Column, k: Column, starts: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), n) - start
            whole = (size > 1) | F.get(at["marks"], start)["long"]
            return F.struct(F.array_join(F.slice(at["lines"], start + 1, size), "\n").alias("text"), size.alias("lines"), whole.alias("whole"), start.alias("start"))

        # the arrays are bound once by a one-element transform, not computed again for each use
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda start, k: chunk(start, k, s)))[0]

    return F.transform(F.array(lines), lambda x: F.transform(F.array(cut(x)), build)[0])[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """docs with repeated chunks removed from their texts."""
    docs, names = _set_aside(docs)
    place = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")), "__text": F.xxhash64(text_col)}
    keyed = docs.withColumns(place)
    cut = keyed.select("__id", "__text", F.posexplode(chunks(F.col(text_col), long_words)).alias("__k", "__c")).where("__c.whole")
    seen = written(cut.select("__id", "__text", "__k", F.unhex(F.md5(F.col("__c.text").cast("binary"))).alias("__hash")), "chunks")
    spot = F.struct("__id", "__text", "__k")
    repeated = seen.groupBy("__hash").agg(F.min(spot).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    later = seen.join(repeated.withColumnRenamed("__hash", "__hash2"), F.col("__hash") == F.col("__hash2")).where(spot != F.col("__first")).select("__id", "__text", "__k", "__hash")
    # bytes of the first occurrences
    firsts = repeated.select("__hash", F.col("__first.__id").alias("__id"), F.col("__first.__text").alias("__text"), F.col("__first.__k").alias("__k"))
    wanted = firsts.groupBy("__id", "__text").agg(F.collect_set(F.struct("__k", "__hash")).alias("__wanted"))
    bytes_ = (
        keyed.select("__id", "__text", text_col).join(wanted, ["__id", "__text"])
        .withColumn("__chunks", chunks(F.col(text_col), long_words))
        .select("__chunks", F.explode("__wanted").alias("__w"))
        .select(F.col("__w.__hash").alias("__hash"), F.get("__chunks", F.col("__w.__k"))["text"].alias("__bytes"))
        .dropDuplicates(["__hash"])
    )
    claims = later.join(bytes_, "__hash").groupBy("__id", "__text").agg(F.map_from_entries(F.collect_set(F.struct("__k", "__bytes"))).alias("__claims"))
    joined = keyed.join(claims, ["__id", "__text"], "left")
    touched = F.when(F.col("__claims").isNotNull(), chunks(F.col(text_col), long_words))
    # each chunk is compared with the bytes of the first occurrence it is said to repeat
    kept = F.filter("__chunks", lambda c, k: ~F.coalesce(F.col("__claims")[k] == c["text"], F.lit(False)))
    out = joined.withColumn("__chunks", touched).withColumn("__kept", kept)
    lines = lambda a: F.aggregate(a, F.lit(0), lambda n, c: n + c["lines"])
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("__kept", lambda c: c["text"]), "\n"))
    removed = F.coalesce(lines(F.col("__chunks")) - lines(F.col("__kept")), F.lit(0)).cast("long")
    out = out.withColumn("removed_lines", removed).withColumn(text_col, text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _given_back(out, names)


def passages(text: Column, words: int = LONG_WORDS) -> Column:
    """Array of (start, end, hash) of the passages of a text that are looked for elsewhere.

    These are its whole chunks and, from every line on and up to every line, the shortest
    run of lines that has ``words`` words. A repeated run of lines of so many words is the
    union of such runs within it, so all of it is found, wherever its neighbours differ.
    """

    def mark(line: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), F.size(F.array_remove(F.split(line, "[ \t\r]+"), "")).alias("words"), F.sha2(line.cast("binary"), 256).alias("hash"))

    def reach(side: Column) -> Column:
        more = lambda a, m: F.when(a["words"] >= words, a).otherwise(F.struct((a["words"] + m["words"]).alias("words"), (a["n"] + 1).alias("n")))
        return F.aggregate(side, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), more)

    def digest(data: Column) -> Column:
        return F.unhex(F.sha2(data.cast("binary"), 256)).alias("hash")

    def run(at: Column, first: Column, n: Column) -> Column:
        hashes = F.transform(F.slice(at["full"], first + 1, n), lambda m: m["hash"])
        end = F.coalesce(F.get(at["full"], first + n)["i"], at["n"])
        return F.struct(F.get(at["full"], first)["i"].alias("start"), end.alias("end"), digest(F.array_join(hashes, "")))

    def runs(at: Column) -> Column:
        full = at["full"]

        def onward(m: Column, p: Column) -> Column:
            found = F.array(reach(F.slice(full, p + 1, words)))
            return F.transform(found, lambda r: F.when(r["words"] >= words, run(at, p, r["n"])))[0]

        def back(m: Column, p: Column) -> Column:
            low = F.greatest(p - (words - 1), F.lit(0))
            found = F.array(reach(F.reverse(F.slice(full, low + 1, p - low + 1))))
            # the others are shortest from their first line on as well
            return F.transform(found, lambda r: F.when(r["words"] - m["words"] >= words, run(at, p - r["n"] + 1, r["n"])))[0]

        return F.concat(F.transform(full, onward), F.transform(full, back))

    marks = F.transform(F.split(text, "\n", -1), mark)
    found = F.transform(F.transform(F.array(marks), lambda a: F.struct(F.filter(a, lambda m: m["words"] > 0).alias("full"), F.size(a).alias("n"))), runs)[0]
    whole = F.transform(F.filter(chunks(text, words), lambda c: c["whole"]), lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["lines"]).alias("end"), digest(c["text"])))
    return F.filter(F.concat(whole, found), lambda p: p.isNotNull())


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = LONG_WORDS) -> DataFrame:
    """docs without lines of a passage that stands earlier in the corpus as well.

    Does what ``dedup_lines`` does, and takes every run of lines of ``words`` words or more,
    however it is cut into lines and whatever stands around it. Lines without a word do not
    count and go with the line before. Passages are equal if their SHA-256 is.
    A passage that overlaps its first occurrence is no repetition of it.
    """
    docs, names = _set_aside(docs)
    place = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")), "__text": F.xxhash64(text_col)}
    keyed = docs.withColumns(place)
    seen = written(keyed.select("__id", "__text", F.explode(passages(F.col(text_col), words)).alias("__p")).select("__id", "__text", "__p.start", "__p.end", "__p.hash"), "passages")
    spot = F.struct("__id", "__text", "start", "end")
    repeated = seen.groupBy("hash").agg(F.min(spot).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col("hash").alias("__hash"), "__first")
    apart = (F.col("__id") != F.col("__first.__id")) | (F.col("__text") != F.col("__first.__text")) | (F.col("start") >= F.col("__first.end"))
    later = seen.join(repeated, F.col("hash") == F.col("__hash")).where(apart)
    claims = later.groupBy("__id", "__text").agg(F.collect_set(F.struct("start", "end")).alias("__claims"))
    joined = keyed.join(claims, ["__id", "__text"], "left")

    def left(lines: Column) -> Column:
        gone = F.flatten(F.transform("__claims", lambda c: F.sequence(c["start"], c["end"] - 1)))
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(F.transform(at, lambda i: F.get(lines, i)).alias("lines"), F.size(lines).alias("n"))

    kept = F.when(F.col("__claims").isNotNull(), F.transform(F.array(F.split(F.col(text_col), "\n", -1)), left)[0])
    out = joined.withColumn("__kept", kept)
    out = out.withColumn("removed_lines", F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(F.col("__kept.n") - F.size("__kept.lines")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept.lines", "\n")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _given_back(out, names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without repeated passages; a text of which nothing is left goes."""
    out = dedup_passages(docs)
    return out.where((F.col("removed_lines") == 0) | (F.length(F.trim("text", F.lit(" \t\r\n"))) > 0)).drop("removed_lines")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), m AS (
  SELECT doc_id, i, line, md5(line) AS h, length(line) - length(replace(line, ' ', '')) + 1 >= {LONG_WORDS} AS long FROM l
), w AS (
  SELECT *, lag(h) OVER d AS h1, lag(h, 2) OVER d AS h2, lag(long) OVER d AS long1 FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT *, sum(CASE WHEN i = 0 OR long OR long1 OR substr(md5(coalesce(h2, '') || h1), 1, 1) IN {ENDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w
), c AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, count(*) > 1 OR bool_or(long) AS whole FROM s GROUP BY doc_id, k
), r AS (
  SELECT *, whole AND row_number() OVER (PARTITION BY chunk, whole ORDER BY doc_id, k) > 1 AS again FROM c
), t AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT again), '') AS text, coalesce(sum(n) FILTER (WHERE again), 0)::BIGINT AS removed_lines FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, coalesce(t.removed_lines, 0) AS removed_lines,
  CASE WHEN t.removed_lines > 0 THEN length(t.text) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN t USING (doc_id)
"""
