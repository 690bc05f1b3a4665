"""From files to the documents table: scanning, routing, reading, provenance, upserts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.frames import union_by, written

_REFS = "array<string>"
#: White space at the ends of a text, which does not count.
BLANKS = " \t\n\r\0\x0b"
# Layouts of the JSON payloads. Numbers and lists of references are read as text
# first, so that "3" is a number and a lone reference a list as well.
_GIVEN = "string"
VERSES = "array<struct<verse:string,number:string,text:string,content:string,cross_references:string,crossReferences:string>>"
BIBLE = f"""struct<translation:string,language:string,source_edition:string,book:string,book_abbreviation:string,chapter:string,testament:string,verses:{VERSES},
 books:array<struct<book:string,name:string,abbreviation:string,book_abbreviation:string,testament:string,chapters:array<struct<chapter:string,number:string,verses:{VERSES}>>>>>"""
_LEVELS = "part:string,section:string,chapter:string,article:string,paragraph:string"
CATECHISM = f"""struct<catechism:string,language:string,source_edition:string,publication_year:string,source_url:string,
 paragraphs:array<struct<number:string,title:string,content:string,category:string,topics:string,hierarchy:struct<{_LEVELS}>,{_LEVELS},
  ccc_references:{_GIVEN},internal_references:{_GIVEN},scripture_references:{_GIVEN},church_father_references:{_GIVEN},patristic_references:{_GIVEN}>>,
 lessons:array<struct<lesson:string,title:string,questions:array<struct<number:string,question:string,answer:string>>>>>"""
FATHERS = f"""struct<author:string,work:string,language:string,original_language:string,translation:string,translator:string,century:string,topics:string,volume:string,source_edition:string,source_url:string,
 sections:array<struct<reference:string,title:string,content:string,section:string,chapter:string,paragraph:string,volume:string,translation:string,topics:string,
  scripture_references:{_GIVEN},catechism_references:{_GIVEN},ccc_references:{_GIVEN},church_father_references:{_GIVEN},patristic_references:{_GIVEN},cross_references:{_GIVEN}>>>"""


def scan_sources(spark: SparkSession, paths: list[str] | str, patterns: tuple[str, ...] = ("*.json", "*.txt", "*.md")) -> DataFrame:
    """(file_path, file_name, modified, value): whole files below paths."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}")
    raw = reader.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def checksum_files(raw: DataFrame) -> DataFrame:
    return raw.withColumn("checksum", F.sha2(F.col("value").cast("binary"), 256))


def _has(*keys: str) -> Column:
    """A JSON file with one of the keys at its top, where it is not null."""
    found = F.lit(False)
    for k in keys:
        found = found | F.get_json_object("value", f"$.{k}").isNotNull()
    return _json() & found


def _ending(*names: str) -> Column:
    return F.lower(F.element_at(F.split("file_name", r"\."), -1)).isin(*names) & F.contains("file_name", F.lit("."))


def _json() -> Column:
    return _ending("json")


def _named(*parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower("file_name"), F.lit(part))
    return found


def _broken(value: Column) -> Column:
    """Text that is no JSON object, or holds anything besides it."""
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    return ~(F.startswith(F.trim(value, F.lit(BLANKS)), F.lit("{")) & F.coalesce(alone, F.lit(False)))


def _whole(c: Column) -> Column:
    """A number as it is read: 0 where there is none."""
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def _list(c: Column) -> Column:
    """A list as it is given, or a lone value as a list; blank items do not count."""
    items = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, _REFS)).when(c.isNotNull(), F.array(c))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(BLANKS)) == ""


def detect_source(raw: DataFrame, importers: tuple[Importer, ...] | None = None) -> DataFrame:
    """Adds importer: the name of the first importer that supports the file, or null."""
    name = F.lit(None).cast("string")
    for i in reversed(IMPORTERS if importers is None else importers):
        name = F.when(i.supports(), i.name).otherwise(name)
    return raw.withColumn("importer", name)


def skip_unchanged(files: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Files without a completed manifest for their path, checksum and importer."""
    if force:
        return files
    done = manifests.where("status = 'completed'").select("file_path", "checksum", "importer").distinct()
    return files.join(done, ["file_path", "checksum", "importer"], "left_anti")


def write_manifests(attempts: DataFrame, root: str) -> None:
    attempts.write.mode("append").parquet(root)


def read_bible_json(raw: DataFrame, book: str | None = None, chapter: int | None = None) -> DataFrame:
    """One row a verse: file_path, book, abbreviation, testament, chapter, verse, text, cross_references, position.

    A chapter or verse without a number has number 0. Files that are no JSON have no rows;
    ``verify_sources`` says so."""
    rows = raw.withColumn("p", F.from_json("value", BIBLE))
    single = F.array(F.struct(F.col("p.book").alias("book"), F.col("p.book").alias("name"), F.col("p.book_abbreviation").alias("abbreviation"), F.col("p.book_abbreviation").alias("book_abbreviation"), F.col("p.testament").alias("testament"), F.array(F.struct(F.col("p.chapter").alias("chapter"), F.col("p.chapter").alias("number"), F.col("p.verses").alias("verses"))).alias("chapters")))
    rows = rows.select("file_path", "p.translation", "p.language", "p.source_edition", F.posexplode(F.coalesce("p.books", single)).alias("bi", "b"))
    rows = rows.select("*", F.posexplode("b.chapters").alias("ci", "c")).select("*", F.posexplode("c.verses").alias("vi", "v"))
    out = rows.select(
        "file_path", "translation", "language", "source_edition", F.coalesce("b.book", "b.name").alias("book"), F.coalesce("b.abbreviation", "b.book_abbreviation").alias("abbreviation"), "b.testament",
        _whole(F.coalesce("c.chapter", "c.number")).alias("chapter"), _whole(F.coalesce("v.verse", "v.number")).alias("verse"), F.coalesce("v.text", "v.content").alias("text"),
        F.coalesce(_list(F.coalesce("v.cross_references", "v.crossReferences")), F.array().cast(_REFS)).alias("cross_references"), (F.col("bi").cast("long") * 1_000_000 + F.col("ci") * 1_000 + F.col("vi")).alias("position"),
    )
    if book:
        out = out.where(F.lower("book") == book.lower())
    return out.where(F.col("chapter") == chapter) if chapter is not None else out


def _document(source_type: str, source_name: Column, reference: Column, title: Column, content: Column, tradition: str, metadata: list[Column]) -> list[Column]:
    return [F.lit(source_type).alias("source_type"), source_name.alias("source_name"), F.lit(tradition).alias("tradition"), reference.alias("reference"), title.alias("title"), content.alias("content"), F.to_json(F.struct(*metadata)).alias("metadata")]


def bible_documents(verses: DataFrame, tradition: str = "catholic") -> DataFrame:
    """A document for each verse and each chapter."""
    from corpusloom.operators.study import assemble_chapters

    name = F.coalesce(F.col("translation"), F.lit("bible"))
    ref = tx.format_reference(F.col("book"), F.col("chapter"), F.col("verse"))
    meta = [F.col("language"), F.col("book"), F.col("chapter"), F.col("verse"), F.col("cross_references"), tx.content_checksum(name, ref, F.col("text")).alias("checksum")]
    single = verses.select("file_path", *_document("bible_verse", name, ref, ref, F.col("text"), tradition, meta))
    chapters = assemble_chapters(verses, ["file_path", "translation", "language", "book", "chapter"], references="cross_references")
    cref = tx.format_reference(F.col("book"), F.col("chapter"))
    cmeta = [F.col("language"), F.col("book"), F.col("chapter"), F.col("verse_count"), F.col("references").alias("cross_references"), tx.content_checksum(name, cref, F.col("content")).alias("checksum")]
    return single.unionByName(chapters.select("file_path", *_document("bible_chapter", name, cref, cref, F.col("content"), tradition, cmeta)))


# Books that a mention in running text can name.
SCRIPTURE_BOOKS = (
    "Genesis", "Exodus", "Leviticus", "Numbers", "Deuteronomy", "Joshua", "Judges", "Ruth", "Matthew", "Mark", "Luke", "John",
    "Acts", "Romans", "Philippians", "Ephesians", "Corinthians", "Galatians", "Hebrews", "James", "Peter", "Jude", "Revelation",
)


def scripture_mention(books: tuple[str, ...] = SCRIPTURE_BOOKS) -> str:
    return r"(?i)\b(?:[1-3]\s+)?(?:" + "|".join(books) + r")\s+\d+:\d+(?:[-–]\d+)?"


SCRIPTURE_MENTION = scripture_mention()


def read_catechism_json(raw: DataFrame, tradition: str = "catholic") -> DataFrame:
    """A document for each paragraph, or else for each question of the lessons."""
    rows = raw.withColumn("p", F.from_json("value", CATECHISM))
    name = F.coalesce(F.col("p.catechism"), F.lit("catechism"))
    para = rows.select("file_path", name.alias("name"), "p.language", F.explode("p.paragraphs").alias("x"))
    ref = F.concat(F.lit("CCC "), _whole(F.col("x.number")).cast("string"))
    levels = F.struct(*[F.coalesce(F.col(f"x.hierarchy.{k}"), F.col(f"x.{k}")).alias(k) for k in ("part", "section", "chapter", "article", "paragraph")])
    text = F.coalesce("x.content", F.lit(""))
    own = F.array_remove(tx.extract_references(text, r"\bCCC\s+\d+\b", _list(F.col("x.internal_references")), _list(F.col("x.ccc_references"))), ref)
    meta = [F.col("language"), _whole(F.col("x.number")).alias("number"), F.col("x.category").alias("category"), _list(F.col("x.topics")).alias("topics"), levels.alias("hierarchy"), own.alias("internal_references"),
            tx.extract_references(text, SCRIPTURE_MENTION, _list(F.col("x.scripture_references"))).alias("scripture_references"),
            tx.list_union(F.coalesce(_list(F.col("x.church_father_references")), F.array().cast(_REFS)), F.coalesce(_list(F.col("x.patristic_references")), F.array().cast(_REFS))).alias("church_father_references"), tx.content_checksum(F.col("name"), ref, text).alias("checksum")]
    first = para.select("file_path", *_document("catechism", F.col("name"), ref, F.coalesce("x.title", ref), F.col("x.content"), tradition, meta))
    lessons = rows.where("p.paragraphs is null").select("file_path", name.alias("name"), "p.language", F.explode("p.lessons").alias("l")).select("*", F.explode("l.questions").alias("q"))
    qref = F.concat(F.lit("Question "), F.col("q.number").cast("string"))
    body = F.concat_ws("\n", "q.question", "q.answer")
    qmeta = [F.col("language"), _whole(F.col("l.lesson")).alias("lesson"), _whole(F.col("q.number")).alias("number"), tx.content_checksum(F.col("name"), qref, body).alias("checksum")]
    return first.unionByName(lessons.select("file_path", *_document("catechism", F.col("name"), qref, F.concat(qref, F.lit(": "), F.col("q.question")), body, tradition, qmeta)))


def read_fathers_json(raw: DataFrame, author: str | None = None, tradition: str = "catholic") -> DataFrame:
    """A document for each section; a section's values go before the payload's."""
    rows = raw.withColumn("p", F.from_json("value", FATHERS)).select("file_path", "p", F.explode("p.sections").alias("s"))
    if author:
        rows = rows.where(tx.author_key(F.col("p.author")) == tx.author_key(F.lit(author)))
    both = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"p.{c}"))
    none = F.array().cast(_REFS)
    text = F.coalesce("s.content", F.lit(""))
    ref = F.coalesce("s.reference", F.concat_ws(" ", "p.author", "p.work", "s.section"))
    meta = [F.col("p.language").alias("language"), F.col("p.author").alias("author"), tx.author_key(F.col("p.author")).alias("author_key"), F.col("p.work").alias("work"), F.col("p.century").alias("century"), both("volume").alias("volume"), both("translation").alias("translation"), _list(both("topics")).alias("topics"),
            tx.extract_references(text, SCRIPTURE_MENTION, _list(F.col("s.scripture_references"))).alias("scripture_references"), tx.extract_references(text, r"\bCCC\s+\d+\b", _list(F.col("s.catechism_references")), _list(F.col("s.ccc_references"))).alias("catechism_references"),
            tx.list_union(F.coalesce(_list(F.col("s.church_father_references")), none), F.coalesce(_list(F.col("s.patristic_references")), none)).alias("church_father_references"), F.coalesce(_list(F.col("s.cross_references")), none).alias("cross_references"), tx.content_checksum(F.col("p.work"), ref, text).alias("checksum")]
    return rows.select("file_path", *_document("church_father", F.col("p.author"), ref, F.coalesce("s.title", ref), F.col("s.content"), tradition, meta))


def split_segments(texts: DataFrame, id_col: str, text_col: str, separator: str = r"\n\s*\n", blanks: str = " ") -> DataFrame:
    """(id, segment, text): segments keep their number among all, blank ones are left out."""
    cut = lambda c: F.trim(c, F.lit(blanks))
    rows = texts.select(id_col, F.posexplode(F.split(cut(F.col(text_col)), separator, -1)).alias("i", "text"))
    return rows.where(cut(F.col("text")) != "").select(id_col, (F.col("i") + 1).alias("segment"), cut(F.col("text")).alias("text"))


def text_documents(raw: DataFrame, source_type: str, tradition: str = "catholic", language: str = "en") -> DataFrame:
    """A document for each paragraph of a text file, named by the file and the paragraph's number."""
    named = raw.withColumn("__file", F.struct("file_path", "file_name"))
    rows = split_segments(named, "__file", "value", blanks=BLANKS)
    name = F.col("__file.file_name")
    ref = F.concat(name, F.lit("#"), F.col("segment").cast("string"))
    meta = [F.lit(language).alias("language"), name.alias("source_file"), F.col("segment"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum")]
    return rows.select(F.col("__file.file_path").alias("file_path"), *_document(source_type, name, ref, ref, F.col("text"), tradition, meta))


def extract_html_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label): the first link of each label on a page."""
    anchor = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(found).alias("position", "x")).select("page_id", "position", F.col("x.href").alias("href"), tx.clean_html(F.col("x.label")).alias("label")).where("label <> ''")
    first = W.partitionBy("page_id", "label").orderBy("position")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def extract_html_records(pages: DataFrame, pattern: str, names: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """(page_id, position, names...): one row for each match, a column for each group."""
    groups = [F.regexp_extract_all("html", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(*groups)).alias("position", "x"))
    values = [(tx.clean_html(F.col(f"x.{n}")) if t == "string" else F.col(f"x.{n}").try_cast(t)).alias(n) for n, t in zip(names, types, strict=True)]
    return rows.select("page_id", "position", *values)


def stamp_provenance(docs: DataFrame, stamps: dict[str, Column], column: str = "metadata") -> DataFrame:
    """Adds stamps to the JSON metadata; empty values are dropped, stamps go before old keys."""
    old = F.map_filter(F.from_json(column, "map<string,string>"), lambda k, v: ~k.isin(*stamps))
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, stamps)), F.array(*[v.cast("string") for v in stamps.values()])), lambda k, v: v.isNotNull() & (v != ""))
    merged = F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), new)
    return docs.withColumn(column, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))))


def read_reference_tables(spark: SparkSession, path: str, columns: list[str], order: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns).orderBy(*order)


def replace_slice(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the slices that new names (by keys) replaced by new."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


@dataclass(frozen=True)
class Importer:
    """A source family: which files are its own, how to read them, which rows are wrong."""

    name: str
    read: Callable[[DataFrame], DataFrame]
    errors: Callable[[DataFrame], DataFrame] | None = None
    supports: Callable[[], Column] = lambda: F.lit(False)
    """Condition over file_name and value"""


def _listed(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def _of_file(raw: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(file_path, reference, error) of what is wrong with whole files."""
    return raw.select("file_path", F.lit(None).cast("string").alias("reference"), F.explode(_listed(rules)).alias("error"))


#: The error of a file that gives no record, where it has no other.
NO_RECORDS = "no records"


def _all_errors(raw: DataFrame, records: DataFrame, *parts: DataFrame) -> DataFrame:
    """Errors of files and rows; a file that gives no record is wrong, whatever the reason."""
    out = raw.join(records.select("file_path"), "file_path", "left_anti").select("file_path", F.lit(None).cast("string").alias("reference"), F.lit(NO_RECORDS).alias("error"))
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def _repeated(*keys) -> Column:
    return F.count("*").over(W.partitionBy("file_path", *keys)) > 1


def _file_rules(layout: str, *lists: str) -> dict[str, Column]:
    """Files that are empty, are named as JSON and are none, or hold something else than a
    list where their layout has one."""
    value, read = F.col("value"), F.from_json("value", layout)
    odd = [read[k].isNull() & F.get_json_object("value", f"$.{k}").isNotNull() for k in lists]
    return {"empty": _blank(value), "json": _json() & _broken(value), "layout": _json() & ~_broken(value) & F.exists(F.array(*odd), lambda x: x)}


CCC = r"^CCC\s+\d+$"


def _wrong_reference(references: Column) -> Column:
    return F.exists(F.coalesce(_list(references), F.array().cast(_REFS)), lambda r: ~F.rlike(r, F.lit(CCC)))


# The books that are taken, in canonical order.
CANON = (
    "genesis", "exodus", "leviticus", "numbers", "deuteronomy", "joshua", "judges", "ruth", "1 samuel", "2 samuel", "1 kings", "2 kings", "1 chronicles", "2 chronicles", "ezra", "nehemiah",
    "tobit", "judith", "esther", "1 maccabees", "2 maccabees", "job", "psalms", "proverbs", "ecclesiastes", "song of songs", "wisdom", "sirach", "isaiah", "jeremiah", "lamentations", "baruch",
    "ezekiel", "daniel", "hosea", "joel", "amos", "obadiah", "jonah", "micah", "nahum", "habakkuk", "zephaniah", "haggai", "zechariah", "malachi", "matthew", "mark", "luke", "john", "acts",
    "romans", "1 corinthians", "2 corinthians", "galatians", "ephesians", "philippians", "colossians", "1 thessalonians", "2 thessalonians", "1 timothy", "2 timothy", "titus", "philemon",
    "hebrews", "james", "1 peter", "2 peter", "1 john", "2 john", "3 john", "jude", "revelation",
)


def _verse_errors(raw: DataFrame) -> DataFrame:
    held = lambda k: F.get_json_object("value", f"$.{k}").isNotNull()
    fields = {k: ~_broken(F.col("value")) & ~held("books") & ~held(k) for k in ("book", "chapter", "verses")}
    # only what the windows below need is dealt by file, not the texts
    verses = read_bible_json(raw).select("file_path", "position", "book", "chapter", "verse", _blank(F.col("text")).alias("no_text"))
    ref = tx.format_reference(F.col("book"), F.col("chapter"), F.col("verse"))
    before = F.lag("verse").over(W.partitionBy("file_path", F.floor(F.col("position") / 1000)).orderBy("position"))
    place = F.array_position(F.array(*map(F.lit, CANON)), F.regexp_replace(F.lower(F.trim("book")), r"\s+", " "))
    verses = verses.withColumn("canon", place * 1_000_000 + F.col("chapter") * 1_000 + F.col("verse"))
    earlier = F.lag("canon").over(W.partitionBy("file_path").orderBy("position"))
    strange = {"unknown book": ~_blank(F.col("book")) & (place == 0), "canon": before.isNull() & (place > 0) & (F.col("canon") <= earlier)}
    rules = strange | {"bad_number": (F.col("chapter") < 1) | (F.col("verse") < 1), "order": (F.col("verse") > 0) & (F.col("verse") <= before), "duplicate": _repeated("book", "chapter", "verse"), "blank": F.col("no_text"), "book": _blank(F.col("book"))}
    named = F.coalesce(ref, F.concat(F.lit("position "), F.col("position").cast("string")))
    rows = verses.withColumn("bad", _listed(rules)).select("file_path", named.alias("reference"), F.explode("bad").alias("error"))
    return _all_errors(raw, verses, _of_file(raw, _file_rules(BIBLE, "books", "verses") | fields), rows)


def _paragraph_errors(raw: DataFrame) -> DataFrame:
    payload = raw.where(_json()).withColumn("p", F.from_json("value", CATECHISM))
    x = payload.select("file_path", F.posexplode("p.paragraphs").alias("i", "x")).withColumn("number", _whole(F.col("x.number")))
    ref = F.when(F.col("number") > 0, F.concat(F.lit("CCC "), F.col("number").cast("string"))).otherwise(F.concat(F.lit("index "), F.col("i").cast("string")))
    levels = F.struct(*[F.coalesce(F.col(f"x.hierarchy.{k}"), F.col(f"x.{k}")).alias(k) for k in ("part", "section", "chapter", "article", "paragraph")])
    own = {
        "bad_number": F.col("number") < 1, "blank": _blank(F.col("x.content")), "hierarchy": ~tx.hierarchy_valid("h"),
        "topics": F.col("x.topics").isNotNull() & ~F.startswith(F.trim("x.topics"), F.lit("[")), "reference": _wrong_reference(F.col("x.ccc_references")),
    }
    x = x.withColumn("h", levels).select("file_path", "i", "number", *[broken.alias(name) for name, broken in own.items()])
    rules = {"duplicate": _repeated("number")} | {name: F.col(name) for name in own}
    rows = x.withColumn("bad", _listed(rules)).select("file_path", ref.alias("reference"), F.explode("bad").alias("error"))
    return _all_errors(raw, read_catechism(raw), _of_file(raw, _file_rules(CATECHISM, "paragraphs", "lessons")), rows)


# Authors whose works are taken, by key.
AUTHORS = ("augustine", "thomas_aquinas", "john_chrysostom", "athanasius", "gregory_the_great")


def section_errors(authors: tuple[str, ...] | None = AUTHORS) -> Callable[[DataFrame], DataFrame]:
    """Errors of files of sections; authors, if given, are all that are taken."""

    def errors(raw: DataFrame) -> DataFrame:
        parsed = raw.withColumn("p", F.from_json("value", FATHERS))
        author, good = F.col("p.author"), _json() & ~_broken(F.col("value"))
        known = F.lit(True) if authors is None else F.coalesce(tx.author_key(author).isin(*authors), F.lit(False))
        fields = {"author": good & _blank(author), "unknown author": good & ~_blank(author) & ~known, "work": good & _blank(F.col("p.work"))}
        whole = _of_file(parsed, _file_rules(FATHERS, "sections") | fields)
        s = parsed.where(good).select("file_path", F.posexplode("p.sections").alias("i", "s"))
        ref = F.when(_blank(F.col("s.reference")), F.concat(F.lit("index "), F.col("i").cast("string"))).otherwise(F.trim("s.reference"))
        own = {
            "no reference": _blank(F.col("s.reference")), "blank": _blank(F.col("s.content")),
            "hierarchy": F.col("s.paragraph").isNotNull() & F.col("s.chapter").isNull() & F.col("s.section").isNull(), "reference": _wrong_reference(F.col("s.catechism_references")),
        }
        s = s.select("file_path", ref.alias("named"), F.trim(F.coalesce("s.reference", F.lit(""))).alias("key"), *[broken.alias(name) for name, broken in own.items()])
        rules = {"duplicate": _repeated("key")} | {name: F.col(f"`{name}`") for name in own}
        rows = s.withColumn("bad", _listed(rules)).select("file_path", F.col("named").alias("reference"), F.explode("bad").alias("error"))
        return _all_errors(raw, read_fathers(raw), whole, rows)

    return errors


def read_catechism(raw: DataFrame) -> DataFrame:
    """Documents of JSON files, and of text files by paragraph."""
    return read_catechism_json(raw.where(_json())).unionByName(text_documents(raw.where(~_json()), "catechism"))


def read_fathers(raw: DataFrame) -> DataFrame:
    return read_fathers_json(raw.where(_json())).unionByName(text_documents(raw.where(~_json()), "church_father"))


def _all_of(*keys: str) -> Column:
    found = _json()
    for k in keys:
        found = found & _has(k)
    return found


TEXT = ("txt", "md")
IMPORTERS = (
    Importer("bible", lambda raw: bible_documents(read_bible_json(raw)), _verse_errors, lambda: _json() & _named("bible", "douay") | _has("books") | _all_of("book", "chapter", "verses")),
    Importer("catechism", read_catechism, _paragraph_errors, lambda: _ending(*TEXT) & _named("catechism") | _json() & _named("catechism", "ccc") | _has("paragraphs", "lessons")),
    Importer("church_fathers", read_fathers, section_errors(), lambda: _ending("json", *TEXT) & _named("church-father", "church_father", "fathers") | _has("sections") & _has("author", "work")),
)


def verify_sources(raw: DataFrame, importers: tuple[Importer, ...] = IMPORTERS) -> DataFrame:
    """(file_path, status, errors): verified, unsupported or failed.

    A file fails if it is empty, is named as JSON and is none, has something else than a
    list where its layout has one, breaks a rule of its kind in any row, or gives no record
    at all. What is wrong with a whole file stands without a reference. Routed files are
    written to the shared folder, as the checks read them several times.
    """
    return _verified(written(detect_source(raw, importers), "routed"), importers)


def _verified(routed: DataFrame, importers: tuple[Importer, ...]) -> DataFrame:
    errors = routed.limit(0).select("file_path", F.lit(None).cast("string").alias("reference"), F.lit("").alias("error"))
    for i in importers:
        if i.errors is None:
            continue
        own = routed.where(F.col("importer") == i.name)
        errors = union_by(["file_path"], errors, i.errors(own))
    all_of_it = F.sort_array(F.collect_set(F.concat_ws(": ", "reference", "error")))
    grouped = errors.groupBy("file_path").agg(all_of_it.alias("all")).select("file_path", F.when(F.size("all") > 1, F.array_remove("all", NO_RECORDS)).otherwise(F.col("all")).alias("errors"))
    out = routed.select("file_path", "importer").join(grouped, "file_path", "left")
    status = F.when(F.col("importer").isNull(), "unsupported").when(F.size("errors") > 0, "failed").otherwise("verified")
    return out.select("file_path", status.alias("status"), F.coalesce("errors", F.array().cast(_REFS)).alias("errors"))


def running_manifests(files: DataFrame) -> DataFrame:
    """Import attempts that have begun, to be written before the import."""
    return files.select("file_path", "checksum", "importer", F.lit("running").alias("status"), F.current_timestamp().alias("started_at"))


def changed_documents(upserted: DataFrame) -> DataFrame:
    """The documents of an import that are to be embedded."""
    return upserted.where(F.col("status").isin("created", "updated"))


def document_key() -> Column:
    """Id of an imported document, the same in every import: a digest of its key."""
    told = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.sha2(F.concat(*[told(c) for c in ("source_type", "source_name", "reference")]).cast("binary"), 256)


#: Up to so many paths of failed files go to every task; more are joined.
BROADCAST_ROWS = 100_000


def import_sources(raw: DataFrame, existing: DataFrame, manifests: DataFrame, importers: tuple[Importer, ...] = IMPORTERS, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents after the upsert with their status, import attempts) of scanned files.

    Files without changes since a completed import are skipped; any error rejects its
    whole file. An attempt counts its file's records: total, created, updated, skipped,
    failed. Of records that repeat a key the last one stands, by file and place. The files to
    import, their checks, their records and the documents after the upsert are written to the
    shared folder, as all of them are used several times.
    """
    from corpusloom.operators.documents import KEY, upsert_documents

    files = written(skip_unchanged(detect_source(checksum_files(raw), importers).where("importer is not null"), manifests, force), "files")
    checked = written(_verified(files, importers), "checked")
    bad = checked.where("status <> 'verified'").select("file_path")
    if bad.count() <= BROADCAST_ROWS:  # so that no text is dealt by its file
        bad = F.broadcast(bad)
    records = None
    for i in importers:
        part = i.read(files.where(F.col("importer") == i.name))
        records = part if records is None else records.unionByName(part)
    records = written(records, "records")
    incoming = records.where("file_path is not null").join(bad, "file_path", "left_anti")
    every = records.groupBy("file_path").agg(F.count("*").alias("total_records"))
    upserted = written(upsert_documents(existing, incoming), "upserted")
    told = incoming.select("file_path", *KEY).join(upserted.select(*KEY, "status"), KEY)
    counts = told.groupBy("file_path").agg(*[F.count_if(F.col("status") == x).alias(f"{x}_records") for x in ("created", "updated", "skipped")])
    failed = checked.withColumn("error_message", F.array_join("errors", "; ")).withColumn("status", F.when(F.col("status") == "verified", "completed").otherwise("failed"))
    attempts = files.select("file_path", "checksum", "importer").join(failed, "file_path").join(every, "file_path", "left").join(counts, "file_path", "left")
    names = ["total_records", "created_records", "updated_records", "skipped_records"]
    attempts = attempts.fillna(0, names).withColumn("failed_records", F.when(F.col("status") == "failed", F.greatest("total_records", F.size("errors"))).otherwise(0).cast("long"))
    return upserted, attempts.select("file_path", "checksum", "importer", "status", "error_message", *names, "failed_records", F.current_timestamp().alias("finished_at"))
