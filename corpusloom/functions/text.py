"""Column functions over texts, references and metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of query analysis and answers.
SCRIPTURE = r"\b(?:[1-3]\s*)?[A-Z][a-z]+\s+\d+:\d+(?:[-–]\d+)?\b"
PARAGRAPH = r"(?i)\bCCC\s+\d+\b"
FATHERS = r"(?i)\b(Augustine|Athanasius|Chrysostom|Aquinas|Gregory|Catena Aurea)\b"
QUESTION = r"(?i)^(who|what|when|where|why|how|which)\b"
WORD = "[A-Za-z'-]+"
INDICATORS = r"(?i)\b(I made up|hypothetical source|unknown citation|as an AI)\b"
EXPANSIONS = {
    "incarnation": (("Word became flesh", "Jesus became man", "the Word became Flesh"), ("John 1:14", "CCC 456", "CCC 457", "Athanasius")),
    "grace": (("justification", "gift of God", "sanctifying grace"), ("Romans 5:1", "CCC 1996", "CCC 1997")),
    "trinity": (("Father Son Holy Spirit", "one God three Persons"), ("Matthew 28:19", "CCC 232", "CCC 234")),
}


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """max(1, ceil(1.35 * words)); a null text has one token."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(words(text), F.lit(0)) * 1.35)).cast("int")


def content_checksum(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def clean_html(text: Column) -> Column:
    """Tags out, common character references decoded, white space collapsed."""
    out = F.regexp_replace(text, "&nbsp;| ", " ")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def highlight(text: Column, query: str) -> Column:
    """HTML-escaped text with case-insensitive literal matches of query marked."""

    def escape(c: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    out = escape(text)
    if not query.strip():
        return out
    literal = query.strip()
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        literal = literal.replace(sign, name)
    return F.regexp_replace(out, "(?i)(" + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", literal) + ")", "<mark>$1</mark>")


def author_key(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), r"^(saint |st\. |st )", "")
    return F.replace(F.regexp_replace(F.trim(out), r"\s+", " "), F.lit(" "), F.lit("_"))


def translation_slug(*names: Column) -> Column:
    """First name that is set, lower-cased, blanks and hyphens as underscores."""
    set_ = [F.nullif(F.trim(n), F.lit("")) for n in names]
    return F.translate(F.lower(F.coalesce(*set_)), "- ", "__")


def translation_name(slug: Column, known: dict[str, str] | None = None) -> Column:
    out = F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))
    for k, v in (known or {}).items():
        out = F.when(slug == k, F.lit(v)).otherwise(out)
    return out


def normalize_book(book: Column) -> Column:
    return F.lower(F.trim(book))


def format_reference(book: Column, chapter: Column, verse: Column | None = None) -> Column:
    if verse is None:
        return F.concat(book, F.lit(" Chapter "), chapter.cast("string"))
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def canonicalize_book(docs: DataFrame, canon: DataFrame, book: str = "book", chapter: str = "chapter", verse: str = "verse") -> DataFrame:
    """Adds canonical_book, abbreviation, testament, canonical_order; unknown books get nulls.

    canon: (name, abbreviation, testament, position), some tens of rows, keyed by name
    and abbreviation.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = canon.select(key(F.col("name")).alias("__key"), F.col("name").alias("canonical_book"), "abbreviation", "testament", "position")
    short = canon.select(key(F.col("abbreviation")).alias("__key"), F.col("name").alias("canonical_book"), "abbreviation", "testament", "position")
    dimension = names.union(short).dropDuplicates(["__key"])
    order = F.col("position") * 1_000_000 + F.col(chapter) * 1_000 + F.coalesce(F.col(verse), F.lit(0))
    out = docs.withColumn("__key", key(F.col(book))).join(dimension, "__key", "left")
    return out.withColumn("canonical_order", order).drop("__key", "position")


def hierarchy(inner: str, outer: str, levels: tuple[str, ...] = ("part", "section", "chapter", "article", "paragraph")) -> Column:
    """Struct of five levels, each from the inner struct or else from the outer row."""
    return F.struct(*[F.coalesce(F.col(f"{inner}.{k}"), F.col(f"{outer}.{k}") if outer else F.col(k)).alias(k) for k in levels])


def hierarchy_valid(h: str) -> Column:
    needs = lambda low, high: F.col(f"{h}.{low}").isNull() | F.col(f"{h}.{high}").isNotNull()
    return needs("section", "part") & needs("chapter", "section") & needs("article", "chapter")


def extract_references(text: Column, pattern: str, *lists: Column) -> Column:
    """Mentions of pattern in text after the supplied lists, without repeats, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    given = [F.coalesce(c, F.array().cast("array<string>")) for c in lists]
    return F.array_distinct(F.concat(*given, found))


def list_union(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def list_difference(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def list_shared(a: Column, b: Column) -> Column:
    """Items of a that are in b, repeats kept."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def analyze_queries(queries: DataFrame, query: str = "query", topics: tuple[str, ...] = tuple(EXPANSIONS)) -> DataFrame:
    """Adds query (trimmed), references, topics, is_question, intents."""
    q = F.trim(F.col(query))
    scripture = F.transform(F.regexp_extract_all(q, F.lit(SCRIPTURE), F.lit(0)), lambda x: F.trim(x))
    paragraphs = F.transform(F.regexp_extract_all(q, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.upper(F.trim(x)))
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(q), F.lit(t.lower())), F.lit(t)) for t in topics]))
    out = queries.withColumn(query, q).withColumn("__s", scripture).withColumn("__c", paragraphs).withColumn("topics", found)
    out = out.withColumn("references", F.array_distinct(F.concat("__s", "__c"))).withColumn("is_question", F.contains(F.col(query), F.lit("?")) | F.col(query).rlike(QUESTION))
    # intents are in order of their detection
    intents = F.array_compact(F.array(
        F.when(F.size("__s") > 0, F.lit("scripture_reference")), F.when(F.size("__c") > 0, F.lit("catechism_reference")),
        F.when(F.col(query).rlike(FATHERS), F.lit("church_father_reference")), F.when(F.size("topics") > 0, F.lit("theological_topic")),
        F.when(F.col("is_question"), F.lit("natural_language_question")),
        F.when((words(F.col(query)) <= 4) & (F.size("references") == 0), F.lit("keyword_query")),
    ))
    mixed = F.when(F.size(intents) > 1, F.array_prepend(intents, F.lit("mixed_query"))).when(F.size(intents) == 0, F.array(F.lit("natural_language"))).otherwise(intents)
    return out.withColumn("intents", mixed).drop("__s", "__c")


def expand_queries(analyzed: DataFrame, query: str = "query", expansions: dict = EXPANSIONS) -> DataFrame:
    """Adds terms, expansion_references and expanded_query.

    The dictionary is a constant of the plan; a query's topics select from it.
    """
    entries = [(k, F.array(*map(F.lit, v[0])), F.array(*map(F.lit, v[1]))) for k, v in expansions.items()]
    none = F.array().cast("array<string>")
    choose = lambda i: F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains("topics", e[0]), e[i]).otherwise(none) for e in entries])))
    out = analyzed.withColumn("terms", choose(1)).withColumn("expansion_references", F.array_distinct(F.concat("references", choose(2))))
    return out.withColumn("expanded_query", F.array_join(F.array_distinct(F.concat(F.array(query), "terms", "expansion_references")), " "))
