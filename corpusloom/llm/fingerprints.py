"""Document fingerprints by a homomorphic multiset hash.

A paragraph (line, blank ones too) is hashed to a wide vector, and a document's vector is
the sum of its paragraphs' vectors, every lane modulo a power of two. So the fingerprint
does not depend on the order of paragraphs, and paragraphs are put in or taken out by
adding or subtracting their vectors (``add``, ``subtract``). The vector has two parts:

* 256 lanes modulo 2**16, expanded from the paragraph's SHA-256, tell equal multisets of
  paragraphs. Four lanes lie in a long, and sums are masked so that no lane carries into
  another.
* 128 lanes modulo 2**32 tell how much documents have in common, the ``likeness``: each
  distinct pair of neighbouring tokens of the paragraph adds or takes its weight at every
  lane by a bit of its hash, so the cosine of two documents' lanes is an estimate of the
  cosine of their weights, with a standard deviation below 0.09. A pair that stands c
  times in a paragraph weighs the square root of c, so that the cosine is about the share
  of tokens in common however often some are repeated.

Tokens are the words between blanks. A paragraph with a word of more than 16 characters is
cut into runs of at most 16 that hold no white space, and into single characters where a
script is written without blanks. A paragraph of one token counts as a pair of its own.

A text and its edited version begin with the same paragraphs; these are hashed once and
their sums added to both.

The next document is the next row by id, then by a hash of the text; after the last comes
the first. Rows are sorted over range partitions, written with their places, and each
partition gets the first row of the next one that has rows; ids may be dense, sparse,
hashed, repeated or null (a null id sorts first). Null texts are empty, repeated rows are
rows of their own, other columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Longs of four 16-bit lanes; lanes of 32 bits.
WIDE, LANES = 64, 128
EVEN = 0x0000FFFF0000FFFF
ODD = ~EVEN
MASK = (1 << 32) - 1
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LONGEST = 16
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,{LONGEST}}}"
#: Four bits of a hash in one long, 16 bits apart: sums below 2**15 stay apart and within a long.
QUAD = 0x0001000100010001
NO_ID = -(1 << 63)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, not for every time that it is named."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


# the vector of multisets


def wide_sum(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane by lane a + b (or a - b) modulo 2**16, four lanes to a long."""

    def lanes(x: Column, y: Column) -> Column:
        even = (x.bitwiseAND(_long(EVEN)) + y.bitwiseAND(_long(EVEN))).bitwiseAND(_long(EVEN))
        # halved, so that the upper lane's carry stays within a long
        half = lambda v: F.shiftrightunsigned(v.bitwiseAND(_long(ODD)), 16)
        odd = F.shiftleft((half(x) + half(y)).bitwiseAND(_long(EVEN)), 16)
        return even.bitwiseOR(odd)

    def less(y: Column) -> Column:  # the lanes' negatives
        even = (_long(0x0001000000010000) - y.bitwiseAND(_long(EVEN))).bitwiseAND(_long(EVEN))
        odd = F.shiftleft((_long(0x0001000000010000) - F.shiftrightunsigned(y.bitwiseAND(_long(ODD)), 16)).bitwiseAND(_long(EVEN)), 16)
        return even.bitwiseOR(odd)

    return F.zip_with(a, b if sign > 0 else F.transform(b, less), lanes)


def wide_lanes(paragraphs: Column) -> Column:
    """Sum of the 256 lanes of each of an array of paragraphs, as 64 longs."""
    even = lambda x: x.bitwiseAND(_long(EVEN))

    def summed(x: Column) -> Column:
        low = F.aggregate(x, _long(0), lambda s, v: even(s + even(v)))
        high = F.aggregate(x, _long(0), lambda s, v: even(s + even(F.shiftrightunsigned(v, 16))))
        return low.bitwiseOR(F.shiftleft(high, 16))

    # each long over all paragraphs, so that no array is made for each of them
    one = lambda d: lambda k: _once(F.transform(d, lambda x: F.xxhash64(x, k)), summed)
    digests = F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 256))
    return _once(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), one(d)))


# the vector of likeness


def token_pairs(paragraphs: Column) -> Column:
    """Array of (h, c): hash and count of each distinct token pair of each paragraph."""
    each = lambda t: F.transform(t, lambda w, i: F.xxhash64(w, F.get(t, i + 1)))
    inner = lambda h: F.when(F.size(h) > 1, F.slice(h, 1, F.size(h) - 1)).otherwise(h)
    longer = lambda x: (F.octet_length(x) > LONGEST) & (F.length(x) > LONGEST)

    def counted(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return _once(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(h, at).alias("h"), (F.coalesce(F.get(s, k + 1), F.size(h)) - at).alias("c"))))

    def of(paragraph: Column) -> Column:
        words = F.array_remove(F.split(paragraph, " "), "")
        cut = F.regexp_extract_all(paragraph, F.lit(TOKEN), F.lit(0))
        hashes = _once(words, lambda w: F.when(F.exists(w, longer), _once(cut, each)).otherwise(each(w)))
        return _once(_once(hashes, lambda h: F.sort_array(inner(h))), lambda h: F.when(F.size(h) > 0, counted(h)))

    return F.flatten(F.filter(F.transform(paragraphs, of), lambda p: p.isNotNull()))


def signed(lanes: Column) -> Column:
    """Lanes modulo 2**32 as whole numbers around 0."""
    return F.transform(lanes, lambda x: F.shiftright(F.shiftleft(x, 32), 32))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of signed lanes, from 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def of(x: Column, y: Column) -> Column:
        norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm)))

    a, b = (c.cast("array<double>") for c in (a, b))
    return _once(a, lambda x: _once(b, lambda y: of(x, y)))


# fingerprints: structs of both vectors


def fingerprint(wide: Column, lanes: Column) -> Column:
    return F.struct(wide.alias("wide"), lanes.alias("lanes"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after insertion (with sign -1 removal) of paragraphs of fingerprint b."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + sign * y).bitwiseAND(_long(MASK)))
    return fingerprint(wide_sum(a["wide"], b["wide"], sign), lanes)


def subtract(a: Column, b: Column) -> Column:
    return add(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """What two fingerprints have in common, from 0 to 1; 1 for equal multisets."""
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).otherwise(cosine(signed(a["lanes"]), signed(b["lanes"])))


def fingerprint_text(a: Column) -> Column:
    digits = lambda c, n: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.base64(F.unhex(F.concat(digits(a["wide"], 16), digits(a["lanes"], 8))))


def share(version: int | None, paragraphs: Column) -> Column:
    """Paragraphs of one version of a text, or of version 0 and version 1 (None)."""
    return F.struct(F.lit(version).cast("int").alias("version"), paragraphs.alias("paragraphs"))


def summed_versions(rows: DataFrame, key: list[str], shares: Column, carried: list[str]) -> DataFrame:
    """key and carried with a row for each version of a text and its fingerprint.

    shares is an array of ``share``; the paragraphs that two versions have in common are
    hashed once. key must name each row; rows are grouped where they are if rows is dealt
    by a part of key.
    """
    shared = rows.select(*key, *carried, F.explode(shares).alias("__s")).select(*key, *carried, F.col("__s.version").alias("__version"), F.col("__s.paragraphs").alias("__paragraphs"))
    # arrays are made before the explode, which is then compiled
    first = F.struct(wide_lanes(F.col("__paragraphs")).alias("__wide"), *carried)
    made = shared.select(*key, "__version", first.alias("__first"), token_pairs(F.col("__paragraphs")).alias("__pairs"))
    exploded = made.select(*key, "__version", "__first", F.posexplode_outer("__pairs").alias("__at", "__p"))
    # the weight, in halves; its sums stay below 2**31, as a string has less than 2**30 tokens
    weight = F.when(F.col("__p.c") == 1, _long(2)).otherwise(F.coalesce(F.floor(2 * F.sqrt("__p.c") + 0.5), _long(0)))
    at = F.coalesce(F.col("__at"), F.lit(0))
    # only the first pair carries the wide lanes and what else belongs to the row
    of_first = F.when(at == 0, F.col("__first")).alias("__first")
    hashes = exploded.select(*key, "__version", of_first, at.alias("__at"), weight.alias("__w"), F.coalesce("__p.h", _long(0)).alias("__h0")).withColumn("__h1", F.xxhash64("__h0"))
    # four bits to a long: sums of 2,048 weights of up to 15 stay below 2**15, a greater weight has sums of its own
    few = hashes.withColumn("__few", F.when(F.col("__w") > 15, -1 - F.col("__at")).otherwise(F.shiftright("__at", 11)))
    bits = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(_long(QUAD)) * F.col("__w")).alias(f"{h}_{j}") for h in ("__h0", "__h1") for j in range(16)]
    counted = few.groupBy(*key, "__version", "__few", "__first").agg(F.sum("__w").alias("__n"), *bits)
    # two counts to a long
    names = [(f"{h}_{j}", f"{h}_{j + 16 * k}", 16 * k) for h in ("__h0", "__h1") for k in range(2) for j in range(16)]
    pairs = [F.sum(F.shiftrightunsigned(name, by).bitwiseAND(_long(EVEN))).alias(to) for name, to, by in names]
    versions = F.when(F.col("__version").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("__version"))
    each = counted.withColumn("__version", F.explode(versions))
    summed = each.groupBy(*key, "__version").agg(F.sum("__n").alias("__n"), F.collect_list("__first").alias("__first"), *pairs)
    lane = lambda count: (2 * count - F.col("__n")).bitwiseAND(_long(MASK))
    sums = [F.col(to) for _, to, _ in names]
    lanes = F.array(*[lane(s.bitwiseAND(_long(MASK))) for s in sums], *[lane(F.shiftrightunsigned(s, 32)) for s in sums])
    whole = F.aggregate("__first.__wide", F.array_repeat(_long(0), WIDE), lambda s, w: wide_sum(s, w))
    one = F.col("__first")[0]
    return summed.select(*key, *[one[c].alias(c) for c in carried], "__version", fingerprint(whole, lanes).alias("fingerprint"))


def fingerprints(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep with the fingerprint of each row's text.

    keep must name each row; rows are grouped where they are if rows is dealt by a part
    of keep.
    """
    own = share(0, paragraphs(F.coalesce(F.col(text_col), F.lit(""))))
    return summed_versions(rows, keep, F.array(own), []).select(*keep, "fingerprint")


def placed_rows(docs: DataFrame) -> DataFrame:
    """docs (id, text) with part and seq, their place in the order of ids.

    Each part is a range partition; equal ids lie in order of a hash of the text, and
    equal rows in order of the input partition, so no key is too large for a part.
    """
    ordered = docs.orderBy("id", F.xxhash64("text"), F.spark_partition_id())
    place = F.monotonically_increasing_id()
    placed = written(ordered.select("id", "text", place.alias("place")), "placed", **{"parquet.enable.dictionary": "false"})
    return placed.select("id", "text", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(_long((1 << 33) - 1)).alias("seq"))


def with_next_parts(placed: DataFrame) -> DataFrame:
    """placed with the first row of each part also at the end of the part before.

    Adds borrowed, 1 for those rows. The table of parts has one row for each task that
    wrote rows.
    """
    parts = placed.where("seq = 0").select("part")
    order = W.orderBy("part")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = parts.select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(whole)).alias("to"))
    lent = placed.where("seq = 0").join(before, "part").select("id", "text", F.col("to").alias("part"), _long(1 << 40).alias("seq"), F.lit(1).alias("borrowed"))
    return placed.withColumn("borrowed", F.lit(0)).unionByName(lent)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter is the next one's head."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), _long(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = W.partitionBy("part").orderBy("seq")
    dealt = with_next_parts(placed_rows(docs)).repartition("part")
    paired = dealt.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut)
    edited = F.concat(kept, F.substr("next", F.lit(1), cut))
    # both versions begin with the paragraphs that lie before the last line end of what is kept
    begins = F.col("n_chars").cast("int") - cut - F.length(F.substring_index(kept, "\n", -1))
    cuts = paired.withColumns({"edited": edited, "begins": begins})
    rest = lambda text: paragraphs(F.substr(text, F.col("begins") + 1))
    same = F.when(F.col("begins") > 0, F.array(share(None, paragraphs(F.substr("text", F.lit(1), F.col("begins") - 1))))).otherwise(F.array())
    shares = F.concat(same, F.array(share(0, rest("text")), share(1, rest("edited"))))
    rows = cuts.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    made = summed_versions(rows, ["part", "seq"], shares, ["id", "borrowed", "n_chars", "sha"]).withColumnRenamed("__version", "edit")
    # a row, its edited version and the next row follow each other
    along = W.partitionBy("part").orderBy("seq", "edit")
    one = made.withColumn("e", F.lead(F.struct("fingerprint", "sha"), 1).over(along)).withColumn("x", F.lead("fingerprint", 2).over(along)).where("borrowed = 0 and edit = 0")
    return one.select(
        F.when(F.col("id") == NO_ID, F.lit(None).cast("long")).otherwise(F.col("id")).alias(id_col), "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        fingerprint_text(F.col("fingerprint")).alias("fingerprint"), fingerprint_text(F.col("e.fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("e.fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("x")).alias("near_next"),
    )
