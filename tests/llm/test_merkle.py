"""Merkle manifests against a plain version that builds every level in lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, idx string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row[:5]
    n = n + more if n is not None else None
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(leaves):
    """Levels from the leaves to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(sibling or None, whether it is on the left) from leaf i upwards."""
    for level in levels[:-1]:
        beside = i ^ 1
        yield (level[beside] if beside < len(level) else None), i % 2 == 1
        i //= 2


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in sorted(rows, key=lambda r: ((r[2] is not None, (r[2] or "").encode()), first(r[0]), leaf(r))):
        groups.setdefault(r[2], []).append(r)
    trees = {g: tree([leaf(r) for r in own]) for g, own in groups.items()}
    top = tree([t[-1][0] for t in trees.values()])
    for k, (g, own) in enumerate(groups.items()):
        for i, r in enumerate(own):
            steps = [*path(trees[g], i), *path(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, hit)
            for beside, left in steps:
                h = sha((beside or "") + h if left else h + (beside or ""))
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(b or "" for b, _ in steps)), h, h == top[-1][0]


def odd_rows():
    out = []
    for lang, n in (("de", 1), ("en", 2), (None, 5), ("fr", 64), ("é", 65), ("it", 130), ("-", 3)):
        out += [(1000 * len(out) + i, f"text {i}" if i % 5 else None, lang, "s" if i % 3 else "", None if i % 11 == 3 else i) for i in range(n)]
    return [(*r, "x", "y") for r in [*out, *out[3:6], (None, "", "fr", None, 3), (None, "-", None, "-", None), (7, "a" * 200_000, "fr", "s", 7)]]


@pytest.mark.parametrize("stride", [2, 6])
def test_manifest_equals_plain_version(spark, stride):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = merkle.ascend(*merkle.build(docs, claimed=merkle.tampered(), stride=stride), stride=stride)
    hexed = lambda c: F.lower(F.hex(c))
    got = found.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(hexed("proof").cast("binary"), 256), hexed("folded"), F.expr("folded = root"))
    want = sorted(plain(rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {True, False} == {w[-1] for w in want}


def test_small_manifests(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_rows(none).collect() == []
    one = [(5, "t", "en", "s", 1, None, None)]
    assert [tuple(r) for r in merkle.verified_rows(spark.createDataFrame(one, SCHEMA)).collect()] == list(plain(one))
    groups = [(i, "t", f"l{i:03}", "s", 1, None, None) for i in range(70)]  # more trees than one block holds
    got = merkle.verified_rows(spark.createDataFrame(groups, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(plain(groups))
    same = [(5, "t", "en", "s", 1, None, None)] * 9
    assert sorted(map(tuple, merkle.verified_rows(spark.createDataFrame(same, SCHEMA)).collect())) == sorted(plain(same))


def test_any_change_is_found(spark):
    rows = [(i, f"t{i}", "en", "s", i, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    other = [F.col("doc_id") == 3, "doc_id", "source", "lang", "n_chars", "text"]
    for column, value in (("text", "t4"), ("source", None), ("n_chars", 4)):
        claimed = [other[0], *[F.lit(value) if c == column else F.col(c) for c in other[1:]]]
        found = merkle.ascend(*merkle.build(docs, claimed=claimed)).where("folded <> root").collect()
        assert [r.doc_id for r in found] == [3]
