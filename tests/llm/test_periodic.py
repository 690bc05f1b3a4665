"""Runs of repeated words against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def runs_of(words):
    """(start, length, period) by the definition: maximal stretches, smallest periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def noisy_texts(count):
    r = random.Random(5)
    for _ in range(count):
        few, n, words = r.choice([1, 2, 2, 3, 5, 20]), r.randrange(0, r.choice([15, 40, 150])), []
        while len(words) < n:
            if words and r.random() < 0.4:
                words += words[-r.randrange(1, min(len(words), 40) + 1) :] * r.randrange(1, 8)
            else:
                words += [f"w{r.randrange(few if r.random() < 0.8 else 1000)}" for _ in range(r.randrange(1, 12))]
        yield words[:n]


def test_runs_equal_the_definition():
    texts = list(noisy_texts(1500))
    found, left = periodic.collapse([" ".join(w).encode() for w in texts])
    for words, runs, text in zip(texts, found, left, strict=True):
        assert runs == sorted(runs_of(words), key=lambda x: (x[0], x[2]))
        assert text == collapsed(words, runs)
    assert sum(map(len, found)) > 500


def test_splitting_loses_no_run_and_leaves_little():
    r = random.Random(2)
    words = np.array([r.randrange(4000) for _ in range(3000)] + list(range(20)) * 3 + [r.randrange(4000) for _ in range(3000)])
    kept = periodic.surviving_segments(words, np.zeros(len(words), int))
    assert sum(len(at) for at, _ in kept) < len(words)
    assert [tuple(x) for x in periodic.find_runs(words, np.zeros(len(words), int))] == runs_of(words.tolist())


@pytest.mark.parametrize("words", [[b"a"] * 200_000, [b"a", b"b"] * 100_000, [b"%d" % (i % 999) for i in range(200_000)]])
def test_long_runs_take_little_time(words):
    found, left = periodic.collapse([b" ".join(words)])
    q = len(set(words))
    assert found == [[(0, len(words), q)]] and left[0].split() == [w.decode() for w in words[:q]]


def test_odd_rows(spark):
    row = " ".join("abc" * 5)
    rows = [(1, None, "x"), (2, "", "y"), (None, row, None), (3, "a " * 11, "z"), (3, "a\t\n" * 12, "z"), (4, "é b " * 12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((tuple(x) for x in periodic.periodic_runs(docs).collect()), key=repr)
    want = [(1, [], ""), (2, [], ""), (None, [(0, 15, 3)], "a b c"), (3, [], " ".join("a" * 11)), (3, [(0, 12, 1)], "a"), (4, [(0, 12, 1)], "é b")]
    assert sorted(((i, [tuple(r) for r in runs], t) for i, runs, t in got), key=repr) == sorted(want, key=repr)
    assert periodic.digest(periodic.periodic_runs(periodic.edited(docs.limit(0)))).collect() == []
    clash = docs.withColumnRenamed("runs", "n_runs").withColumn("collapsed", docs.doc_id)
    assert periodic.periodic_runs(clash, "text").columns == ["doc_id", "n_runs", "runs", "collapsed"]


def test_query_equals_the_definition(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [r for r in queries.table(spark, SF, "documents").collect() if len(r.text or "") < 5000]
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted(runs_of(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and x.collapsed_sha256 == sha(collapsed(words, runs))
    assert len(rows) > 100 and sum(x.n_runs > 0 for x in got.values()) > 5
