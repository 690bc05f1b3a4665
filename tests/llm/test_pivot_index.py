"""The permutation index: recall against brute force, exact answers where all is ranked anew."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pivot_index as pi
from corpusloom.llm import queries


def answers(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.query_row, r.rank)):
        got[r.query_id, r.query_row].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id, r.query_row])
    return got


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    rows = sorted(queries.table(spark, path, "embeddings").select("vec_id", "embedding").collect())
    v = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = answers(queries.op12_permutation_index(spark, path).collect())
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0).tolist():
        score = v @ v[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        (found,) = (x for (q, _), x in got.items() if q == ids[i])
        assert [x for _, x in found] == sorted((x for _, x in found), reverse=True) and len(found) == 20
        assert all(abs(x - v[j] @ v[i]) < 1e-12 for j, x in found)
        hits, total = hits + len(best & {j for j, _ in found}), total + 20
    assert hits / total >= 0.93, hits / total


def rows_of(r, n):
    rows = [(i, [r.choice([-1.0, -0.3, 0.2, 0.7]) * (1 + i % 3) for _ in range(5)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 5) for i in range(60)] + [(2000, None), (2001, [0.1, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2004, [0.0, 0.0]), (2005, []), (None, [1.0] * 5)]
    return [*rows, (0, [0.9] * 5), (20, rows[20][1]), (2006, [1.0, -0.0]), (2007, [3.0])]


@pytest.mark.parametrize("pivots", [1, 40])
def test_all_ranked_anew_equals_brute_force(spark, pivots):
    """With a width of all vectors nothing is left to chance: ties, copies, odd rows."""
    import random

    rows = rows_of(random.Random(3), 150)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "row", "cls", "is_query")})
    got = answers(pi.nearest_found(v, F.col("vec_id") % 20 == 0, k=7, pivots=pivots, width=1e9, block=3, shard=16).collect())
    good = [(i, np.array(e + [0.0] * (5 - len(e)))) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    want = []
    for n, (q, e) in enumerate(good):
        if q % 20 == 0:
            score = lambda f: float(np.einsum("ij,j->i", f[None, :], e)[0])  # noqa: B023, E731
            best = sorted((-score(f), i) for m, (i, f) in enumerate(good) if m != n)[:7]
            want.append((q, [(i, -s) for s, i in best]))
    assert sorted((q, x) for (q, _), x in got.items()) == sorted(want)


def test_few_and_none(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0, 1.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = answers(pi.nearest_found(v, F.col("vec_id") == 0, k=20).collect())
    assert list(got.values()) == [[(1, 2.0), (3, 1.0)]]
    assert pi.nearest_found(v.limit(0), F.col("vec_id") == 0).collect() == []
    assert pi.nearest_found(v, F.col("vec_id") == 9).collect() == []


def test_lengths_do_not_mislead(spark):
    """Long vectors are nearest by inner product; the further component keeps them in front."""
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 2.0, size=(3000, 1))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(pi.nearest_found(v, F.col("vec_id") % 60 == 0, k=10).collect())
    score = x[::60] @ x.T
    score[np.arange(50), np.arange(0, 3000, 60)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :10]
    assert np.mean([len(set(best[q // 60]) & {j for j, _ in f}) / 10 for (q, _), f in got.items()]) >= 0.9


def test_footrule():
    files = pi.Pivots.of(np.eye(4), 1.0).files(np.array([[4.0, 3, 2, 1], [1, 2, 3, 4]]) / 10)
    assert files.T.tolist() == [[0, 1, 2, 3], [3, 2, 1, 0]]
    assert pi.footrule(files, np.array([0, 1, 2, 3]), 4).tolist() == [0, 8] and pi.footrule(files, np.array([0, 1, 2, 3]), 1).tolist() == [0, 3]
