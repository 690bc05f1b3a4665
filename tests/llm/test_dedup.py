"""Near duplicates, repeated lines and fingerprints against brute force."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints as fp
from corpusloom.llm import line_dedup as ld
from corpusloom.llm import near_dedup as nd
from corpusloom.llm.wordhash import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return {rows[i][0]: (len(sets[i]), low[find(i)]) for i in range(len(rows))}


def copies(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.choice([3, 10, 60, 200]))] for _ in range(12)]
    out = []
    for k in range(120):
        text = list(base[k % 12])
        for _ in range(r.choice([0, 0, 1, 2, 6]) * len(text) // 60):
            text[r.randrange(len(text))] = word()
        out.append((k, " ".join(text).upper() if k % 5 == 0 else " ".join(text)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = copies()
    want = brute_components(rows)
    for rounds in (0, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, block=8).collect()}
        assert got == want


def test_near_duplicates_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "a b", "x"), (4, "a b", "x"), (5, "A\tb", "x"), (None, "a b", "x"), (6, long, "x"), (7, long + " word", "x"), (8, "ä b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").withColumns({"n": F.lit(1), "bands": F.lit(2), "label": F.lit(3)})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True)], key=repr)
    assert nd.near_duplicates(docs.limit(0)).collect() == []
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    assert nd.without_near_duplicates(docs.limit(0)).collect() == []


def test_rows_are_told_apart_by_id_and_text(spark):
    t, u, x = ("".join(f"{w}{i} " for i in range(30)) for w in "tux")
    rows = [(3, t, 1), (5, t, 2), (5, u, 3), (7, x, 4), (7, x, 5), (7, x, 4), (None, u + "more", 6), (None, "only here", 7), (None, "only here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    got = sorted(((r.doc_id or 0), r.text) for r in nd.without_near_duplicates(docs).collect())
    assert got == sorted([(3, t), (5, u), (7, x), (0, "only here")])


def test_repetitive_words_do_not_collide(spark):
    thue = [0]
    while len(thue) < 4096:
        thue += [1 - k for k in thue]
    for n in (1024, 2048, 4096):
        one, two = "".join("ab"[k] for k in thue[:n]), "".join("ba"[k] for k in thue[:n])
        data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
        words, _ = word_hashes(data, np.array([0, len(data)]))
        assert words[0] != words[1]


def test_recall_just_above_the_threshold(spark):
    r = np.random.default_rng(11)
    factors, shifts = nd.register_coefficients(192 + nd.FINE)
    lost = tried = 0
    for n in (10, 50, 200, 900):
        for _ in range(60):
            shared = int(np.ceil(0.8 * n))  # similarity from 0.80 to 0.82
            pool = r.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = pool[: shared + (n - shared) // 2], np.concatenate([pool[:shared], pool[shared + (n - shared) // 2 :]])
            x, y = nd.set_sketch(a, factors, shifts)[None], nd.set_sketch(b, factors, shifts)[None]
            banded = (nd.band_keys(x[:, :192], 32) == nd.band_keys(y[:, :192], 32)).any()
            near = nd.joint_estimate(x[:, :192], y[:, :192], np.array([float(len(a))]), np.array([float(len(b))]))[0] >= 0.7
            fine = nd.same_share(x[:, 192:].astype(np.uint8), y[:, 192:].astype(np.uint8))[0] >= 0.8 - nd.FINE_MARGIN
            tried, lost = tried + 1, lost + (not (banded and near and fine))
    assert lost <= 0.01 * tried


def test_bucket_of_unlinked_members(spark):
    """Pages of one template, at a similarity of 0.76, share buckets and stay apart."""
    shared = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(shared + [f"own{i}x{k}" for k in range(60)])) for i in range(300)] + [(1000, " ".join(shared + [f"own7x{k}" for k in range(59)]))]
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == {i: 7 if i == 1000 else i for i, _ in rows}


def test_estimates_and_hashes():
    r = np.random.default_rng(3)
    factors, shifts = nd.register_coefficients(192)
    pool = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for j in (0.5, 0.8, 0.95):
        n = int(1000 * 2 * j / (1 + j))
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - n : 2000 - n])
        e = nd.joint_estimate(nd.set_sketch(a, factors, shifts)[None], nd.set_sketch(b, factors, shifts)[None], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(e - j) < 0.12
    union = nd.merge_registers(nd.set_sketch(pool[:900], factors, shifts), nd.set_sketch(pool[900:], factors, shifts))
    assert (union == nd.set_sketch(pool, factors, shifts)).all()  # registers merge by maximum
    data = np.frombuffer(b"Ab ab\x0bcAb  ", np.uint8)
    words, at = word_hashes(data, np.array([0, 6, 6, 11]))
    assert len(words) == 3 and words[0] == words[1] and list(at) == [0, 2, 2, 3] and len(shingle_hashes(words[:2], 4)) == 1


def brute_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        lines = text.split("\n")
        h = [hashlib.md5(x.encode()).hexdigest() for x in lines]
        long = [x.count(" ") + 1 >= ld.LONG_WORDS for x in lines]
        chunks = []
        for i, x in enumerate(lines):
            cut = i == 0 or long[i] or long[i - 1] or hashlib.md5(((h[i - 2] if i > 1 else "") + h[i - 1]).encode()).hexdigest()[0] in ld.ENDS
            if cut:
                chunks.append([])
            chunks[-1].append(i)
        kept = []
        for c in chunks:
            body = "\n".join(lines[i] for i in c)
            if len(c) > 1 or long[c[0]]:
                if body in seen:
                    continue
                seen.add(body)
            kept.append(body)
        out[doc_id] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.choice([2, 5, 30])))
    passages = [[line() for _ in range(r.randint(1, 5))] for _ in range(6)]
    rows = [(i, "\n".join(sum(([line()] if r.random() < 0.6 else r.choice(passages) for _ in range(8)), []))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n\n"), (104, rows[3][1]), (105, " ".join("long line".split() * 20)), (106, " ".join("long line".split() * 20))]
    docs = spark.createDataFrame([(*x, "en", "s", len(x[1] or "")) for x in rows], DOCS).withColumn("removed_lines", F.lit("x"))
    got = ld.dedup_lines(docs)
    found = {r.doc_id: r.text for r in got.collect()}
    assert found == brute_lines(rows) and found[106] == "" and found[105]
    assert all(r.n_chars == len(r.text or "") for r in got.collect())
    left = {r.doc_id for r in ld.without_repeats(docs).collect()}
    assert left >= {100, 101, 105} and 106 not in left


def brute_passages(rows, words=ld.LONG_WORDS):
    """Lines in any run of words or more that stands earlier, each run tried."""
    first, runs = {}, []
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        full = [(i, x, len(x.split())) for i, x in enumerate(lines) if x.split()]
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if sum(f[2] for f in full[a:b]) >= words:
                    key = tuple(f[1] for f in full[a:b])
                    at = (doc_id, full[a][0], full[b][0] if b < len(full) else len(lines))
                    runs.append((key, at))
                    first.setdefault(key, at)
    gone = {(i, k) for key, (i, a, b) in runs if i != first[key][0] or a >= first[key][2] for k in range(a, b)}
    return {i: [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone] for i, t in rows}


def test_passages_of_short_lines_go(spark):
    r = random.Random(8)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    planted = [[line(words) for _ in range(n)] for n, words in ((3, 20), (4, 13), (5, 12), (6, 10), (10, 20), (30, 2)) for _ in range(20)]
    around = lambda: [line(r.randint(1, 9)) for _ in range(r.randint(1, 4))]
    rows = [(k * 1000 + i, "\n".join(around() + p[: len(p) // 2] + [""] * (k == 2) + p[len(p) // 2 :] + around())) for i, p in enumerate(planted) for k in range(3)]
    rows.append((9000, "\n".join(["ten words of one line that stands here many times"] * 20)))
    got = {x.doc_id: x.text.split("\n") for x in ld.without_repeats(spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)).collect()}
    for i, p in enumerate(planted):
        assert set(p) <= set(got[i]) and not set(p) & {*got[1000 + i], *got[2000 + i]}
        for k in range(3):  # and nothing else goes
            assert [x for x in got[k * 1000 + i] if x not in p] == [x for x in dict(rows)[k * 1000 + i].split("\n") if x and x not in p]
    assert len(got[9000]) == 3
    pool = [line(n) for n in (1, 4, 8, 12, 30)]
    rows = [(i, "\n".join(r.choice([*pool, line(3), ""]) for _ in range(12))) for i in range(40)]
    found = {x.doc_id: x.text.split("\n") for x in ld.dedup_passages(spark.createDataFrame([(*x, "en", "s", 1) for x in rows], DOCS)).collect()}
    want = brute_passages(rows)
    for i, lines in found.items():  # chunks of few words go besides
        rest = iter(want[i])
        assert lines == [""] or all(x in rest for x in lines)
    assert sum(map(len, want.values())) - sum(map(len, found.values())) < 80  # and little else


def test_line_dedup_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage, "en", "s", 1), (1, passage, "en", "s", 1), (1, passage, "en", "s", 1), (2, passage + "\nmore", "en", "s", 1), (2, "other", "en", "s", 1)]
    got = sorted((str(r.doc_id), r.text) for r in ld.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", ""), ("1", ""), ("2", "more"), ("2", "other"), ("None", passage)]
    assert ld.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def brute_pairs(text):
    """Weight of each token pair, by paragraph."""
    out = {}
    for p in (text or "").split("\n"):
        words = [w for w in p.split(" ") if w]
        counts = {}
        for pair in [tuple(words[i : i + 2]) for i in range(max(len(words) - 1, min(len(words), 1)))]:
            counts[pair] = counts.get(pair, 0) + 1
        for pair, c in counts.items():
            out[pair] = out.get(pair, 0) + round(2 * c**0.5)
    return out


def brute_likeness(a, b):
    if sorted((a or "").split("\n")) == sorted((b or "").split("\n")):
        return 1.0
    x, y = brute_pairs(a), brute_pairs(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(2)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(r.randrange(-(1 << 60), 1 << 60), "\n".join(line(r.choice([0, 1, 5, 30])) for _ in range(r.randint(1, 12)))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "x"), (5003, "same text here"), (5003, "same text here"), (5003, "other"), (5004, "\n\n"), (5005, "word " * 30_000)]
    rows += [(5006, "\n".join(reversed(rows[0][1].split("\n")))), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"part": F.lit("x"), "seq": F.lit(1), "id": F.lit(2), "fingerprint": F.lit(3)})
    got = fp.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    first = lambda x: -(1 << 63) if x is None else x
    by = {}
    for x in got:
        by.setdefault(first(x.doc_id), []).append(x)
    order = sorted(rows, key=lambda x: first(x[0]))
    off = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        if doc_id == 5003 or order[(i + 1) % len(order)][0] == 5003:
            continue  # repeated ids lie in any order
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        (one,) = by[first(doc_id)]
        assert (one.n_chars, one.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for found, want in ((one.near_edited, brute_likeness(text, edited)), (one.near_next, brute_likeness(text, after))):
            assert (found == 1.0) == (want == 1.0)
            off.append(abs(found - want))
    assert max(off) < 0.35 and sum(off) / len(off) < 0.06
    assert by[5000][0].fingerprint == by[5001][0].fingerprint and by[5000][0].near_next == 1.0
    # order of paragraphs does not matter, their number does, blank ones too
    assert by[5006][0].fingerprint == by[first(None)][0].fingerprint == by[rows[0][0]][0].fingerprint
    assert by[5004][0].fingerprint != by[5001][0].fingerprint
    assert len({x.fingerprint for x in by[5003]}) == 2
    assert fp.edited_fingerprints(docs.limit(0)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(None, "alone here")], "doc_id long, text string")).first()
    assert one.doc_id is None and one.near_next == 1.0


def test_fingerprints_grow_and_shrink(spark):
    r = random.Random(6)
    rows = []
    for i in range(40):
        lines = ["".join(r.choice("ab \t\u4e00") for _ in range(r.choice([0, 3, 40]))) for _ in range(r.randint(2, 9))]
        shuffled, cut = r.sample(lines, len(lines)), r.randint(1, len(lines) - 1)
        rows.append((i, "\n".join(lines), "\n".join(shuffled), "\n".join(lines[:cut]), "\n".join(lines[cut:])))
    rows.append((100, "alpha beta\n\ngamma delta", "alpha beta\ngamma delta\n", "alpha beta\n", "gamma delta"))
    t = spark.createDataFrame(rows, "id long, a string, b string, c string, d string").repartition(3, "id")
    made = t.select("id")
    for c in "abcd":
        made = made.join(fp.fingerprints(t, c, ["id"]).withColumnRenamed("fingerprint", c), "id")
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    a, b, c, d = (F.col(x) for x in "abcd")
    checks = made.select(same(a, b), same(fp.add(c, d), a), same(fp.subtract(a, d), c), same(fp.subtract(fp.add(a, b), b), a), fp.likeness(a, b) == 1)
    assert checks.count() == len(rows) and all(all(x) for x in checks.collect())


def test_lanes_wrap_without_carry(spark):
    lanes = [0xFFFF, 0x8000, 1, 0xFFFE]
    value = sum(x << 16 * i for i, x in enumerate(lanes))
    row = spark.createDataFrame([([value - (1 << 64)],)], "a array<long>")
    twice, none = row.select(fp.wide_sum(F.col("a"), F.col("a"))[0], fp.wide_sum(F.col("a"), F.col("a"), -1)[0]).first()
    assert [(twice >> 16 * i) & 0xFFFF for i in range(4)] == [2 * x & 0xFFFF for x in lanes] and none == 0


def generated_rows(plan):
    """Rows out of each Generate of an executed plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return generated_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return generated_rows(plan.plan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    return own + [n for p in below for n in generated_rows(p)]


def test_common_paragraphs_are_hashed_once(spark):
    r = random.Random(7)
    lines = lambda n, m: "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(m)) for _ in range(n))
    rows = [(i, lines(40, 20)) for i in range(20)]
    made = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    made.collect()
    pairs = 20 * 40 * 19
    assert max(generated_rows(made._jdf.queryExecution().executedPlan())) < 1.4 * pairs  # both texts of every row: 2 * pairs


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    texts = ["one line of words without an end", "a b\nc d\n", "\n\n\n\n", "abc\nd", "abcd\nefg", "\nabcdefg", "abcdefg\n", "x\n" * 500 + "last " * 4, "", "y", "two\nlines", "\n", "word " * 9000 + "\nend"]
    got = fp.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    both = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(zip(texts, edited))], "id long, t string, e string").repartition(2, "id")
    for c, column in (("t", "fingerprint"), ("e", "edited_fingerprint")):
        want = dict(fp.fingerprints(both, c, ["id"]).select("id", fp.fingerprint_text(F.col("fingerprint"))).collect())
        assert {x.doc_id: x[column] for x in got} == want


def test_lanes_are_the_sums_of_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(70)]
    often = " ".join(" ".join(r.sample(words, 70)) for _ in range(3000))  # thousands of pairs that stand about 43 times each
    texts = [(1, often), (2, "same " * 20_000 + "\n" + "a b " * 900), (3, " ".join(map(str, range(9000)))), (4, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2, "id")
    hashed = dict(docs.select("id", fp.token_pairs(fp.paragraphs(F.col("text")))).collect())
    for i, found in fp.fingerprints(docs, "text", ["id"]).select("id", "fingerprint.lanes").collect():
        sums = [0] * 128
        second = dict(spark.createDataFrame([(p.h,) for p in hashed[i]], "h long").distinct().select("h", F.xxhash64("h")).collect()) if hashed[i] else {}
        for p in hashed[i]:
            for k, h in enumerate((p.h, second[p.h])):
                for j in range(64):
                    sums[j % 32 + 32 * k + 64 * (j // 32)] += round(2 * p.c**0.5) * (1 if h >> j & 1 else -1)
        assert found == [x % (1 << 32) for x in sums]
