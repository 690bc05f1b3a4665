"""Search, sharding, packing, mixing, the pipeline, and the registered SQL."""

import glob
import itertools
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import exact_topk, language_id, mixing, near_dedup, packing, queries, sharding
from corpusloom.llm.common import BATCH_BYTES, written
from corpusloom.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_top_k_equals_brute_force(spark, parts):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, -0.3, 0.0, 0.2, 0.7]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf")]), (304, [1.0]), (305, []), (None, [1.0] * 6)]
    rows += [(0, [0.9] * 6), (20, rows[20][1]), (7, [0.7] * 6), (400, [2.0**40, 1.0, 0.0]), (401, [1e300, -1.0]), (402, [-(2.0**27)] * 6)]
    # scores between 2**60 and 2**63 in one part or in both, and parts that cancel
    rows += [(440, [2.0**25, 0.0, 0.0, 2.0**24]), (441, [2.0**25, 0.5, 0.0, 2.0**24]), (442, [-(2.0**25), 0.0, 0.0, 2.0**24, 0.0, 1.0]), (443, [2.0**25, 0.0, 0.0, -(2.0**24)])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "block": F.lit(2), "row": F.lit(3), "is_query": F.lit(4)})
    got = defaultdict(list)
    for x in exact_topk.top_k(v, F.col("vec_id") % 20 == 0, k=7, block=3, shard=16, parts=parts).orderBy("query_id", "rank").collect():
        got[x.query_id, x.query_row].append((x.score, x.vec_id))
        assert x.rank == len(got[x.query_id, x.query_row])
    whole = lambda e: [int(np.floor(64 * x)) if abs(x) < 2**53 else 64 * int(x) for x in e] + [0] * (6 - len(e))
    edges = [round(p * 6 / parts) for p in range(parts + 1)]
    clamp = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))
    product = lambda e, f: sum(clamp(sum(a * b for a, b in zip(e[i:j], f[i:j], strict=True))) for i, j in itertools.pairwise(edges))
    good = [(i, whole(e)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = Counter()
    for n, (q, e) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-product(e, f), i) for m, (i, f) in enumerate(good) if m != n)[:7]
            want[q, tuple((clamp(-s), i) for s, i in best)] += 1
    assert Counter((q, tuple(x)) for (q, _), x in got.items()) == want and want.total() == 14
    assert (64 * 64 * (2**50 + 2**48), 441) in got[next(x for x in got if x[0] == 440)]
    assert exact_topk.top_k(v.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = exact_topk.top_k(v.where("vec_id < 3"), F.col("vec_id") == 1, k=7)
    assert few.count() == 3


def test_rows_that_lists_send_do_not_grow_with_their_entries(spark, monkeypatch):
    from corpusloom.llm import common

    r, k, made, write = random.Random(5), 4, {}, common.written
    monkeypatch.setattr(common, "written", lambda df, name, **o: made.setdefault(name, write(df, name, **o)))
    monkeypatch.setattr(common, "dropped", lambda *tables: None)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(1200)], "vec_id long, embedding array<double>")
    assert exact_topk.top_k(v, F.col("vec_id") % 100 == 0, k=k, shard=30).count() == 12 * k
    lists = 12 * 40 * exact_topk.PARTS  # queries, shards, parts
    assert made["best-entries"].count() <= lists and made["sufficient-entries"].count() <= lists
    assert made["best-entries"].agg(F.sum(F.size("vrows"))).first()[0] <= lists * 3  # of 80 = 20 * k a list, two and one for the query's own row


def test_sharding(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), target_bytes=1 << 20)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 50)).alias("text"))
    for i in range(5):
        table.append(rows(i * 100, i * 100 + 100).coalesce(1))
    assert table.versions() == [1, 2, 3, 4, 5] and table.manifest().count() == 5
    before = table.manifest(5).collect()
    last = table.compact()
    assert last == 6 and table.manifest().count() == 1 and table.manifest(5).collect() == before
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows(0, 500).collect()))
    assert table.read(2).count() == 200  # older versions stay readable
    assert table.commit(table.manifest(), lambda: False) is None
    table.append(rows(0, 0))
    assert table.versions()[-1] == 7 and table.read().count() == 500
    table.vacuum()
    assert table.versions() == [7] and table.read().count() == 500 and len(glob.glob(str(tmp_path / "t/data/*/*.parquet"))) == 1
    table.append(rows(500, 600))  # versions go on after older ones were summed up
    assert table.versions() == [7, 8] and table.read(7).count() == 500 and table.read().count() == 600
    odd = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, None), (2, "", 6)], "doc_id long, text string, __arrival int")
    assert Counter(map(tuple, sharding.shard(odd).read().collect())) == Counter(map(tuple, odd.collect()))
    empty = sharding.shard(rows(0, 0))
    assert empty.read().collect() == [] and empty.read().columns == ["doc_id", "text"]


def test_columns_that_come_and_widen(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), target_bytes=1 << 20)
    assert table.read().collect() == [] and table.read().columns == []
    table.append(spark.createDataFrame([], "x int, z string"))
    assert table.read().dtypes == [("x", "int"), ("z", "string")] and table.read().collect() == []
    table.append(spark.createDataFrame([(1, "a")], "x int, z string"))
    table.append(spark.createDataFrame([(2, "b", 0.5)], "x int, z string, y float"))
    table.append(spark.createDataFrame([(1 << 40, 0.1)], "x long, y double"))
    want = [(1, "a", None), (2, "b", 0.5), (1 << 40, None, 0.1)]
    told = lambda v=None: sorted((tuple(r) for r in table.read(v).select("x", "z", "y").collect()), key=repr)
    assert [x[:2] for x in told()] == sorted((x[:2] for x in want), key=repr) and table.read(2).dtypes == [("x", "int"), ("z", "string")]
    for wrong in ("x string", "x int, z int", "y boolean"):
        with pytest.raises(ValueError):
            table.append(spark.createDataFrame([], wrong))
    table.append(spark.createDataFrame([(None, "c")], "x tinyint, z string"))
    table.compact()
    assert table.manifest().where("rows > 0").count() == 1
    table.vacuum()
    assert [x[:2] for x in told()] == sorted((x[:2] for x in [*want, (None, "c", None)]), key=repr) and table.read().dtypes[0] == ("x", "bigint")


def test_two_first_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    tables = [sharding.ShardedTable(spark, str(tmp_path / "t")) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: tables[i].append(spark.range(i, i + 1).coalesce(1)), range(3)))
    assert sorted(r.id for r in tables[0].read().collect()) == [0, 1, 2] and tables[0].versions() == [1, 2, 3]
    other = sharding.ShardedTable(spark, str(tmp_path / "t"))
    other.schema = lambda version=None: sharding.united([])  # it looked before the others came
    assert other.append(spark.createDataFrame([("a",)], "name string")) == 4


def test_two_writers(spark, tmp_path):
    table, other = (sharding.ShardedTable(spark, str(tmp_path / "t"), target_bytes=1 << 20) for _ in range(2))
    rows = lambda a: spark.range(a, a + 10).select(F.col("id").alias("doc_id")).coalesce(1)
    for i in range(4):
        table.append(rows(i * 10))
    commit, seen = table.commit, []

    def late(changes, *more):
        """The other writer appends, vacuums and compacts before this one commits."""
        if not seen:
            seen.append(other.append(rows(100)))
            other.vacuum()
        return commit(changes, *more)

    table.commit = late
    assert table.append(rows(200)) == 6 and seen == [5]
    assert sorted(r[0] for r in table.read().collect()) == [*range(40), *range(100, 110), *range(200, 210)]
    seen.clear()

    def merged_before(changes, holds=lambda: True):
        if not seen:
            seen.append(other.compact())
        return commit(changes, holds)

    table.commit = merged_before
    table.compact()  # its merge is given up, as the other's stands
    assert table.read().count() == 60 and table.manifest().count() == 1
    table.vacuum()
    assert table.read().count() == 60 and len(glob.glob(str(tmp_path / "t/data/*/*.parquet"))) == 1
    with pytest.raises(Exception, match="no such"):
        table.append(rows(0).select(F.raise_error(F.lit("no such")).alias("doc_id")))
    assert not os.listdir(tmp_path / "t/intents") and table.read().count() == 60


def bins_of(plan):
    out = defaultdict(list)
    for length, low, high, each, first, offset in plan.intervals:
        for r in range(high - low):
            out[first + r // each].append((offset + r % each * length, length))
    return out


def fewest(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_packing_plan():
    r, excess = random.Random(1), 0
    for _ in range(200):
        items = sorted((r.randint(1, 20) for _ in range(9)), reverse=True)
        counts = Counter(items)
        plan = packing.plan(counts, 20)
        bins = bins_of(plan)
        assert Counter(n for b in bins.values() for _, n in b) == counts
        for b in bins.values():
            assert [o for o, _ in sorted(b)] == list(itertools.accumulate([0] + [n for _, n in sorted(b)]))[:-1] and sum(n for _, n in b) <= 20
        best = fewest(items, 20)
        excess += plan.bins - best
        reduced = packing.Plan(counts, 20)
        reduced.reduce()
        rest = sorted((k for k, n in reduced.left.items() for _ in range(n)), reverse=True)
        assert reduced.bins + fewest(rest, 20) == best  # the reduction loses nothing
    assert excess <= 4


def test_word_tokenizer_equals_tokenizer():
    w = WordTokenizer(packing.default_tokenizer(), most_words=50)
    r = random.Random(7)
    texts = ["don't we'll 's ''s '", "", "İ Σ ß é", "a<|endoftext|>b", "日本 x", "tab\tnbsp\xa0x"] + ["".join(r.choice("'srevlmtd aZ.,1½é\n") for _ in range(r.randint(0, 60))) for _ in range(300)]
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate({97: 98, 98: 97})
    texts += [f"{thue[:n]} {thue[:n].translate({97: 98, 98: 97})}" for n in (1024, 2048, 4096)]  # such words once shared a hash
    for text, ids in zip(texts, w.encode(texts), strict=True):
        assert ids.tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_table_stays_small():
    w = WordTokenizer(packing.default_tokenizer())
    w._learn = lambda keys, words: w.table.add(keys, np.full(len(words), 2), np.tile(np.arange(2, dtype=np.int32), len(words)))
    words = map("".join, itertools.product("abcdefghijklmnopqrst", repeat=5))
    most = 0
    while part := list(itertools.islice(words, 50_000)):  # 3.2 million words in all
        assert sum(map(len, w.encode([" ".join(part)]))) == 2 * len(part)
        most = max(most, sum(x.nbytes for x in (w.table.keys, w.table.slots, w.table.starts, w.table.ids)))
        if most > 40 << 20:
            break
    assert most <= 40 << 20


def test_texts_come_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    seen = lambda docs: docs.mapInArrow(sizes, "rows long, size long").collect()
    docs = spark.range(0, 1200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two "), 2500).alias("text"))
    for stage in (packing.pack_documents, language_id.keep_identified, near_dedup.without_near_duplicates):
        spark.conf.unset(BATCH_BYTES)
        stage(docs.withColumn("lang", F.lit("en")).limit(2))
        found = seen(docs)
        assert sum(r.rows for r in found) == 1200 and max(r.size for r in found) < 5 << 20
    spark.conf.set(BATCH_BYTES, "1m")  # the user's own size stays
    packing.pack_documents(docs.limit(2))
    assert max(r.size for r in seen(docs)) < 2 << 20
    spark.conf.unset(BATCH_BYTES)


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i * 3))) for i in range(60)] + [(100, None), (101, ""), (102, "one two " * 3000), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    packed = packing.pack_documents(docs, capacity=256, with_ids=True)
    found = packed.collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows)
    whole = defaultdict(list)
    for p in found:
        assert p.length == len(p.ids) <= 256 and p.start == 256 * p.piece
        whole[p.doc_id].append(p)
    for (i, ids), n in want.items():
        pieces = sorted((p.start, tuple(p.ids)) for p in whole[i])
        if len([k for k in want if k[0] == i]) == 1 and n == 1:
            assert sum((list(p) for _, p in pieces), []) == list(ids)
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(joined[p.sequence_id][p.offset : p.offset + p.length] == p.ids for p in found)
    assert sum(map(len, joined.values())) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack_documents(docs.limit(0)).collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_shares_shortages(spark):
    rows = [(i, "w " * 10, "en", f"s{i % 3}", 1) for i in range(300)] + [(1000 + i, "w " * 10, "de", "s3", 1) for i in range(2)]
    rows += [(2000, None, None, None, 0), (2001, "", "en", "s0", 0), (None, "a b", "en", "s0", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("x"))
    got = mixing.mix(docs, 1, 2, max_epochs=2, domains={}, languages={}).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    tokens = {r.source: r.n for r in got}
    # 3022 tokens, so a budget of 1511 in four equal domains; s3 has 20 in two epochs 40
    assert tokens["s3"] == 40 and all(480 < tokens[s] <= 491 for s in ("s0", "s1", "s2"))
    again = mixing.mix(docs, 1, 2, max_epochs=2, domains={}, languages={})
    assert sorted((r.doc_id or 0, r.epoch) for r in again.collect()) == sorted((r.doc_id or 0, r.epoch) for r in again.collect())
    assert mixing.mix(docs.limit(0)).collect() == []
    odd = docs.withColumns({"__domain": F.lit("x"), "__source": F.lit(3)})
    kept = mixing.mix(odd.union(odd.where("doc_id < 20")), 1, 2, max_epochs=2, domains={}, languages={})  # repeated rows, ties
    assert {(r["__domain"], r["__source"]) for r in kept.collect()} == {("x", 3)}
    assert all(r["n"] == 2 * (r["doc_id"] < 20) + (r["doc_id"] >= 20) for r in kept.where("doc_id < 300").groupBy("doc_id", "epoch").agg(F.count("*").alias("n")).collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in found.fetchall())


def pipeline_rows():
    """Documents with all that the stages look for, and what each stage should leave."""
    r = random.Random(12)
    docs = [x for x in duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 300 AND 2000 AND position(chr(10) IN text) = 0 AND n_chars > 300").fetchall()]
    words = {lang: sorted({w for t, k in docs if k == lang for w in t.split()}) for lang in ("en", "de", "fr", "es")}
    line = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    langs = list(words)
    passage = [line("en", 12) for _ in range(5)]
    rows = []
    for i in range(120):
        lang = langs[i % 4]
        lines = [line(lang, r.randint(16, 24)) for _ in range(6)]
        if i in (8, 20, 32):
            lines[2:2] = passage
        rows.append((i * 10, "\n".join(lines), lang, f"s{i % 3}"))
    near = rows[40][1].split(" ")
    near[50] = "changed"
    rows += [(2000, " ".join(near), "en", "s1"), (2001, rows[41][1], "de", "s1"), (rows[42][0], rows[43][1], "fr", "s2"), (2002, rows[44][1], None, None), (2002, rows[44][1], None, None)]
    rows += [(3000, None, "en", "s0"), (3001, "", None, "s0"), (3002, "123 !!", "de", "s0"), (3003, "Съешь ещё этих мягких французских булок, да выпей чаю", None, "s1"), (None, line("en", 30), None, None)]
    return rows, passage


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from .test_dedup import brute_components, brute_passages

    rows, passage = pipeline_rows()
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages, found = dict(corpus_pipeline.STAGES), {}
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        kept = written(stages[name](spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns, name
        found[name] = [tuple(x)[:4] for x in kept.collect()]
    texts = lambda rows: Counter((i, t) for i, t, *_ in rows)
    # languages: all but null, empty, without letters, in no known language; null ones filled
    want = [x for x in rows if x[1] and x[0] not in (3002, 3003)]
    assert texts(found["language_id"]) == texts(want)
    assert all(lang for _, _, lang, _ in found["language_id"])
    # lines: the passage stays once, in its first document; exact repeats of long texts go whole
    order = {k: n for n, k in enumerate(sorted({(x[0] if x[0] is not None else -(1 << 63), x[1]) for x in want}))}
    numbered = [(n, k[1]) for k, n in order.items()]
    lines = {n: "\n".join(x) for n, x in brute_passages(numbered).items()}
    want = Counter((x[0], lines[order[x[0] if x[0] is not None else -(1 << 63), x[1]]]) for x in want)
    want = Counter({k: n for k, n in want.items() if k[1].strip()})
    assert texts(found["line_dedup"]) == want
    # near duplicates: one row of each group
    left = sorted(want, key=lambda x: (x[0] is None, x[0] or 0))
    groups = brute_components(list(enumerate(t for _, t in left)), size=5)
    assert texts(found["near_dedup"]) == Counter(x for n, x in enumerate(left) if groups[n][1] == n)
    # mixing: the same rows as its SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", found["near_dedup"])
    told = con.execute(mixing.oracle(4, 5, 1)).fetchall()
    assert Counter(x[0] for x in found["mixing"]) == Counter(x[0] if x[0] is not None else None for x in told)
    # packing: each row's own ids, cut and placed without gaps, in as few sequences as the tokens allow and one
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t, *_ in found["mixing"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((p.doc_id, p.length) for p in packed) == ids and all(p.start == 0 for p in packed)
    spans = defaultdict(list)
    for p in packed:
        spans[p.sequence_id].append((p.offset, p.length))
    for span in spans.values():
        assert [o for o, _ in sorted(span)] == list(itertools.accumulate([0] + [n for _, n in sorted(span)]))[:-1] and sum(n for _, n in span) <= 2048
    assert len(spans) <= -(-sum(k[1] * n for k, n in ids.items()) // 2048) + 1


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for n, table in enumerate((docs, docs.withColumns({"__id": F.lit(1), "__key": F.lit("x"), "score": F.lit(2)}), spark.createDataFrame([(None, None, None, None, None), (1, "words", None, None, 5)], DOCS))):
        path = tmp_path / str(n)
        table.write.parquet(str(path / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(path)).count() <= 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, kept, SF), name)
        assert after.columns == columns, name
        assert after.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0, name
        kept = after
    packed = corpus_pipeline.run(spark, SF)
    spans = defaultdict(list)
    for p in packed.collect():
        spans[p.sequence_id].append((p.offset, p.length))
    assert all(sum(n for _, n in s) <= 2048 for s in spans.values())
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").distinct().collect()}
