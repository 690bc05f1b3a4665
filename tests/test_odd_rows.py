"""Registered queries against their SQL over tables with odd rows.

The smallest tables, in which a document that asks has no word of four letters (its query is
empty), some texts are empty, null or begin with a line break, and every document is there
again with an id greater by 100,000, so that each cites two others.
"""

import glob
import os

import duckdb
import pytest
from test_oracles import SF, plain

from corpusloom import adapters as ad
from corpusloom.operators import documents as dx
from corpusloom.plans import catalogue

TEXTS = "CASE doc_id WHEN 100 THEN 'A.' WHEN 101 THEN '' WHEN 102 THEN NULL WHEN 103 THEN chr(10) || text WHEN 104 THEN '  ' || chr(10) || text ELSE text END"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(p)[:-8]
        rows = f"SELECT * FROM '{p}'"
        if name == "documents":
            rows = f"SELECT doc_id + shift AS doc_id, {TEXTS} AS text, lang, source, n_chars FROM '{p}', (SELECT unnest([0, 100000])::BIGINT AS shift)"
        duck.execute(f"COPY ({rows}) TO '{root}/{name}.parquet'")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return duck, str(root)


def equals_its_sql(spark, odd, name):
    duck, root = odd
    df = catalogue.queries()[name](spark, root)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["t1_lexical_search", "t1_stored_index", "t1_partial_words", "j11_merge_rankings", "u1_union_candidates", "a21_fuse_candidates", "h6_rerank", "t12_diagnose", "t7_answer"])
def test_empty_query_equals_its_sql(spark, odd, name):
    equals_its_sql(spark, odd, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["t5_retrieve", "t5_stage_counts"])
def test_documents_that_cite_several_equal_their_sql(spark, odd, name):
    equals_its_sql(spark, odd, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_blank_titles_equal_their_sql(spark, odd):
    equals_its_sql(spark, odd, "f8_validate_source_values")
    docs = ad.documents(spark, odd[1]).where("doc_id in (101, 102, 103, 104)")
    told = {r.doc_id: r.violations for r in dx.violations(docs, ad.SOURCE_TYPES, ad.TRADITIONS).collect()}
    blank = ["title_blank", "content"]
    assert told == {101: blank, 102: blank, 103: ["title_blank"], 104: ["title_blank"]}  # the operator has them
