"""The stages on small inputs, each on its own input, and SQL answers of the operators."""

from __future__ import annotations

import brute
import pytest
from check_oracle import compare, connect
from conftest import SMALL_DATA

import __spark_entry__ as entry
import corpus_pipeline as P
from shopmetrics.llm import queries
from shopmetrics.sources.staging import stage as stage_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, "x " + base, base.replace("w50", "q"), "short", "short", None, "", "else " * 30]
    docs = docs_of(spark, texts)
    got = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    want = brute.jaccard_components(list(enumerate(texts)), 5, 80, 100)
    assert got == {d for d, (_, c) in want.items() if c == d} == {0, 3, 5, 6, 7}


def test_near_duplicates_by_row(spark):
    """Repeated rows stay once; rows that share a doc_id are decided one by one."""
    base = " ".join(f"w{i}" for i in range(100))
    clean = " ".join(f"c{i}" for i in range(100))
    rows = [(1, base, "en"), (1, base, "de"), (2, base + " x", "en"), (2, clean, "en"),
            (3, "", "en"), (None, base, "en"), (None, base, "en")]
    docs = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], DOCS)
    got = [(r.doc_id or 0, r.text, r.lang) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    want = [(0, base, "en"), (0, base, "en"), (1, base, "de"), (2, clean, "en"), (3, "", "en")]
    assert sorted(got) == want


def test_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["one\n " + passage, passage + " two", "three  words\nstay", None]
    got = {r.doc_id: r for r in P.cut_repeats(spark, docs_of(spark, texts), "").collect()}
    assert [got[i].text for i in range(4)] == [texts[0], "two", texts[2], None]
    assert got[1].n_chars == 3


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL_DATA}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage_table(stage(spark, before, SMALL_DATA), f"test-{name}")
        assert after.columns == docs.columns and after.count() > 0
        if name != "source_mixing":
            assert after.count() <= before.count()
        before = after
    pieces = P.STAGES[-1][1](spark, before, SMALL_DATA).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SMALL_DATA), name, SMALL_DATA) == ""


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    found = entry.queries()
    assert all(sum(q.startswith(n) for q in found) == 1 for n in names) and "pipeline" in found
