"""Mixing of sources against a plain water filling and the block rules."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, bucket int, size int"


def targets_of(sizes: dict, weights=(5, 2, 1), most=3.0) -> dict:
    """Targets by resharing the excess until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: most * sizes[s] for s in above}


def rows_of(spec: dict) -> list[tuple]:
    rows, doc = [], 0
    for source, docs in spec.items():
        for n in docs:
            text = None if n is None else " ".join(f"{source}{doc}w{i}" for i in range(n))
            rows.append((doc, text, source, "en", len(text or ""), 7, 8))
            doc += 1
    return rows


SPECS = {
    "capped": {"a": [5, 3], "b": [4000, 10, None, 0], None: [900] * 5, "c": [300] * 20, "B": [1]},
    "wordless": {"a": [0, None], "b": [0]},
    "plain": {"s%02d" % i: [40 + i] * 30 for i in range(7)},
}


@pytest.mark.parametrize("name", SPECS)
def test_mix(spark, name):
    rows = rows_of(SPECS[name])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.mix(docs).collect()
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(2)).collect()}
    assert {r.doc_id: r.taken for r in got} == again
    sizes = defaultdict(int)
    for d, text, source, *_ in rows:
        sizes[source] += len(brute.words_of(text))
    want = targets_of(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(brute.words_of(rows[r.doc_id][1]))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * 64 + 0.02 * want[s]


def test_mixed_documents_take_the_same_words(spark):
    rows = rows_of(SPECS["capped"])
    rows += [rows[6], rows[6]]  # copies of a whole row
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken = defaultdict(int)
    for r in M.mix(docs, block_words=16).collect():
        taken[r.doc_id] += r.taken
    out = M.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    words = defaultdict(int)
    seen = Counter()
    for r in out.collect():
        own = brute.words_of(r.text)
        words[r.doc_id] += len(own)
        assert len(r.text or "") == (r.n_chars or 0) and (own or rows[r.doc_id][1] in (None, ""))
        seen.update(own)
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in taken.items() if n}
    assert max(seen.values()) <= 9  # three times, of three copies
    assert M.mixed_documents(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    index = spark.range(n).select(M._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
    values = [r.p for r in index.collect()]
    assert sorted(values) == list(range(n))
    if n >= 97:
        assert values != sorted(values)


def test_native_plan(spark):
    docs = spark.createDataFrame(rows_of(SPECS["plain"]), SCHEMA)
    for df in (M.mix(docs), M.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_uses_of_blocks_stay_off_the_driver(spark):
    """The table of blocks grows with the words: it is never broadcast, however small it looks."""
    docs = spark.createDataFrame(rows_of(SPECS["plain"]), SCHEMA)
    for df in (M.mix(docs), M.mixed_documents(docs)):
        plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        joins = [line for line in plan if "Join [source_number#" in line and "block#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_documents_without_words_are_dealt_out(spark):
    """They share no join key, and each keeps its row."""
    rows = [(i if i % 3 else None, "" if i % 2 else None, "s", "en", 0, 7, 8) for i in range(400)]
    docs = spark.createDataFrame(rows + rows_of({"t": [200]}), SCHEMA)
    used = M._uses_of_documents(M._sized(docs), (1,), 1.0, 3.0, 64, 1 << 16, 0).where("size = 0")
    assert used.count() == 400 and used.where("uses = 0 and words = 0").count() == 400
    assert used.select("block").distinct().count() > 100
    assert M.mix(docs).count() == 401
