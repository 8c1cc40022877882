"""Substring deduplication and the similarity join against brute force."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import jaccard_join as J
from shopmetrics.llm import substring_dedup as S
from shopmetrics.llm import words as W

SCHEMA = "doc_id long, text string, n_words string, key int"


def corpus(seed: int, n: int) -> list[tuple]:
    """Random texts with passages, copies and near copies, and odd cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ünï", "a", "B,"]
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [draw(rng.randint(5, 60)) for _ in range(8)]
    base = draw(120)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6:
            words = draw(rng.randint(0, 40)) + rng.choice(passages) + draw(rng.randint(0, 20))
            words += rng.choice(passages)
        else:
            words = draw(rng.randint(0, 80))
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += [None, "", "   \n", "one", "One two", "one  two", base[0], " ".join(["x"] * 4000)]
    texts += [" ".join(base)] * 5 + [" ".join(["x"] * 50), "a b c\x0bd\x0ce"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "kept out", 1) for d, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed, 120)
    out = S.substring_dedup(frame(spark, rows), 13)
    assert out.columns == ["doc_id", "text", "key", "n_words", "n_removed", "repeats", "kept_text"]
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(rows, 13))
    for r in out.where("n_removed > 0").collect():
        assert sum(x.length for x in r.repeats) == r.n_removed
        assert all(x.length >= 13 for x in r.repeats)
        ends = [(x.start, x.start + x.length) for x in r.repeats]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_substring_dedup_small_steps(spark, monkeypatch):
    """Runs that cross Arrow batches give the same result."""
    rows = corpus(3, 60)
    want = sorted(brute.substring_dedup(rows, 4))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = S.substring_dedup(frame(spark, rows), 4)
        got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want


def test_substring_dedup_ids(spark):
    """Null ids and equal ids neither give nor take repeats among themselves."""
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (5, long), (5, long), (5, long + " x"), (7, "y " + long)]
    out = S.substring_dedup(frame(spark, rows), 13).collect()
    got = sorted((r.doc_id or 0, r.n_removed) for r in out)
    assert got == [(0, 0), (5, 0), (5, 0), (5, 0), (7, 20)]
    assert S.substring_dedup(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_join(spark, size, num, den):
    rows = corpus(4, 150)
    got = J.jaccard_join(frame(spark, rows), size, num, den).collect()
    want = brute.jaccard_components(rows, size, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_join_far_members(spark):
    """Links between sets that don't link to their signature's smallest set are found."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for d in range(1, 160):
        words = list(base)
        for _ in range(rng.randint(4, 9)):  # far from the base
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((2 * d, " ".join(words)))
        words[rng.randrange(200)] = "one"  # and a near one
        rows.append((2 * d + 1, " ".join(words)))
    got = J.jaccard_join(frame(spark, rows), 3, 90, 100).collect()
    want = brute.jaccard_components(rows, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 50


def test_jaccard_join_ids(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "A b c d e"), (9, None), (None, "q"), (8, "")]
    got = J.jaccard_join(frame(spark, rows), 3, 90, 100).collect()
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)
    assert found == [(0, 1, 0), (0, 3, 3), (3, 3, 3), (3, 3, 3), (8, 0, 8), (9, 0, 9)]
    assert J.jaccard_join(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_join_null_id_bridges(spark):
    """A near copy without an id links documents that don't link themselves."""
    one = [f"w{i}" for i in range(200)]
    bridge = ["x" if i in (20, 60, 100, 140) else w for i, w in enumerate(one)]
    two = ["y" if i in (40, 80, 120, 160) else w for i, w in enumerate(bridge)]
    rows = [(1, " ".join(one)), (None, " ".join(bridge)), (2, " ".join(two))]
    got = J.jaccard_join(frame(spark, rows), 5, 80, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1)]


def test_jaccard_join_pairs_of_many_signatures(spark):
    """A pair that meets in very many signatures is searched in few of them, and in one at least."""
    rng = random.Random(6)
    words = [f"s{j}" for j in range(J.SKETCH_WORDS)]
    held = {i: rng.sample(range(-300, 300), rng.choice([1, 5, 200, 300])) for i in range(60)}
    rows = [(s, i, i // 2, 400, *[7] * len(words)) for i in held for s in held[i]]
    schema = ", ".join(f"{c} long" for c in ["sign", "set_id", "root", "n_shingles", *words])
    near = J._with_earlier(spark.createDataFrame(rows, schema).repartition(5))
    once = (F.col("a_set_id") < F.col("b_set_id"), J._unmet())
    found = J._met_pairs(J._side(near, "a"), J._side(near, "b"), 80, 100, *once)
    got = [tuple(r) for r in found.collect()]
    shared = {
        (a, b): len(set(held[a]) & set(held[b]))
        for a in held for b in held if a < b and a // 2 != b // 2
    }
    assert set(got) == {pair for pair, n in shared.items() if n}
    assert len(got) < 2 * len(set(got)) < sum(shared.values()) / 10


def test_signatures_meet():
    """Any two sets within the allowed difference share a signature."""
    import numpy as np

    rng = np.random.default_rng(0)
    bands = J.Bands(80, 100)
    for size in [*range(5, 60), 200, 777]:
        one = rng.integers(0, 2**63, size, dtype=np.uint64)
        for extra, gone in [(0, size // 5), (1, size // 9), (size // 9, size // 9), (size // 5, 0)]:
            two = np.concatenate([one[gone:], rng.integers(0, 2**63, extra, dtype=np.uint64)])
            both = len(np.intersect1d(one, two))
            if 100 * both < 80 * (len(one) + len(two) - both):
                continue
            first = np.array([0, len(one), len(one) + len(two)])
            text, sign = J.signatures(np.concatenate([one, two]), first, bands)
            apart = len(one) + len(two) - 2 * both
            if apart:
                assert set(sign[text == 0].tolist()) & set(sign[text == 1].tolist())


def test_words_match_the_definition():
    import pyarrow as pa

    texts = [None, "", " a  b c\td\x1ce ", "é\r\nf\x0bg\x0ch", "x"]
    found = next(W.slices(pa.array(texts)))[1]
    assert found.counts.tolist() == [len(brute.words_of(t)) for t in texts]
    again = next(W.slices(pa.array(["b c x"])))[1]
    assert found.hashes[1] == again.hashes[0] and found.hashes[-1] == again.hashes[1]
