"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopmetrics.llm import resampling, running_crc, terms

DOCS = "doc_id long, text string, score string, __row int, n_words int, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def grams(text, most):
    w = words(text)
    return [
        zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(w) - n + 1)
    ]


def brute(rows, target, most, buckets, least, percent):
    have = [[g % buckets for g in grams(t, most)] for _, t in rows]
    s, t = Counter(sum(have, [])), Counter(g % buckets for x in target for g in grams(x, most))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    out = []
    for (doc, text), own in zip(rows, have):
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in own]
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = sum(gain) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), sum(gain), score, None, len(words(text))])
    able = sorted(
        (r for r in out if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], -r[1])
    )
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return out


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("most, buckets, least, percent", [(1, 10_000, 20, 10), (3, 7, 1, 100), (2, 50, 2, 0)])
def test_against_brute_force(spark, most, buckets, least, percent):
    rng = random.Random(most)
    vocabulary = ["Word", "é", "日本", "x1", "the", "of", "a" * 300]
    texts = [None, "", "...", "one", "a-b\tc\x00d", " lead", "end "] + [
        rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))
        for _ in range(150)
    ] + ["the " * 5000]
    rows = [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts)]
    rows += [(9, "repeated row " * 15)] * 40
    target = [None, "", "the word of é", "x1 x1 日本 日本"]
    docs = spark.createDataFrame([(d, t, "s", 3, 4, "en") for d, t in rows], DOCS).repartition(4)
    found = resampling.importance_resample(
        docs, spark.createDataFrame([(t,) for t in target], "text string"), most, buckets, least, percent
    )
    got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()]
    assert sorted(got, key=key) == sorted(map(tuple, brute(rows, target, most, buckets, least, percent)), key=key)


def test_carried_columns(spark):
    docs = spark.createDataFrame([(i, f"a b {i}", "s", 1, 2, "en") for i in range(10)], DOCS)
    target = spark.createDataFrame([("a",)], "text string")
    found = resampling.importance_resample(docs, target, least_words=1, percent=50, carry=["lang", "text"])
    drawn = found.where("rank is not null").collect()
    assert len(drawn) == 5 and all(r.text == f"a b {r.doc_id}" and r.lang == "en" for r in drawn)
    with pytest.raises(ValueError):
        resampling.importance_resample(docs, target, carry=["Score"])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resample(empty, empty).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = resampling.importance_resample(one, empty, least_words=1, percent=100).collect()
    assert (row.n_features, row["rank"]) == (3, 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.data())
def test_stretches(data, draw):
    """CRC of any stretch from two prefixes, also of a string scanned in two parts."""
    n = len(data)
    cut = draw.draw(st.integers(0, n))
    raw = np.frombuffer(data, dtype=np.uint8)
    first = running_crc.prefix_crcs(raw[:cut], np.arange(cut + 1))
    rest = running_crc.prefix_crcs(raw[cut:], np.arange(n - cut + 1), int(first[-1]))
    crcs = np.concatenate([first[:-1], rest])
    low = np.array(draw.draw(st.lists(st.integers(0, n), min_size=1, max_size=20)))
    high = np.minimum(n, low + draw.draw(st.integers(0, n)))
    got = crcs[high] ^ running_crc.shift(crcs[low], high - low)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(low, high)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é.\n日", max_size=40), max_size=6), st.integers(1, 4))
def test_features_in_parts(texts, most):
    whole = terms.PART_BYTES
    terms.PART_BYTES = 8
    try:
        for row, counts, text, found in resampling.feature_slices(pa.array(texts, pa.string()), most, 1 << 32):
            for i, n in enumerate(counts):
                assert n == len(words(texts[row + i]))
                assert sorted(found[text == i].tolist()) == sorted(grams(texts[row + i], most))
    finally:
        terms.PART_BYTES = whole
