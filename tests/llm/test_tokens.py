"""Tokens, packing and wavelet files."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopmetrics.llm import packing, wavelet
from shopmetrics.llm.tokens import Encoder, default_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "  x", "x  ", "a  b", " \n y", "foo\n \nbar", "a\nb.\nC", "don't we'll 's", "1a2 3.4",
    "<|endoftext|> a<|endoftext|>", "a\x1cb \x1c c", "日本 語", "é ́", "İ ſ ﬁ Σς", "​ a",
    "  a b", "#$%a&&& b^_`{|}~", "Straße ÀÉ ÿ µ ª", "\t\ttab  \t", "a\r\nb",
]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    encoder = Encoder.of(default_path(name))
    for text in ODD:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB é́\n\t 1.'sß \x1c<|>İ日"), max_size=30))
@pytest.mark.parametrize("name", FILES)
def test_any_text(name, text):
    encoder = Encoder.of(default_path(name))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text).tolist() == want


def test_level_grows_the_sum_of_squares_least():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(32)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        costs = {}
        for level in [0, *np.flatnonzero(packer.counts)]:
            if level + size <= 32:
                after = packer.counts.copy()
                if level:
                    after[level] -= 1
                if level + size < 32:
                    after[level + size] += 1
                costs[int(level)] = int((after**2).sum())
        assert costs[packer.level(size)] == min(costs.values())
        list(packer.add(0, np.zeros(size, dtype="<u2")))


def documents(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, ids int")


def test_packing(spark):
    path = default_path(FILES[0])
    texts = [None, "", "word " * 3000, *ODD, *[f"some text {i} " * (i % 90) for i in range(300)]]
    rows = [(i // 2 if i > 5 else None, t) for i, t in enumerate(texts)]
    pieces = packing.pack_documents(documents(spark, rows).repartition(3), path, 64, 0).collect()
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= total / 64 + 3
    encoder = Encoder.of(path)
    want = sorted([*encoder.encode(t or "").tolist(), 0] for _, t in rows)
    joined: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        # equal ids and lengths can't be told apart here, so sums are compared
        joined.setdefault((p.doc_id, p.doc_tokens), []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted(x for ids in joined.values() for x in ids) == sorted(x for w in want for x in w)
    assert packing.pack_documents(documents(spark, rows).limit(0), path).count() == 0


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (7, 2), (5000, 49408), (1025, 70000)])
def test_wavelet_matrix(size, top):
    ids = np.random.default_rng(size).integers(0, top, size).astype("<u4" if top > 65536 else "<u2")
    matrix = wavelet.WaveletMatrix.build(ids)
    assert (matrix.decode() == ids).all()
    for token in [0, int(ids[0]) if size else 3, top - 1, 1 << 20]:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert (matrix.occurrences(token) == places).all()
        for n in range(0, len(places), 7):
            assert matrix.select(token, n) == places[n]
        for place in range(0, size, 611):
            assert matrix.rank(token, place) == (ids[:place] == token).sum()
            assert matrix.access(place) == ids[place]
    with pytest.raises(IndexError):
        matrix.select(0, matrix.count(0))


def test_wavelet_files(spark):
    path = default_path(FILES[1])
    rows = [(i * 3 % 101, f"Text {i} " * (i % 40)) for i in range(200)] + [(None, "x"), (5, None)]
    docs = documents(spark, rows).repartition(4)
    folder, manifest = wavelet.write_tokens(docs, path, end_id=2, shard_bytes=4000)
    assert manifest.count() > 3
    got = wavelet.read_tokens(folder, manifest).collect()
    encoder = Encoder.of(path)
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for doc, text in order:
        ids = [*encoder.encode(text or "").tolist(), 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sorted(got, key=lambda r: r.start)] == want
    assert sorted(p.place for p in wavelet.find_token(folder, manifest, 2).collect()) == [
        s + n - 1 for _, s, n, _ in want
    ]
    folder, manifest = wavelet.write_tokens(docs.limit(0), path)
    assert wavelet.read_tokens(folder, manifest).count() == 0
    name = wavelet.write_tokens(docs, path, shard_bytes=4000)
    first = [r.sha256 for r in name[1].orderBy("shard").collect()]
    again = wavelet.write_tokens(docs.repartition(2), path, shard_bytes=4000)[1]
    assert first == [r.sha256 for r in again.orderBy("shard").collect()]


def test_damaged_file_is_noticed(spark):
    docs = documents(spark, [(1, "a b")])
    folder, manifest = wavelet.write_tokens(docs, default_path(FILES[1]))
    bad = manifest.withColumn("sha256", F.lit("0"))
    with pytest.raises(Exception, match="differs"):
        wavelet.read_tokens(folder, bad).collect()
