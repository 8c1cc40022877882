"""Alignment of two tokenizers, against whole texts encoded one by one."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL_DATA
from shopmetrics.llm import aligned, alignment
from shopmetrics.llm.queries import op11_alignment
from shopmetrics.llm.varint import pack_lists, unpack_lists

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  x", "x  ", "a  b", " \n y", "foo\n \nbar", "a\nb.\nC", "don't we'll 's",
    "<|endoftext|> a<|endoftext|>", "<s> </s> x", "a\x1cb \x1c c", "日本 語", "é ́", "İ ſ ﬁ Σς",
    "▁a b", "a ▁ b", "a\x00b", "x\n\n\ny z", "　x \xa0y", "aaaa" * 50, "\r\n \r x", "\t\ttab  \t",
]


class Brute:
    """Whole texts by both libraries, groups and counts in plain Python."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def bytes_a(self, i):
        return bytes(self.letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        left, right = [self.bytes_a(i) for i in a], [self.bytes_b(i) for i in b]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([*map(len, left)]).tolist(), np.cumsum([*map(len, right)]).tolist()
        out, i, j = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            out.append((a[i:to_a], b[j:to_b]))
            i, j = to_a, to_b
        return out

    def table(self, rows):
        groups = [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
        counts = Counter(pair for own in links for pair in own)
        highest = defaultdict(int)
        for (a, _), n in counts.items():
            highest[a] = max(highest[a], n)
        for (doc, _), g, own in zip(rows, groups, links):
            shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                sum(n for p, n in own.items() if counts[p] == highest[p[0]]),
                sum(n * counts[p] for p, n in own.items()),
                hashlib.sha256(shown.encode()).hexdigest() if g else "",
            )


@pytest.fixture(scope="module")
def brute():
    return Brute()


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def same(df, want):
    got = sorted(map(tuple, df.collect()), key=key)
    assert got == sorted(want, key=key)


def test_odd_documents(spark, brute):
    """Null ids, repeated ids and rows, clashing columns, several tasks."""
    texts = [*ODD, *ODD, "word " * 4000, "no-break" * 3000, *[f"Some text {i}\nof, words {i % 7}." for i in range(200)]]
    rows = [(i // 2 if i > 5 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(
        [(d, t, "x", 1) for d, t in rows], "doc_id long, text string, groups_sha256 string, block int"
    ).repartition(3)
    want = list(brute.table(rows))
    same(alignment.align_documents(docs, PATH_A, PATH_B, block_bytes=200), want)


def test_small_blocks(brute, monkeypatch):
    """Counts of one block a document, in small pieces; large groups are counted by id."""
    rows = [(i, t) for i, t in enumerate([*ODD, "日本語" * 40, "=" * 400 + "-" * 300])] * 2
    for module, name, value in (
        (alignment, "PIECE", 5), (aligned, "RUN_CHARACTERS", 7),
        (aligned, "LISTED_LINKS", 1),
    ):
        monkeypatch.setattr(module, name, value)
    v = aligned.Vocabularies.of(PATH_A, PATH_B)
    vector = np.zeros(len(v.same), dtype=np.int64)
    counts: Counter = Counter()
    blocks = []
    for doc_id, text in rows:
        block = alignment._Block()
        block.add(doc_id, text)
        for rows_out in block.rows(v, len(blocks), vector):
            for r in rows_out.to_pylist():
                if r["kind"] == alignment.COUNT:
                    counts[r["code"]] += r["n"]
                if r["kind"] == alignment.DOCUMENT:
                    blocks.append(r)
    for a in np.flatnonzero(vector):
        counts[int(v.same[a])] += int(vector[a])
    want = Counter()
    for _, text in rows:
        want.update({a * v.n_b + b for g in [brute.groups(text)] for x, y in g for a in x for b in y})
    assert counts == want
    for r, w in zip(blocks, brute.table(rows)):
        assert (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == w[:5]
        assert r["groups_sha256"] == w[7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, PATH_A, PATH_B).collect() == []


def test_pairs(spark, brute):
    rows = [(1, "one two three"), (2, "one two"), (3, "tokenizers misalign")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b): r["count"] for r in alignment.Alignment(docs, PATH_A, PATH_B).pairs().collect()}
    want = Counter()
    for _, text in rows:
        want.update({(a, b) for x, y in brute.groups(text) for a in x for b in y})
    assert got == want


def test_whole_table(spark, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL_DATA}/documents.parquet").select("doc_id", "text").collect()]
    same(op11_alignment(spark, SMALL_DATA), list(brute.table(rows)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é́\n\t 1.'sß \x1c<|>İ日\r"), max_size=25), max_size=5))
def test_any_text(brute, texts):
    v = aligned.Vocabularies.of(PATH_A, PATH_B)
    block = alignment._Block()
    for text in texts:
        block.add(1, text)
    shown = aligned.align(v, list(block.index)).shown
    for text, chunks in zip(texts, block.chunks):
        want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute.groups(text))
        assert "".join([shown[i] for i in chunks])[:-1] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 50), min_size=1, max_size=8), max_size=6))
def test_packed_lists(lists):
    lists = [sorted(x) for x in lists]
    heads = np.cumsum([0, *map(len, lists)])[:-1]
    values, counts = unpack_lists(pack_lists(np.array(sum(lists, []), dtype=np.int64), heads))
    assert values.tolist() == sum(lists, []) and counts.tolist() == [*map(len, lists)]
