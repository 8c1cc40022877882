"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes.

Method. Texts are encoded once by both tokenizers and cut into groups at the bytes
where tokens of both end (``aligned``). A group of one token each has equal bytes, so
its pair is that of a precomputed array from A ids to B ids of equal bytes (identity
map); how many documents hold such a pair is counted in a vector as long as A's
vocabulary, one for each task, and the vectors are added up. Only other pairs,
from groups of several tokens, enter a shuffle by pair, counted by block of documents
first. A block then asks for the counts of the pairs that it holds, gets them back in
one shuffle by block, and its documents' figures are added up from those of their
distinct chunks; no token pair of a single document is ever moved.

Bounds. A block is about ``BLOCK_BYTES`` of text (one text at least). Tasks get two vectors of A's vocabulary's
length: the counts of identity pairs and the highest count of each A id. The join that
answers blocks has a unique side; its hot pairs are split by adaptive execution.

Defined cases: null and empty texts, and texts whose tokens' joined bytes aren't a space
and the text (for example those that hold U+2581), have no tokens: zeros and ''. Each
row counts as one document, also if it repeats a doc_id or has none. Strings of special
tokens are plain text. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.aligned import SPACE_SIGN, Vocabularies, align, cut
from shopmetrics.llm.staged import stage_and_release
from shopmetrics.llm.varint import pack_lists, unpack_lists

BLOCK_BYTES = 8 << 20
# Pairs of documents that are told apart at once.
PIECE = 1 << 21

# Kinds of rows of the encoded table.
DOCUMENT, PAIRS, COUNT, VECTOR = range(4)
_FIELDS = [
    ("kind", "int", pa.int32()), ("block", "long", pa.int64()), ("doc_id", "long", pa.int64()),
    ("n_a", "long", pa.int64()), ("n_b", "long", pa.int64()), ("n_groups", "long", pa.int64()),
    ("n_links", "long", pa.int64()), ("groups_sha256", "string", pa.string()),
    # Of a document its chunks, ascending, and running numbers of their occurrences; of a
    # block's pairs their codes, (chunk, code) in one number, and running numbers of links.
    ("chunks", "binary", pa.binary()), ("times", "binary", pa.binary()),
    ("links", "binary", pa.binary()), ("code", "long", pa.int64()), ("n", "long", pa.int64()),
    ("vector", "array<long>", pa.list_(pa.int64())),
]
_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)


def _rows(size: int, kind: int, /, **columns: pa.Array) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(size, kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [columns[name] if name in columns else pa.nulls(size, t) for name, _, t in _FIELDS],
        names=[name for name, _, _ in _FIELDS],
    )


def _one(values: np.ndarray) -> pa.Array:
    """One ascending list as a single binary value."""
    return pack_lists(values, np.zeros(1, np.int64)) if len(values) else pa.array([b""])


def _runs_of(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] of them, for each i."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _documents_with(
    doc: np.ndarray, first: np.ndarray, count: np.ndarray, rank_of: np.ndarray, n_ranks: int
) -> np.ndarray:
    """Of each pair, the number of documents that hold it in any of their chunks."""
    total = np.zeros(n_ranks, dtype=np.int64)
    sums = np.cumsum(count)
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))  # of documents
    low = 0
    while low < len(doc):  # whole documents at a time
        fits = np.searchsorted(sums, (sums[low - 1] if low else 0) + PIECE, side="right")
        last = int(np.searchsorted(ends, fits, side="right")) - 1
        high = int(ends[max(last, int(np.searchsorted(ends, low, side="right")))])
        part = slice(low, high)
        ranks = rank_of[_expand(first[part], count[part])]
        held = np.unique(np.repeat(doc[part], count[part]) * max(n_ranks, 1) + ranks)
        total += np.bincount(held % max(n_ranks, 1), minlength=n_ranks)
        low = high
    return total


class _Block:
    """Documents encoded together."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.chunks: list[list[int]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        if not text or SPACE_SIGN in text:
            self.chunks.append([])
            return
        index = self.index
        self.chunks.append([index.setdefault(c, len(index)) for c in cut(text)])
        self.size += len(text)

    def rows(self, v: Vocabularies, block: int, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = align(v, list(self.index))
        n_docs, n_chunks = len(self.ids), len(found.good)
        bad = set(np.flatnonzero(~found.good).tolist())
        if bad:
            self.chunks = [[] if bad.intersection(c) else c for c in self.chunks]
        shown = found.shown
        digests = [
            hashlib.sha256("".join([shown[i] for i in c])[:-1].encode()).hexdigest() if c else ""
            for c in self.chunks
        ]
        size = np.array([len(c) for c in self.chunks], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *[np.array(c, np.int64) for c in self.chunks if c]])
        doc = np.repeat(np.arange(n_docs), size)
        sums = {}
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            sums[name] = np.zeros(n_docs, dtype=np.int64)
            np.add.at(sums[name], doc, getattr(found, name)[flat])
        held, times = np.unique((doc << 32) | flat, return_counts=True)
        doc, chunk = held >> 32, held & ((1 << 32) - 1)
        used = np.unique(chunk)
        first = np.searchsorted(found.pair_chunk, np.arange(n_chunks))
        pairs = np.bincount(found.pair_chunk, minlength=n_chunks)
        at = _expand(first[used], pairs[used])
        codes, rank = np.unique(found.pair_code[at], return_inverse=True)
        rank_of = np.zeros(len(found.pair_code), dtype=np.int64)
        rank_of[at] = rank
        n = _documents_with(doc, first[chunk], pairs[chunk], rank_of, len(codes))
        same = codes == v.same[codes // v.n_b]
        vector[codes[same] // v.n_b] += n[same]
        others = np.flatnonzero(~same)
        yield _rows(
            len(others), COUNT, block=pa.array(np.full(len(others), block)),
            code=pa.array(codes[others]), n=pa.array(n[others]),
        )
        # Chunks are numbered anew by their place among those used.
        place = np.searchsorted(used, chunk)
        own = np.repeat(np.arange(len(used)), pairs[used])
        order = np.argsort(own * max(len(codes), 1) + rank)
        yield _rows(
            1, PAIRS, block=pa.array([block]), chunks=_one(codes),
            times=_one((own * max(len(codes), 1) + rank)[order]),
            links=_one(np.cumsum(found.pair_links[at][order])), n=pa.array([len(used)]),
        )
        heads = _runs_of(doc)
        have = np.zeros(n_docs, dtype=bool)
        have[doc[heads]] = True
        running = np.cumsum(times)
        before = np.repeat((running - times)[heads], np.diff(np.append(heads, len(doc))))
        where = pa.array(np.where(have, np.cumsum(have) - 1, 0), mask=~have)
        yield _rows(
            n_docs, DOCUMENT, block=pa.array(np.full(n_docs, block)), doc_id=pa.array(self.ids, pa.int64()),
            **{name: pa.array(x) for name, x in sums.items()}, groups_sha256=pa.array(digests),
            chunks=pack_lists(place, heads).take(where), times=pack_lists(running - before, heads).take(where),
        )


def _encode(path_a: str, path_b: str, block_bytes: int):
    """Map task: the rows of its blocks, and at its end the vector of identity pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies.of(path_a, path_b)
        vector = np.zeros(len(v.same), dtype=np.int64)
        number = TaskContext.get().partitionId() << 33
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if block.size >= block_bytes:
                    yield from block.rows(v, number, vector)
                    number, block = number + 1, _Block()
        if block.ids:
            yield from block.rows(v, number, vector)
        if vector.any():
            yield _rows(1, VECTOR, vector=pa.array([vector.tolist()], pa.list_(pa.int64())))

    return run


def _figures(size_b: int, same: np.ndarray, counts: np.ndarray, highest: np.ndarray):
    """A block's documents with the sums over their links."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        docs = rows.take(pa.array(np.flatnonzero(kind == DOCUMENT)))
        pairs = rows.take(pa.array(np.flatnonzero(kind == PAIRS)))
        codes, _ = unpack_lists(pairs.column("chunks"))
        n_chunks = pairs.column("n")[0].as_py()
        key, _ = unpack_lists(pairs.column("times"))
        links, _ = unpack_lists(pairs.column("links"))
        links = np.diff(links, prepend=0)
        chunk, rank = key // max(len(codes), 1), key % max(len(codes), 1)
        a = codes // size_b
        count = np.where(codes == same[a], counts[a], 0)
        order = np.argsort(answers.column("code").to_numpy())
        asked = answers.column("code").to_numpy()[order]
        count[np.searchsorted(codes, asked)] = answers.column("count").to_numpy()[order]
        best = count == highest[a]
        chunk_sum, chunk_best = np.zeros(n_chunks, np.int64), np.zeros(n_chunks, np.int64)
        np.add.at(chunk_sum, chunk, links * count[rank])
        np.add.at(chunk_best, chunk, links * best[rank])
        held, size = unpack_lists(docs.column("chunks").combine_chunks().fill_null(b""))
        running, _ = unpack_lists(docs.column("times").combine_chunks().fill_null(b""))
        doc = np.repeat(np.arange(docs.num_rows), size)
        times = np.diff(running, prepend=0)
        heads = _runs_of(doc)
        times[heads] = running[heads]
        sums = {name: np.zeros(docs.num_rows, np.int64) for name in ("n_best", "count_sum")}
        np.add.at(sums["n_best"], doc, times * chunk_best[held])
        np.add.at(sums["count_sum"], doc, times * chunk_sum[held])
        return pa.table(
            {n: docs.column(n) for n in names}
            | {n: pa.array(x) for n, x in sums.items()}
            | {"groups_sha256": docs.column("groups_sha256")}
        )

    return run


_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


class Alignment:
    """Documents encoded by both tokenizers, and how many of them hold each id pair."""

    def __init__(
        self, docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES
    ):
        self.v = v = Vocabularies.of(path_a, path_b)
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.encoded = stage_and_release(
            texts.mapInArrow(_encode(path_a, path_b, block_bytes), _SCHEMA), "encoded"
        )
        same = (
            self.encoded.where(F.col("kind") == VECTOR)
            .select(F.posexplode("vector").alias("a", "n"))
            .groupBy("a")
            .agg(F.sum("n").alias("n"))
        )
        self.counts = np.zeros(len(v.same), dtype=np.int64)
        for r in same.collect():  # as many rows as the vocabulary at most
            self.counts[r.a] = r.n
        self.others = stage_and_release(
            self.encoded.where(F.col("kind") == COUNT).groupBy("code").agg(F.sum("n").alias("count")),
            "pair-counts",
        )
        self.highest = self.counts.copy()
        a = F.floor(F.col("code") / v.n_b).cast("int")
        for r in self.others.groupBy(a.alias("a")).agg(F.max("count").alias("n")).collect():
            self.highest[r.a] = max(self.highest[r.a], r.n)

    def pairs(self) -> DataFrame:
        """(a, b, count): id pairs and how many documents hold them linked."""
        spark = self.encoded.sparkSession
        held = np.flatnonzero(self.counts)
        rows = [(int(i), int(self.v.same[i] % self.v.n_b), int(self.counts[i])) for i in held]
        same = spark.createDataFrame(rows, "a long, b long, count long")
        return same.unionByName(
            self.others.select(
                F.floor(F.col("code") / self.v.n_b).alias("a"), (F.col("code") % self.v.n_b).alias("b"), "count"
            )
        )

    def documents(self) -> DataFrame:
        """One row for each document with its counts, sums and the digest of its groups."""
        asked = self.encoded.where(F.col("kind") == COUNT).select(
            F.col("block").alias("asking"), "code"
        )
        answers = asked.join(self.others, "code").select("asking", "code", "count")
        rows = self.encoded.where(F.col("kind").isin(DOCUMENT, PAIRS)).select(
            "kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks",
            "times", "links", "n",
        )
        return (
            rows.groupBy("block")
            .cogroup(answers.groupBy("asking"))
            .applyInArrow(_figures(self.v.n_b, self.v.same, self.counts, self.highest), _RESULT)
        )


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every row of ``docs``: tokens, groups, links and how common its links are."""
    return Alignment(docs, path_a, path_b, block_bytes).documents()
