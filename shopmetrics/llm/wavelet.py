"""Token ids of a corpus as one wavelet matrix file per shard.

Method. A shard holds the ids of consecutive documents. Its wavelet matrix has
one bit plane per bit of the largest id, highest first; each plane is in the
order left by stably parting the ids by the bits before. A plane needs one bit
per token, and a rank directory over it gives, from the one compressed file:
the token at a place (``access``), the number of times a token occurs before a
place (``rank``), and the place of its n-th occurrence (``select``).

Shards are ranges of doc_id with about ``shard_bytes`` of text, the same in
every run; a task writes a shard under a temporary name and moves it to its
place. The table of files, with the number of tokens before each, is the
manifest; readers open only files it lists and check their digest.

Defined cases: a null or empty text has the end id alone. A null doc_id sorts
first. Rows with equal doc_ids are separate documents, ordered by text. An
empty table has an empty manifest. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.llm import files
from shopmetrics.llm.lean import lean
from shopmetrics.llm.ordered import shard_bounds, shard_of
from shopmetrics.llm.staged import stage_and_release
from shopmetrics.llm.tokens import Encoder
from shopmetrics.sources.staging import new_path

MAGIC = b"WVM1"
SHARD_BYTES = 4 << 20
BLOCK = 512  # bits for each entry of the rank directory
MANIFEST_SCHEMA = "shard long, name string, n_docs long, n_tokens long, sha256 string"
DOCUMENT_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class WaveletMatrix:
    """Bit planes of a sequence of ids, highest bit first."""

    def __init__(self, size: int, planes: list[np.ndarray]):
        self.size = size
        self.planes = planes
        self.zeros: list[int] = []
        self.directory: list[np.ndarray] = []
        for plane in planes:
            ones = np.bitwise_count(plane)
            step = BLOCK // 8
            sums = np.add.reduceat(ones, np.arange(0, len(ones), step), dtype=np.int64)
            self.directory.append(np.concatenate([[0], np.cumsum(sums)]))
            self.zeros.append(size - int(self.directory[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one))
            ids = np.concatenate([np.compress(~one, ids), np.compress(one, ids)])
        return cls(len(ids), planes)

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3] >> (7 - (place & 7))) & 1

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        block = place // BLOCK
        first = block * BLOCK // 8
        ones = int(self.directory[level][block])
        ones += int(np.bitwise_count(self.planes[level][first : place >> 3]).sum())
        rest = place & 7
        return ones + (int(self.planes[level][place >> 3]) >> (8 - rest)).bit_count() if rest else ones

    def access(self, place: int) -> int:
        """The token at a place."""
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, place), self._ones(level, place)
            value = value * 2 + bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def rank(self, token: int, place: int) -> int:
        """Occurrences of a token before a place."""
        if token >> len(self.planes):
            return 0
        low, high = 0, place
        for level in range(len(self.planes)):
            one_low, one_high = self._ones(level, low), self._ones(level, high)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + one_low, self.zeros[level] + one_high
            else:
                low, high = low - one_low, high - one_high
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, n: int) -> int:
        """Place of the n-th occurrence (from 0) of a token."""
        if not 0 <= n < self.count(token):
            raise IndexError(f"token {token} has no occurrence {n}")
        low, high = 0, self.size - 1
        while low < high:
            middle = (low + high) // 2
            if self.rank(token, middle + 1) > n:
                high = middle
            else:
                low = middle + 1
        return low

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, from the planes alone."""
        if token >> len(self.planes):
            return np.zeros(0, dtype=np.int64)
        low, high = 0, self.size
        spans = []
        for level in range(len(self.planes)):
            spans.append((low, high))
            one_low, one_high = self._ones(level, low), self._ones(level, high)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + one_low, self.zeros[level] + one_high
            else:
                low, high = low - one_low, high - one_high
        within = np.arange(high - low)
        for level in range(len(self.planes) - 1, -1, -1):
            first, last = spans[level]
            bits = np.unpackbits(self.planes[level], count=self.size)[first:last]
            wanted = token >> (len(self.planes) - 1 - level) & 1
            within = np.flatnonzero(bits == wanted)[within]
        return within

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        ids = np.zeros(self.size, dtype="<u2" if len(self.planes) <= 16 else "<u4")
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size).view(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~one)] = ids[: self.zeros[level]]
            above[np.flatnonzero(one)] = ids[self.zeros[level] :] | ids.dtype.type(
                1 << (len(self.planes) - 1 - level)
            )
            ids = above
        return ids


def to_bytes(docs: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: header, document table and planes, each part compressed."""
    matrix = WaveletMatrix.build(ids)
    parts = [docs.astype("<i8").tobytes(), np.packbits(known).tobytes()]
    parts += [lengths.astype("<i8").tobytes(), *(p.tobytes() for p in matrix.planes)]
    packed = [pa.compress(p, codec="zstd", asbytes=True) if p else b"" for p in parts]
    header = {
        "documents": len(docs),
        "tokens": matrix.size,
        "raw": [len(p) for p in parts],
        "packed": [len(p) for p in packed],
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, whether each is known, tokens of each, and the matrix."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    (size,) = struct.unpack_from("<I", data, 4)
    header = json.loads(data[8 : 8 + size])
    at = 8 + size
    parts = []
    for raw, packed in zip(header["raw"], header["packed"]):
        part = data[at : at + packed]
        parts.append(pa.decompress(part, raw, codec="zstd", asbytes=True) if raw else b"")
        at += packed
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=header["documents"])
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    matrix = WaveletMatrix(header["tokens"], planes)
    return np.frombuffer(parts[0], "<i8"), known, np.frombuffer(parts[2], "<i8"), matrix


def _write(path: str, end_id: int, folder: str):
    """Reduce task: a file for each shard; rows come sorted by shard and doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], dtype=encoder.dtype)
        shard: int | None = None
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def finish() -> pa.RecordBatch:
            data = to_bytes(
                np.array([d or 0 for d in docs], dtype=np.int64),
                np.array([d is not None for d in docs]),
                np.array(lengths, dtype=np.int64),
                np.concatenate(ids),
            )
            name = f"tokens-{shard:08d}.wvm"
            file = files.PendingFile(folder, name)
            file.write(data)
            file.commit()
            row = {
                "shard": shard,
                "name": name,
                "n_docs": len(docs),
                "n_tokens": sum(lengths),
                "sha256": hashlib.sha256(data).hexdigest(),
            }
            docs.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            shards, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own, doc, text in zip(shards, known, batch.column(2)):
                if docs and own != shard:
                    yield finish()
                shard = own
                ids += [encoder.encode(text.as_py() or ""), end]
                docs.append(doc)
                lengths.append(len(ids[-2]) + 1)
        if docs:
            yield finish()

    return run


def write_tokens(
    docs: DataFrame, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES
) -> tuple[str, DataFrame]:
    """Write the corpus; its folder and manifest (with ``first_token`` of each file)."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    bounds = shard_bounds(texts, "doc_id", weight, shard_bytes)
    dealt = (
        texts.select(shard_of("doc_id", bounds).alias("shard"), "doc_id", "text")
        .repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "doc_id", "text")
    )
    written = stage_and_release(
        dealt.mapInArrow(lean(_write(path, end_id, folder)), MANIFEST_SCHEMA), "token-manifest"
    )
    # One row per file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token")
    return folder, written.select("*", first)


def _checked(folder: str, name: str, sha256: str) -> bytes:
    data = files.read_file(folder, name)
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{name} differs from its manifest")
    return data


def _dealt(listed: DataFrame) -> DataFrame:
    """Files over as many tasks as shuffles have: their names are too few bytes to tell."""
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "name")


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens and ids (32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = _checked(folder, row["name"], row["sha256"])
                docs, known, lengths, matrix = from_bytes(data)
                ends = np.cumsum(lengths)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int64)
                raw = pa.py_buffer(matrix.decode().astype("<u4").tobytes())
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(docs), [None, pa.py_buffer(offsets), raw]
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs, mask=known == 0),
                        "start": pa.array(ends - lengths + row["first_token"]),
                        "n_tokens": pa.array(lengths),
                        "ids": ids.cast(pa.binary()),
                    }
                )

    listed = manifest.select("name", "sha256", "first_token")
    spread = _dealt(stage_and_release(listed, "token-files"))
    return spread.mapInArrow(lean(run), DOCUMENT_SCHEMA)


def find_token(folder: str, manifest: DataFrame, token: int) -> DataFrame:
    """Places of a token in the whole corpus, from the planes alone: (place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = from_bytes(_checked(folder, row["name"], row["sha256"]))[3]
                places = matrix.occurrences(token) + row["first_token"]
                yield pa.RecordBatch.from_pydict({"place": pa.array(places)})

    listed = manifest.select("name", "sha256", "first_token")
    return _dealt(listed).mapInArrow(run, "place long")
