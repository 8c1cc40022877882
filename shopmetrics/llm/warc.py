"""WARC archives of pages: deterministic sharded writer, and reader.

Method. Pages are sorted by page_id within shards, ranges of ids with about
``shard_bytes`` of payload; the ranges depend on the pages alone. A task
writes a shard's records as gzip members and rolls to the next file when the
compressed size reaches ``roll_bytes``. Headers, record ids and digests are
made anew from the payloads; with the fixed date that is given, the same pages
give the same bytes. A file is written under a temporary name, moved when it
is complete, and listed in the manifest with its size and digest; readers open
only listed files and check them. A task that runs again rewrites the same
files.

Of records with equal payloads of at least ``least_bytes`` bytes the one with
the largest page_id is a response and the others are revisits of it, which
hold only headers. Which is which comes from one aggregation of digests. The
revisits' targets travel to the writers as narrow rows, sorted next to their
pages, so pages are shuffled once.

Defined cases: a null html is an empty payload, a null url an empty target. A
null page_id sorts first and is written without an id; it is a response only
if no record with its payload has an id. Rows with equal page_ids and payloads
are all what the first is. An empty table gives no files. Other columns aren't
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm import files
from shopmetrics.llm.ordered import shard_bounds, shard_of
from shopmetrics.llm.staged import stage_and_release
from shopmetrics.sources.staging import new_path

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
RECORD_BYTES = 600  # of headers, for the size of a shard
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
IDENTITY = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_SCHEMA = "shard long, name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDENTITY, f'{page_id} {digest}')}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    data = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str
) -> bytes:
    """A response, or a revisit of page ``refers_to``."""
    digest = payload_digest(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    # A line break in a URL would end the header.
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    return _member(fields, block)


class ShardWriter:
    """Files of one shard, rolled by their compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        self.folder, self.shard, self.roll_bytes, self.date = folder, shard, roll_bytes, date
        self.file: files.PendingFile | None = None
        self.rolled = 0

    def write(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None):
        if self.file is None:
            self.name = f"pages-{self.shard:08d}-{self.rolled:05d}.warc.gz"
            self.file = files.PendingFile(self.folder, self.name)
            self.sha256, self.size, self.records = hashlib.sha256(), 0, 0
            info = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(IDENTITY, self.name)}>"),
                ("WARC-Date", self.date),
                ("WARC-Filename", self.name),
                ("Content-Type", "application/warc-fields"),
            ]
            self._put(_member(info, b"format: WARC File Format 1.1\r\n"))
        self._put(record(page_id, url, payload, refers_to, self.date))
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha256.update(data)
        self.size += len(data)

    def roll(self, always: bool) -> list[dict]:
        """The finished file, if the current one is full or ``always``."""
        if self.file is None or not (always or self.size >= self.roll_bytes):
            return []
        self.file.commit()
        self.file = None
        self.rolled += 1
        return [
            {
                "shard": self.shard,
                "name": self.name,
                "records": self.records,
                "bytes": self.size,
                "sha256": self.sha256.hexdigest(),
            }
        ]


def _write(folder: str, roll_bytes: int, date: str):
    """Reduce task: rows sorted by shard, page, digest; a target comes before its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: ShardWriter | None = None
        target: tuple | None = None
        for batch in batches:
            done: list[dict] = []
            for shard, page, digest, is_page, refers, url, html in zip(*batch.columns):
                shard, page, digest = shard.as_py(), page.as_py(), digest.as_py()
                if not is_page.as_py():
                    target = (page, digest, refers.as_py())
                    continue
                if writer is None or writer.shard != shard:
                    done += writer.roll(True) if writer else []
                    writer = ShardWriter(folder, shard, roll_bytes, date)
                own = target[2] if target and target[:2] == (page, digest) else None
                writer.write(page, url.as_py(), html.as_py(), own)
                done += writer.roll(False)
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if writer and (done := writer.roll(True)):
            yield pa.RecordBatch.from_pylist(done)

    return run


def write_warc(
    pages: DataFrame,
    least_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> tuple[str, DataFrame]:
    """Write the archives; their folder and manifest."""
    folder = new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html")
    )
    narrow = stage_and_release(
        rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")),
        "page-digests",
    )
    largest = (
        narrow.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"))
    )
    revisits = (
        narrow.join(largest, "digest")
        .where("refers_to is not null and (page_id is null or page_id <> refers_to)")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    bounds = shard_bounds(narrow, "page_id", F.col("size") + RECORD_BYTES, shard_bytes)
    shard = shard_of("page_id", bounds).alias("shard")
    columns = ["shard", "page_id", "digest", "is_page", "refers_to", "url", "html"]
    records = rows.select(
        shard,
        "page_id",
        F.sha1("html").alias("digest"),
        F.lit(True).alias("is_page"),
        F.lit(None).cast("long").alias("refers_to"),
        "url",
        "html",
    )
    targets = revisits.select(
        shard,
        "page_id",
        "digest",
        F.lit(False).alias("is_page"),
        "refers_to",
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("html"),
    )
    dealt = (
        records.unionByName(targets)
        .select(columns)
        .repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    )
    return folder, stage_and_release(
        dealt.mapInArrow(_write(folder, roll_bytes, date), MANIFEST_SCHEMA), "warc-manifest"
    )


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of a file."""
    view, at = memoryview(data), 0
    unpacker = zlib.decompressobj(31)
    parts: list[bytes] = []
    while at < len(view):
        block = view[at : at + (1 << 16)]
        at += len(block)
        parts.append(unpacker.decompress(block))
        if unpacker.eof:
            yield b"".join(parts)
            at -= len(unpacker.unused_data)
            unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields.get("WARC-Block-Digest")
    if digest and digest != f"sha1:{payload_digest(block)}":
        raise ValueError(f"block of {fields['WARC-Record-ID']} differs from its digest")
    return fields, block


def _page(fields: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    """A record's row and payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(
        int(line.split(b":")[1])
        for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    known, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    row = {
        "page_id": int(known) if known else None,
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
    }
    return row, payload


def read_warc(folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the listed files; with ``payloads`` the html of responses too."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    fields = [pa.field(n, k) for n, k in zip(names, kinds)]
    if payloads:
        fields.append(pa.field("payload", pa.binary()))
    shape = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for listed in batch.to_pylist():
                data = files.read_file(folder, listed["name"])
                if hashlib.sha256(data).hexdigest() != listed["sha256"]:
                    raise ValueError(f"{listed['name']} differs from its manifest")
                rows: list[dict] = []
                for part in members(data):
                    head, block = parse(part)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    row, payload = _page(head, block)
                    if payloads and row["record_type"] == "response":
                        row["payload"] = payload
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    # As many tasks as shuffles have: the names are too few bytes to tell what they cost.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = manifest.select("name", "sha256").repartition(parts, "name")
    return listed.mapInArrow(run, RECORD_SCHEMA + (", payload binary" if payloads else ""))
