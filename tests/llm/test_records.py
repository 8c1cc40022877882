"""WARC archives and conversations."""

from __future__ import annotations

import base64
import hashlib

import pytest

from shopmetrics.llm import warc
from shopmetrics.llm.chat import format_chats

PAGES = "page_id long, url string, html string, size int, shard int"


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(120)]
    rows += [(None, None, "<p>1</p>"), (None, "u", "only here"), (500, "a\nb", None), (500, "a", None)]
    rows += [(501, "big", "é" * 300_000), (502, "", "x"), (502, "", "y")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES).repartition(4)


def expected(rows, least=0):
    payload = lambda r: (r[2] or "").encode()
    largest: dict = {}
    for r in rows:
        if r[0] is not None and len(payload(r)) >= least:
            largest[payload(r)] = max(largest.get(payload(r), r[0]), r[0])
    out = []
    for r in rows:
        p = payload(r)
        top = largest.get(p)
        revisit = top is not None and top != r[0]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((r[0], len(p), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_warc_round_trip(spark, least):
    rows, df = pages(spark)
    folder, manifest = warc.write_warc(df, least, shard_bytes=20_000, roll_bytes=1500)
    assert manifest.count() > 5
    got = warc.read_warc(folder, manifest, payloads=True).collect()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=str) == expected(rows, least)
    assert all(len(r.payload) == r.payload_bytes for r in got if r.record_type == "response")


def test_warc_is_deterministic(spark):
    _, df = pages(spark)
    sums = []
    for part in (2, 5):
        _, manifest = warc.write_warc(df.repartition(part), shard_bytes=20_000, roll_bytes=1500)
        sums.append([tuple(r) for r in manifest.orderBy("name").collect()])
    assert sums[0] == sums[1]


def test_warc_empty(spark):
    _, df = pages(spark)
    folder, manifest = warc.write_warc(df.limit(0))
    assert warc.read_warc(folder, manifest).count() == 0


def test_cut_file_is_noticed():
    data = warc.record(1, "u", b"payload", None, warc.DATE)
    assert len(list(warc.members(data * 3))) == 3
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(data[:-3]))


TURNS = "conv_id long, turn long, role string, text string, prefix int, n_turns int"


def chats(spark, convs):
    rows = [(c, i, r, t, 1, 2) for c, turns in convs for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS).repartition(3)


def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    convs = [
        (9, [a]), (8, [a, b]), (7, [a, b, c]), (6, [a, b, c]), (5, [a, c]), (4, [("user", None)]),
        (3, [("user", "")]), (2, [(None, "hi")]), (None, [a, b, c, a]), (1, [("us", "erhi")]),
        (0, [b, ("x", "<|end|>\n")]),
    ]
    got = {r.conv_id: r for r in format_chats(chats(spark, convs)).collect()}
    assert set(got) == {6, 5, 4, 3, 2, 1, 0}
    assert (got[6].n_turns, got[6].n_copies, got[6].n_snapshots) == (3, 2, 2)
    assert (got[5].n_copies, got[5].n_snapshots) == (1, 1)
    assert got[6].rendered == (
        "<|begin|>user\nhi<|end|>\n<|begin|>assistant\nhello<|end|>\n<|begin|>user\nbye<|end|>\n"
    )
    assert got[4].rendered == "<|begin|>user\n<|end|>\n"
    assert got[2].rendered == "<|begin|>unknown\nhi<|end|>\n"
    assert got[0].rendered.count("<|end|>") == 2
    assert format_chats(chats(spark, convs).limit(0)).count() == 0


def test_many_equal_chats(spark):
    turns = [("user", "same"), ("assistant", "again")]
    convs = [(i, turns[: 1 + i % 2]) for i in range(300)] + [(1000, [*turns, ("user", "more")])]
    got = format_chats(chats(spark, convs)).collect()
    assert [(r.conv_id, r.n_copies, r.n_snapshots) for r in got] == [(1000, 1, 300)]
