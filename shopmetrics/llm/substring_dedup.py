"""Removal of long word sequences that a document with a smaller id has too.

Method (seed and extend). Every window of ``min_words`` words owns one anchor:
the leftmost smallest hash among its ``SEED_WORDS``-word seeds (winnowing), so
equal windows have equal anchors at equal places. Consecutive windows with the
same anchor form a run. Documents meet on anchors in one shuffle. Two runs on
the same anchor that agree over their whole extent, left and right of the
seed, match entirely: only the smallest document's run is kept, the others are
repeats. If runs on one anchor differ, the smallest document of each variant
is extended window by window and matched on 128-bit window hashes. A match
with any smaller document counts, so partners are never enumerated as pairs,
and a passage that very many documents share costs one row for each of them.
Overlapping and touching matches merge into the maximal repeats.

Rows per anchor are reduced in the map tasks before the shuffle (copies within
a batch are settled there), rows stream through the reduce tasks, and the last
join is keyed by document.

Defined cases: a null or empty text has no words and an empty kept text. A row
with a null doc_id is neither matched nor changed. Rows with the same doc_id
are different texts of the same rank: they don't match each other, and equal
rows get equal results. Columns of the input stay, apart from those named like
the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm import words as W
from shopmetrics.llm.lean import lean
from shopmetrics.llm.sorted_runs import Columns, new_run, over_sorted
from shopmetrics.llm.staged import stage_and_release

SEED_WORDS = 5
OUT_COLUMNS = ("n_words", "n_removed", "repeats", "kept_text")
# A span is window start * SPAN_UNIT + number of consecutive windows.
SPAN_UNIT = 1 << 12


def _runs(words: W.Words, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, anchor hash, run hash, first window and window count of each run."""
    n = len(words.hashes)
    seed = min(SEED_WORDS, min_words)
    width = min_words - seed + 1
    if n < min_words:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    prefix = W.Runs(words.hashes)
    at = np.arange(n - seed + 1)
    seeds = prefix.of(at, at + seed)
    windows = n - min_words + 1
    least = seeds[:windows].copy()
    for j in range(1, width):
        np.minimum(least, seeds[j : windows + j], out=least)
    place = np.zeros(windows, dtype=np.int64)
    for j in range(width - 1, -1, -1):
        np.copyto(place, j, where=seeds[j : windows + j] == least)
    place += np.arange(windows)
    text = words.text_of_word()
    valid = np.flatnonzero(text[:windows] == text[min_words - 1 :])
    text, place, least = text[valid], place[valid], least[valid]
    head = np.flatnonzero(new_run(text, place))
    count = np.diff(np.append(head, len(valid)))
    start = valid[head]
    stop = start + count - 1 + min_words
    whole = prefix.of(start, stop)
    whole = W.mix(whole ^ W.mix((place[head] - start + 64 * count).astype(np.uint64)))
    return text[head], least[head], whole, start - words.first[text[head]], count


def _anchors(min_words: int):
    """Map task: one row for each run, copies within the batch settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            text_hash = batch.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for row, found in W.slices(batch.column(2)):
                text, anchor, whole, start, count = _runs(found, min_words)
                parts.append((text + row, anchor, whole, start * SPAN_UNIT + count))
            if not parts:
                continue
            text, anchor, whole, span = (np.concatenate(x) for x in zip(*parts))
            if not len(text):
                continue
            docs = doc[text]
            both = anchor ^ (whole * np.uint64(3))
            order = np.argsort(both, kind="stable")
            head = np.flatnonzero(new_run(both[order]))
            first = np.minimum.reduceat(docs[order], head)
            smallest = np.empty(len(order), dtype=np.int64)
            smallest[order] = np.repeat(first, np.diff(np.append(head, len(order))))
            settled = docs > smallest
            key = W.signed(np.where(settled, W.mix(both + docs.astype(np.uint64)), anchor))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(key),
                    "whole": pa.array(W.signed(whole)),
                    "doc": pa.array(docs),
                    "text_hash": pa.array(text_hash[text]),
                    "span": pa.array(span),
                    "settled": pa.array(settled),
                }
            )

    return run


ANCHOR_SCHEMA = "key long, whole long, doc long, text_hash int, span long, settled boolean"
MATCH_SCHEMA = "doc long, text_hash int, span long, settled boolean"


def _match_anchors(rows: Columns, last: bool) -> tuple[Columns, Columns]:
    """Settle runs that equal a smaller document's; ask for windows of the rest.

    Rows come sorted by settled in the map task, key, run hash and document.
    Of the last anchor, rows that may still turn out to have a variant are
    seen again, and so is one row that stands for its last variant.
    """
    settled, key, whole, doc = (rows[n] for n in ("settled", "key", "whole", "doc"))
    n = len(key)
    anchor_head = new_run(settled, key)
    variant_head = new_run(settled, key, whole)
    anchor = np.cumsum(anchor_head) - 1
    heads = np.flatnonzero(variant_head)
    variant = np.cumsum(variant_head) - 1
    smallest = doc[heads][variant]
    variants = np.bincount(anchor[heads])[anchor]
    copy = ~settled & (doc > smallest)
    original = ~settled & (doc == smallest)
    wanted = original & (variants > 1)
    emit = (settled | copy | wanted) & ~rows["seen"]
    out = {c: rows[c][emit] for c in ("doc", "text_hash", "span")}
    out["settled"] = (settled | copy)[emit]
    if last or settled[-1]:
        return out, {c: v[:0] for c, v in rows.items()}
    final = anchor == anchor[-1]
    if variants[-1] == 1:
        keep = final & original
        again = {c: v[keep] for c, v in rows.items()}
    else:  # the originals are out; one row of each end variant stands for the anchor
        own = np.flatnonzero(final)
        ends = np.array([own[0], heads[-1]])
        again = {c: v[ends].copy() for c, v in rows.items()}
        again["seen"][:] = True
    return out, again


def _windows(min_words: int):
    """Map task: the 128-bit hash of each window of the spans asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            text_hash = batch.column(1).to_numpy(zero_copy_only=False)
            spans = batch.column(3)
            for row, found in W.slices(batch.column(2)):
                part = spans.slice(row, len(found.first) - 1)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                size = np.diff(part.offsets.to_numpy())
                text = np.repeat(np.arange(len(size)), size)
                count = flat % SPAN_UNIT
                text, start = np.repeat(text, count), np.repeat(flat // SPAN_UNIT, count)
                within = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                start = start + within
                at = start + found.first[text]
                one, two = (
                    W.signed(W.Runs(found.hashes, b).of(at, at + min_words)) for b in W.RUN_BASES
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "one": pa.array(one),
                        "two": pa.array(two),
                        "doc": pa.array(doc[row + text]),
                        "text_hash": pa.array(text_hash[row + text]),
                        "span": pa.array(start * SPAN_UNIT + 1),
                    }
                )

    return run


WINDOW_SCHEMA = "one long, two long, doc long, text_hash int, span long"


def repeated_spans(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """Windows that also start in a document with a smaller id.

    One row for each run of windows: doc, text_hash (Spark's ``hash`` of the
    text, which tells texts of equal ids apart), span.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("text_hash"), "text"
    ).where("doc is not null and text is not null")
    anchors = texts.mapInArrow(lean(_anchors(min_words)), ANCHOR_SCHEMA)
    matched = stage_and_release(
        over_sorted(
            anchors,
            "key",
            ["settled", "key", "whole", "doc"],
            _match_anchors,
            {"seen": "bool"},
            MATCH_SCHEMA,
        ),
        "matched-runs",
    )
    asked = (
        matched.where("not settled")
        .groupBy("doc", "text_hash")
        .agg(F.sort_array(F.collect_set("span")).alias("spans"))
    )
    windows = stage_and_release(
        texts.dropDuplicates(["doc", "text_hash"])
        .join(asked, ["doc", "text_hash"])
        .select("doc", "text_hash", "text", "spans")
        .mapInArrow(lean(_windows(min_words)), WINDOW_SCHEMA),
        "windows",
    )
    first = windows.groupBy("one", "two").agg(F.min("doc").alias("first_doc"))
    again = windows.join(first, ["one", "two"]).where("doc > first_doc")
    columns = ["doc", "text_hash", "span"]
    return matched.where("settled").select(columns).unionByName(again.select(columns))


def _cut(min_words: int, names: list[str], text_at: int):
    """Map task: kept words and maximal repeats of each text."""

    def one(text: bytes | None, spans: np.ndarray):
        found = text.split() if text else []
        if not len(spans):
            return len(found), 0, [], b" ".join(found)
        start = spans // SPAN_UNIT
        depth = np.zeros(len(found) + 1, dtype=np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + spans % SPAN_UNIT - 1 + min_words, -1)
        covered = np.cumsum(depth[:-1]) > 0
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        repeats = [
            {"start": int(a), "length": int(b - a)} for a, b in zip(bounds[::2], bounds[1::2])
        ]
        kept = [found[i] for i in np.flatnonzero(~covered)]
        return len(found), int(covered.sum()), repeats, b" ".join(kept)

    kinds = [pa.int64(), pa.int64(), None, pa.string()]
    kinds[2] = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            spans = batch.column(batch.num_columns - 1)
            results = [
                one(t.as_py(), np.asarray(s.as_py() or [], dtype=np.int64))
                for t, s in zip(texts, spans)
            ]
            columns = [batch.column(i) for i in range(len(names))]
            for i, kind in enumerate(kinds):
                values = [r[i] for r in results]
                if i == 3:
                    columns.append(pa.array(values, pa.binary()).cast(kind))
                else:
                    columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *OUT_COLUMNS])

    return run


def substring_dedup(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, repeats and kept_text.

    A word is removed if a window of ``min_words`` words covers it whose word
    sequence also starts in a document with a smaller doc_id; windows are
    judged on the input. ``repeats`` lists the maximal removed spans (start
    word, length); ``kept_text`` has the other words, one space between them.
    """
    if not 1 <= min_words < SPAN_UNIT // 2:
        raise ValueError(f"min_words must be from 1 to {SPAN_UNIT // 2 - 1}")
    spans = (
        repeated_spans(docs, min_words)
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("span").alias("__spans"))
        .select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "__spans")
    )
    kept = docs.select([c for c in docs.columns if c.lower() not in OUT_COLUMNS])
    joined = kept.join(
        spans,
        (F.col("doc_id").cast("long") == F.col("__doc")) & (F.hash("text") == F.col("__hash")),
        "left",
    ).select(*[kept[c] for c in kept.columns], "__spans")
    schema = T.StructType(
        [
            *kept.schema.fields,
            *T._parse_datatype_string(
                "n_words long, n_removed long, "
                "repeats array<struct<start: long, length: long>>, kept_text string"
            ).fields,
        ]
    )
    text_at = [c.lower() for c in kept.columns].index("text")
    return joined.mapInArrow(lean(_cut(min_words, list(kept.columns), text_at)), schema)
