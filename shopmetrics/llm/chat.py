"""Logged conversations without the snapshots that longer ones contain, rendered.

Method (cumulative-snapshot collapse). A log that writes a conversation after
each turn holds all its beginnings. Turns are sorted by conversation in one
shuffle and stream through a rolling hash, so each turn has the hash of the
conversation up to it. A conversation whose last hash occurs as an inner hash
of another one is a snapshot of it: an anti-join drops it. Of equal
conversations the one with the smallest id stays. The rest is rendered.

Hashes are 128 bits, turns enter with the lengths of their parts, so that
different turns can't run into each other. Inner hashes are made unique before
the join, so a first turn that very many conversations share is one row.

Defined cases: turns are ordered by turn, role and text, nulls first; repeated
rows are turns of their own. Rows with a null conv_id take no part. A null role
is rendered as ``unknown`` and a null text as nothing, but both differ from
those words. Markers inside a text lose their first bar, so that no text can
forge a turn. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.staged import stage_and_release

BEGIN, END = "<|begin|>", "<|end|>"
PREFIX_SCHEMA = "conv_id long, n_turns long, prefix binary, is_last boolean"


def _part(value: str | None) -> bytes:
    data = (value or "").encode()
    return (b"-" if value is None else b"%d" % len(data)) + b":" + data


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce task: rolling hash of each turn; rows come sorted by conversation."""
    held: tuple | None = None
    state = b""
    for batch in batches:
        rows: list[tuple] = []
        for conv, role, text in zip(*batch.columns):
            conv = conv.as_py()
            going_on = held is not None and held[0] == conv
            if held is not None:
                rows.append((*held, not going_on))
            if not going_on:
                state, turns = b"", 0
            else:
                turns = held[1]
            state = hashlib.blake2b(
                state + _part(role.as_py()) + _part(text.as_py()), digest_size=16
            ).digest()
            held = (conv, turns + 1, state)
        if rows:
            yield _rows(rows)
    if held is not None:
        yield _rows([(*held, True)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in PREFIX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
    )


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, n_snapshots) of the conversations that stay.

    ``n_copies`` counts the logged conversations equal to it, itself included,
    ``n_snapshots`` those that are proper beginnings of it.
    """
    sorted_turns = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .where("conv_id is not null")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    prefixes = stage_and_release(sorted_turns.mapInArrow(_prefixes, PREFIX_SCHEMA), "prefixes")
    logged = (
        prefixes.where("is_last")
        .groupBy("prefix")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.first("n_turns").alias("n_turns"),
            F.count("*").alias("n_copies"),
        )
    )
    logged = stage_and_release(logged, "logged")
    inner = prefixes.where("not is_last").select("prefix").distinct()
    kept = stage_and_release(logged.join(inner, "prefix", "left_anti"), "kept")
    snapshots = (
        prefixes.where("not is_last")
        .join(kept.select("conv_id"), "conv_id", "left_semi")
        .join(logged.select("prefix", F.col("n_copies").alias("n")), "prefix")
        .groupBy("conv_id")
        .agg(F.sum("n").alias("n_snapshots"))
    )
    return kept.join(snapshots, "conv_id", "left").select(
        "conv_id", "n_turns", "n_copies", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """The conversations that stay, with ``rendered``, their text for training."""
    kept = collapse(turns)
    shown = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .join(kept.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    one = lambda t: F.concat(
        F.lit(BEGIN),
        F.when(t["role"].isNull(), "unknown").otherwise(_safe(t["role"])),
        F.lit("\n"),
        _safe(t["text"]),
        F.lit(END + "\n"),
    )
    rendered = F.array_join(F.transform("turns", one), "")
    return kept.join(shown.select("conv_id", rendered.alias("rendered")), "conv_id")
