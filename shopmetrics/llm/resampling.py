"""Target-distribution importance resampling over hashed n-grams.

Method. Texts become lower-cased terms with one space between them. Each text is
scanned once and the CRC-32 of every prefix that ends at a term's edge is kept;
the CRC of an n-gram of any length follows from two prefixes (``running_crc``),
so n-grams are neither built as strings nor hashed byte by byte. A first scan of
all documents and of all target texts counts features in a vector of ``buckets``
figures in each task; the vectors are added by bucket. A second scan adds up the
gains of each document's features. Documents of enough terms are then ordered by
weight and a pseudorandom Gumbel term in one distributed sort; places follow from
the numbers of rows in the sorted partitions, so the drawn ones are exactly the
best of the whole table, without a limit, and the same in every run.

Bounds. The driver gets ``buckets`` counts of documents and targets; tasks get the
gains. Everything else stays with the rows; every row of the sort has a key of its
own, so equal rows are no hot key.

Defined cases: a null or empty text has no features, weight 0 and a score, and isn't
drawn. A row without a doc_id has counts and a weight, no score, and isn't drawn.
Rows that share a doc_id are scored and drawn each by itself; among equal scores and
ids, rows of more features come first, then any. Equal rows may differ in rank
only. No documents or no target texts: the counts are 0, which the formula allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.running_crc import prefix_crcs, shift
from shopmetrics.llm.staged import stage_and_release
from shopmetrics.llm.terms import IN_TERM, LOWER, parts, separated_slices, term_bounds

OUT_COLUMNS = ("n_words", "n_features", "weight", "score", "rank")
# monotonically_increasing_id has the partition above this many bits.
_ROW_BITS = 33


def _scan(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, CRC before, CRC after, place, length) of the terms of separated bytes.

    Place and CRCs are those of the normalised string, in which one space follows each term.
    """
    found: list[tuple[np.ndarray, ...]] = []
    crc, length = 0, 0
    for low, high in parts(data):
        part = data[low:high]
        begin, end = term_bounds(part)
        if not len(begin):
            continue
        keep = IN_TERM[part]
        after = end[end < len(part)]
        keep[after] = True
        plain = np.where(IN_TERM[part], LOWER[part], 32).astype(np.uint8)[keep]
        sizes = end - begin
        first = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        crcs = prefix_crcs(plain, np.concatenate([first, first + sizes, [len(plain)]]), crc)
        n = len(begin)
        found.append((begin + low, crcs[:n], crcs[n : 2 * n], first + length, sizes))
        crc, length = int(crcs[-1]), length + len(plain)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint32), none.astype(np.uint32), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def feature_slices(
    texts: pa.Array, most_terms: int, buckets: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the first text, terms of each text, text and bucket of each n-gram)."""
    for row, data, starts in separated_slices(texts):
        begin, before, after, place, size = _scan(data)
        counts = np.diff(np.searchsorted(begin, starts))
        text = np.repeat(np.arange(len(counts)), counts)
        owners, found = [], []
        for n in range(1, most_terms + 1):
            heads = len(text) - n + 1
            if heads <= 0:
                break
            i = np.flatnonzero(text[:heads] == text[n - 1 :])
            j = i + n - 1
            crcs = after[j] ^ shift(before[i], place[j] + size[j] - place[i])
            owners.append(text[i])
            found.append(crcs.astype(np.int64) % buckets)
        none = np.zeros(0, dtype=np.int64)
        yield row, counts, np.concatenate([none, *owners]), np.concatenate([none, *found])


def bucket_counts(texts: DataFrame, most_terms: int, buckets: int) -> DataFrame:
    """(bucket, n) over all n-grams of 1 to ``most_terms`` terms of column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, found in feature_slices(batch.column(0), most_terms, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held), "n": pa.array(total[held])})

    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> list[int]:
    vector = [0] * buckets
    for r in counts.collect():  # a row for each bucket at most
        vector[r.bucket] = r.n
    return vector


def gains(docs: DataFrame, target: DataFrame, most_terms: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, counts plus one."""
    source = _vector(bucket_counts(docs, most_terms, buckets), buckets)
    wanted = _vector(bucket_counts(target, most_terms, buckets), buckets)
    all_source, all_wanted = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_wanted)))
            for s, t in zip(source, wanted)
        ],
        dtype=np.int64,
    )


def _weigh(gain: np.ndarray, most_terms: int, names: list[str], text_at: int, keep_text: bool):
    """Map task: terms, features and the sum of gains of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for row, counts, text, found in feature_slices(
                batch.column(text_at), most_terms, len(gain)
            ):
                stop = row + len(counts)
                words[row:stop] = counts
                features[row:stop] = np.bincount(text, minlength=len(counts))
                sums = np.zeros(len(counts), dtype=np.int64)
                np.add.at(sums, text, gain[found])
                weight[row:stop] = sums
            kept = {
                name: batch.column(i)
                for i, name in enumerate(names)
                if keep_text or i != text_at
            }
            yield pa.RecordBatch.from_pydict(
                kept | {"n_words": words, "n_features": features, "weight": weight}
            )

    return run


def gumbel(seed: str, doc_id: Column) -> Column:
    """floor(1000 times a Gumbel figure) drawn by the SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    most_terms: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with n_words, n_features, weight, score and rank.

    ``rank`` is the place (from 1) among the rows drawn, null for others: of the N
    rows with an id and ``least_words`` terms, floor(percent * N / 100) of highest
    score, ties to the smaller doc_id. ``target`` has a column ``text``. ``carry``
    names further columns of ``docs`` to return (``text`` among them for a drawn
    corpus); names of the result's own columns are refused.
    """
    if most_terms < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("most_terms and buckets are at least 1, percent from 0 to 100")
    carry = list(carry or [])
    clash = [c for c in carry if c.lower() in (*OUT_COLUMNS, "doc_id")]
    if clash:
        raise ValueError(f"columns of the result have these names: {clash}")
    keep_text = any(c.lower() == "text" for c in carry)
    others = [c for c in carry if c.lower() != "text"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *others, F.col("text").cast("string").alias("text")
    )
    gain = gains(docs, target, most_terms, buckets)
    schema = T.StructType(
        [f for f in rows.schema.fields if keep_text or f.name != "text"]
        + [T.StructField(n, T.LongType()) for n in OUT_COLUMNS[:3]]
    )
    weighed = rows.mapInArrow(
        _weigh(gain, most_terms, rows.columns, len(rows.columns) - 1, keep_text), schema
    )
    scored = stage_and_release(
        weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn(
            "__row", F.monotonically_increasing_id()
        ),
        "weights",
    )
    enough = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.asc("__row")]
    placed = stage_and_release(
        scored.where(enough).orderBy(*order).withColumn("__place", F.monotonically_increasing_id()),
        "places",
    )
    part = F.shiftright("__place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).count()  # a row for each sorted partition
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    n = placed.count()
    within = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rank = F.col("__ahead") + within + 1
    columns = ["doc_id", *carry, *OUT_COLUMNS]
    drawn = (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn("rank", F.when(rank <= percent * n // 100, rank))
        .select(columns)
    )
    rest = scored.where(~F.coalesce(enough, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest.select(columns))
