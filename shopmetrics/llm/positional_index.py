"""Benchmark decontamination with a distributed positional inverted index.

Index. The terms of all documents lie one after the other in segments of about
``segment_terms`` terms. For each term of a segment one row keeps its positions
there, as packed differences; a directory row (null term) of each segment says
which documents lie where. A text longer than a segment goes on in the next one
and is followed by the ``reach`` terms that a match may need beyond the segment.
The index is a table; it can be written once and asked by many test sets.

Search. Windows of the test items are told apart by their term sequences, and
terms are counted over the whole index. Of each window the two rarest terms come
first: their lists are fetched, shifted by the terms' offsets and intersected in
each segment. Only where both occur at the right distance are the lists of the
window's other terms fetched, for these segments alone, and the window is matched
term by term. With ``slop`` 0 a match is the exact phrase; otherwise its terms
occur in this order with at most ``slop`` terms between them in all (of each
place where one begins, the nearest such match).

Bounds. Work is dealt by segment and by block of about ``WINDOW_BLOCK`` windows, never
by term or by document, so neither a common term nor a passage that many documents
share gathers in one task. Lists of test terms are joined with the index; small
sides of those joins, counted before, are broadcast (``MOST_BROADCAST`` rows),
larger ones are merged. Places are compared in pieces of ``PIECE`` at a time.

Defined cases: null, empty or term-free texts have no words and no hits; items
without words are in no document. An item without item_id hits words but isn't
counted or named; rows that share an item_id are one item. Rows of documents are told apart
by their place, so that equal, null or repeated doc_ids give one result row each.
Only doc_id and text are read of documents, item_id and text of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.staged import stage_and_release
from shopmetrics.llm.terms import hashed_slices
from shopmetrics.llm.varint import pack_lists, unpack_lists

SEGMENT_TERMS = 1 << 20
WINDOW_BLOCK = 1 << 16
MOST_BROADCAST = 1_000_000
PIECE = 1 << 21
_LOW = (1 << 32) - 1

INDEX_SCHEMA = (
    "segment long, term long, n int, postings binary, "
    "directory array<struct<row: long, doc_id: long, low: int, high: int, stop: int, before: long>>"
)
_DIRECTORY = pa.list_(
    pa.struct(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
         ("stop", pa.int32()), ("before", pa.int64())]
    )
)
_INDEX = pa.schema(
    [("segment", pa.int64()), ("term", pa.int64()), ("n", pa.int32()), ("postings", pa.binary()),
     ("directory", _DIRECTORY)]
)


class _Segment:
    """Terms gathered for one segment: places low to high are its own, up to stop it may read."""

    def __init__(self) -> None:
        self.terms: list[np.ndarray] = []
        self.places: list[dict] = []
        self.size = 0

    def add(self, row: int, doc_id: int | None, terms: np.ndarray, own: int, before: int) -> None:
        low = self.size
        self.size += len(terms)
        self.terms.append(terms)
        self.places.append(
            {"row": row, "doc_id": doc_id, "low": low, "high": low + own, "stop": self.size,
             "before": before}
        )

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        terms = np.concatenate([np.zeros(0, dtype=np.uint64), *self.terms]).view(np.int64)
        order = np.argsort(terms, kind="stable")
        ordered = terms[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        sizes = np.diff(np.append(heads, len(ordered)))
        packed = pack_lists(order, heads)
        n = len(heads)
        for low in range(0, n, 10_000):
            part = slice(low, min(low + 10_000, n))
            size = part.stop - low
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, segment)), pa.array(ordered[heads[part]]),
                 pa.array(sizes[part].astype(np.int32)), packed.slice(low, size),
                 pa.nulls(size, _DIRECTORY)],
                schema=_INDEX,
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment]), pa.nulls(1, pa.int64()), pa.array([len(self.places)], pa.int32()),
             pa.nulls(1, pa.binary()), pa.array([self.places], _DIRECTORY)],
            schema=_INDEX,
        )


def _index_rows(segment_terms: int, reach: int):
    """Map task: the rows of the segments of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        row = segment = first
        open_one = _Segment()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, starts, hashes in hashed_slices(batch.column(1)):
                for i in range(len(starts) - 1):
                    terms = hashes[starts[i] : starts[i + 1]]
                    done = 0
                    while True:
                        own = min(len(terms) - done, segment_terms - open_one.size)
                        own = max(own, 0)
                        open_one.add(row, ids[at + i], terms[done : done + own + reach], own, done)
                        done += own
                        if open_one.size >= segment_terms or len(open_one.places) >= segment_terms:
                            yield from open_one.rows(segment)
                            segment, open_one = segment + 1, _Segment()
                        if done >= len(terms):
                            break
                    row += 1
        if open_one.places:
            yield from open_one.rows(segment)

    return run


def positional_index(
    docs: DataFrame, reach: int = 16, segment_terms: int = SEGMENT_TERMS
) -> DataFrame:
    """Index of all terms of ``docs``; matches of up to ``reach`` + 1 terms can be asked of it."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage_and_release(texts.mapInArrow(_index_rows(segment_terms, reach), INDEX_SCHEMA), "index")


# --- windows of the test items ------------------------------------------------


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at, starts, hashes in hashed_slices(batch.column(1)):
                terms = hashes.view(np.int64)
                counts = np.diff(starts)
                item = np.repeat(np.arange(len(counts)), np.where(counts == 0, 0, np.maximum(counts - size + 1, 1)))
                within = np.arange(len(item)) - np.searchsorted(item, item)
                length = np.minimum(counts[item], size)
                begin = starts[item] + within
                flat = np.repeat(begin, length) + (
                    np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                )
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(terms[flat])
                ).cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(item + at)), lists], names=["item_id", "terms"]
                )

    return run


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id as text, terms): each run of ``size`` terms, or all terms of shorter items."""
    texts = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(_item_windows(size), "item_id string, terms array<long>")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast if it was counted and is small."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df.hint("merge")


# --- search -------------------------------------------------------------------


def _keys(terms: np.ndarray, packed: pa.Array) -> np.ndarray:
    """Ascending (list, position) keys of lists whose ascending terms are given."""
    values, counts = unpack_lists(packed)
    return (np.repeat(np.arange(len(terms)), counts) << 32) | values


def _next(keys: np.ndarray, low: np.ndarray) -> np.ndarray:
    """First key of at least ``low``, or -1."""
    if not len(keys):
        return np.full(len(low), -1)
    at = np.searchsorted(keys, low)
    return np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], -1)


_NEAR_SCHEMA = "segment long, block long, window long, offset int, anchors array<int>"


def _meet_rarest(slop: int):
    """A segment's lists of rarest terms: places where a window's two rarest terms fit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("term")
        terms = table.column("term").to_numpy()
        keys = _keys(terms, table.column("postings"))
        counts = np.bincount(keys >> 32, minlength=len(terms))
        head = np.cumsum(counts) - counts
        asks = table.column("asks").combine_chunks()
        flat = asks.flatten()
        own = np.repeat(np.arange(len(terms)), asks.value_lengths().fill_null(0).to_numpy())
        window, offset, second, gap = (
            flat.field(n).to_numpy(zero_copy_only=False) for n in ("window", "offset", "second", "gap")
        )
        other = np.searchsorted(terms, second)
        known = np.minimum(other, len(terms) - 1)
        there = np.flatnonzero((other < len(terms)) & (terms[known] == second))
        own, window, offset, gap, other = own[there], window[there], offset[there], gap[there], other[there]
        found_ask, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sums = np.concatenate([[0], np.cumsum(counts[own])])
        low = 0
        while low < len(own):  # some asks at a time; one ask's list is at most a segment
            high = max(low + 1, int(np.searchsorted(sums, sums[low] + PIECE, side="right")) - 1)
            size = counts[own[low:high]]
            ask = np.repeat(np.arange(low, high), size)
            at = keys[head[own[ask]] + np.arange(len(ask)) - np.repeat(np.cumsum(size) - size, size)] & _LOW
            # The other term lies gap places on, or up to slop places further away.
            least = at + gap[ask] - np.where(gap[ask] < 0, slop, 0)
            key = (other[ask] << 32) + np.maximum(least, 0)
            hit = _next(keys, key)
            fits = (hit >= 0) & (hit >> 32 == other[ask]) & ((hit & _LOW) <= least + slop)
            found_ask.append(ask[fits])
            found_at.append(at[fits])
            low = high
        ask, at = np.concatenate(found_ask), np.concatenate(found_at)
        order = np.argsort(ask, kind="stable")
        ask, at = ask[order], at[order]
        heads = np.flatnonzero(np.concatenate([[True], ask[1:] != ask[:-1]])[: len(ask)])
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(heads, len(ask)).astype(np.int32)), pa.array(at.astype(np.int32))
        )
        one = ask[heads]
        n = len(one)
        return pa.table(
            {
                "segment": pa.array(np.full(n, table.column("segment")[0].as_py())),
                "block": pa.array(np.full(n, table.column("block")[0].as_py())),
                "window": pa.array(window[one].astype(np.int64)),
                "offset": pa.array(offset[one].astype(np.int32)),
                "anchors": lists,
            }
        )

    return run


_MATCH_SCHEMA = (
    "row long, doc_id long, matches array<struct<window: long, start: long, stop: long>>"
)


def _match_windows(slop: int):
    """A segment's surviving windows, matched term by term on the lists of their terms."""

    def run(near: pa.Table, lists: pa.Table) -> pa.Table:
        directory = lists.filter(pc.is_null(lists.column("term")))
        lists = lists.filter(pc.is_valid(lists.column("term"))).combine_chunks().sort_by("term")
        terms = lists.column("term").to_numpy()
        keys = _keys(terms, lists.column("postings"))
        places = directory.column("directory").combine_chunks().flatten()
        field = {n: places.field(n) for n in ("row", "doc_id", "low", "high", "stop", "before")}
        low, high, stop = (field[n].to_numpy(zero_copy_only=False) for n in ("low", "high", "stop"))
        near = near.combine_chunks()
        own_terms = near.column("terms").combine_chunks()
        sizes = own_terms.value_lengths().to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = own_terms.flatten().to_numpy(zero_copy_only=False)
        of_list = np.searchsorted(terms, flat)
        known = terms[np.minimum(of_list, len(terms) - 1)] == flat if len(terms) else False
        of_list = np.where(known, of_list, -1)
        anchors = near.column("anchors").combine_chunks()
        counts = anchors.value_lengths().to_numpy()
        ask = np.repeat(np.arange(len(sizes)), counts)
        at = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at -= near.column("offset").to_numpy()[ask]
        found = []
        for part in range(0, len(ask), PIECE // (slop + 1) + 1):
            some = slice(part, part + PIECE // (slop + 1) + 1)
            a = np.repeat(ask[some], slop + 1)
            start = np.repeat(at[some], slop + 1) - np.tile(np.arange(slop + 1), len(at[some]))
            both = np.unique((a[start >= 0] << 32) | start[start >= 0])
            a, start = both >> 32, both & _LOW
            end = start - 1
            for k in range(int(sizes.max(initial=0))):
                more = sizes[a] > k
                wanted = of_list[np.minimum(first[a] + k, len(flat) - 1)]
                hit = _next(keys, (wanted << 32) + end + 1)
                fits = (hit >= 0) & (hit >> 32 == wanted)
                now = hit & _LOW
                # The first term is at the start itself.
                fits &= (now - start <= k + slop) & ((k > 0) | (now == start))
                end = np.where(more, now, end)
                keep = fits | ~more
                a, start, end = a[keep], start[keep], end[keep]
            place = np.searchsorted(low, start, side="right") - 1
            # Places without terms share their low with the next one; the last of them has it.
            inside = (start < high[place]) & (end < stop[place])
            found.append(
                np.stack([(a[inside] << 32) | start[inside], end[inside] + 1, place[inside]])
            )
        both, end, place = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        order = np.unique(both, return_index=True)[1]
        order = order[np.argsort(place[order], kind="stable")]
        both, end, place = both[order], end[order], place[order]
        a, start = both >> 32, both & _LOW
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
        shift = field["before"].to_numpy(zero_copy_only=False)[place] - low[place]
        matches = pa.ListArray.from_arrays(
            pa.array(np.append(heads, len(place)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array(near.column("window").to_numpy()[a]), pa.array(start + shift), pa.array(end + shift)],
                names=["window", "start", "stop"],
            ),
        )
        chosen = pa.array(place[heads])
        return pa.table(
            {"row": field["row"].take(chosen), "doc_id": field["doc_id"].take(chosen), "matches": matches}
        )

    return run


class Windows:
    """Distinct windows of items with ids, and the items that hold each."""

    def __init__(self, items: DataFrame, size: int):
        found = stage_and_release(item_windows(items, size), "item-windows")
        self.table = stage_and_release(
            found.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()),
            "windows",
        )
        self.of_items = stage_and_release(
            found.where("item_id is not null").join(self.table, "terms").select("window", "item_id").distinct(),
            "window-items",
        )
        self.count = self.table.count()


def find_windows(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """(row, doc_id, matches): where windows occur in the documents of an index.

    One row for each document and segment with matches; start and stop count the
    document's terms from 0.
    """
    blocks = 1 + windows.count // WINDOW_BLOCK
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    lists = index.where("term is not null").select("segment", "term", "n", "postings")
    held = windows.table.select("window", F.posexplode("terms").alias("offset", "term"))
    held = held.groupBy("window", "term").agg(F.min("offset").alias("offset"))
    wanted = stage_and_release(held.select("term").distinct(), "terms")
    counts = stage_and_release(
        lists.select("term", "n")
        .join(_sized(wanted, wanted.count()), "term")
        .groupBy("term")
        .agg(F.sum("n").alias("n")),
        "term-counts",
    )
    rarest = (
        held.join(counts, "term", "left")
        .groupBy("window")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")))
            .alias("by_n")
        )
        .where(F.get("by_n", F.lit(0))["n"] > 0)  # a term that no document has: no match
    )
    one = F.get("by_n", F.lit(0))
    two = F.coalesce(F.get("by_n", F.lit(1)), one)
    asked = stage_and_release(
        rarest.select(
            "window",
            block.alias("block"),
            one["term"].alias("term"),
            one["offset"].alias("offset"),
            two["term"].alias("second"),
            (two["offset"] - one["offset"]).alias("gap"),
        ),
        "rarest-terms",
    )
    asks = asked.groupBy("term", "block").agg(
        F.collect_list(F.struct("window", "offset", "second", "gap")).alias("asks")
    )
    needed = asked.select("term", "block").union(asked.select("second", "block")).distinct()
    needed = stage_and_release(needed.join(asks, ["term", "block"], "left"), "rarest-lists")
    n_windows = windows.count
    near = stage_and_release(
        lists.join(_sized(needed, needed.count() + n_windows), "term")
        .select("segment", "block", "term", "postings", "asks")
        .groupBy("segment", "block")
        .applyInArrow(_meet_rarest(slop), _NEAR_SCHEMA),
        "near-windows",
    )
    near = near.join(_sized(windows.table, n_windows), "window")
    pairs = stage_and_release(
        near.select("segment", "block", F.explode("terms").alias("term")).distinct(), "wanted-lists"
    )
    found = lists.join(_sized(pairs, pairs.count()), ["segment", "term"]).select(
        "segment", "block", "term", "postings",
        F.lit(None).cast(index.schema["directory"].dataType).alias("directory"),
    )
    open_parts = pairs.select("segment", "block").distinct()
    directory = (
        index.where("term is null")
        .join(open_parts, "segment")
        .select("segment", "block", "term", "postings", "directory")
    )
    return (
        near.select("segment", "block", "window", "offset", "anchors", "terms")
        .groupBy("segment", "block")
        .cogroup(found.unionByName(directory).groupBy("segment", "block"))
        .applyInArrow(_match_windows(slop), _MATCH_SCHEMA)
    )


def covered(matches: Column) -> Column:
    """Number of terms that lie in a match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"], m["stop"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(done: Column, span: Column) -> Column:
        new = F.greatest(span["stop"] - F.greatest(span["start"], done["to"]), F.lit(0).cast("long"))
        return F.struct((done["n"] + new).alias("n"), F.greatest(span["stop"], done["to"]).alias("to"))

    return F.aggregate(spans, zero, add)["n"]


def decontaminate(
    docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, index: DataFrame | None = None
) -> DataFrame:
    """One row for each row of ``docs``: what of it the test items hold.

    Columns doc_id, n_words, n_hit (words inside a match of a window of ``size``
    words), n_items, items (sorted item_ids as texts), matches (window, start, stop)
    and contaminated. ``index`` may give a ``positional_index`` of the same documents.
    """
    if size < 1 or slop < 0:
        raise ValueError("size is at least 1 and slop at least 0")
    if index is None:
        index = positional_index(docs, reach=size + slop - 1)
    windows = Windows(items, size)
    parts = find_windows(index, windows, slop)
    hits = stage_and_release(
        parts.groupBy("row")
        .agg(F.flatten(F.collect_list("matches")).alias("matches"))
        .select(
            "row", "matches", covered(F.col("matches")).alias("n_hit"),
            F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["window"]))).alias("held"),
        ),
        "hits",
    )
    # Documents that hold the same windows share one list of items.
    held = hits.groupBy("held").agg(F.count(F.lit(1)).alias("n")).select("held")
    items_of = (
        held.select("held", F.explode("held").alias("window"))
        .join(windows.of_items, "window")
        .groupBy("held")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    named = hits.join(items_of, "held", "left").drop("held")
    rows = (
        index.where("term is null")
        .select(F.explode("directory").alias("d"))
        .groupBy("d.row", "d.doc_id")
        .agg(F.sum(F.col("d.high") - F.col("d.low")).cast("long").alias("n_words"))
    )
    none = F.array().cast("array<string>")
    return rows.join(named, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        "matches",
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
