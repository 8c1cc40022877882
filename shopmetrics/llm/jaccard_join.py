"""Similarity join of documents on word shingles, with PartEnum signatures.

Method. A document's set holds the 64-bit hashes of its distinct shingles.
Sets fall into size bands; two sets that are similar enough lie in one band or
in neighbouring ones, and differ in at most k elements, where k follows from
the band. The domain of hashes is cut into n1 parts, each into n2 = 2 smaller
ones: by the pigeonhole principle two such sets differ in at most k2 = 1
elements within some part, so they agree on one of the subsets of n2 - k2
smaller parts. A signature is the hash of a set restricted to such a subset.
Similar sets therefore share signatures; how many of them is known, so each set
goes without the weakest ones (of fewest elements) and no link is lost.

Equal sets are collapsed first. Rows of a signature shared by several sets
are met in one sorted pass, which links each set to the smallest one (the
pivot): as many candidates as rows, also for a signature with very many sets.
Verified links give components. Signatures that still hold several components
are met again, now with a set drawn by a hash of the signature: a large group of
near copies thus meets many of its sets and grows together, still with as many
candidates as rows. What signatures are then left with several components are
searched for further links, between sets of different components whose 512-bit
parity sketches (a lower bound of the difference) do not exclude a link. Two sets
often share many signatures; all but a few of these leave their pair to an earlier
one. All candidates are verified on the full sets.

Defined cases: a null text, an empty one or one without words has an empty set
and is linked with nothing. With fewer words than a shingle, the whole
sequence is the only element. A null doc_id takes part; its component id is
the smallest non-null id of its component, else null. Equal rows are equal
sets and lie in one component. Input columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.llm import words as W
from shopmetrics.llm.components import components
from shopmetrics.llm.lean import lean
from shopmetrics.llm.sorted_runs import Columns, new_run, over_sorted
from shopmetrics.llm.staged import stage_and_release

# Elements that may differ within a first-level part; a signature leaves out as many
# of its second-level parts.
SLACK = 1
INNER = 2
# Widths of a band, as a power of the inverse similarity.
BAND_POWER = 2
SKETCH_WORDS = 8
# Signatures before its own that a row knows of its set, to tell pairs met in them.
EARLIER = 16
# A first-level part more than the pigeonhole principle asks for to so many of them.
SPARE = 10


class Bands:
    """Size bands for Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the similarity must lie between 0 and 1")
        self.num, self.den = num, den
        self.low, self.high = [1], []

    def reach(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.low[len(self.high)]
            high = low * self.den**BAND_POWER // self.num**BAND_POWER
            self.high.append(max(low, high))
            self.low.append(self.high[-1] + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1

    def difference(self, band: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two similar sets of a band or the one below."""
        self.reach(1)
        while len(self.high) <= int(band.max(initial=0)):
            self.reach(self.high[-1] + 1)
        high = np.array(self.high)[band]
        return 2 * high * (self.den - self.num) // (self.den + self.num)


def shingle_sets(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and first of each text."""
    counts = found.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start = found.first[text] + np.arange(first[-1]) - first[text]
    stop = start + np.minimum(size, counts[text])
    grams = W.Runs(found.hashes).of(start, stop) if len(start) else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:]):
        grams[a:b].sort()
    fresh = new_run(text, grams)
    kept = np.concatenate([[0], np.cumsum(fresh)])[first]
    return grams[fresh], kept


def set_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set, whatever the order of its elements."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(W.mix(grams), out=sums[1:])
    sizes = np.diff(first).astype(np.uint64)
    return W.signed(W.mix((sums[first[1:]] - sums[first[:-1]]) ^ W.mix(sizes)))


def wide_sketches(grams: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parity sketches with at least one bit for each element, of a power of two bits.

    The exclusive or of two has at most as many ones as the sets differ in
    elements; a longer one folds to the length of a shorter one.
    """
    sizes = np.diff(first)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = base[text] + ((grams >> np.uint64(20)).astype(np.int64) & (bits[text] - 1))
    flags = np.zeros(base[-1], dtype=np.uint8)
    np.bitwise_xor.at(flags, place, 1)
    offsets = pa.py_buffer((base // 8).astype(np.int32))
    packed = pa.py_buffer(np.packbits(flags, bitorder="little"))
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets, packed])


def _near_sketches(num: int, den: int):
    """Map task: pairs that their wide sketches don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (one, two) in enumerate(zip(batch.column(3), batch.column(4))):
                one = np.frombuffer(one.as_py(), np.uint8)
                two = np.frombuffer(two.as_py(), np.uint8)
                while len(one) > len(two):
                    one = one[: len(one) // 2] ^ one[len(one) // 2 :]
                while len(two) > len(one):
                    two = two[: len(two) // 2] ^ two[len(two) // 2 :]
                apart = int(np.bitwise_count(one ^ two).sum())
                keep[i] = apart * (den + num) <= int(total[i]) * (den - num)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def signatures(
    grams: np.ndarray, first: np.ndarray, bands: Bands
) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows; texts that can differ from no other similar one have none.

    Each element that differs changes one of the 2 p signatures of p parts, so a
    difference of k leaves 2 p - k equal. A set goes without one less than that, of
    those that rest on the fewest elements: in an order that is the same for all
    sets, the last signature that two similar sets share is one that both keep.
    """
    sizes = np.diff(first)
    band = bands.of(sizes)
    out_text, out = [], []
    for up in (0, 1):
        tag = band + up
        k = bands.difference(tag)
        largest = np.minimum(sizes * bands.den // bands.num, np.array(bands.high)[tag])
        own_k = (sizes + largest) * (bands.den - bands.num) // (bands.den + bands.num)
        use = (sizes > 0) & (own_k > 0)
        if up:  # similar larger sets lie in the next band
            use &= sizes * bands.den // bands.num >= np.array(bands.low)[tag]
        needed = (k + SLACK + 1) // (SLACK + 1)
        parts = np.where(use, needed + np.maximum(1, needed // SPARE), 0)
        base = np.concatenate([[0], np.cumsum(parts * INNER)])
        text = np.repeat(np.arange(len(sizes)), np.where(use, sizes, 0))
        gram = grams[np.repeat(use, sizes)]
        cell = base[text] + (gram >> np.uint64(32)).astype(np.int64) % parts[text] * INNER
        cell += (gram & np.uint64(0xFFFFFFFF)).astype(np.int64) % INNER
        sums = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(sums, cell, W.mix(gram + np.uint64(0x9E3779B97F4A7C15)))
        sums = sums.reshape(-1, INNER)
        held = np.bincount(cell, minlength=base[-1]).reshape(-1, INNER)
        text = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(text)) - np.repeat(base[:-1] // INNER, parts)
        place = W.mix(((tag[text] * (1 << 32) + part) * 4).astype(np.uint64))
        totals = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        weight = held.sum(axis=1)[:, None] - held
        sign = W.mix(W.mix(totals + np.arange(INNER, dtype=np.uint64)) ^ place[:, None]).ravel()
        order = np.minimum(weight, 255).astype(np.uint64).ravel() << np.uint64(56)
        order |= sign >> np.uint64(8)
        shared = 2 * parts - own_k
        wanted = np.ones(len(sign), dtype=bool)
        for i in np.flatnonzero(use & (shared > 1)):
            weakest = np.argpartition(order[base[i] : base[i + 1]], shared[i] - 1)
            wanted[base[i] + weakest[: shared[i] - 1]] = False
        out.append(sign[wanted])
        out_text.append(np.repeat(text, INNER)[wanted])
    return np.concatenate(out_text), np.concatenate(out)


def _profiles(size: int):
    """Map task: set size, set id and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in W.slices(batch.column(1), lower=True):
                grams, first = shingle_sets(found, size)
                sizes = np.diff(first)
                bits = np.zeros((len(sizes), 64 * SKETCH_WORDS), dtype=np.uint8)
                text = np.repeat(np.arange(len(sizes)), sizes)
                np.bitwise_xor.at(
                    bits, (text, (grams % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)), 1
                )
                sketch = np.packbits(bits, axis=1).view(np.int64)
                columns = {
                    "doc_id": batch.column(0).slice(row, len(sizes)),
                    "n_shingles": pa.array(sizes),
                    "set_id": pa.array(set_ids(grams, first)),
                    "wide": wide_sketches(grams, first),
                }
                for j in range(SKETCH_WORDS):
                    columns[f"s{j}"] = pa.array(np.ascontiguousarray(sketch[:, j]))
                yield pa.RecordBatch.from_pydict(columns)

    return run


PROFILE_SCHEMA = "doc_id long, n_shingles long, set_id long, wide binary, " + ", ".join(
    f"s{j} long" for j in range(SKETCH_WORDS)
)
ROW_SCHEMA = "settled boolean, key long, sign long, set_id long, pivot long"


def _signature_rows(size: int, num: int, den: int):
    """Map task: a row for each signature; a batch's sets meet here already.

    Equal sets of a batch count once. Of the sets of a batch that share a
    signature only the smallest goes on to the signature's reduce task; the
    others are tied to it, in rows that are dealt by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            seen: set[int] = set()
            signs, idents = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for _, found in W.slices(batch.column(0), lower=True):
                grams, first = shingle_sets(found, size)
                sizes = np.diff(first)
                ident = set_ids(grams, first)
                fresh = np.zeros(len(sizes), dtype=bool)
                for i, x in enumerate(ident.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                kept = np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))])
                owner, sign = signatures(grams[np.repeat(fresh, sizes)], kept, bands)
                signs.append(W.signed(sign))
                idents.append(ident[owner])
            sign, ident = np.concatenate(signs), np.concatenate(idents)
            order = np.lexsort((ident, sign))
            sign, ident = sign[order], ident[order]
            head = new_run(sign)
            count = np.diff(np.append(np.flatnonzero(head), len(sign)))
            several = np.repeat(count > 1, count)
            pick = np.concatenate([np.flatnonzero(head), np.flatnonzero(several)])
            settled = np.arange(len(pick)) >= head.sum()
            pivot = np.repeat(ident[head], count)
            spread = W.mix((sign ^ ident).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "settled": pa.array(settled),
                    "key": pa.array(np.where(settled, spread[pick], sign[pick])),
                    # A row that goes on has its signature in the key.
                    "sign": pa.array(np.where(settled, sign[pick], 0)),
                    "set_id": pa.array(ident[pick]),
                    "pivot": pa.array(np.where(settled, pivot[pick], 0)),
                }
            )

    return run


def _meet(rows: Columns, last: bool) -> tuple[Columns, Columns]:
    """Sets that share a signature, each with the smallest of them."""
    settled, key, ident = rows["settled"], rows["key"], rows["set_id"]
    head = np.flatnonzero(new_run(settled, key))
    run = np.cumsum(new_run(settled, key)) - 1
    pivot = np.where(settled, rows["pivot"], ident[head][run])
    several = (ident[np.append(head[1:], len(key)) - 1] != ident[head])[run]
    emit = settled | (several & ~rows["seen"])
    sign = np.where(settled, rows["sign"], key)
    out = {"sign": sign[emit], "set_id": ident[emit], "pivot": pivot[emit]}
    again = {c: v[:0] for c, v in rows.items()}
    if not last and not settled[-1]:  # the run may go on; its smallest set stands for it
        again = {c: v[head[-1] : head[-1] + 1].copy() for c, v in rows.items()}
        again["seen"][:] |= several[-1]
    return out, again


def _sets(size: int):
    """Map task: the full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in W.slices(batch.column(1), lower=True):
                grams, first = shingle_sets(found, size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "set_id": pa.array(set_ids(grams, first)),
                        "grams": pa.ListArray.from_arrays(
                            pa.array(first.astype(np.int32)), pa.array(W.signed(grams))
                        ),
                    }
                )

    return run


def _sketch_side(sets: DataFrame, side: str) -> DataFrame:
    columns = ["set_id", "n_shingles", *(f"s{j}" for j in range(SKETCH_WORDS))]
    return sets.select(*(F.col(c).alias(f"{side}_{c}") for c in columns))


def _may_link(num: int, den: int):
    """False only where sizes or sketches exclude a link."""
    total = F.col("a_n_shingles") + F.col("b_n_shingles")
    apart = sum(
        (F.bit_count(F.col(f"a_s{j}").bitwiseXOR(F.col(f"b_s{j}"))) for j in range(SKETCH_WORDS)),
        F.lit(0),
    )
    apart = F.greatest(apart, F.abs(F.col("a_n_shingles") - F.col("b_n_shingles")))
    return apart * (den + num) <= total * (den - num)


def _verified(
    pairs: DataFrame, met: DataFrame, grams: DataFrame, num: int, den: int
) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough.

    Sketches go to the pairs first; the full sets only to pairs near in them.
    """
    first = met.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("wide").alias("wa"))
    second = met.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("wide").alias("wb"))
    pairs = stage_and_release(
        pairs.join(first, "a")
        .join(second, "b")
        .select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "wa", "wb")
        .mapInArrow(lean(_near_sketches(num, den)), "a long, b long"),
        "near-pairs",
    )
    a = grams.select(F.col("set_id").alias("a"), F.col("grams").alias("ga"))
    b = grams.select(F.col("set_id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - both
    return pairs.join(a, "a").join(b, "b").where(both * den >= union * num).select("a", "b")


def _open_rows(shared: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows, with roots and sketches, of the signatures that hold several components."""
    labelled = (
        shared.select("sign", "set_id")
        .join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
        .select("sign", "set_id", F.coalesce("root", "set_id").alias("root"))
    )
    mixed = (
        labelled.groupBy("sign")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("sign")
    )
    return stage_and_release(
        labelled.join(mixed, "sign", "left_semi").distinct().join(sketches, "set_id"),
        "open-signatures",
    )


def _hashed_pivots(near: DataFrame) -> DataFrame:
    """One set of each signature, by a hash of both: seldom the same for two signatures."""
    row = F.struct(F.xxhash64("sign", "set_id"), *(c for c in near.columns if c != "sign"))
    return near.groupBy("sign").agg(F.min(row).alias("row")).select("sign", "row.*")


def _side(near: DataFrame, name: str) -> DataFrame:
    return near.select("sign", *(F.col(c).alias(f"{name}_{c}") for c in near.columns if c != "sign"))


def _with_earlier(near: DataFrame) -> DataFrame:
    """Rows with the ``EARLIER`` signatures of their set that come right before theirs."""
    before = Window.partitionBy("set_id").orderBy("sign").rowsBetween(-EARLIER, -1)
    return near.withColumn("earlier", F.collect_list("sign").over(before))


def _unmet():
    """False only where a pair meets in an earlier signature, too; never in its first one."""
    return ~F.arrays_overlap("a_earlier", "b_earlier")


def _met_pairs(left: DataFrame, right: DataFrame, num: int, den: int, *also) -> DataFrame:
    """Pairs of a signature from different components that sketches don't exclude."""
    pairs = left.join(right, "sign").where(F.col("a_root") != F.col("b_root"))
    for condition in (_may_link(num, den), *also):
        pairs = pairs.where(condition)
    return pairs.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))


def jaccard_join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents link if the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``num / den``. ASCII letters are lower-cased first.
    ``component_id`` is the smallest doc_id reachable by links.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = stage_and_release(texts.mapInArrow(lean(_profiles(size)), PROFILE_SCHEMA), "profiles")
    shared = stage_and_release(
        over_sorted(
            texts.select("text").mapInArrow(lean(_signature_rows(size, num, den)), ROW_SCHEMA),
            "key",
            ["settled", "key", "set_id"],
            _meet,
            {"seen": "bool"},
            "sign long, set_id long, pivot long",
        ),
        "shared-signatures",
    )
    sketches = ["n_shingles", *(f"s{j}" for j in range(SKETCH_WORDS))]
    met = stage_and_release(
        profiles.join(shared.select("set_id").distinct(), "set_id", "left_semi")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ["wide", *sketches])),
        "met-sets",
    )
    left, right = _sketch_side(met, "a"), _sketch_side(met, "b")
    pairs = (
        shared.where("set_id <> pivot")
        .select(F.col("set_id").alias("a_set_id"), F.col("pivot").alias("b_set_id"))
        .distinct()
        .join(left, "a_set_id")
        .join(right, "b_set_id")
        .where(_may_link(num, den))
        .select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))
    )
    grams = stage_and_release(
        # The met sets grow with the corpus: never broadcast them.
        texts.join(met.select("doc_id").hint("merge"), "doc_id", "left_semi")
        # A set that only rows without an id hold has none to be found by.
        .unionByName(texts.where("doc_id is null").dropDuplicates(["text"]))
        .mapInArrow(lean(_sets(size)), "set_id long, grams array<long>")
        .join(met.select("set_id"), "set_id", "left_semi")
        .dropDuplicates(["set_id"]),
        "sets",
    )
    links = stage_and_release(_verified(pairs, met, grams, num, den), "links")
    near = _open_rows(shared, met.drop("doc_id", "wide"), components(links))
    further = _met_pairs(_side(near, "a"), _side(_hashed_pivots(near), "b"), num, den)
    found = stage_and_release(_verified(further.distinct(), met, grams, num, den), "links")
    links = stage_and_release(links.unionByName(found), "links")
    near = _open_rows(shared, met.drop("doc_id", "wide"), components(links))
    near = stage_and_release(_with_earlier(near), "open-signatures")
    once = (F.col("a_set_id") < F.col("b_set_id"), _unmet())
    further = _met_pairs(_side(near, "a"), _side(near, "b"), num, den, *once)
    found = stage_and_release(_verified(further.distinct(), met, grams, num, den), "links")
    links = links.unionByName(found)
    roots = components(links).withColumnRenamed("id", "set_id")
    rooted = profiles.select("doc_id", "n_shingles", "set_id").join(roots, "set_id", "left")
    rooted = rooted.withColumn(
        "root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id"))
    )
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
