"""Mixing of sources to target weights, over blocks of words joined by index.

Method. The words of a source, document after document, form a stream that is
cut into blocks of ``block_words`` words. The mix is a sequence of slots of one
block each, dealt out to output shards of ``shard_slots`` slots. A shard draws
how many of its slots each source gets: a multinomial draw that gives each
source the whole part of its expected count for certain and draws the other
slots by the remaining fractions, so that totals stay near the targets. The i-th slot of a source takes
block ``i mod n`` of its n blocks in pass ``i div n``, through a pseudorandom
permutation of the block numbers for each source and pass: a Feistel network
over the grid of rows and columns that holds n, walked until the value lies
below n. So each block is used once before any is used twice, and documents
are joined to their blocks by (source, block number).

Everything is DataFrame functions. Streams need running totals of sizes; they
come from buckets of about ``BUCKET_DOCS`` documents, filled by a hash of the
document: totals by bucket, an offset for each bucket, and a running total
within it. A source with a third of all rows thus has a third of the buckets,
and no task sees a whole source. Draws are hashes of (seed, shard, source), so
a rerun gives the same mix.

Targets: sources in code point order, null last, weigh ``weights`` in turn and
share ``share`` of all sizes; none gets more than ``most`` times its size, and
what it can't take goes to the others by weight.

Defined cases: a null or empty text has size 0 and takes nothing; a source
without words has target 0. A null source is a source of its own. Equal rows
are separate documents. Without any words all targets are 0. Columns other
than doc_id, source and text aren't read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.sources.staging import stage

BUCKET_DOCS = 4096
ROUNDS = 4
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words_in(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """Pseudorandom number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def source_targets(
    sized: DataFrame, weights: tuple[int, ...], share: float, most: float
) -> DataFrame:
    """One row per source: source, source_size, n_docs, target, source_number.

    The targets are min(most * size, level * weight) for the one level at which
    they add up; the level follows from running totals over the sources in
    order of size by weight. The table has one row per source.
    """
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")
    )
    everything = Window.partitionBy()
    ordered = per_source.select(
        "*",
        turn.alias("source_number"),
        weight.alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("wanted"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_number")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    above = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum(
        "weight"
    ).over(above)
    levelled = ordered.withColumn("level", level)
    # The first source that the level doesn't fill sets the level for all after it.
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    settled = F.first(free, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(settled.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), settled * F.col("weight"))
    )
    return levelled.select(
        "source", "source_size", "n_docs", target.alias("target"), "source_number"
    )


def _streams(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's first word in the stream of its source."""
    buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    # One narrow row per source: adaptive execution broadcasts it or splits hot sources.
    tagged = sized.join(
        targets.select(F.col("source").alias("__name"), "source_number", "n_docs"),
        F.col("source").eqNullSafe(F.col("__name")),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), buckets))
    totals = tagged.groupBy("source_number", "bucket").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source_number").orderBy("bucket")
    offsets = totals.select(
        "source_number",
        "bucket",
        (F.sum("total").over(before) - F.col("total")).alias("offset"),
    )
    within = (
        Window.partitionBy("source_number", "bucket")
        .orderBy("doc_id", "size", "row_hash")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.withColumn("running", F.sum("size").over(within) - F.col("size"))
        .join(offsets, ["source_number", "bucket"])
        .withColumn("first_word", F.col("offset") + F.col("running"))
        .drop("__name", "n_docs", "bucket", "running", "offset")
    )


def _permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, chosen by ``key``."""
    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    columns = F.floor((n + rows - 1) / rows).cast("long")

    def network(x: Column) -> Column:
        row, column = F.floor(x / columns).cast("long"), x % columns
        for i in range(ROUNDS):
            if i % 2:
                column = F.pmod(column + F.pmod(F.xxhash64(row, F.lit(i), *key), columns), columns)
            else:
                row = F.pmod(row + F.pmod(F.xxhash64(column, F.lit(i), *key), rows), rows)
        return row * columns + column

    # Fewer than rows + columns values of the grid lie outside, so a walk ends
    # within that many steps; most slots need none.
    first = network(index)
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("long"), rows + columns),
        first,
        lambda x, _: F.when(x < n, x).otherwise(network(x)),
    )
    return F.when(first < n, first).otherwise(walked)


def _shard_draws(live: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(source_number, shard, n): slots of each source in each output shard.

    A shard's whole parts are certain. Its other slots draw their source
    independently, by the remaining fractions: slots and the bounds of the
    fractions are put in one order, and a slot takes the last bound before it.
    """
    everything = Window.partitionBy()
    lower = Window.orderBy("source_number").rowsBetween(Window.unboundedPreceding, -1)
    shares = live.withColumn(
        "n_shards", F.ceil(F.sum("slots").over(everything) / shard_slots).cast("long")
    ).withColumn("expected", F.col("slots") / F.col("n_shards"))
    shares = shares.withColumn("whole", F.floor("expected").cast("long")).withColumn(
        "fraction", F.col("expected") - F.floor("expected")
    )
    shares = shares.withColumn("below", F.coalesce(F.sum("fraction").over(lower), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    bounds = shares.select(
        F.explode(F.sequence(zero, F.col("n_shards") - 1)).alias("shard"),
        "source_number",
        "whole",
        F.col("below").alias("at"),
        F.lit(0).alias("is_slot"),
    )
    rest = (
        shares.groupBy("n_shards")
        .agg(F.sum("fraction").alias("rest"))
        .select("rest", F.explode(F.sequence(zero, F.col("n_shards") - 1)).alias("shard"))
        .withColumn("n", F.floor(F.col("rest") + _unit(F.lit(seed), F.col("shard"))).cast("long"))
        .where("n > 0")
        .select("rest", "shard", F.explode(F.sequence(zero, F.col("n") - 1)).alias("slot"))
        .select(
            "shard",
            F.lit(None).cast("int").alias("source_number"),
            zero.alias("whole"),
            (F.col("rest") * _unit(F.lit(seed), F.col("shard"), F.col("slot"))).alias("at"),
            F.lit(1).alias("is_slot"),
        )
    )
    order = Window.partitionBy("shard").orderBy("at", "is_slot", "source_number")
    taker = F.last("source_number", ignorenulls=True).over(order)
    return (
        bounds.unionByName(rest)
        .select("shard", taker.alias("source_number"), (F.col("whole") + F.col("is_slot")).alias("n"))
        .groupBy("source_number", "shard")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )


def mix_slots(
    targets: DataFrame, block_words: int, shard_slots: int, seed: int, most: float
) -> DataFrame:
    """The mix: (source_number, shard, slot, block) of every slot."""
    spark = targets.sparkSession
    live = targets.where("source_size > 0 and target > 0").select(
        "source_number",
        F.ceil(F.col("source_size") / block_words).cast("long").alias("n_blocks"),
        # Blocks have source_size / n_blocks words on average: the last may be short.
        (F.col("target") * F.ceil(F.col("source_size") / block_words) / F.col("source_size")).alias(
            "slots"
        ),
    )
    draws = _shard_draws(live, shard_slots, seed)
    before = Window.partitionBy("source_number").orderBy("shard")
    placed = draws.withColumn("first", F.sum("n").over(before) - F.col("n"))
    spread = placed.join(live.drop("slots"), "source_number").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "source_number", "shard"
    )
    slots = spread.select(
        "source_number",
        "shard",
        "n_blocks",
        "first",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"),
    ).withColumn("index", F.col("first") + F.col("slot"))
    n = F.col("n_blocks")
    block = _permuted(
        F.col("index") % n, n, F.lit(seed), F.col("source_number"), F.floor(F.col("index") / n)
    )
    return slots.where(F.col("index") < F.floor(n * F.lit(float(most)))).select(
        "source_number", "shard", "slot", block.alias("block")
    )


def _uses_of_documents(
    sized: DataFrame,
    weights: tuple[int, ...],
    share: float,
    most: float,
    block_words: int,
    shard_slots: int,
    seed: int,
) -> DataFrame:
    """A row for each document and block that its words lie in, with the block's uses.

    Documents without words have one row without a block. ``from`` and
    ``words`` give the document's words that the block holds.
    """
    targets = stage(source_targets(sized, weights, share, most), "source-targets")
    streams = _streams(sized, targets)
    uses = (
        mix_slots(targets, block_words, shard_slots, seed, most)
        .groupBy("source_number", "block")
        .agg(F.count("*").alias("uses"))
    )
    last = F.col("first_word") + F.col("size")
    blocks = F.sequence(
        F.floor(F.col("first_word") / block_words),
        F.floor((last - 1) / block_words),
    )
    start = F.greatest(F.col("first_word"), F.col("block") * block_words)
    stop = F.least(last, (F.col("block") + 1) * block_words)
    cut = (
        streams.withColumn(
            "block", F.explode_outer(F.when(F.col("size") > 0, blocks))
        )
        .withColumn("from", start - F.col("first_word"))
        .withColumn("words", stop - start)
    )
    figures = targets.select("source_number", "source_size", "target")
    # Documents without words lie in no block; they are dealt out by a key of their own.
    no_block = -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # Estimates take ``uses`` for small, as it comes from a row per source; it has one per block.
    return (
        cut.withColumn("block", F.coalesce("block", no_block))
        .join(uses.hint("merge"), ["source_number", "block"], "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))
        .join(figures, "source_number")
    )


def _sized(docs: DataFrame) -> DataFrame:
    return stage(
        docs.select(
            "doc_id",
            "source",
            words_in(F.col("text")).alias("size"),
            F.xxhash64("text").alias("row_hash"),
        ),
        "sizes",
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    block_words: int = 64,
    shard_slots: int = 1 << 16,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each document.

    ``taken`` counts the words of the document that the mix takes, repeats
    included.
    """
    used = _uses_of_documents(
        _sized(docs), weights, share, most, block_words, shard_slots, seed
    )
    worded = (
        used.where("size > 0")
        .groupBy("source_number", "first_word")
        .agg(
            *(F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")),
            F.sum(F.col("uses") * F.col("words")).alias("taken"),
        )
    )
    columns = ["doc_id", "size", "source", "source_size", "target", "taken"]
    wordless = used.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return worded.select(columns).unionByName(wordless.select(columns))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    block_words: int = 64,
    shard_slots: int = 1 << 16,
    seed: int = 0,
) -> DataFrame:
    """The mix as documents: a row for each time words of a document are taken.

    The r-th row of a document has the words of those blocks that the mix
    takes at least r times, its whole text if that is all of them; a document
    that the mix doesn't take has no row, one without words stays as it is.
    Rows equal in doc_id, source and text count as copies of one row. Other
    columns stay; ``n_chars``, if there, is the length of the new text.
    """
    used = _uses_of_documents(
        _sized(docs), weights, share, most, block_words, shard_slots, seed
    ).where("uses > 0 or size = 0")
    part = F.struct("from", "words", "uses")
    takes = (
        used.groupBy("source_number", "first_word", "doc_id", "size", "row_hash")
        .agg(
            F.first("source").alias("__source"),
            F.sort_array(F.collect_list(part)).alias("__parts"),
            F.sum("words").alias("__covered"),
            F.count("*").alias("__rows"),
        )
        .select(
            F.col("doc_id").alias("__doc"),
            "__source",
            F.col("size").alias("__size"),
            F.col("row_hash").alias("__hash"),
            "__parts",
            "__covered",
            "__rows",
        )
    )
    kept = docs.withColumn("__text_hash", F.xxhash64("text")).dropDuplicates(
        ["doc_id", "source", "__text_hash"]
    )
    joined = kept.join(
        takes,
        F.col("doc_id").eqNullSafe(F.col("__doc"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__text_hash") == F.col("__hash")),
    )
    most_uses = F.array_max(F.transform("__parts", lambda b: b["uses"]))
    # Equal documents without words share one group.
    times = F.when(F.col("__size") == 0, F.col("__rows")).otherwise(most_uses)
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    parts = F.filter("__parts", lambda b: b["uses"] >= F.col("__copy"))
    held = F.aggregate(parts, F.lit(0).cast("long"), lambda n, b: n + b["words"])
    slices = F.transform(
        parts,
        lambda b: F.slice(
            F.col("__words"), (b["from"] + 1).cast("int"), b["words"].cast("int")
        ),
    )
    copies = copies.withColumn("__words", words)
    text = F.when(held == F.col("__size"), F.col("text")).otherwise(
        F.array_join(F.flatten(slices), " ")
    )
    text = F.when(F.col("__size") == 0, F.col("text")).otherwise(text)
    values = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in values:
        values["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(v.alias(c) for c, v in values.items()))
