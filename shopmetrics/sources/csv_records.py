"""CSV files with line breaks inside quotes, read by several tasks a file.

A file is split into blocks of lines as any text is. Whether a line begins a record
depends on the number of quotes before it in its file: an even number means that no
quoted value is open (a quote within a value is doubled, which adds two). Each task
counts quotes and record starts of its blocks for both cases, open and closed; a
table with one row for each block carries the case and the record number from block
to block; then every line knows its record. Lines that are whole records are parsed
where they are. Only the lines of records with line breaks are gathered by record, from
the blocks that have any.
Spark's own CSV parser reads each record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"quote": '"', "escape": '"', "encoding": "UTF-8"}

_PLACE = ["file", "block"]
_LINE_SCHEMA = (
    "file string, block long, value string, line long, opened int, "
    "record_closed long, record_open long"
)
_BLOCK_SCHEMA = (
    "file string, block long, odd int, spans boolean, if_closed long, if_open long"
)


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch, of at least one row, at which another block than before begins."""
    key = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
    block = batch.column(1).to_numpy()
    return np.flatnonzero(
        np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    )


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: line number, parity of quotes before, and records begun so far, by block.

    ``record_closed`` counts the records begun in the block up to the line if no value
    is open where the block begins, ``record_open`` if one is. Blank lines between
    records begin none.
    """
    last, line, quotes, closed, opened = None, 0, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column(0), batch.column(1).to_numpy()
        heads = _heads(batch)
        value = batch.column(2)
        count = pc.count_substring(value, '"').to_numpy().astype(np.int64)
        blank = pc.equal(pc.utf8_trim(value, " \r"), "").to_numpy(zero_copy_only=False)
        columns = {c: np.zeros(n, dtype=np.int64) for c in ("line", "before", "closed", "open")}
        for low, high in zip(heads, [*heads[1:], n]):
            here = (file[int(low)].as_py(), int(block[low]))
            if here != last:
                last, line, quotes, closed, opened = here, 0, 0, 0, 0
            own = slice(low, high)
            sums = quotes + np.cumsum(count[own])
            before = (sums - count[own]) & 1
            starts = ~blank[own]
            columns["line"][own] = line + np.arange(high - low)
            columns["before"][own] = before
            columns["closed"][own] = closed + np.cumsum(starts & (before == 0))
            columns["open"][own] = opened + np.cumsum(starts & (before == 1))
            line, quotes = line + int(high - low), int(sums[-1])
            closed, opened = int(columns["closed"][high - 1]), int(columns["open"][high - 1])
        yield pa.RecordBatch.from_arrays(
            [file, batch.column(1), value, pa.array(columns["line"]),
             pa.array(columns["before"].astype(np.int32)), pa.array(columns["closed"]),
             pa.array(columns["open"])],
            names=[*_PLACE, "value", "line", "opened", "record_closed", "record_open"],
        )


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: for each block its quotes' parity, if any line has odd quotes, and its records."""
    found: dict[tuple[str, int], tuple[int, bool, int, int]] = {}
    for batch in _number_lines(batches):
        file, block, value, _, opened, closed, opened_records = batch.columns
        inside = opened.to_numpy()
        for low, high in zip(heads := _heads(batch), [*heads[1:], batch.num_rows]):
            at, last = (file[int(low)].as_py(), block[int(low)].as_py()), int(high) - 1
            odd = (int(inside[last]) + value[last].as_py().count('"')) & 1
            spans = bool(odd or inside[low:high].any() or (at in found and found[at][1]))
            found[at] = (odd, spans, closed[last].as_py(), opened_records[last].as_py())
    if found:
        columns = zip(*((*at, *figures) for at, figures in found.items()))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=[*_PLACE, "odd", "spans", "if_closed", "if_open"],
        )


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files with their block; a break of two signs keeps the first one."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    )


def _blocks(text: DataFrame) -> DataFrame:
    """Per block: is a value open where it begins, and how many records began before.

    ``spans``: some line of it has an odd number of quotes.
    """
    blocks = text.mapInArrow(_count_blocks, _BLOCK_SCHEMA)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    began = F.when(F.col("open_before") == 1, F.col("if_open")).otherwise(F.col("if_closed"))
    return (
        blocks.withColumn("open_before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
        .withColumn("records_before", F.coalesce(F.sum(began).over(earlier), F.lit(0)))
        .select(*_PLACE, "open_before", "records_before", "spans")
    )


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, record, text): every record of the files and where it begins.

    ``record`` counts from 1 in each file. A file that ends within quotes ends with
    a record of all lines since.
    """
    text = _text(spark, path)
    blocks = _blocks(text)
    number = F.col("records_before") + F.when(
        F.col("open_before") == 1, F.col("record_open")
    ).otherwise(F.col("record_closed"))

    def numbered(text: DataFrame) -> DataFrame:
        # One row for each block of a file: sent to every task, so that lines stay where they are.
        lines = text.mapInArrow(_number_lines, _LINE_SCHEMA)
        return lines.join(F.broadcast(blocks), _PLACE).withColumn("record", number)

    inside = (F.col("opened") + F.col("open_before")) % 2 == 1
    # Blocks that begin closed and have even quotes in every line need no count here.
    alone = ~_broken() | (~inside & (_quotes() % 2 == 0))
    columns = [*_PLACE, "line", "record"]
    whole = numbered(text).where(alone & ~_blank())
    # The number of records, never below 0, keeps this branch's columns: blocks are counted once.
    broken = blocks.where(_broken() & (F.col("records_before") >= 0)).select(*_PLACE)
    some = text.join(F.broadcast(broken), _PLACE, "left_semi")
    parts = numbered(some).where(~alone).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines")
    )
    joined = parts.select(
        "file",
        F.col("lines")[0]["block"].alias("block"),
        F.col("lines")[0]["line"].alias("line"),
        "record",
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"),
    )
    record = F.when(
        F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")
    ).otherwise(F.col("value"))
    return whole.select(*columns, "value").unionByName(joined).select(
        *columns, record.alias("text")
    )


def _broken() -> Column:
    """Some line of the block lies in a value of several lines."""
    return F.col("spans") | (F.col("open_before") == 1)


def _quotes() -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))


def _blank() -> Column:
    return F.btrim("value", F.lit(" \r")) == ""


def read_records(spark: SparkSession, path: str, arrival: str) -> DataFrame:
    """Rows of CSV files with a header each; all columns are text, plus their arrival.

    Column names are those of the first file's header, as Spark reads them.
    """
    reader = spark.read.option("header", True).option("multiLine", True)
    for name, value in OPTIONS.items():
        reader = reader.option(name, value)
    names = reader.csv(path).columns  # reads one record
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    # A lambda keeps the parser out of the code generated for what the caller does with the
    # columns, which else becomes one method too long for Java's compiler.
    parsed = F.transform(F.array("text"), lambda text: F.from_csv(text, schema.json(), OPTIONS))[0]
    return (
        numbered_records(spark, path)
        .where("record > 1")
        .select(parsed.alias("row"), F.struct("file", "block", F.col("line").alias("row")).alias(arrival))
        .select("row.*", arrival)
    )
