"""CSV files whose values hold line breaks, read in many tasks a file.

A line break ends a record only where the quotes before it, from the start of the file, are even
in number. Files are read as lines in splits; a first pass counts the quotes of every split, the
parity before each split follows from the counts of the splits before it, and a second pass
joins lines to records. What begins in one split and ends in a later one goes out in pieces,
at most two a split, which are put together by a grouping. No value is read before that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scale import lookup_join

WHOLE, FIRST, LATER = 0, 1, 2  # a record; the beginning of one that goes on; what goes on


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task, in their order, to records and pieces; a task may read several splits."""
    split, odd, held, kind, at = None, False, [], WHOLE, 0

    def given(rows: list[tuple]) -> pa.RecordBatch:
        names = ["file", "block", "at", "kind", "record"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        out: list[tuple] = []
        quotes = pc.count_substring(batch.column("value"), '"').to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("value", "file", "block", "odd")]
        for n, value, file, block, starts_odd in zip(quotes, *columns):
            if (file, block) != split:
                if held:
                    out.append((*split, at, LATER if kind == LATER else FIRST, "\n".join(held)))
                split, odd, held, at = (file, block), bool(starts_odd), [], 0
                kind = LATER if odd else WHOLE
            held.append(value)
            odd ^= bool(n % 2)
            if not odd:
                out.append((file, block, at, kind, "\n".join(held)))
                held, kind, at = [], WHOLE, at + 1
        if out:
            yield given(out)
    if held:
        yield given([(*split, at, LATER if kind == LATER else FIRST, "\n".join(held))])


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``block``, ``at``, ``record``: the text of every record, in files of any number of splits.

    (``file``, ``block``, ``at``) sorts records as they stand. Lines end in LF or CR LF; quotes within a
    value are doubled. A quote that is never closed makes one record of the rest of its file.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).cast("int").alias("odd"))
    marked = lookup_join(lines, parity, ["file", "block"])
    rows = marked.mapInArrow(_joined, "file string, block long, at long, kind int, record string")
    whole = rows.filter(F.col("kind") == WHOLE).select("file", "block", "at", "record")
    # Pieces belong to the last beginning before them.
    pieces = rows.filter(F.col("kind") != WHOLE)
    in_order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("begins", F.last(F.when(F.col("kind") == FIRST, F.struct("block", "at")), ignorenulls=True).over(in_order))
    mended = pieces.groupBy("file", "begins").agg(F.array_sort(F.collect_list(F.struct("block", "at", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")
    return whole.unionByName(mended.select("file", "begins.block", "begins.at", text))


def split_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text columns of CSV files with a header each, as ``multiLine`` reads them, and ``_place`` (sortable).

    Blank lines between records are left out; a record with fewer values than the header has nulls.
    """
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    rows = csv_records(spark, path)
    record = F.regexp_replace("record", "\r$", "")
    rows = rows.filter(~((F.col("block") == 0) & (F.col("at") == 0)) & (record != ""))
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    values = F.from_csv(record, schema, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("_v")
    place = F.concat_ws("#", "file", F.lpad(F.col("block").cast("string"), 15, "0"), F.lpad(F.col("at").cast("string"), 20, "0"))
    return rows.select(values, place.alias("_place")).select(*[F.col("_v")[c].alias(c) for c in names], "_place")
