"""Splittable CSV with line ends inside values (SRC-1, SRC-3), and rows zipped by position (JON-4).

A quoted value may hold line ends, so where a record begins depends on whether the number of quotes before is even.  The file
is read as lines in byte ranges, each range counts its quotes, and the counts' prefix sums over a file's ranges (one row per
range) say how every range begins: no range reads what stands before it.  The same sums count the records before each range, so
every record has its number in file order.  Lines that are whole records go straight on; only the lines of records that span
lines are gathered, by record.

Files of a folder follow one another by name.  Line ends are \\n or \\r\\n; blank lines between records are no records; a file
whose quotes don't close, or files with different headers, are errors.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, written_table


def _quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, id, value, open``: every line with the number of quotes before it in its range."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("quotes", quotes.cast("long")).withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: ``file, block``, whether it begins inside quotes, and the records of all ranges before it."""
    some = ~F.col("value").isin("", "\r")
    begins = lambda odd: F.count(F.when((F.col("before") % 2 == odd) & some, 1)).alias(f"begins{odd}")
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), begins(0), begins(1))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2)
    # A row per range: the prefix sums over all files are taken in one task.
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("inside") == 1, F.col("begins1")).otherwise(F.col("begins0"))
    sums = sums.withColumns({"own": own, "first": F.coalesce(F.sum(own).over(earlier), F.lit(0))})
    # A file's first record is its header: its number, and how many headers stand up to it.
    sums = sums.withColumn("header", F.min(F.when(F.col("own") > 0, F.col("first"))).over(Window.partitionBy("file")))
    opens = ((F.col("own") > 0) & (F.col("first") == F.col("header"))).cast("long")
    return sums.withColumn("headers", F.sum(opens).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, record, head``: the text of every record, with its number from 0 over all files among the rows; a
    file's first record is its header (``head`` 1), whose number says nothing."""
    lines = written_table(_quoted_lines(spark, path), "csv-lines")
    ranges = written_table(_ranges(lines), "csv-ranges")
    broken = ranges.groupBy("file").agg((F.sum("quotes") % 2).alias("open")).filter("open = 1").select("file").first()
    if broken:
        raise ValueError(f"{broken['file']}: a quoted value doesn't end")
    at = lines.join(ranges.select("file", "block", "inside", "first", "header", "headers"), ["file", "block"])
    begins = (F.col("before") + F.col("inside")) % 2 == 0
    at = at.filter(~(begins & F.col("value").isin("", "\r"))).withColumn("begins", begins)
    upto = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("nr", F.col("first") + F.sum(F.col("begins").cast("long")).over(upto) - 1)
    at = at.select("file", "block", "id", "value", "begins", "quotes", (F.col("nr") - F.col("headers")).alias("number"),
                   (F.col("nr") == F.col("header")).cast("int").alias("head"))
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    one = at.filter(whole).select("file", "number", "head", F.col("value").alias("record"))
    # Ranges that a record only ends in count the headers before it as its own range does.
    parts = at.filter(~whole).groupBy("file", "number", "head").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("lines"))
    out = one.unionByName(parts.select("file", "number", "head", F.array_join("lines.value", "\n").alias("record")))
    return out.withColumn("record", F.rtrim(F.col("record"), F.lit("\r")))


def read_numbered(spark: SparkSession, path: str, number: str = "number") -> DataFrame:
    """The rows of a CSV file or folder as strings, with their ``number`` from 0 in file order."""
    # Headers have a folder of their own: a filter would let the optimizer test or cast their texts as values.
    place = scratch_path(spark, "csv-records")
    every = records(spark, path).select("number", "record", "head")
    every.write.partitionBy("head").parquet(place)
    every = spark.read.schema("number long, record string, head int").parquet(place)
    titles = [r["record"] for r in every.filter("head = 1").select("record").distinct().limit(2).collect()]
    if len(titles) != 1:
        raise ValueError(f"{path}: {'no header' if not titles else 'files with different headers'}")
    names = next(csv.reader(io.StringIO(titles[0])))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("record", fields, {"escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    return every.filter("head = 0").select(F.col("number").alias(number), parsed.alias("r")).select(
        number, *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def zip_by_position(left: DataFrame, right: DataFrame, number: str = "number") -> DataFrame:
    """JON-4: the rows of two numbered tables side by side; tables of different lengths are an error.  A column that both have
    is the left one's."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be zipped with {m}")
    return left.join(right.select(number, *[F.col(f"`{c}`") for c in right.columns if c not in left.columns]), number)
