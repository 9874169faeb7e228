"""Lines of text files by number: an index of files, and lookup that reads only the files it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 0 within the file), value; blank lines count.

    A file may be read in several blocks. Lines of a block are numbered by where they stand in its task; blocks are
    counted, and the counts of a file's earlier blocks added. No file is gathered in a task.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def index_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, first, n: the number of each file's first line among all, in the order of their paths, and its lines. Written, so
    that the files are gone through once for any number of lookups."""
    files = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file, as the driver lists them
    return written(files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), "n"), "line-index")


def lookup_lines(spark: SparkSession, index: DataFrame, wanted: DataFrame, number: str = "number", step: int = 1 << 16) -> DataFrame:
    """``wanted`` with ``value``: the line of that number, for repeated numbers each time. A number without line is an ``IndexError``.

    Numbers meet files in a join on stretches of ``step`` numbers, and only files that hold some are read.
    """
    cells = F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n") - 1) / step))
    spread = index.where("n > 0").select("file", "first", "n", F.explode(cells).alias("cell"))
    asked = wanted.select(F.col(number).cast("long").alias("number")).distinct().withColumn("cell", F.floor(F.col("number") / step))
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n"))
    placed = asked.join(spread, "cell").where(inside).select("number", "file", (F.col("number") - F.col("first")).alias("line"))
    lost = asked.join(placed, "number", "left_anti").agg(F.min("number").alias("number"), F.count(F.lit(1)).alias("n")).first()
    if lost["n"]:
        raise IndexError(f"line {lost['number']} isn't there, nor are {lost['n'] - 1} others")
    files = [r["file"] for r in placed.select("file").distinct().collect()]  # no more than the driver lists
    if not files:
        return wanted.withColumn("value", F.lit(None).cast("string"))
    found = numbered_lines(spark, files).join(placed, ["file", "line"]).select("number", "value")
    return wanted.join(found, wanted[number].cast("long") == found["number"]).select(*[wanted[c] for c in wanted.columns], "value")
