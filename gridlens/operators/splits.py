"""Ordered splits and sampling without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from ..sources.scratch import written


def with_ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """``ordinal``: 0-based place in the order of ``order``; rows equal there are in the order of a hash of the whole row.

    Rows are dealt out by ranges of the order, as many as the session's shuffle has, and numbered each within its range;
    ranges are counted, and the counts summed up. A range of equal keys is cut by the hash. The numbered rows are
    written, so that a task that runs again finds the ranges that were counted.
    """
    part, at, tie, before = (unused(rows.columns, n) for n in ("part", "at", "tie", "before"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    ranged = rows.select(*columns, F.xxhash64(*columns).alias(tie)).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(ranged.select(*columns, F.spark_partition_id().alias(part), within.alias(at)), "ordinal")
    running = Window.partitionBy(F.lit(1)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    counts = counts.select(part, F.coalesce(F.sum(before).over(running), F.lit(0)).alias(before))
    return placed.join(counts, part).select(*columns, (F.col(before) + F.col(at)).alias("ordinal"))


def ordered_split(rows: DataFrame, order: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``split`` by cut points int(n * train) and int(n * (train + val)) in the given order."""
    total = unused([*rows.columns, "ordinal", "split"], "total")
    n = rows.agg(F.count(F.lit(1)).alias(total))
    at = F.col("ordinal")
    cut = lambda share: F.floor(F.col(total) * F.lit(float(share)))
    numbered = with_ordinal(rows, order).join(F.broadcast(n))  # one row
    return numbered.withColumn("split", F.when(at < cut(train), "train").when(at < cut(train + val), "val").otherwise("test")).drop(total)


def split_by_group(rows: DataFrame, group: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``split`` by the ordinal of whole groups, so that no group lies in two splits."""
    groups = ordered_split(rows.select(group).distinct(), group, train, val).select(group, "split")
    return rows.join(groups, group)


def hash_share(key: str | Column, scale: int = 1_000_000, multiplier: int = 2_654_435_761, modulus: int = 4_294_967_296) -> Column:
    """A reproducible number below ``scale`` from an integer key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.floor(F.pmod(key * multiplier, F.lit(modulus)) / 1024), F.lit(scale))


def undersample(rows: DataFrame, key: str, label: str, thinned: str, share: float) -> DataFrame:
    """Rows of class ``thinned`` stay with probability ``share``, decided by their key; other classes stay."""
    return rows.where((F.col(label) != thinned) | (hash_share(key) <= int(share * 1_000_000)))


def in_split(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return rows.join(index.select(key), key, "left_semi")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``ordinal``: a training order, the same for the same seed, by a hash of an integer key; validation and test sets keep theirs."""
    by = unused(rows.columns, "by")
    return with_ordinal(rows.withColumn(by, hash_share(F.col(key) + seed)), by, key).drop(by)
