"""Graphs of various sizes in long tables with slices, and in batches with running pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from ..sources.scratch import written
from .splits import shuffled


def with_starts(rows: DataFrame, order: str, **sizes: str) -> DataFrame:
    """``rows`` with ``ordinal``, their place in the order of a unique key, and for each name the sum of its size before the row.

    Sums run within ranges of the order, and over the ranges' sums.
    """
    part = unused([*rows.columns, "ordinal", *sizes], "part")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    held = written(rows.repartitionByRange(order).select(*columns, F.spark_partition_id().alias(part)), "starts")
    counted = {"ordinal": F.lit(1).cast("long")} | {k: F.col(v).cast("long") for k, v in sizes.items()}
    before = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(F.lit(1)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = held.groupBy(part).agg(*[F.sum(c).alias(k) for k, c in counted.items()])
    nought = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = sums.select(part, F.struct(*[nought(F.sum(k).over(ranges)).alias(k) for k in counted]).alias("base"))
    own = held.select(*columns, part, F.struct(*[nought(F.sum(c).over(before)).alias(k) for k, c in counted.items()]).alias("own"))
    return own.join(sums, part).select(*columns, *[(F.col(f"own.{k}") + F.col(f"base.{k}")).alias(k) for k in counted])


def slices_of(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """graph, ordinal, node_start, n_nodes, edge_start, n_edges: where each graph lies in the long tables, by the order of
    graphs. Graphs without edges have none; edges of graphs without nodes are left out."""
    per = nodes.groupBy(graph).agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy(graph).agg(F.count(F.lit(1)).alias("n_edges")), graph, "left")
    return with_starts(per.select(graph, "n_nodes", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges")), graph, node_start="n_nodes", edge_start="n_edges")


def collate(nodes: DataFrame, edges: DataFrame, graph: str, node_order: list[str], edge_order: list[str], path: str, **options: str) -> None:
    """Writes ``path/slices``, ``path/nodes`` and ``path/edges``: each row of the latter two has its ``row`` in the long table,
    by which the files and their row groups are sorted. ``options`` go to the Parquet writer."""
    slices = written(slices_of(nodes, edges, graph), "slices")
    for label, rows, order, start in (("nodes", nodes, node_order, "node_start"), ("edges", edges, edge_order, "edge_start")):
        place = F.row_number().over(Window.partitionBy(graph).orderBy(*order)) - 1
        long = rows.withColumn("row", place.cast("long")).join(slices.select(graph, start), graph)
        long = long.select(*[c for c in rows.columns if c != graph], (F.col("row") + F.col(start)).alias("row"))
        long.repartitionByRange("row").sortWithinPartitions("row").write.options(**options).parquet(f"{path}/{label}")
    slices.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.options(**options).parquet(f"{path}/slices")


def graph_at(spark: SparkSession, path: str, ordinal: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph. Of the long tables only row groups that hold its slice are read."""
    found = spark.read.parquet(f"{path}/slices").where(F.col("ordinal") == ordinal).collect()
    if not found:
        raise IndexError(f"no graph {ordinal}")
    s = found[0]
    cut = lambda label, start, n: spark.read.parquet(f"{path}/{label}").where((F.col("row") >= start) & (F.col("row") < start + n)).orderBy("row").drop("row")
    return cut("nodes", s["node_start"], s["n_nodes"]), cut("edges", s["edge_start"], s["n_edges"])


def all_graphs(spark: SparkSession, path: str, graph: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs with their graph again."""
    slices = spark.read.parquet(f"{path}/slices")
    spread = lambda start, n: slices.where(F.col(n) > 0).select(graph, F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias("row"))
    return tuple(spark.read.parquet(f"{path}/{label}").join(spread(start, n), "row").drop("row") for label, start, n in (("nodes", "node_start", "n_nodes"), ("edges", "edge_start", "n_edges")))


def batched(graphs: DataFrame, graph: str, n_nodes: str, seed: int, size: int = 256) -> DataFrame:
    """``graphs`` with ``batch``, ``place`` in it and ``ptr``, the nodes of the batch before this graph; dealt in a seeded order."""
    earlier = Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # size rows at most
    dealt = shuffled(graphs, graph, seed).withColumn("batch", F.floor(F.col("ordinal") / size)).withColumn("place", F.col("ordinal") % size).drop("ordinal")
    return dealt.withColumn("ptr", F.coalesce(F.sum(n_nodes).over(earlier), F.lit(0)).cast("long"))


def batch_target(location: Column, ptr: Column, n_nodes: Column) -> Column:
    """The node of the batch to mark for a fault of one graph: at most the graph's last node; null for none."""
    return F.when(location >= 0, F.least(ptr + location, ptr + n_nodes - 1))


def batch_nodes(nodes: DataFrame, batches: DataFrame, graph: str, place: str) -> DataFrame:
    """``nodes`` with ``batch`` and ``node``, their number in it; ``place`` is a node's number in its own graph."""
    return nodes.join(batches.select(graph, "batch", "ptr"), graph).withColumn("node", F.col("ptr") + F.col(place)).drop("ptr")


def batch_edges(edges: DataFrame, batches: DataFrame, graph: str, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """``edges`` with ``batch`` and both ends as numbers in it."""
    met = edges.join(batches.select(graph, "batch", "ptr"), graph)
    return met.select(*[F.col(c) + F.col("ptr") if c in ends else F.col(c) for c in edges.columns if c not in ends], "batch", *[(F.col(c) + F.col("ptr")).alias(c) for c in ends])
