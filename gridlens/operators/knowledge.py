"""A knowledge graph of topology and rules: nodes and edges of fixed kinds, closure to whatever depth, chains of rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .splits import with_ordinal

#: Kinds of nodes, and the kinds that an edge of each kind may join.
ENTITY_KINDS = ("Bus", "Line", "Transformer", "Generator", "Load")
NODE_KINDS = (*ENTITY_KINDS, "ProtectionDevice", "Rule")
EDGE_KINDS = {
    "connected_to": (("Bus", "Line"), ("Line", "Bus"), ("Bus", "Transformer"), ("Transformer", "Bus")),
    "feeds": (("Generator", "Bus"), ("Line", "Bus")),
    "protected_by": (("Line", "ProtectionDevice"), ("Bus", "ProtectionDevice")),
    "has_rule": tuple((k, "Rule") for k in ENTITY_KINDS),
    "triggers": (("Rule", "ProtectionDevice"),),
}


def name(kind: str, key: str | Column) -> Column:
    """A node's name: its kind and key, so that keys of two kinds don't meet."""
    return F.concat(F.lit(f"{kind}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def nodes(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """kind, node, attributes (map of strings): each frame holds ``key`` and whatever the nodes of its kind have."""
    if unknown := set(kinds) - set(NODE_KINDS):
        raise ValueError(f"no such kinds of nodes: {sorted(unknown)}")

    def one(kind: str, rows: DataFrame) -> DataFrame:
        pairs = [x for c in rows.columns if c != "key" for x in (F.lit(c), F.col(c).cast("string"))]
        held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return rows.where("key IS NOT NULL").select(F.lit(kind).alias("kind"), name(kind, "key").alias("node"), held.alias("attributes"))

    return reduce(DataFrame.union, [one(k, f) for k, f in kinds.items()])


def edges(kinds: Iterable[tuple[str, str, str, DataFrame]], once: bool = True) -> DataFrame:
    """kind, source, target of (edge kind, source kind, target kind, frame with ``source`` and ``target`` keys), each edge once if ``once``."""
    parts = []
    for kind, a, b, rows in kinds:
        if (a, b) not in EDGE_KINDS.get(kind, ()):
            raise ValueError(f"no {kind!r} leads from {a} to {b}")
        parts.append(rows.where("source IS NOT NULL AND target IS NOT NULL").select(F.lit(kind).alias("kind"), name(a, "source").alias("source"), name(b, "target").alias("target")))
    out = reduce(DataFrame.union, parts)
    return out.distinct() if once else out


def both_ways(rows: DataFrame) -> DataFrame:
    """source, target and the other way round."""
    return rows.select("source", "target").union(rows.select("target", "source"))


def dangling(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    known = all_nodes.select("node").distinct()
    whole = all_edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    return all_edges.join(whole, ["kind", "source", "target"], "left_anti")


#: Starts whose bits share a number.
_BITS = 64


def reached(starts: DataFrame, all_edges: DataFrame, kinds: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The closure as sets of starts. Returns start, block, bit, and node, block, hops, mask: of which starts of the block the node is ``hops`` steps away.

    Each round joins what was new in the last one with the edges and takes away what has been seen, so cycles end and no
    depth is given. A row holds 64 starts, so a round has a row for each node it meets rather than for each start
    and node. Edges into nodes that all starts have reached tell nothing more; they are left out once most are such.
    Rounds are written, as many as the longest of the shortest paths has steps.
    """
    steps = all_edges if kinds is None else all_edges.where(F.col("kind").isin(list(kinds)))
    steps = written(steps.select("source", "target"), "graph-steps")
    numbered = with_ordinal(starts.select(F.col("node").alias("start")).distinct(), "start")
    numbered = written(numbered.select("start", F.floor(F.col("ordinal") / _BITS).alias("block"), (F.col("ordinal") % _BITS).cast("int").alias("bit")), "graph-starts")
    n = numbered.count()
    blocks, rest = -(-n // _BITS), (1 << n % _BITS) - 1
    whole = F.when(F.col("block") < n // _BITS, F.lit(-1)).otherwise(F.lit(rest)).cast("long")

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    front = numbered.select(F.col("start").alias("node"), "block", one.alias("mask"), F.lit(0).cast("long").alias("hops")).withColumn("full", F.col("mask") == whole)
    seen = front = written(front, "graph-front")
    nought = F.lit(0).cast("long")
    targets = written(steps.select(F.col("target").alias("node")).distinct(), "graph-targets")
    left, filled, k = targets.count() * blocks, 0, 0
    while True:
        met, full = front.agg(F.count(F.lit(1)), F.count_if("full")).first()
        if not met:
            return numbered, seen.select("node", "block", "hops", "mask")
        filled += full
        if filled * 4 >= left * 3 > 0:
            done = seen.where("full").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == blocks).select("node")
            targets = written(targets.join(done, "node", "left_anti"), "graph-targets")
            steps = written(steps.join(targets.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target"), "graph-steps")
            left, filled = targets.count() * blocks, 0
        k += 1
        now = front.join(steps, front["node"] == steps["source"]).select(F.col("target").alias("node"), "block", F.col("mask").alias("new"), nought.alias("old"))
        both = now.union(seen.select("node", "block", nought, "mask")).groupBy("node", "block").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = both.select("node", "block", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask"), F.lit(k).cast("long").alias("hops"), (F.col("new").bitwiseOR(F.col("old")) == whole).alias("full"))
        front = written(fresh.where("mask != 0"), "graph-front")
        seen = seen.union(front)


def by_start(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """Rows with ``block`` and ``mask`` as a row for each ``start`` in the mask."""
    held = F.call_function("shiftrightunsigned", F.col("mask"), F.col("bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return sets.join(numbered, "block").where(held).drop("block", "mask", "bit")


def closure(starts: DataFrame, all_edges: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """start, node, hops: all that each start reaches, itself included, along edges of ``kinds``, by the fewest steps (:func:`reached`)."""
    numbered, sets = reached(starts, all_edges, kinds)
    return by_start(sets, numbered).select("start", "node", "hops")


def chains(all_edges: DataFrame) -> DataFrame:
    """entity, rule, device, own, near: the rules of an entity and the devices that these trigger; whether such a device
    protects the entity itself, and whether it protects something that the entity is connected to."""
    of = lambda kind, a, b: all_edges.where(F.col("kind") == kind).select(F.col("source").alias(a), F.col("target").alias(b))
    guards = of("protected_by", "entity", "device").distinct()
    through = of("connected_to", "entity", "by").join(guards.withColumnRenamed("entity", "by"), "by").select("entity", "device").distinct()
    found = of("has_rule", "entity", "rule").join(of("triggers", "rule", "device"), "rule")
    found = found.join(guards.withColumn("own", F.lit(True)), ["entity", "device"], "left").join(through.withColumn("near", F.lit(True)), ["entity", "device"], "left")
    return found.select("entity", "rule", "device", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("own", "near")])
