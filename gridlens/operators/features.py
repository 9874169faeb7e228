"""Graph features: facts per node from attached elements and incident lines, and edges in both directions.

Facts are aggregated before they meet the node dimension, and both ends of a line come out of one pass over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused

#: Fixed value: the voltage that scales to 1.
VOLTAGE_BASE = 150.0


def scatter_add(elements: DataFrame, node_col: str, value_col: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return elements.groupBy(*keys, F.col(node_col).alias("node")).agg(F.sum(value_col).alias(out))


def endpoints(lines: DataFrame, origin: str = "src", extremity: str = "dst") -> DataFrame:
    """Each line once for each of its ends, as ``node``."""
    return lines.withColumn("node", F.explode(F.array(origin, extremity)))


def line_features(lines: DataFrame, keys: tuple[str, ...] = (), voltage: str = "v_or", rho: str = "rho", status: str = "status") -> DataFrame:
    """Per node: mean voltage of its lines (the origin's voltage for both ends), largest loading, share of connected lines."""
    return (
        endpoints(lines)
        .groupBy(*keys, "node")
        .agg((F.avg(voltage) / VOLTAGE_BASE).alias("mean_v"), F.greatest(F.max(rho), F.lit(0.0)).alias("max_rho"), F.avg(F.col(status).cast("double")).alias("connected"))
    )


def node_features(nodes: DataFrame, loads: DataFrame, gens: DataFrame, lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` (keys, node) with load_p, gen_p, mean_v, max_rho, connected; a node without lines counts as connected."""
    on = [*keys, "node"]
    joined = nodes.join(loads, on, "left").join(gens, on, "left").join(line_features(lines, keys), on, "left")
    fill = {"load_p": 0.0, "gen_p": 0.0, "mean_v": 0.0, "max_rho": 0.0, "connected": 1.0}
    return joined.select(*on, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge forwards and backwards with its other columns repeated: one explode instead of a union of two scans."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    ends = F.array(F.struct(F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(False).alias("r")), F.struct(F.col(dst).alias("a"), F.col(src).alias("b"), F.lit(True).alias("r")))
    e = unused(edges.columns, "end")
    return edges.withColumn(e, F.explode(ends)).select(*rest, F.col(f"{e}.a").alias(src), F.col(f"{e}.b").alias(dst), F.col(f"{e}.r").alias("reversed"))


def explode_records(records: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Record arrays as rows: key, element, and one column a field; arrays of one record have one length."""
    zipped = F.arrays_zip(*[F.col(f).alias(f) for f in fields])
    return records.select(key, F.posexplode(zipped).alias("element", "__z")).select(key, "element", *[F.col(f"__z.{f}").alias(a) for f, a in fields.items()])


def fault_target(location: Column, last_node: int) -> Column:
    """Node to mark for a fault: the location, at most the last node; null for none."""
    return F.when(location >= 0, F.least(location, F.lit(last_node)))


def max_pool(rows: DataFrame, keys: list[str], array_col: str) -> DataFrame:
    """Largest value per dimension and group."""
    return rows.select(*keys, F.posexplode(array_col).alias("dim", "x")).groupBy(*keys, "dim").agg(F.max("x").alias("x"))
