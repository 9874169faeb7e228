"""Forward pass of a graph attention network: attention per edge, softmax over the edges that enter a node, weighted sum;
then a classifier over the pooled graph and a localiser for each node.

Expressed as joins and aggregates over long tables, one row a node or an edge; the weights are parameters of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)


def _linear(x: Column, matrix: list[list[float]]) -> Column:
    return F.array(*[_dot(x, row) for row in matrix])


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def attention_layer(
    nodes: DataFrame,
    edges: DataFrame,
    matrix: list[list[float]],
    from_source: list[float],
    from_target: list[float],
    keys: tuple[str, ...] = (),
    slope: float = 0.2,
    from_edge: list[float] | None = None,
    activate: bool = True,
) -> DataFrame:
    """``nodes``: keys, node, x (array<double>); ``edges``: keys, src, dst, and attributes ``a`` (array<double>) if
    ``from_edge`` is given. Returns keys, node, x after the layer, through ELU if ``activate``.

    Attention of an edge is softmax over all edges into its target of leaky(from_source . Wx_src + from_target . Wx_dst
    + from_edge . a); every node also has an edge from itself, whose attributes are the means of those that enter it.
    """
    on = list(keys)
    h = nodes.select(*on, "node", _linear(F.col("x"), matrix).alias("h"))
    h = h.withColumn("s", _dot(F.col("h"), from_source)).withColumn("t", _dot(F.col("h"), from_target))
    by_edge = edges.select(*on, "src", "dst", (_dot(F.col("a"), from_edge) if from_edge else F.lit(0.0)).alias("g"))
    # the attributes' share is linear, so its mean is the share of the mean attributes
    entering = by_edge.groupBy(*on, F.col("dst").alias("node")).agg(F.avg("g").alias("g"))
    loops = nodes.select(*on, "node").join(entering, [*on, "node"], "left").select(*on, F.col("node").alias("src"), F.col("node").alias("dst"), F.coalesce("g", F.lit(0.0)).alias("g"))
    every = by_edge.unionByName(loops)
    met = every.join(h.select(*on, F.col("node").alias("src"), "h", "s"), [*on, "src"]).join(h.select(*on, F.col("node").alias("dst"), "t"), [*on, "dst"])
    raw = F.col("s") + F.col("t") + F.col("g")
    scored = met.select(*on, "dst", "h", F.when(raw > 0, raw).otherwise(raw * slope).alias("e"))
    # scores are shifted by each target's largest, which the softmax doesn't see
    top = scored.groupBy(*on, "dst").agg(F.max("e").alias("m"))
    weighed = scored.join(top, [*on, "dst"]).withColumn("w", F.exp(F.col("e") - F.col("m")))
    width = len(matrix)
    sums = weighed.groupBy(*on, "dst").agg(F.sum("w").alias("z"), *[F.sum(F.col("w") * F.col("h")[k]).alias(f"c{k}") for k in range(width)])
    out = [F.col(f"c{k}") / F.col("z") for k in range(width)]
    return sums.select(*on, F.col("dst").alias("node"), F.array(*[elu(c) if activate else c for c in out]).alias("x"))


def attention_heads(nodes: DataFrame, edges: DataFrame, heads: list[dict], keys: tuple[str, ...] = (), activate: bool = True) -> DataFrame:
    """Several layers side by side, their outputs one after another in ``x``; each of ``heads`` holds the weights of one."""
    out = None
    for k, weights in enumerate(heads):
        one = attention_layer(nodes, edges, keys=keys, activate=activate, **weights).withColumnRenamed("x", f"x{k}")
        out = one if out is None else out.join(one, [*keys, "node"])
    return out.select(*keys, "node", F.concat(*[F.col(f"x{k}") for k in range(len(heads))]).alias("x"))


def two_layers(x: Column, hidden: list[list[float]], last: list[list[float]]) -> Column:
    return _linear(F.transform(_linear(x, hidden), relu), last)


def localised(nodes: DataFrame, keys: list[str], hidden: list[list[float]], last: list[float]) -> DataFrame:
    """keys, node, logit: how much a node looks like the place of the fault."""
    return nodes.select(*keys, "node", two_layers(F.col("x"), hidden, [last])[0].alias("logit"))


def pooled_logits(nodes: DataFrame, keys: list[str], matrix: list[list[float]], hidden: list[list[float]] | None = None) -> DataFrame:
    """Largest value per dimension of a graph's nodes, through a linear classifier, with a ``hidden`` layer if given: keys, logits, predicted."""
    width = len((hidden or matrix)[0])
    pooled = nodes.groupBy(*keys).agg(F.array(*[F.max(F.col("x")[k]) for k in range(width)]).alias("x"))
    logits = two_layers(F.col("x"), hidden, matrix) if hidden else _linear(F.col("x"), matrix)
    out = pooled.select(*keys, logits.alias("logits"))
    return out.withColumn("predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
