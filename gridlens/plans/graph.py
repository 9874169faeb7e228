"""Queries on graph features: nations are nodes, suppliers and customers attached elements, line items lines between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attention as N
from ..operators import features as G
from ..operators import shield as H
from ..operators import splits as P
from ..operators import stats as S
from ..sources.readers import table
from ..sources.scratch import written
from .labels import OBS, observations


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """line id, src and dst nation, loading, voltage and status; only the columns needed reach the joins."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_tax", "l_extendedprice", "l_linestatus")
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    joined = item.join(supplier, item["l_suppkey"] == supplier["s_suppkey"]).join(order, item["l_orderkey"] == order["o_orderkey"]).join(customer, order["o_custkey"] == customer["c_custkey"])
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("number"),
        "src",
        "dst",
        (F.col("l_tax") * 20).alias("rho"),
        (F.col("l_extendedprice") / 200).alias("v_or"),
        (F.col("l_linestatus") == "O").alias("status"),
    )


_LINES = """lines AS (SELECT l_orderkey AS order_id, l_linenumber AS number, s_nationkey AS src, c_nationkey AS dst, l_tax * 20 AS rho, l_extendedprice / 200 AS v_or, l_linestatus = 'O' AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ends AS (SELECT src AS node, * FROM lines UNION ALL SELECT dst AS node, * FROM lines),
raw_lines AS (SELECT node, avg(v_or) / 150 AS mean_v, greatest(max(rho), 0) AS max_rho, avg(status::INT) AS connected FROM ends GROUP BY node),
of_lines AS (SELECT node, round(mean_v, 6) AS mean_v, round(max_rho, 6) AS max_rho, round(connected, 6) AS connected FROM raw_lines)"""


def _loads(spark, d):
    return G.scatter_add(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "load_p")


def _gens(spark, d):
    return G.scatter_add(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "gen_p")


def node_load(spark, d):
    return nodes(spark, d).join(_loads(spark, d), "node", "left").select("node", F.round(F.coalesce("load_p", F.lit(0.0)), 4).alias("load_p"))


def node_gen(spark, d):
    return nodes(spark, d).join(_gens(spark, d), "node", "left").select("node", F.round(F.coalesce("gen_p", F.lit(0.0)), 4).alias("gen_p"))


def node_lines(spark, d):
    out = G.line_features(lines(spark, d))
    return out.select("node", *[F.round(c, 6).alias(c) for c in ("mean_v", "max_rho", "connected")])


def node_features(spark, d):
    out = G.node_features(nodes(spark, d), _loads(spark, d), _gens(spark, d), lines(spark, d))
    return out.select("node", F.round("load_p", 4).alias("load_p"), F.round("gen_p", 4).alias("gen_p"), *[F.round(c, 6).alias(c) for c in ("mean_v", "max_rho", "connected")])


def edges_bidirectional(spark, d):
    e = lines(spark, d).select("order_id", "number", "src", "dst", F.round("rho", 6).alias("rho"), "status")
    return G.both_directions(e)


def fault_target(spark, d):
    loc = F.when(F.col("o_orderkey") % 32 >= 3, F.col("o_orderkey") % 32 - 3)
    marked = table(spark, d, "orders").select(G.fault_target(F.coalesce(loc, F.lit(-1)), 24).alias("node"))
    return marked.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def max_pool(spark, d):
    out = G.max_pool(observations(spark, d), ["episode"], "rho")
    return out.select("episode", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def exploded_records(spark, d):
    long = G.explode_records(observations(spark, d), "vec_id", {"rho": "rho", "status": "status"})
    return long.groupBy(F.col("element").cast("long").alias("element")).agg(F.round(F.avg("rho"), 6).alias("mean_rho"), F.count_if(~F.col("status")).alias("n_off"))


def kg_reach(spark, d):
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    part = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    found, edges = H.graph(
        {"region": (region, "r_regionkey"), "nation": (nation, "n_nationkey"), "supplier": (supplier, "s_suppkey")},
        {"region->nation": (nation, "n_regionkey", "n_nationkey"), "nation->supplier": (supplier, "s_nationkey", "s_suppkey"), "supplier->part": (part, "l_suppkey", "l_partkey")},
    )
    got = H.reach(found.where("kind = 'region'"), edges, 3)
    return got.groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n"))


def _weights(rows: int, columns: int, a: int, b: int) -> list[list[float]]:
    """A matrix of fixed numbers."""
    return [[((a * i + b * j) % 7 - 3) / 10 for j in range(columns)] for i in range(rows)]


#: Three layers of attention, the first with two heads; then the classifier and the localiser with a hidden layer each.
LAYERS = [
    [
        {"matrix": _weights(4, 5, 3, 5), "from_source": [0.1, -0.2, 0.3, 0.1], "from_target": [0.2, 0.1, -0.1, 0.3], "from_edge": [0.4, -0.1]},
        {"matrix": _weights(4, 5, 2, 3), "from_source": [-0.1, 0.2, 0.1, 0.2], "from_target": [0.1, 0.1, 0.2, -0.2], "from_edge": [-0.2, 0.3]},
    ],
    [{"matrix": _weights(4, 8, 2, 3), "from_source": [0.2, 0.1, 0.1, -0.3], "from_target": [-0.1, 0.3, 0.2, 0.1], "from_edge": [0.1, 0.2]}],
    [{"matrix": _weights(3, 4, 5, 2), "from_source": [0.3, -0.1, 0.2], "from_target": [0.1, 0.2, -0.2], "from_edge": [0.2, 0.1]}],
]
CLASSIFIER = {"hidden": _weights(6, 3, 4, 3), "matrix": _weights(5, 6, 1, 2)}
LOCALISER = {"hidden": _weights(4, 3, 2, 5), "last": [0.3, -0.2, 0.1, 0.4]}


def _attended(spark, d):
    """Every nation's vector after all layers. Edges carry the mean loading and status of the lines between two nations."""
    feats = G.node_features(nodes(spark, d), _loads(spark, d), _gens(spark, d), lines(spark, d))
    x = F.array(F.col("load_p") / 1e6, F.col("gen_p") / 1e5, "mean_v", "max_rho", "connected")
    ends = G.both_directions(lines(spark, d).select("src", "dst", "rho", F.col("status").cast("double").alias("on"))).where("src != dst")
    # each layer reads its nodes and edges several times, so they are written in between
    edges = written(ends.groupBy("src", "dst").agg(F.array(F.avg("rho"), F.avg("on")).alias("a")), "edges")
    h = written(feats.select("node", x.alias("x")), "layer")
    for k, heads in enumerate(LAYERS):
        h = written(N.attention_heads(h, edges, heads, activate=k < len(LAYERS) - 1), "layer")
    return h


def graph_attention(spark, d):
    """The graph of each region through pooling and the classifier."""
    named = _attended(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region")), "node")
    out = N.pooled_logits(named, ["region"], **CLASSIFIER)
    return out.select("region", F.posexplode("logits").alias("class", "logit"), "predicted").select("region", F.col("class").cast("long").alias("class"), F.round("logit", 5).alias("logit"), "predicted")


def graph_localiser(spark, d):
    return N.localised(_attended(spark, d), [], **LOCALISER).select("node", F.round("logit", 5).alias("logit"))


def _sql_attention() -> str:
    """The same layers as common table expressions; ``h`` holds the nodes' vectors at the end."""
    dot = lambda a, row: f"list_dot_product({a}, CAST({row} AS DOUBLE[]))"
    through = lambda x, m: f"list_transform(CAST({m} AS DOUBLE[][]), lambda r: list_dot_product(r, {x}))"
    out = [
        f"""{_LINES}, p AS (SELECT c_nationkey AS node, sum(c_acctbal) AS s FROM customer GROUP BY 1), g AS (SELECT s_nationkey AS node, sum(s_acctbal) AS s FROM supplier GROUP BY 1),
both_ends AS (SELECT src, dst, rho, status FROM lines UNION ALL SELECT dst, src, rho, status FROM lines), edges AS (SELECT src, dst, [avg(rho), avg(status::INT)] AS a FROM both_ends WHERE src <> dst GROUP BY 1, 2),
h0 AS (SELECT n_nationkey AS node, [coalesce(p.s, 0) / 1e6, coalesce(g.s, 0) / 1e5, coalesce(mean_v, 0), coalesce(max_rho, 0), coalesce(connected, 1)] AS x
  FROM nation LEFT JOIN p ON p.node = n_nationkey LEFT JOIN g ON g.node = n_nationkey LEFT JOIN raw_lines o ON o.node = n_nationkey)"""
    ]
    for k, heads in enumerate(LAYERS):
        for j, w in enumerate(heads):
            t = f"{k}_{j}"
            shaped = "v" if k == len(LAYERS) - 1 else "CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END"
            out.append(f"""w{t} AS (SELECT node, {through("x", w["matrix"])} AS v FROM h{k}), n{t} AS (SELECT node, v, {dot("v", w["from_source"])} AS s, {dot("v", w["from_target"])} AS t FROM w{t}),
g{t} AS (SELECT src, dst, {dot("a", w["from_edge"])} AS g FROM edges), e{t} AS (SELECT * FROM g{t} UNION ALL SELECT n.node, n.node, coalesce((SELECT avg(g) FROM g{t} i WHERE i.dst = n.node), 0) FROM n{t} n),
r{t} AS (SELECT e.dst, a.v, a.s + b.t + e.g AS raw FROM e{t} e JOIN n{t} a ON a.node = e.src JOIN n{t} b ON b.node = e.dst), q{t} AS (SELECT dst, v, CASE WHEN raw > 0 THEN raw ELSE 0.2::DOUBLE * raw END AS e FROM r{t}),
z{t} AS (SELECT dst, v, exp(e - max(e) OVER (PARTITION BY dst)) AS w FROM q{t}), y{t} AS (SELECT dst, d, sum(w * v[d]) / sum(w) AS v FROM z{t}, (SELECT unnest(range(1, {len(w["matrix"])} + 1)) AS d) GROUP BY 1, 2),
x{t} AS (SELECT dst AS node, list({shaped} ORDER BY d) AS x FROM y{t} GROUP BY 1)""")
        joined = " JOIN ".join([f"x{k}_0", *[f"x{k}_{j} USING (node)" for j in range(1, len(heads))]])
        parts = [f"x{k}_{j}.x" for j in range(len(heads))]
        whole = parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"
        out.append(f"h{k + 1} AS (SELECT node, {whole} AS x FROM {joined})")
    out.append(f"h AS (SELECT * FROM h{len(LAYERS)})")
    return ", ".join(out)


def _sql_two_layers(x: str, hidden: list, last: list) -> str:
    inner = f"list_transform(CAST({hidden} AS DOUBLE[][]), lambda r: greatest(list_dot_product(r, {x}), 0))"
    return f"list_transform(CAST({last} AS DOUBLE[][]), lambda r: list_dot_product(r, {inner}))"


def _train(spark, d):
    """The rows of the train split, in the order of their ids, which alone are numbered."""
    rows = table(spark, d, "embeddings")
    ids = P.ordered_split(rows.select("vec_id"), "vec_id").where("split = 'train'")
    return P.in_split(rows.select("vec_id", "embedding"), ids, "vec_id")


def norm_stats(spark, d):
    out = S.norm_stats(_train(spark, d), "embedding")
    return out.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _z(spark, d, exempt):
    e = table(spark, d, "embeddings")
    z = S.zscore(e, "vec_id", "embedding", S.norm_stats(_train(spark, d), "embedding"), exempt)
    return z.select("vec_id", F.posexplode("z").alias("dim", "z")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z", 5).alias("z"))


def zscore(spark, d):
    return _z(spark, d, ())


def zscore_exempt(spark, d):
    return _z(spark, d, (3,))


_FLAT = """flat AS (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
placed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 < floor(count(*) OVER () * 0.7::DOUBLE) AS train FROM embeddings),
stats AS (SELECT dim, avg(x) AS mean, stddev_pop(x) + 1e-7 AS std FROM flat JOIN placed USING (vec_id) WHERE train GROUP BY dim)"""

PLANS = {
    "node_load": (node_load, "SELECT n_nationkey AS node, round(coalesce(sum(c_acctbal), 0), 4) AS load_p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "node_gen": (node_gen, "SELECT n_nationkey AS node, round(coalesce(sum(s_acctbal), 0), 4) AS gen_p FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "node_lines": (node_lines, f"WITH {_LINES} SELECT * FROM of_lines"),
    "node_features": (
        node_features,
        f"""WITH {_LINES}, p AS (SELECT c_nationkey AS node, sum(c_acctbal) AS s FROM customer GROUP BY 1), g AS (SELECT s_nationkey AS node, sum(s_acctbal) AS s FROM supplier GROUP BY 1)
SELECT n_nationkey AS node, round(coalesce(p.s, 0), 4) AS load_p, round(coalesce(g.s, 0), 4) AS gen_p, coalesce(mean_v, 0) AS mean_v, coalesce(max_rho, 0) AS max_rho, coalesce(connected, 1) AS connected
FROM nation LEFT JOIN p ON p.node = n_nationkey LEFT JOIN g ON g.node = n_nationkey LEFT JOIN of_lines o ON o.node = n_nationkey""",
    ),
    "edges_bidirectional": (
        edges_bidirectional,
        f"WITH {_LINES} SELECT order_id, number, round(rho, 6) AS rho, status, src, dst, false AS reversed FROM lines UNION ALL SELECT order_id, number, round(rho, 6), status, dst, src, true FROM lines",
    ),
    "fault_target": (fault_target, "SELECT CASE WHEN o_orderkey % 32 >= 3 THEN least(o_orderkey % 32 - 3, 24) END AS node, count(*) AS n FROM orders GROUP BY 1"),
    "max_pool": (max_pool, f"WITH {OBS} SELECT episode, dim, round(max(x), 6) AS x FROM (SELECT episode, CAST(unnest(range(64)) AS BIGINT) AS dim, unnest(rho) AS x FROM obs) GROUP BY 1, 2"),
    "exploded_records": (
        exploded_records,
        f"WITH {OBS} SELECT element, round(avg(r), 6) AS mean_rho, count(*) FILTER (NOT s) AS n_off FROM (SELECT CAST(unnest(range(64)) AS BIGINT) AS element, unnest(rho) AS r, unnest(status) AS s FROM obs) GROUP BY 1",
    ),
    "kg_reach": (
        kg_reach,
        """WITH h AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation), s AS (SELECT DISTINCT r, s_suppkey AS k FROM h JOIN supplier ON s_nationkey = n),
p AS (SELECT DISTINCT r, l_partkey AS k FROM s JOIN lineitem ON l_suppkey = k)
SELECT 'region:' || r_regionkey AS start, CAST(0 AS BIGINT) AS hops, count(*) AS n FROM region GROUP BY 1 UNION ALL SELECT 'region:' || r, 1, count(DISTINCT n) FROM h GROUP BY 1
UNION ALL SELECT 'region:' || r, 2, count(*) FROM s GROUP BY 1 UNION ALL SELECT 'region:' || r, 3, count(*) FROM p GROUP BY 1""",
    ),
    "graph_attention": (
        graph_attention,
        f"""WITH {_sql_attention()}, top AS (SELECT n_regionkey AS region, d, max(x[d]) AS v FROM h JOIN nation ON n_nationkey = node, (SELECT unnest(range(1, 4)) AS d) GROUP BY 1, 2),
pooled AS (SELECT region, list(v ORDER BY d) AS x FROM top GROUP BY 1), l AS (SELECT region, {_sql_two_layers("x", CLASSIFIER["hidden"], CLASSIFIER["matrix"])} AS logits FROM pooled)
SELECT region, CAST(unnest(range(len(logits))) AS BIGINT) AS "class", round(unnest(logits), 5) AS logit, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted FROM l""",
    ),
    "graph_localiser": (graph_localiser, f"WITH {_sql_attention()} SELECT node, round({_sql_two_layers('x', LOCALISER['hidden'], [LOCALISER['last']])}[1], 5) AS logit FROM h"),
    "norm_stats": (norm_stats, f"WITH {_FLAT} SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"),
    "zscore": (zscore, f"WITH {_FLAT} SELECT vec_id, dim, round((x - mean) / std, 5) AS z FROM flat JOIN stats USING (dim)"),
    "zscore_exempt": (zscore_exempt, f"WITH {_FLAT} SELECT vec_id, dim, round(CASE WHEN dim = 3 THEN x ELSE (x - mean) / std END, 5) AS z FROM flat JOIN stats USING (dim)"),
}
