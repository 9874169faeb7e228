"""Queries on whole networks: the graph of topology and rules, collated graphs and batches, lines by number, indexed rules.

Nations are buses, parts lines between the nations that supply them, suppliers generators, customers loads; brands and
regions are protection devices, and a kind of part or a market is a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import collate as C
from ..operators import features as G
from ..operators import knowledge as K
from ..operators import metrics as M
from ..operators import shield as H
from ..sources.lines import index_lines, lookup_lines
from ..sources.readers import table
from ..sources.scratch import shared_path, written


def _keys(rows: DataFrame, source: str, target: str) -> DataFrame:
    return rows.select(F.col(source).alias("source"), F.col(target).alias("target"))


def knowledge(spark: SparkSession, d: str, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, each edge once if ``once``."""
    region, nation, supplier, part, customer = (table(spark, d, t) for t in ("region", "nation", "supplier", "part", "customer"))
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    ruled = part.withColumn("rule", F.concat_ws("-", "p_type", "p_size"))
    supplied = table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == supplier["s_suppkey"])
    lines = supplied.select(F.col("l_partkey").alias("line"), F.col("s_nationkey").alias("bus")).repartition("line").distinct()
    lines = written(lines, "lines")  # a line's buses lie together
    devices = part.select(F.col("p_brand").alias("key")).union(region.select("r_name")).distinct()
    rules = ruled.select(F.col("rule").alias("key")).union(customer.select("c_mktsegment")).distinct()
    nodes = K.nodes(
        {
            "Bus": nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
            "Line": part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("max_loading")),
            "Generator": supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("p_max")),
            "Load": customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("p_nominal")),
            "ProtectionDevice": devices,
            "Rule": rules,
        }
    )
    edges = K.edges(
        [
            ("connected_to", "Bus", "Line", _keys(lines, "bus", "line")),
            ("connected_to", "Line", "Bus", _keys(lines, "line", "bus")),
            ("feeds", "Generator", "Bus", _keys(supplier, "s_suppkey", "s_nationkey")),
            ("feeds", "Line", "Bus", _keys(lines.groupBy("line").agg(F.min("bus").alias("bus")), "line", "bus")),
            ("protected_by", "Line", "ProtectionDevice", _keys(part, "p_partkey", "p_brand")),
            ("protected_by", "Bus", "ProtectionDevice", _keys(named, "n_nationkey", "r_name")),
            ("has_rule", "Line", "Rule", _keys(ruled, "p_partkey", "rule")),
            ("has_rule", "Load", "Rule", _keys(customer, "c_custkey", "c_mktsegment")),
            ("triggers", "Rule", "ProtectionDevice", _keys(ruled, "rule", "p_brand")),
        ],
        once,
    )
    return nodes, edges


_KNOWLEDGE = """ruled AS (SELECT *, p_type || '-' || p_size AS rule FROM part),
lines AS (SELECT DISTINCT l_partkey AS line, s_nationkey AS bus FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
nodes AS (SELECT 'Bus' AS kind, 'Bus_' || n_nationkey AS node FROM nation UNION ALL SELECT 'Line', 'Line_' || p_partkey FROM part UNION ALL SELECT 'Generator', 'Generator_' || s_suppkey FROM supplier
  UNION ALL SELECT 'Load', 'Load_' || c_custkey FROM customer UNION ALL SELECT DISTINCT 'ProtectionDevice', 'ProtectionDevice_' || k FROM (SELECT p_brand AS k FROM part UNION SELECT r_name FROM region)
  UNION ALL SELECT DISTINCT 'Rule', 'Rule_' || k FROM (SELECT rule AS k FROM ruled UNION SELECT c_mktsegment FROM customer)),
edges AS (SELECT DISTINCT * FROM (SELECT 'connected_to' AS kind, 'Bus_' || bus AS source, 'Line_' || line AS target FROM lines UNION ALL SELECT 'connected_to', 'Line_' || line, 'Bus_' || bus FROM lines
  UNION ALL SELECT 'feeds', 'Generator_' || s_suppkey, 'Bus_' || s_nationkey FROM supplier UNION ALL SELECT 'feeds', 'Line_' || line, 'Bus_' || min(bus) FROM lines GROUP BY line
  UNION ALL SELECT 'protected_by', 'Line_' || p_partkey, 'ProtectionDevice_' || p_brand FROM part UNION ALL SELECT 'protected_by', 'Bus_' || n_nationkey, 'ProtectionDevice_' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'has_rule', 'Line_' || p_partkey, 'Rule_' || rule FROM ruled UNION ALL SELECT 'has_rule', 'Load_' || c_custkey, 'Rule_' || c_mktsegment FROM customer
  UNION ALL SELECT 'triggers', 'Rule_' || rule, 'ProtectionDevice_' || p_brand FROM ruled))"""


def kg_edges(spark, d):
    """Edges by kind and the kinds of their ends, and how many of them dangle."""
    nodes, edges = knowledge(spark, d)
    lost = K.dangling(edges, nodes).withColumn("lost", F.lit(1))
    ends = [F.regexp_extract(c, "^([^_]*)", 1).alias(f"{c}_kind") for c in ("source", "target")]
    return edges.join(lost, ["kind", "source", "target"], "left").groupBy("kind", *ends).agg(F.count(F.lit(1)).alias("n"), F.count("lost").alias("dangling"))


def kg_closure(spark, d):
    """All that each bus reaches along edges of whatever kind, by kind of node."""
    nodes, edges = knowledge(spark, d, once=False)
    numbered, sets = K.reached(nodes.where("kind = 'Bus'"), edges)
    alike = sets.join(nodes.select("node", "kind"), "node").groupBy("kind", "block", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("hops").alias("hops"), F.max("hops").alias("furthest"))
    return K.by_start(alike, numbered).groupBy("start", "kind").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "hops"), (F.max, "furthest"))])


def kg_chains(spark, d):
    """Entity, rule, device: for each rule and device, how many entities, and how many of them the device protects."""
    _, edges = knowledge(spark, d)
    found = K.chains(edges)
    return found.groupBy("rule", "device").agg(F.count(F.lit(1)).alias("entities"), F.count_if("own").alias("own"), F.count_if("near").alias("near"))


def _graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as graphs: their items are nodes, numbered from 0, each linked with the next, and the last with the first."""
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    listed = item.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("number", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("items"))
    nodes = listed.select("graph", F.posexplode("items").alias("place", "i")).select("graph", F.col("place").cast("long").alias("place"), F.col("i.l_partkey").alias("part"), F.col("i.l_quantity").alias("quantity"))
    ring = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: F.struct(k.cast("long").alias("src"), F.pmod(k + 1, F.size("items")).cast("long").alias("dst")))
    edges = listed.where(F.size("items") > 1).select("graph", F.explode(ring).alias("e")).select("graph", "e.src", "e.dst")
    return nodes, edges


_GRAPHS = """nodes AS (SELECT l_orderkey AS graph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place, l_partkey AS part, l_quantity AS quantity FROM lineitem),
sizes AS (SELECT graph, count(*) AS n_nodes FROM nodes GROUP BY 1), edges AS (SELECT graph, place AS src, (place + 1) % n_nodes AS dst FROM nodes JOIN sizes USING (graph) WHERE n_nodes > 1)"""


def collated_graphs(spark, d):
    """Graphs written to long tables and read back through their slices."""
    nodes, edges = _graphs(spark, d)
    path = shared_path(spark, "collated")
    C.collate(nodes, edges, "graph", ["place"], ["src", "dst"], path)
    slices = spark.read.parquet(f"{path}/slices")
    n, e = C.all_graphs(spark, path, "graph")
    n = n.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("place") * F.col("part")).alias("parts"), F.sum("quantity").alias("quantity"))
    e = e.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("src") * 100 + F.col("dst")).alias("ends"))
    nought = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return slices.select("graph", "ordinal", "node_start", "edge_start").join(n, "graph").join(e, "graph", "left").select("graph", "ordinal", "node_start", "edge_start", "n_nodes", "parts", "quantity", nought("n_edges"), nought("ends"))


def _dealt(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graphs(spark, d)
    sizes = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"))
    return nodes, edges, C.batched(sizes, "graph", "n_nodes", 23)


def batch_targets(spark, d):
    """Graphs in batches of 256, and the node of the batch that a fault marks; some graphs have none, some lie beyond the last node."""
    dealt = _dealt(spark, d)[2]
    location = F.when(F.col("graph") % 11 >= 2, F.col("graph") % 11 - 2).otherwise(F.lit(-1))
    return dealt.select("graph", "batch", "place", "ptr", C.batch_target(location, F.col("ptr"), F.col("n_nodes")).alias("target"))


def batch_graphs(spark, d):
    """Nodes and edges of batches with numbers of the batch: figures of each batch."""
    nodes, edges, dealt = _dealt(spark, d)
    n = C.batch_nodes(nodes, dealt, "graph", "place").groupBy("batch").agg(F.count(F.lit(1)).alias("nodes"), F.max("node").alias("last"), F.sum(F.col("node") * F.col("part")).alias("parts"))
    e = C.batch_edges(G.both_directions(edges), dealt, "graph").groupBy("batch").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("src") * F.col("dst")).alias("ends"))
    return n.join(e, "batch")


_DEALT = f"""{_GRAPHS}, dealt AS (SELECT graph, n_nodes, row_number() OVER (ORDER BY (((graph + 23) * 2654435761) % 4294967296) // 1024 % 1000000, graph) - 1 AS o FROM sizes),
b AS (SELECT graph, n_nodes, o // 256 AS batch, o % 256 AS place, CAST(coalesce(sum(n_nodes) OVER (PARTITION BY o // 256 ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM dealt)"""


def lines_by_number(spark, d):
    """Events as lines of text files, every seventh blank, looked up by numbers that repeat."""
    path = shared_path(spark, "numbered")
    events = table(spark, d, "events")
    said = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.to_json(F.struct("event_id", "event_type")))
    events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(said.alias("value")).write.text(path)
    wanted = table(spark, d, "orders").join(events.agg(F.count(F.lit(1)).alias("n"))).select("o_orderkey", (F.col("o_orderkey") * 3 % F.col("n")).alias("number"))
    return lookup_lines(spark, index_lines(spark, path), wanted)


def shield_index(spark, d):
    """A rule for each part, in an index by thresholds, against suppliers."""
    i = F.col("p_partkey")
    entity = F.get(F.array(*[F.lit(x) for x in ("Bus", "line", "generator")]), F.pmod(i, F.lit(3)).cast("int"))
    size, price = F.col("p_size").cast("string"), (F.col("p_size") * 150).cast("string")
    conditions = [F.concat(F.lit("rho > "), size), F.concat(F.lit("temp <= "), price, F.lit(" AND rho >= "), size), F.concat(size, F.lit(" = rho OR temp < -900")), F.lit("rho > temp"), F.concat(F.lit("rho != "), size, F.lit(" AND "), price, F.lit(" < temp"))]
    rules = table(spark, d, "part").select(
        entity.alias("entity"),
        i.cast("string").alias("rule_id"),
        F.get(F.array(*conditions), F.pmod(i, F.lit(5)).cast("int")).alias("condition"),
        F.concat(F.lit("r"), i.cast("string")).alias("explanation"),
    )
    j = F.col("s_suppkey")
    predictions = table(spark, d, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(x) for x in ("bus", "Line", "load")]), F.pmod(j, F.lit(3)).cast("int")).alias("entity"), F.pmod(j, F.lit(60)).cast("double").alias("rho"), F.col("s_acctbal").alias("temp"))
    out = H.indexed_shield(predictions, H.parsed_rules(rules, ("rho", "temp")), "s_suppkey", ("rho", "temp"), cell=64, digest=True)
    return out.select("s_suppkey", "decision", F.col("explanation").alias("digest"), "n_violated")


def finite_records(spark, d):
    """Records that pass the assertion on finite values: embeddings cleaned, then asserted."""
    cleaned = A.fill_nonfinite(F.transform("embedding", lambda v: F.when(v > 0.3, F.lit(float("nan"))).otherwise(v.cast("double"))))
    rows = table(spark, d, "embeddings").select("vec_id", cleaned.alias("x"))
    return rows.select("vec_id", A.assert_finite(F.col("x"), "x").alias("x")).select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


PLANS = {
    "kg_edges": (
        kg_edges,
        f"""WITH {_KNOWLEDGE} SELECT kind, regexp_extract(source, '^([^_]*)', 1) AS source_kind, regexp_extract(target, '^([^_]*)', 1) AS target_kind, count(*) AS n,
  count(*) FILTER (source NOT IN (SELECT node FROM nodes) OR target NOT IN (SELECT node FROM nodes)) AS dangling FROM edges GROUP BY 1, 2, 3""",
    ),
    "kg_closure": (
        kg_closure,
        f"""WITH RECURSIVE {_KNOWLEDGE}, steps AS (SELECT DISTINCT source, target FROM edges),
walk AS (SELECT node AS start, node, 0 AS hops FROM nodes WHERE kind = 'Bus' UNION SELECT start, target, hops + 1 FROM walk JOIN steps ON source = node WHERE hops < 7),
best AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY 1, 2)
SELECT start, kind, count(*) AS n, CAST(sum(hops) AS BIGINT) AS hops, CAST(max(hops) AS BIGINT) AS furthest FROM best JOIN nodes USING (node) GROUP BY 1, 2""",
    ),
    "kg_chains": (
        kg_chains,
        f"""WITH {_KNOWLEDGE}, guards AS (SELECT DISTINCT source AS entity, target AS device FROM edges WHERE kind = 'protected_by'),
near AS (SELECT DISTINCT e.source AS entity, g.device FROM edges e JOIN guards g ON g.entity = e.target WHERE e.kind = 'connected_to'),
chain AS (SELECT h.source AS entity, h.target AS rule, t.target AS device FROM edges h JOIN edges t ON t.source = h.target WHERE h.kind = 'has_rule' AND t.kind = 'triggers')
SELECT rule, device, count(*) AS entities, count(g.entity) AS own, count(n.entity) AS near FROM chain c LEFT JOIN guards g USING (entity, device) LEFT JOIN near n USING (entity, device) GROUP BY 1, 2""",
    ),
    "collated_graphs": (
        collated_graphs,
        f"""WITH {_GRAPHS}, e AS (SELECT graph, count(*) AS n_edges, CAST(sum(src * 100 + dst) AS BIGINT) AS ends FROM edges GROUP BY 1),
n AS (SELECT graph, count(*) AS n_nodes, CAST(sum(place * part) AS BIGINT) AS parts, sum(quantity) AS quantity FROM nodes GROUP BY 1),
g AS (SELECT graph, n_nodes, parts, quantity, coalesce(n_edges, 0) AS n_edges, coalesce(ends, 0) AS ends FROM n LEFT JOIN e USING (graph))
SELECT graph, row_number() OVER (ORDER BY graph) - 1 AS ordinal, CAST(sum(n_nodes) OVER w - n_nodes AS BIGINT) AS node_start, CAST(sum(n_edges) OVER w - n_edges AS BIGINT) AS edge_start, n_nodes, parts, quantity, n_edges, ends
FROM g WINDOW w AS (ORDER BY graph)""",
    ),
    "batch_targets": (
        batch_targets,
        f"WITH {_DEALT} SELECT graph, batch, place, ptr, CASE WHEN graph % 11 >= 2 THEN least(ptr + graph % 11 - 2, ptr + n_nodes - 1) END AS target FROM b",
    ),
    "batch_graphs": (
        batch_graphs,
        f"""WITH {_DEALT}, n AS (SELECT batch, count(*) AS nodes, max(ptr + nodes.place) AS last, CAST(sum((ptr + nodes.place) * part) AS BIGINT) AS parts FROM nodes JOIN b USING (graph) GROUP BY 1),
e AS (SELECT batch, 2 * count(*) AS edges, CAST(2 * sum((ptr + src) * (ptr + dst)) AS BIGINT) AS ends FROM edges JOIN b USING (graph) GROUP BY 1) SELECT * FROM n JOIN e USING (batch)""",
    ),
    "lines_by_number": (
        lines_by_number,
        """WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS number, CASE WHEN event_id % 7 = 0 THEN '' ELSE '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' END AS value FROM events)
SELECT o_orderkey, o_orderkey * 3 % (SELECT count(*) FROM events) AS number, value FROM orders JOIN l ON l.number = o_orderkey * 3 % (SELECT count(*) FROM events)""",
    ),
    "shield_index": (
        shield_index,
        """WITH p AS (SELECT s_suppkey, ['bus', 'line', 'load'][s_suppkey % 3 + 1] AS entity, CAST(s_suppkey % 60 AS DOUBLE) AS rho, s_acctbal AS temp FROM supplier),
r AS (SELECT p_partkey AS i, ['bus', 'line', 'generator'][p_partkey % 3 + 1] AS entity, p_size AS size, p_size * 150 AS price FROM part),
x AS (SELECT s_suppkey, 'r' || i AS e FROM p JOIN r USING (entity) WHERE CASE i % 5 WHEN 0 THEN rho > size WHEN 1 THEN temp <= price AND rho >= size WHEN 2 THEN rho = size OR temp < -900 WHEN 3 THEN rho > temp ELSE rho <> size AND price < temp END),
g AS (SELECT s_suppkey, string_agg(e, ' | ' ORDER BY e) AS e, count(*) AS n FROM x GROUP BY 1)
SELECT s_suppkey, CASE WHEN n > 0 THEN 'BLOCK' ELSE 'PASS' END AS decision, md5(coalesce(e, '')) AS digest, coalesce(n, 0) AS n_violated FROM p LEFT JOIN g USING (s_suppkey)""",
    ),
    "finite_records": (
        finite_records,
        """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0.3::FLOAT THEN 0 ELSE CAST(v AS DOUBLE) END)), 5) AS total FROM embeddings""",
    ),
}
