"""URL filters: per-host path-template trees with labelled purity, in DataFrame functions only.

A tree is built level by level. Below each node, a path segment that holds too small a share of the node's urls is
generalised to ``*``; the frequent ones stay literal, so each node has at most 1 / ``min_share`` literal branches.
Branches whose share of bad labels doesn't differ significantly from their siblings' are merged with them; a template
is rejected where its smoothed share of good labels falls below ``min_purity``.

Cases: a null url, or one without ``://``, has empty host and path and is judged by the template of the empty host;
pages without label count towards no purity; repeated rows count each; an empty table gives no rows; columns other
than ``page_id`` and ``url`` are ignored. Equal rules can't tie, as the longer fits win and hosts of equal length that
both fit are the same host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def build_templates(
    urls: DataFrame, depth: int = 3, min_share: float = 0.05, min_count: int = 8, z: float = 2.0
) -> DataFrame:
    """``urls``: id, host, path, bad (0/1 or null). Returns id, host, t1..t<depth>, and the merged branch's n_labelled, n_bad.

    Segments beyond ``depth`` levels are one last segment, so no part of a path is dropped.
    """
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.array_join(F.slice("segs", depth, F.greatest(F.size("segs"), F.lit(1))), "/")
    cur = urls.select("id", "host", "bad", segs.alias("segs")).select(
        "id", "host", "bad", *[F.coalesce(F.get("segs", F.lit(k)), F.lit("")).alias(f"s{k + 1}") for k in range(depth - 1)], tail.alias(f"s{depth}")
    )
    levels = [f"t{k}" for k in range(1, depth + 1)]
    for k in range(1, depth + 1):
        node = ["host", *levels[: k - 1]]
        seen = cur.groupBy(*node, f"s{k}").agg(F.count(F.lit(1)).alias("n_seg"))
        total = seen.groupBy(*node).agg(F.sum("n_seg").alias("n_node"))
        literal = (
            seen.join(total, node)
            .where((F.col(f"s{k}") == "") | ((F.col("n_seg") >= min_share * F.col("n_node")) & (F.col("n_seg") >= min_count)))
            .select(*node, f"s{k}", F.col(f"s{k}").alias(levels[k - 1]))
        )
        cur = cur.join(literal, [*node, f"s{k}"], "left").withColumn(levels[k - 1], F.coalesce(levels[k - 1], F.lit("*"))).drop(f"s{k}")
        cur = materialize(cur, "url-level")
    stats = cur.groupBy("host", *levels).agg(F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    merged = stats.select("*", F.lit(0).alias("merged_levels"))
    for k in range(depth, 0, -1):
        node = ["host", *levels[: k - 1]]
        pool = stats.groupBy(*node).agg(F.sum("n_labelled").alias("pool_n"), F.sum("n_bad").alias("pool_bad"))
        share, pooled = F.try_divide(F.col("n_bad"), F.col("n_labelled")), F.try_divide(F.col("pool_bad"), F.col("pool_n"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n_labelled")) + F.try_divide(F.lit(1.0), F.col("pool_n"))))
        same = (F.col("n_labelled") == 0) | (F.abs(share - pooled) <= z * spread)
        # a branch is merged upwards only while every level below it was merged too
        climbs = (F.col("merged_levels") == depth - k) & F.coalesce(same, F.lit(False))
        merged = merged.join(pool, node, "left").select(
            "host",
            *levels,
            F.when(climbs, F.col("pool_n")).otherwise(F.col("n_labelled")).alias("n_labelled"),
            F.when(climbs, F.col("pool_bad")).otherwise(F.col("n_bad")).alias("n_bad"),
            (F.col("merged_levels") + climbs.cast("int")).alias("merged_levels"),
        )
    return cur.join(merged, ["host", *levels], "left")


def judge(
    pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, prior_weight: float = 4.0, min_purity: float = 0.5, **tree: float
) -> DataFrame:
    """``pages``: page_id, url; ``labels``: page key (the last number of the path) with bad 0/1.

    Returns page_id, host, path, rule, verdict, template, purity.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.expr("try_cast(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') AS BIGINT)"))
    marked = labels.select(F.col("key"), F.col("bad").cast("int").alias("bad")).where(F.col("key").isNotNull()).groupBy("key").agg(F.max("bad").alias("bad"))
    # a url without key must not gather under one join key
    key = F.coalesce("key", -1 - F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 40)))
    rows = rows.withColumn("key", key).join(marked, "key", "left")
    packed = rows.withColumn("id", F.struct("page_id", "path"))
    tree_rows = build_templates(packed.select("id", "host", "path", "bad"), **tree)
    base = tree_rows.agg((F.count("bad") + 2.0).alias("n"), (F.count("bad") - F.coalesce(F.sum("bad"), F.lit(0)) + 1.0).alias("good")).select((F.col("good") / F.col("n")).alias("base"))
    purity = (F.col("n_labelled") - F.col("n_bad") + prior_weight * F.col("base")) / (F.col("n_labelled") + prior_weight)
    depth = len([c for c in tree_rows.columns if c[0] == "t" and c[1:].isdigit()])
    template = F.concat(F.lit("/"), F.concat_ws("/", *[F.nullif(F.col(f"t{k}"), F.lit("")) for k in range(1, depth + 1)]))
    hit = match_rule(F.col("host"), F.col("path"), rules)
    return (
        tree_rows.crossJoin(F.broadcast(base))  # one row
        .select(F.col("id.page_id").alias("page_id"), "host", F.col("id.path").alias("path"), template.alias("template"), F.round(purity, 9).alias("purity"))
        .withColumn("hit", hit)
        .select(
            "page_id",
            "host",
            "path",
            F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.when(F.col("purity") < min_purity, "block").otherwise("allow")).alias("verdict"),
            "template",
            "purity",
        )
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    return judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("key"), bad.alias("bad")))


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), marked AS (
  SELECT doc_id AS key, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), rows_ AS (
  SELECT s.*, bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs
  FROM split s LEFT JOIN marked ON key = TRY_CAST(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') AS BIGINT)
), parts AS (
  SELECT page_id, host, path, bad, coalesce(segs[1], '') AS s1, coalesce(segs[2], '') AS s2, array_to_string(segs[3:], '/') AS s3 FROM rows_
), c1 AS (SELECT *, count(*) OVER (PARTITION BY host, s1) AS n, count(*) OVER (PARTITION BY host) AS m FROM parts),
l1 AS (SELECT * EXCLUDE (n, m), CASE WHEN s1 = '' OR (n >= 0.05::DOUBLE * m AND n >= 8) THEN s1 ELSE '*' END AS t1 FROM c1),
c2 AS (SELECT *, count(*) OVER (PARTITION BY host, t1, s2) AS n, count(*) OVER (PARTITION BY host, t1) AS m FROM l1),
l2 AS (SELECT * EXCLUDE (n, m), CASE WHEN s2 = '' OR (n >= 0.05::DOUBLE * m AND n >= 8) THEN s2 ELSE '*' END AS t2 FROM c2),
c3 AS (SELECT *, count(*) OVER (PARTITION BY host, t1, t2, s3) AS n, count(*) OVER (PARTITION BY host, t1, t2) AS m FROM l2),
l3 AS (SELECT * EXCLUDE (n, m), CASE WHEN s3 = '' OR (n >= 0.05::DOUBLE * m AND n >= 8) THEN s3 ELSE '*' END AS t3 FROM c3),
stats AS (
  SELECT host, t1, t2, t3, count(bad)::DOUBLE AS nl, coalesce(sum(bad), 0)::DOUBLE AS nb FROM l3 GROUP BY ALL
), pools AS (
  SELECT *, sum(nl) OVER w3 AS n3, sum(nb) OVER w3 AS b3, sum(nl) OVER w2 AS n2, sum(nb) OVER w2 AS b2, sum(nl) OVER w1 AS n1, sum(nb) OVER w1 AS b1
  FROM stats WINDOW w3 AS (PARTITION BY host, t1, t2), w2 AS (PARTITION BY host, t1), w1 AS (PARTITION BY host)
), m3 AS (
  SELECT *, coalesce(nl = 0 OR abs(nb / nullif(nl, 0) - b3 / nullif(n3, 0)) <= 2 * sqrt(b3 / nullif(n3, 0) * (1 - b3 / nullif(n3, 0)) * (1 / nullif(nl, 0) + 1 / nullif(n3, 0))), false) AS up3 FROM pools
), v3 AS (SELECT *, CASE WHEN up3 THEN n3 ELSE nl END AS x3, CASE WHEN up3 THEN b3 ELSE nb END AS y3 FROM m3),
m2 AS (
  SELECT *, up3 AND coalesce(x3 = 0 OR abs(y3 / nullif(x3, 0) - b2 / nullif(n2, 0)) <= 2 * sqrt(b2 / nullif(n2, 0) * (1 - b2 / nullif(n2, 0)) * (1 / nullif(x3, 0) + 1 / nullif(n2, 0))), false) AS up2 FROM v3
), v2 AS (SELECT *, CASE WHEN up2 THEN n2 ELSE x3 END AS x2, CASE WHEN up2 THEN b2 ELSE y3 END AS y2 FROM m2),
m1 AS (
  SELECT *, up2 AND coalesce(x2 = 0 OR abs(y2 / nullif(x2, 0) - b1 / nullif(n1, 0)) <= 2 * sqrt(b1 / nullif(n1, 0) * (1 - b1 / nullif(n1, 0)) * (1 / nullif(x2, 0) + 1 / nullif(n1, 0))), false) AS up1 FROM v2
), merged AS (SELECT host, t1, t2, t3, CASE WHEN up1 THEN n1 ELSE x2 END AS n, CASE WHEN up1 THEN b1 ELSE y2 END AS b FROM m1),
base AS (SELECT (sum(nl) - sum(nb) + 1) / (sum(nl) + 2) AS base FROM stats),
judged AS (
  SELECT page_id, host, path, '/' || concat_ws('/', nullif(t1, ''), nullif(t2, ''), nullif(t3, '')) AS template, round((n - b + 4 * base) / (n + 4), 9) AS purity
  FROM l3 JOIN merged USING (host, t1, t2, t3) CROSS JOIN base
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM judged
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity
FROM ruled
"""
