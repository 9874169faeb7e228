"""Queries on data quality, splits, metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..operators import audit as D
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import splits as P
from ..operators import stats as S
from ..sources.readers import lookup, parse_tolerant, table
from ..streaming.trips import tripped_sets
from .labels import OBS, events, observations


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Array records with what the given ones lack: infinities, NaN and cut arrays at fixed places."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    made = F.transform(x, lambda v: F.when(v > 0.3, F.lit(float("inf"))).when(v < -0.3, F.lit(float("nan"))).otherwise(v * 10))
    return table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice(made, 1, 60)).otherwise(made).alias("rho"), "label")


_DIRTY = """dirty AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN m[1:60] ELSE m END AS rho FROM (SELECT vec_id, label,
  list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > 0.3 THEN 'Infinity'::DOUBLE WHEN CAST(v AS DOUBLE) < -0.3 THEN 'NaN'::DOUBLE ELSE CAST(v AS DOUBLE) * 10 END) AS m FROM embeddings))"""


def sanitize_clip(spark, d):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6)
    r = F.col("rho")
    return dirty(spark, d).select("vec_id", total(A.fill_nonfinite(r)).alias("filled"), total(A.clean_then_cap(r, 2.0)).alias("written"), total(A.clip_then_clean(r, 2.0)).alias("read"))


def record_counts(spark, d):
    return D.record_counts(dirty(spark, d), {"rho": 64})


def audit_issues(spark, d):
    classes = tuple(str(k) for k in range(11))
    rows = dirty(spark, d).withColumn("label", F.col("label").cast("string"))
    return D.issues(rows, "label", classes, ("10",), {"rho": 64})


def rho_stats(spark, d):
    flat = dirty(spark, d).select(F.explode("rho").alias("x"))
    return S.value_profile(flat, "x")


def inspect_arrays(spark, d):
    rows = observations(spark, d).withColumn("part", F.when(F.col("vec_id") % 7 == 0, F.slice("rho", 1, 60)).otherwise(F.col("rho")))
    return S.inspect_arrays(rows, "part", "injected").withColumn("largest", F.round("largest", 6))


def episode_lengths(spark, d):
    e = events(spark, d).withColumn("other", F.when(F.col("user_id") % 2 == 0, F.col("user_id"))).withColumn("old", -F.col("user_id"))
    return S.episode_lengths(e, F.coalesce("other", "old"))


def distinct_lengths(spark, d):
    return events(spark, d).groupBy("user_id").count().select(F.col("count").alias("length")).distinct()


def ordered_split(spark, d):
    return P.ordered_split(events(spark, d).select("event_id"), "event_id").select("event_id", "ordinal", "split")


def split_by_group(spark, d):
    out = P.split_by_group(events(spark, d).select("event_id", "user_id"), "user_id")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def split_labels(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    index = P.ordered_split(e, "event_id").where("split = 'val'")
    return S.histogram(P.in_split(e, index, "event_id"), "event_type")


def undersample(spark, d):
    return P.undersample(events(spark, d), "event_id", "event_type", "view", 0.15).select("event_id", "event_type")


def first_records(spark, d):
    return events(spark, d).orderBy("event_id").limit(300).select("event_id", "event_type")


def lookup_records(spark, d):
    ids = table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("event_id"))
    return lookup(events(spark, d), ids, "event_id").select("event_id", "event_type")


def tolerant_scan(spark, d):
    cut = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = parse_tolerant(events(spark, d).withColumn("line", cut), "line", T.StructType([T.StructField("k", T.LongType())]))
    return rows.groupBy("event_type").agg(F.count("record").alias("parsed"), F.count_if(F.col("record").isNull()).alias("malformed"), F.sum("record.k").alias("k"))


def _judged(spark, d):
    return table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")


def confusion(spark, d):
    return M.confusion(_judged(spark, d), "quality", "toxic")


def confusion_matrix(spark, d):
    out = M.confusion_matrix(_judged(spark, d), "quality", "toxic", [0, 1])
    return out.select("truth", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


def class_report(spark, d):
    out = M.report(_judged(spark, d), "quality", "toxic")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1(spark, d):
    return M.macro_f1(_judged(spark, d), "quality", "toxic").select(F.round("macro_f1", 6).alias("macro_f1"))


def top3_hits(spark, d):
    hit = M.top_k_hit(F.transform("embedding", lambda v: v.cast("double")), F.col("label"), 3)
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(M.rate(hit), 6).alias("top3"), F.count(F.lit(1)).alias("n"))


def _envs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .groupBy(F.col("c_mktsegment").alias("env_name"))
        .agg(
            (F.countDistinct("c_nationkey") + F.sum(F.col("c_custkey") % 7) % 40).alias("n_sub"),
            (F.sum(F.col("c_custkey") % 11) % 150 + 30).alias("n_line"),
            F.round(F.avg("o_totalprice") / 300, 4).alias("steps_per_sec"),
            F.round(M.rate(F.col("o_orderpriority") == "1-URGENT") / 10, 6).alias("overload_rate"),
            F.round(M.rate(F.col("o_orderstatus") == "F") / 4, 6).alias("non_normal_rate"),
            F.round(F.countDistinct("o_orderstatus") / 3.0, 6).alias("class_diversity"),
        )
    )


def scorecard(spark, d):
    return C.scorecard(_envs(spark, d))


def recommendation(spark, d):
    return C.recommendation(C.scorecard(_envs(spark, d)))


def _scores(spark, d):
    return events(spark, d).select("user_id", "event_id", F.round("value", 3).alias("score"))


def early_stop(spark, d):
    return C.early_stop(_scores(spark, d), "user_id", "event_id", "score", 0.001, 3)


def best_so_far(spark, d):
    return C.improvements(_scores(spark, d), "user_id", "event_id", "score").where("improved").select("user_id", "event_id", "score")


def top_score(spark, d):
    return C.best(events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("score")), "score", "event_type")


def speed_bands(spark, d):
    per = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    name = A.band(F.col("n"), [(20, "fast"), (12, "moderate"), (5, "slow")], "very slow")
    return per.groupBy(name.alias("band")).agg(F.count(F.lit(1)).alias("users"))


def tripped_lines(spark, d):
    kind = F.col("event_type")
    line = F.col("event_id") % 9
    steps = events(spark, d).select(
        F.col("user_id").alias("episode"),
        F.col("event_id").alias("step"),
        F.when(kind == "click", line).alias("reconnect"),
        F.when(kind == "view", line).alias("inject"),
        F.when(kind == "error", F.array(line, line + 20)).otherwise(F.array().cast("array<bigint>")).alias("trips"),
        (kind == "purchase").alias("done"),
    )
    out = tripped_sets(steps)
    return out.select("episode", "step", "n_tripped", F.array_join(F.transform("tripped", lambda x: x.cast("string")), ",").alias("tripped"))


def run_summary(spark, d):
    return S.run_summary(events(spark, d), "ts")


def train_order(spark, d):
    """The train split of ``ordered_split`` in a shuffled order; the other splits keep theirs."""
    train = P.ordered_split(events(spark, d).select("event_id"), "event_id").where("split = 'train'").select("event_id")
    return P.shuffled(train, "event_id", 17).select("event_id", F.col("ordinal").alias("place"))


_HASH = "(((event_id * 2654435761) % 4294967296) // 1024) % 1000000"
_SPLIT = """split AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS ordinal, count(*) OVER () AS total FROM events),
named AS (SELECT event_id, event_type, ordinal, CASE WHEN ordinal < floor(total * 0.7::DOUBLE) THEN 'train' WHEN ordinal < floor(total * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM split)"""
_PER = """c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
k AS (SELECT t AS label FROM c UNION SELECT p FROM c),
per AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0)::DOUBLE AS tp, coalesce((SELECT sum(n) FROM c WHERE t = label), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM c WHERE p = label), 0)::BIGINT AS called FROM k),
f AS (SELECT label, support, tp, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(called + support, 0), 0) AS f1 FROM per)"""
_ENVS = """envs AS (SELECT c_mktsegment AS env_name, CAST(count(DISTINCT c_nationkey) + sum(c_custkey % 7) % 40 AS BIGINT) AS n_sub, CAST(sum(c_custkey % 11) % 150 + 30 AS BIGINT) AS n_line,
  round(avg(o_totalprice) / 300, 4) AS steps_per_sec, round(avg((o_orderpriority = '1-URGENT')::INT) / 10, 6) AS overload_rate, round(avg((o_orderstatus = 'F')::INT) / 4, 6) AS non_normal_rate,
  round(count(DISTINCT o_orderstatus) / 3.0::DOUBLE, 6) AS class_diversity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
parts AS (SELECT *, greatest(1.0::DOUBLE - CASE WHEN n_sub > 50 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN n_line > 100 THEN 0.15::DOUBLE ELSE 0 END, 0) AS fit, steps_per_sec / max(steps_per_sec) OVER () AS speed,
  CAST(min(n_sub + n_line) OVER () AS DOUBLE) / (n_sub + n_line) AS simplicity, least(non_normal_rate / 0.1::DOUBLE, 1) AS nn, least(overload_rate / 0.03::DOUBLE, 1) AS ov FROM envs),
rich AS (SELECT *, greatest(least(0.45::DOUBLE * nn + 0.25::DOUBLE * ov + 0.3::DOUBLE * class_diversity, 1), 0) AS richness FROM parts),
card AS (SELECT env_name, n_sub, n_line, steps_per_sec, overload_rate, non_normal_rate, class_diversity, round(fit, 4) AS scope_fit_score, round(speed, 4) AS efficiency_score, round(richness, 4) AS event_richness_score,
  round(simplicity, 4) AS simplicity_score, round(0.4::DOUBLE * fit + 0.25::DOUBLE * speed + 0.2::DOUBLE * richness + 0.15::DOUBLE * simplicity, 4) AS final_score,
  round(0.4::DOUBLE * fit + 0.35::DOUBLE * speed + 0.25::DOUBLE * simplicity, 4) AS integration_score, round(0.45::DOUBLE * richness + 0.3::DOUBLE * class_diversity + 0.25::DOUBLE * speed, 4) AS scale_score FROM rich)"""

PLANS = {
    "sanitize_clip": (
        sanitize_clip,
        f"""WITH {_DIRTY}, v AS (SELECT vec_id, unnest(rho) AS x FROM dirty), c AS (SELECT vec_id, x, CASE WHEN isfinite(x) THEN x ELSE 0 END AS z FROM v)
SELECT vec_id, round(sum(z), 6) AS filled, round(sum(least(z, 2)), 6) AS written, round(sum(CASE WHEN isnan(x) THEN 0 ELSE least(greatest(x, 0), 2) END), 6) AS read FROM c GROUP BY 1""",
    ),
    "record_counts": (
        record_counts,
        f"""WITH {_DIRTY}, v AS (SELECT unnest(rho) AS x FROM dirty) SELECT 'rho' AS field, (SELECT count(*) FROM dirty WHERE len(rho) <> 64) AS wrong_size,
  count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infs FROM v""",
    ),
    "audit_issues": (
        audit_issues,
        f"""WITH {_DIRTY}, v AS (SELECT unnest(rho) AS x FROM dirty), absent AS (SELECT list(k ORDER BY k) AS l FROM (SELECT CAST(unnest(range(11)) AS VARCHAR) AS k) WHERE k NOT IN (SELECT CAST(label AS VARCHAR) FROM dirty)),
h AS (SELECT count(*) AS n FROM dirty GROUP BY label), r AS (SELECT round(max(n) / (min(n) + 1e-9::DOUBLE), 2) AS ratio FROM h)
SELECT 'missing_labels' AS id, CASE WHEN l = ['10'] THEN 'medium' ELSE 'high' END AS severity, 'Expected classes don''t occur' AS title, array_to_string(l, ',') AS detail, 'Collect more episodes' AS fix FROM absent WHERE len(l) > 0
UNION ALL SELECT 'imbalance', 'medium', 'Classes are uneven', printf('%.2f', ratio), 'Weigh or undersample classes' FROM r WHERE ratio > 10
UNION ALL SELECT 'shape_rho', 'high', 'Arrays of a wrong length', 'rho: ' || n, NULL FROM (SELECT count(*) AS n FROM dirty WHERE len(rho) <> 64) WHERE n > 0
UNION ALL SELECT 'nan_rho', 'high', 'NaN values', 'rho: ' || n, NULL FROM (SELECT count(*) AS n FROM v WHERE isnan(x)) WHERE n > 0
UNION ALL SELECT 'inf_rho', 'high', 'Infinite values', 'rho: ' || n, NULL FROM (SELECT count(*) AS n FROM v WHERE isinf(x)) WHERE n > 0""",
    ),
    "rho_stats": (
        rho_stats,
        f"""WITH {_DIRTY}, v AS (SELECT unnest(rho) AS x FROM dirty) SELECT round(min(x), 4) AS "min", round(max(x), 4) AS "max", round(avg(x), 4) AS mean, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99
FROM v WHERE isfinite(x)""",
    ),
    "inspect_arrays": (
        inspect_arrays,
        f"""WITH {OBS}, p AS (SELECT CASE WHEN vec_id % 7 = 0 THEN rho[1:60] ELSE rho END AS part, injected FROM obs)
SELECT (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM (SELECT DISTINCT len(part) AS n FROM p)) AS lengths, round(greatest(max(list_max(part)), 0), 6) AS largest, count(*) FILTER (injected IS NULL) AS without FROM p""",
    ),
    "episode_lengths": (episode_lengths, "WITH p AS (SELECT count(*) AS n FROM events GROUP BY CASE WHEN user_id % 2 = 0 THEN user_id ELSE -user_id END) SELECT count(*) AS episodes, min(n) AS shortest, max(n) AS longest FROM p"),
    "distinct_lengths": (distinct_lengths, "SELECT DISTINCT n AS length FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"),
    "ordered_split": (ordered_split, f"WITH {_SPLIT} SELECT event_id, ordinal, split FROM named"),
    "split_by_group": (
        split_by_group,
        """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS o, count(*) OVER () AS t FROM (SELECT DISTINCT user_id FROM events)),
s AS (SELECT user_id, CASE WHEN o < floor(t * 0.7::DOUBLE) THEN 'train' WHEN o < floor(t * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM u)
SELECT split, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN s USING (user_id) GROUP BY 1""",
    ),
    "split_labels": (split_labels, f"WITH {_SPLIT} SELECT event_type AS label, count(*) AS n FROM named WHERE split = 'val' GROUP BY 1"),
    "undersample": (undersample, f"SELECT event_id, event_type FROM events WHERE event_type <> 'view' OR {_HASH} <= 150000"),
    "first_records": (first_records, "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 300"),
    "lookup_records": (lookup_records, "SELECT event_id, event_type FROM events WHERE event_id IN (SELECT o_orderkey * 3 FROM orders)"),
    "tolerant_scan": (
        tolerant_scan,
        """WITH p AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 4) ELSE props END AS line FROM events),
j AS (SELECT event_type, CASE WHEN json_valid(line) THEN CAST(json_extract(line, '$.k') AS BIGINT) END AS k, json_valid(line) AS ok FROM p)
SELECT event_type, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT coalesce(ok, false)) AS malformed, CAST(sum(k) AS BIGINT) AS k FROM j GROUP BY 1""",
    ),
    "confusion": (confusion, "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2"),
    "confusion_matrix": (
        confusion_matrix,
        "SELECT quality AS truth, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1",
    ),
    "class_report": (
        class_report,
        f"""WITH {_PER} SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
    ),
    "macro_f1": (macro_f1, f"WITH {_PER} SELECT round(avg(f1), 6) AS macro_f1 FROM f"),
    "top3_hits": (
        top3_hits,
        """WITH v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM v),
h AS (SELECT vec_id, label, max((i = label)::INT) AS hit FROM r WHERE k <= 3 GROUP BY 1, 2) SELECT label, round(avg(hit), 6) AS top3, count(*) AS n FROM h GROUP BY 1""",
    ),
    "scorecard": (scorecard, f"WITH {_ENVS} SELECT * FROM card"),
    "recommendation": (
        recommendation,
        f"WITH {_ENVS} SELECT (SELECT env_name FROM card ORDER BY integration_score DESC, env_name LIMIT 1) AS start_with, (SELECT env_name FROM card ORDER BY scale_score DESC, env_name LIMIT 1) AS scale_to",
    ),
    "early_stop": (
        early_stop,
        """WITH RECURSIVE s AS (SELECT user_id, round(value, 3) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, x AS best, 0 AS counter, false AS stopped FROM s WHERE i = 1
UNION ALL SELECT s.user_id, s.i, CASE WHEN s.x >= f.best + 0.001::DOUBLE THEN s.x ELSE f.best END, CASE WHEN s.x >= f.best + 0.001::DOUBLE THEN 0 ELSE f.counter + 1 END,
  s.x < f.best + 0.001::DOUBLE AND f.counter + 1 >= 3 FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1 WHERE NOT f.stopped)
SELECT user_id, arg_max(best, i) AS best, arg_max(counter, i) AS counter, arg_max(stopped, i) AS stopped, CAST(max(i) AS INTEGER) AS epochs FROM f GROUP BY 1""",
    ),
    "best_so_far": (
        best_so_far,
        """WITH s AS (SELECT user_id, event_id, round(value, 3) AS score FROM events), b AS (SELECT *, max(score) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT user_id, event_id, score FROM b WHERE score > greatest(coalesce(before, 0), 0)""",
    ),
    "top_score": (top_score, "SELECT event_type, round(avg(value), 1) AS score FROM events GROUP BY 1 ORDER BY score DESC, event_type LIMIT 1"),
    "speed_bands": (
        speed_bands,
        "SELECT CASE WHEN n >= 20 THEN 'fast' WHEN n >= 12 THEN 'moderate' WHEN n >= 5 THEN 'slow' ELSE 'very slow' END AS band, count(*) AS users FROM (SELECT count(*) AS n FROM events GROUP BY user_id) GROUP BY 1",
    ),
    "tripped_lines": (
        tripped_lines,
        """WITH RECURSIVE s AS (SELECT user_id AS episode, event_id AS step, event_type AS kind, event_id % 9 AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT episode, 0 AS i, CAST(NULL AS BIGINT) AS step, CAST([] AS BIGINT[]) AS now, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT episode FROM s)
UNION ALL SELECT episode, i, step, now, CASE WHEN kind = 'purchase' THEN CAST([] AS BIGINT[]) ELSE now END FROM (SELECT s.episode, s.i, s.step, s.kind,
  list_sort(list_distinct(CASE kind WHEN 'click' THEN list_filter(kept, lambda x: x <> line) WHEN 'view' THEN list_append(kept, line) WHEN 'error' THEN list_concat(kept, [line, line + 20]) ELSE kept END)) AS now
  FROM f JOIN s ON s.episode = f.episode AND s.i = f.i + 1))
SELECT episode, step, CAST(len(now) AS BIGINT) AS n_tripped, array_to_string(now, ',') AS tripped FROM f WHERE i > 0""",
    ),
    "run_summary": (
        run_summary,
        """WITH r AS (SELECT min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM events), t AS (SELECT *, (epoch_us(hi) - epoch_us(lo)) / 1e6 AS sec FROM r)
SELECT strftime(lo, '%Y-%m-%dT%H:%M:%S.%f') AS run_start, strftime(hi, '%Y-%m-%dT%H:%M:%S.%f') AS run_end, round(sec, 1) AS total_time_sec, n AS total_records, CAST(round(n / greatest(sec, 1e-9)) AS BIGINT) AS records_per_sec FROM t""",
    ),
    "train_order": (
        train_order,
        f"WITH {_SPLIT}, t AS (SELECT event_id FROM named WHERE split = 'train') SELECT event_id, row_number() OVER (ORDER BY {_HASH.replace('event_id', '(event_id + 17)')}, event_id) - 1 AS place FROM t",
    ),
}
