"""Queries on labels: histograms, weights, ladders and trips. ``events`` stands for a log, ``embeddings`` for array records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import labels as L
from ..operators import stats as S
from ..sources.readers import table
from ..sources.writers import bar

#: The classes expected in ``events``; the last never occurs there.
CLASSES = ("view", "click", "purchase", "signup", "error", "maintenance")
_DOMAIN = "(SELECT unnest(['view','click','purchase','signup','error','maintenance']) AS label, CAST(unnest(range(6)) AS BIGINT) AS label_id)"
_FULL = f"full_h AS (SELECT d.label, d.label_id, count(e.event_id) AS n FROM {_DOMAIN} d LEFT JOIN events e ON e.event_type = d.label GROUP BY 1, 2)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Array records: the embedding gives loading, status and maintenance of 64 lines; episodes are labels, steps vec_ids."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.col("label").alias("episode"),
        F.transform(e, lambda v: F.abs(v) * 4).alias("rho"),
        F.transform(e, lambda v: v > F.lit(-0.2)).alias("status"),
        F.transform(e, lambda v: v > F.lit(0.35)).alias("maintenance"),
        F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 64).alias("injected"),
    )


OBS = """obs AS (SELECT vec_id, label AS episode, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) * 4) AS rho,
  list_transform(embedding, lambda v: CAST(v AS DOUBLE) > -0.2) AS status, list_transform(embedding, lambda v: CAST(v AS DOUBLE) > 0.35) AS maintenance,
  CASE WHEN vec_id % 3 = 0 THEN vec_id % 64 END AS injected FROM embeddings)"""
_STEPS = OBS + """, steps AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY episode ORDER BY vec_id), status) AS before FROM obs),
trips AS (SELECT *, list_filter(list_transform(range(64), lambda i: CASE WHEN before[i + 1] AND NOT status[i + 1] THEN i END), lambda i: i IS NOT NULL) AS new_trips FROM steps),
laddered AS (SELECT *, list_filter(new_trips, lambda i: injected IS NULL OR i <> injected) AS alien, list_max(rho) AS top,
  list_position(rho, list_max(rho)) - 1 AS top_at, nullif(coalesce(list_position(maintenance, true), 0), 0) - 1 AS maint_at FROM trips)"""


def origins() -> Column:
    """The substation where each of the 64 lines begins."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * 7 % 36).cast("long"))


def _trips(spark: SparkSession, d: str) -> DataFrame:
    rows = L.with_previous(observations(spark, d), "status", "episode", "vec_id")
    return rows.withColumn("new_trips", L.new_trips(F.col("previous_status"), F.col("status")))


def label_histogram(spark, d):
    return S.histogram(events(spark, d), "event_type")


def label_percent(spark, d):
    out = S.label_percent(events(spark, d), "event_type", CLASSES)
    return out.withColumn("bar", bar(F.col("pct")))


def class_weights(spark, d):
    return S.class_weights(events(spark, d), "event_type", CLASSES).select("label", "label_id", "n", F.round("weight", 6).alias("weight"))


def class_imbalance(spark, d):
    return S.imbalance(events(spark, d), "event_type")


def missing_labels(spark, d):
    return S.missing_labels(events(spark, d), "event_type", CLASSES, ("maintenance", "error"))


def label_encode(spark, d):
    ids = {c: i for i, c in enumerate(CLASSES) if c != "error"}
    e = events(spark, d)
    code = A.encode_label(F.col("event_type"), ids)
    return e.groupBy(F.col("event_type").alias("label")).agg(
        F.min(A.sentinel(code)).cast("long").alias("with_sentinel"), F.min(A.encode_label(F.col("event_type"), ids, 0)).cast("long").alias("unknown_as_zero"), F.count_if(code.isNull()).alias("skipped")
    )


def new_trips(spark, d):
    t = _trips(spark, d)
    return t.select("vec_id", F.size("new_trips").cast("long").alias("n_trips"), F.get("new_trips", F.lit(0)).alias("first_trip"), F.array_join(F.transform("new_trips", lambda x: x.cast("string")), ",").alias("trips"))


def env_trips(spark, d):
    foreign = L.foreign_trips(F.col("new_trips"), F.when(F.col("injected").isNotNull(), F.array("injected")))
    return _trips(spark, d).select("vec_id", F.array_join(F.transform(foreign, lambda x: x.cast("string")), ",").alias("foreign"), F.array_min(foreign).alias("lowest"))


def priority_label(spark, d):
    t = _trips(spark, d).withColumn("maint_at", A.first_true(F.col("maintenance")))
    args = (F.col("rho"), F.col("new_trips"), F.col("injected"), F.col("maint_at"))
    found = t.select("vec_id", L.priority_label(*args, F.lit("normal")).alias("label"), L.priority_line(*args).cast("long").alias("line"))
    return found.withColumn("substation", L.substation(F.col("line"), origins()))


def screening_label(spark, d):
    return observations(spark, d).select("vec_id", L.screening_label(F.col("rho"), F.col("status"), F.col("maintenance")).alias("label"))


def probe_rates(spark, d):
    o = observations(spark, d)
    label = L.screening_label(F.col("rho"), F.col("status"), F.col("maintenance"))
    out = S.probe_rates(o, A.nan_max(F.col("rho")) > L.OVERLOAD, F.exists("status", lambda s: ~s), F.exists("maintenance", lambda m: m), label, ["episode"])
    return out.select("episode", "steps", *[F.round(c, 6).alias(c) for c in ("overload_rate", "line_down_rate", "maintenance_rate", "non_normal_rate", "class_diversity")])


def array_argmax(spark, d):
    return observations(spark, d).select("vec_id", A.argmax(F.col("rho")).alias("at"), F.round(A.nan_max(F.col("rho")), 6).alias("largest"), A.gather(F.col("rho"), F.col("vec_id") % 80).isNull().alias("gather_beyond"))


_SCREEN = """CASE WHEN list_max(rho) > 1 THEN 'overload' WHEN list_contains(status, false) THEN 'line_down'
  WHEN list_contains(maintenance, true) THEN 'maintenance' ELSE 'normal' END"""

PLANS = {
    "label_histogram": (label_histogram, "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1"),
    "label_percent": (
        label_percent,
        f"WITH {_FULL} SELECT *, repeat('█', CAST(floor(pct / 2) AS INTEGER)) AS bar FROM (SELECT label, label_id, n, round(100.0::DOUBLE * n / greatest(sum(n) OVER (), 1), 2) AS pct FROM full_h)",
    ),
    "class_weights": (class_weights, f"WITH {_FULL} SELECT label, label_id, n, coalesce(round(CAST(sum(n) OVER () AS DOUBLE) / nullif(6 * n, 0), 6), 0) AS weight FROM full_h"),
    "class_imbalance": (
        class_imbalance,
        "WITH h AS (SELECT count(*) AS n FROM events GROUP BY event_type) SELECT round(max(n) / (min(n) + 1e-9::DOUBLE), 2) AS ratio, count(*) AS classes, coalesce(round(max(n) / (min(n) + 1e-9::DOUBLE), 2) > 10, false) AS unbalanced FROM h",
    ),
    "missing_labels": (
        missing_labels,
        f"WITH m AS (SELECT list(label ORDER BY label) AS l FROM {_DOMAIN} WHERE label NOT IN (SELECT event_type FROM events)) "
        "SELECT array_to_string(l, ',') AS missing, CASE WHEN len(l) = 0 THEN 'none' WHEN l = ['error', 'maintenance'] THEN 'medium' ELSE 'high' END AS severity FROM m",
    ),
    "label_encode": (
        label_encode,
        "SELECT event_type AS label, CAST(coalesce(min(c), -1) AS BIGINT) AS with_sentinel, CAST(coalesce(min(c), 0) AS BIGINT) AS unknown_as_zero, count(*) FILTER (c IS NULL) AS skipped "
        "FROM (SELECT event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'maintenance' THEN 5 END AS c FROM events) GROUP BY 1",
    ),
    "new_trips": (new_trips, f"WITH {_STEPS} SELECT vec_id, CAST(len(new_trips) AS BIGINT) AS n_trips, new_trips[1] AS first_trip, array_to_string(new_trips, ',') AS trips FROM laddered"),
    "env_trips": (env_trips, f"WITH {_STEPS} SELECT vec_id, array_to_string(alien, ',') AS \"foreign\", list_min(alien) AS lowest FROM laddered"),
    "priority_label": (
        priority_label,
        f"""WITH {_STEPS}, found AS (SELECT vec_id, CASE WHEN maint_at IS NOT NULL THEN 'maintenance' WHEN top > 1 THEN 'overload' WHEN len(alien) > 0 THEN 'cascade'
  WHEN injected IS NOT NULL AND top > 0.75 THEN 'overload' WHEN injected IS NOT NULL THEN 'line_trip' ELSE 'normal' END AS label,
  CAST(CASE WHEN maint_at IS NOT NULL THEN maint_at WHEN top > 1 THEN top_at WHEN len(alien) > 0 THEN list_min(alien)
  WHEN injected IS NOT NULL AND top > 0.75 THEN top_at WHEN injected IS NOT NULL THEN injected END AS BIGINT) AS line FROM laddered)
SELECT *, list_transform(range(64), lambda i: i * 7 % 36)[line + 1] AS substation FROM found""",
    ),
    "screening_label": (screening_label, f"WITH {OBS} SELECT vec_id, {_SCREEN} AS label FROM obs"),
    "probe_rates": (
        probe_rates,
        f"""WITH {OBS}, l AS (SELECT *, {_SCREEN} AS label FROM obs) SELECT episode, count(*) AS steps, round(avg((list_max(rho) > 1)::INT), 6) AS overload_rate,
  round(avg(list_contains(status, false)::INT), 6) AS line_down_rate, round(avg(list_contains(maintenance, true)::INT), 6) AS maintenance_rate,
  round(avg((label <> 'normal')::INT), 6) AS non_normal_rate, round(count(DISTINCT label) FILTER (label <> 'normal') / 3.0::DOUBLE, 6) AS class_diversity FROM l GROUP BY 1""",
    ),
    "array_argmax": (array_argmax, f"WITH {OBS} SELECT vec_id, CAST(list_position(rho, list_max(rho)) - 1 AS BIGINT) AS \"at\", round(list_max(rho), 6) AS largest, vec_id % 80 >= 64 AS gather_beyond FROM obs"),
}
