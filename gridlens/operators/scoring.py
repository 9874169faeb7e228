"""Environment scorecard: normalised figures, penalties and weighted composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import capped_ratio
from .stats import over_all


def bigger_is_better(v: Column) -> Column:
    top = F.max(v).over(over_all())
    return F.when(top > 0, v / top).otherwise(F.lit(0.0))


def smaller_is_better(v: Column) -> Column:
    return F.when(v > 0, F.min(v).over(over_all()) / v).otherwise(F.lit(0.0))


def scope_fit(n_sub: Column, n_line: Column) -> Column:
    return F.greatest(F.lit(1.0) - F.when(n_sub > 50, 0.20).otherwise(0.0) - F.when(n_line > 100, 0.15).otherwise(0.0), F.lit(0.0))


#: Rates at which an event counts as fully represented, and weights of the composites.
FULL = {"non_normal_rate": 0.10, "overload_rate": 0.03}
RICHNESS = {"non_normal": 0.45, "overload": 0.25, "diversity": 0.30}
FINAL = {"fit": 0.40, "speed": 0.25, "richness": 0.20, "simplicity": 0.15}
INTEGRATION = {"fit": 0.40, "speed": 0.35, "simplicity": 0.25}
SCALE = {"richness": 0.45, "diversity": 0.30, "speed": 0.25}


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    terms = [parts[k] * F.lit(w) for k, w in weights.items()]
    return sum(terms[1:], terms[0])


def scorecard(envs: DataFrame) -> DataFrame:
    """``envs``: env_name, n_sub, n_line, steps_per_sec, overload_rate, non_normal_rate, class_diversity. Adds seven scores."""
    c = {k: F.col(k).cast("double") for k in ("n_sub", "n_line", "steps_per_sec", "overload_rate", "non_normal_rate", "class_diversity")}
    parts = {
        "fit": scope_fit(c["n_sub"], c["n_line"]),
        "speed": bigger_is_better(c["steps_per_sec"]),
        "simplicity": smaller_is_better(c["n_sub"] + c["n_line"]),
        "non_normal": capped_ratio(c["non_normal_rate"], FULL["non_normal_rate"]),
        "overload": capped_ratio(c["overload_rate"], FULL["overload_rate"]),
        "diversity": c["class_diversity"],
    }
    parts["richness"] = F.greatest(F.least(weighted(parts, RICHNESS), F.lit(1.0)), F.lit(0.0))
    scores = {
        "scope_fit_score": parts["fit"],
        "efficiency_score": parts["speed"],
        "event_richness_score": parts["richness"],
        "simplicity_score": parts["simplicity"],
        "final_score": weighted(parts, FINAL),
        "integration_score": weighted(parts, INTEGRATION),
        "scale_score": weighted(parts, SCALE),
    }
    return envs.select("*", *[F.round(v, 4).alias(k) for k, v in scores.items()])


def best(rows: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the highest score; of equal scores the first by ``order``."""
    return rows.orderBy(F.desc(score), order).limit(1)


def recommendation(scored: DataFrame, order: str = "env_name") -> DataFrame:
    """One row: the environment to start with, by the integration score, and the one to scale to, by the scale score."""
    pick = lambda score: F.min_by("env_name", F.struct((-F.col(score)).alias("s"), F.col(order).alias("o")))
    return scored.agg(pick("integration_score").alias("start_with"), pick("scale_score").alias("scale_to"))


def early_stop(scores: DataFrame, key: str, order: str, score: str, delta: float, patience: int) -> DataFrame:
    """Per key, after each score: best, counter, stopped. A score under best + delta counts; others reset and become best.

    The fold runs over one key's scores in order; a key's scores are epochs of one run, so they are few.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("counter"), F.lit(False).alias("stopped"), F.lit(0).alias("seen"))

    def step(acc: Column, s: Column) -> Column:
        x = s["x"]
        better = acc["best"].isNull() | (x >= acc["best"] + F.lit(float(delta)))
        counter = F.when(better, F.lit(0)).otherwise(acc["counter"] + 1)
        moved = F.struct(F.when(better, x).otherwise(acc["best"]).alias("best"), counter.alias("counter"), (counter >= patience).alias("stopped"), (acc["seen"] + 1).alias("seen"))
        return F.when(acc["stopped"], acc).otherwise(moved)

    runs = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).cast("double").alias("x")))).alias("xs"))
    out = runs.withColumn("end", F.aggregate("xs", start, step))
    return out.select(key, F.col("end.best").alias("best"), F.col("end.counter").alias("counter"), F.col("end.stopped").alias("stopped"), F.col("end.seen").alias("epochs"))


def improvements(scores: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """``improved``: whether the score beats all before it (0 at the begin), as a checkpoint would be written."""
    before = F.max(score).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return scores.withColumn("improved", F.col(score) > F.greatest(F.coalesce(before, F.lit(0.0)), F.lit(0.0)))
