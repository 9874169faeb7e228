"""Statistics of labels and of array features. Class tables have one row a class; array features are aggregated in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def histogram(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def domain(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """label, label_id for the whole domain."""
    return rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], "label string, label_id long")


def full_histogram(rows: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    """label, label_id, n for every class of the domain, zeros kept, unknown labels left out."""
    return domain(rows, classes).join(histogram(rows.select(label), label), "label", "left").select("label", "label_id", F.coalesce("n", F.lit(0)).alias("n"))


def over_all() -> Window:
    """A window over a table with one row a class."""
    return Window.partitionBy(F.lit(1))


def label_percent(rows: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    return full_histogram(rows, label, classes).withColumn("pct", A.percent(F.col("n"), F.sum("n").over(over_all())))


def class_weights(rows: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    """total / (classes * n), 0 for an empty class."""
    total = F.sum("n").over(over_all())
    return full_histogram(rows, label, classes).withColumn("weight", F.coalesce(F.try_divide(total, F.lit(len(classes)) * F.col("n")), F.lit(0.0)))


def imbalance(rows: DataFrame, label: str, limit: float = 10.0) -> DataFrame:
    """Largest over smallest class among those present."""
    ratio = F.round(F.max("n") / (F.min("n") + 1e-9), 2)
    return histogram(rows, label).agg(ratio.alias("ratio"), F.count(F.lit(1)).alias("classes")).withColumn("unbalanced", F.coalesce(F.col("ratio") > limit, F.lit(False)))


def missing_labels(rows: DataFrame, label: str, classes: tuple[str, ...], tolerated: tuple[str, ...]) -> DataFrame:
    """One row: the expected classes that don't occur, and a severity: medium for exactly the tolerated ones, else high."""
    absent = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in classes]), F.collect_set("label")))
    found = histogram(rows, label).agg(absent.alias("absent"))
    mild = F.array(*[F.lit(c) for c in sorted(tolerated)])
    return found.select(F.array_join("absent", ",").alias("missing"), F.when(F.size("absent") == 0, "none").when(F.col("absent") == mild, "medium").otherwise("high").alias("severity"))


def norm_stats(rows: DataFrame, array_col: str, floor: float = 1e-7) -> DataFrame:
    """dim, mean, std (population, plus ``floor``) in double precision."""
    flat = rows.select(F.posexplode(array_col).alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return flat.groupBy("dim").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + floor).alias("std"))


def zscore(rows: DataFrame, key: str, array_col: str, stats: DataFrame, exempt: tuple[int, ...] = ()) -> DataFrame:
    """``rows`` with ``z``: (x - mean) / std by dimension. The statistics, one row in all, are sent along; exempt dimensions stay."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    free = F.array(*[F.lit(d) for d in exempt]) if exempt else F.array().cast("array<int>")
    z = F.zip_with(array_col, "s", lambda x, s: F.when(F.array_contains(free, s["dim"].cast("int")), x.cast("double")).otherwise((x.cast("double") - s["mean"]) / s["std"]))
    return rows.join(F.broadcast(packed)).select(key, z.alias("z"))


def _binade(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows; values of one number have one sign and differ by less than a factor of two."""
    return F.when(x == 0, 0).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x))) + 1076)).cast("long")


def quantiles(values: DataFrame, col: str, shares: tuple[float, ...], cells: int = 4096) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, of finite values.

    Values are counted by their powers of two first; the cell that holds a rank is cut into ``cells`` of equal width, and
    again, until it holds one value. A power of two has 2 ** 52 doubles, so six passes do at most, whatever the values,
    and each gives a bounded number of counts.
    """
    x = F.col(col).cast("double")

    def counted(cell: Column, *by: str) -> list:
        found = values.select(x.alias("x"), cell.alias("s")) if not by else values.select(x.alias("x"), F.explode(cell).alias("s")).where("s.c IS NOT NULL")
        return found.where("x IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("s").collect()

    rows = counted(_binade(x))
    total = sum(r["n"] for r in rows)
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    todo = {r: (-math.inf, math.inf, 0) for p in places for r in (math.floor(p), math.ceil(p))}
    counts: dict[tuple[float, float], list] = {(-math.inf, math.inf): rows}
    found: dict[int, float] = {}
    while todo:
        for rank, (lo, hi, below) in list(todo.items()):
            for r in counts[lo, hi]:
                if rank < below + r["n"]:
                    lo, hi = r["lo"], r["hi"]
                    break
                below += r["n"]
            todo[rank] = (lo, hi, below)
            if lo == hi:
                found[rank] = lo
                del todo[rank]
        spans = sorted({(lo, hi) for lo, hi, _ in todo.values()})
        counts = {span: [] for span in spans}
        if spans:
            inside = [F.struct(F.lit(k).alias("k"), F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / (hi - lo) * cells), F.lit(cells - 1))).alias("c")) for k, (lo, hi) in enumerate(spans)]
            for r in counted(F.array(*inside), "k"):
                counts[spans[r["s"]["k"]]].append(r)

    def between(p: float) -> float:
        a, b, part = found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)
        return a + (b - a) * part if math.isfinite(b - a) else a * (1 - part) + b * part

    return [between(p) for p in places]


def value_profile(values: DataFrame, col: str) -> DataFrame:
    """min, max, mean, p95, p99 of finite values, interpolated and rounded to 4 places."""
    finite = values.select(F.col(col).cast("double").alias("x")).where(A.is_finite(F.col("x")))
    p95, p99 = (F.lit(q).cast("double") for q in quantiles(finite, "x", (0.95, 0.99)))
    return finite.agg(*[F.round(c, 4).alias(n) for n, c in (("min", F.min("x")), ("max", F.max("x")), ("mean", F.avg("x")), ("p95", p95), ("p99", p99))])


def run_summary(rows: DataFrame, time: str) -> DataFrame:
    """One row: first and last time in ISO form, seconds between (one place), records, and whole records a second."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    one = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n"))
    seconds = F.timestamp_diff("MICROSECOND", "lo", "hi") / 1e6
    per = F.round(F.col("n") / F.greatest(seconds, F.lit(1e-9))).cast("long")
    return one.select(stamp("lo").alias("run_start"), stamp("hi").alias("run_end"), F.round(seconds, 1).alias("total_time_sec"), F.col("n").alias("total_records"), per.alias("records_per_sec"))


def episode_lengths(rows: DataFrame, episode: Column) -> DataFrame:
    per = rows.groupBy(episode.alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("episodes"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


def inspect_arrays(rows: DataFrame, array_col: str, nullable: str) -> DataFrame:
    """One row: distinct lengths, largest element (0 at least), rows whose ``nullable`` is null."""
    return rows.agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.size(array_col))), lambda n: n.cast("string")), ",").alias("lengths"),
        F.greatest(F.max(F.array_max(array_col)), F.lit(0.0)).alias("largest"),
        F.count_if(F.col(nullable).isNull()).alias("without"),
    )


def probe_rates(rows: DataFrame, overload: Column, line_down: Column, maintenance: Column, label: Column, keys: list[str]) -> DataFrame:
    """Event rates, counted independently of each other and of the label, and the diversity of labels seen."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        rate(overload).alias("overload_rate"),
        rate(line_down).alias("line_down_rate"),
        rate(maintenance).alias("maintenance_rate"),
        rate(label != "normal").alias("non_normal_rate"),
        (F.countDistinct(F.when(label != "normal", label)) / 3.0).alias("class_diversity"),
    )
