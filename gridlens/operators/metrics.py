"""Classification metrics from counts per class, and rule and shield rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Rows true, one column a predicted class."""
    return rows.groupBy(F.col(truth).alias("truth")).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support over classes in the truth or among predictions; 0 where undefined."""
    pairs = confusion(rows, truth, predicted)
    hit = F.col("truth") == F.col("predicted")
    sides = pairs.select(
        "n", hit.alias("hit"), F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("true")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("true")))).alias("s")
    )
    c = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("s.true"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("s.true"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.true"), F.col("n"))), F.lit(0)).alias("called"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("label", zero(F.col("tp"), F.col("called")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support", "tp")


def report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The rows of ``per_class`` plus accuracy, macro and weighted averages, as ``label`` strings."""
    c = per_class(rows, truth, predicted)
    figures = ("precision", "recall", "f1")
    total = F.sum("support")
    lines = c.select(F.col("label").cast("string").alias("label"), *figures, "support")
    macro = c.agg(*[F.avg(f).alias(f) for f in figures], total.alias("support")).select(F.lit("macro avg").alias("label"), *figures, "support")
    weighted = c.agg(*[(F.sum(F.col(f) * F.col("support")) / total).alias(f) for f in figures], total.alias("support")).select(F.lit("weighted avg").alias("label"), *figures, "support")
    accuracy = c.agg((F.sum("tp") / total).alias("a"), total.alias("support")).select(F.lit("accuracy").alias("label"), *[F.col("a").alias(f) for f in figures], "support")
    return lines.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class(rows, truth, predicted).agg(F.avg("f1").alias("macro_f1"))


def top_k_hit(scores: Column, truth: Column, k: int = 3) -> Column:
    """Whether ``truth`` is among the places of the k largest scores; of equal scores the earlier place counts as larger."""
    ranked = F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.array_contains(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]), truth)


def rate(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
