"""Data-quality audit: one pass for record-level counts, one for labels and episodes, and issues with severities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import stats


def record_counts(rows: DataFrame, fields: dict[str, int]) -> DataFrame:
    """field, wrong_size (records), nans, infs (elements), for every array field with its expected length."""
    one = rows.agg(
        *[
            F.struct(F.count_if(A.wrong_size(F.col(f), n)).alias("wrong"), F.sum(A.count_nan(F.col(f))).alias("nans"), F.sum(A.count_inf(F.col(f))).alias("infs")).alias(f)
            for f, n in fields.items()
        ]
    )
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.wrong").alias("wrong_size"), F.col(f"{f}.nans").alias("nans"), F.col(f"{f}.infs").alias("infs")) for f in fields])
    return one.select(F.explode(listed).alias("x")).select("x.field", "x.wrong_size", F.coalesce("x.nans", F.lit(0)).alias("nans"), F.coalesce("x.infs", F.lit(0)).alias("infs"))


def issues(rows: DataFrame, label: str, classes: tuple[str, ...], tolerated: tuple[str, ...], fields: dict[str, int]) -> DataFrame:
    """id, severity, title, detail, fix: one row an issue; an empty table is itself one."""
    none = F.lit(None).cast("string")
    missing = stats.missing_labels(rows, label, classes, tolerated).where("severity != 'none'")
    out = missing.select(F.lit("missing_labels").alias("id"), "severity", F.lit("Expected classes don't occur").alias("title"), F.col("missing").alias("detail"), F.lit("Collect more episodes").alias("fix"))
    uneven = stats.imbalance(rows, label).where("unbalanced")
    out = out.unionByName(uneven.select(F.lit("imbalance").alias("id"), F.lit("medium").alias("severity"), F.lit("Classes are uneven").alias("title"), F.format_string("%.2f", "ratio").alias("detail"), F.lit("Weigh or undersample classes").alias("fix")))
    counts = record_counts(rows, fields) if fields else None
    for col, ident, severity, title in () if counts is None else (("wrong_size", "shape", "high", "Arrays of a wrong length"), ("nans", "nan", "high", "NaN values"), ("infs", "inf", "high", "Infinite values")):
        found = counts.where(F.col(col) > 0)
        detail = F.concat_ws(": ", "field", F.col(col).cast("string"))
        out = out.unionByName(found.select(F.concat(F.lit(f"{ident}_"), "field").alias("id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), none.alias("fix")))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return out.unionByName(empty.select(F.lit("empty").alias("id"), F.lit("high").alias("severity"), F.lit("The data set is empty").alias("title"), none.alias("detail"), none.alias("fix")))
