"""Event labels: priority ladders, trips against the previous step, and injected faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

#: Loading above which a step is overloaded, and above which an injected trip counts as overload.
OVERLOAD, STRAINED = 1.0, 0.75


def with_previous(rows: DataFrame, col: str, episode: str, step: str, seed: Column | None = None) -> DataFrame:
    """``previous_<col>``: the value one step earlier in the episode; at its begin ``seed``, or the value itself."""
    w = Window.partitionBy(episode).orderBy(step)
    return rows.withColumn(f"previous_{col}", F.coalesce(F.lag(col).over(w), F.col(col) if seed is None else seed))


def new_trips(previous: Column, now: Column) -> Column:
    return A.places(A.newly_off(previous, now))


def foreign_trips(trips: Column, injected: Column) -> Column:
    """Trips that nobody injected; ``injected`` is an array, null counting as empty."""
    return A.difference(trips, F.coalesce(injected, F.array().cast("array<bigint>")))


def priority_label(rho: Column, trips: Column, injected_line: Column, maintenance_line: Column, passthrough: Column) -> Column:
    """First match wins: maintenance, overload, cascade (trips not injected), strained injected trip, injected trip, passthrough."""
    foreign = foreign_trips(trips, F.when(injected_line.isNotNull(), F.array(injected_line.cast("bigint"))))
    top = A.nan_max(rho)
    return (
        F.when(maintenance_line.isNotNull(), "maintenance")
        .when(top > OVERLOAD, "overload")
        .when(F.size(foreign) > 0, "cascade")
        .when(injected_line.isNotNull() & (top > STRAINED), "overload")
        .when(injected_line.isNotNull(), "line_trip")
        .otherwise(passthrough)
    )


def priority_line(rho: Column, trips: Column, injected_line: Column, maintenance_line: Column) -> Column:
    """The line that the label is about, null for passthrough. Of several foreign trips the lowest is named."""
    foreign = foreign_trips(trips, F.when(injected_line.isNotNull(), F.array(injected_line.cast("bigint"))))
    top = A.nan_max(rho)
    return (
        F.when(maintenance_line.isNotNull(), maintenance_line)
        .when(top > OVERLOAD, A.argmax(rho))
        .when(F.size(foreign) > 0, F.array_min(foreign))
        .when(injected_line.isNotNull() & (top > STRAINED), A.argmax(rho))
        .when(injected_line.isNotNull(), injected_line.cast("bigint"))
    )


def substation(line: Column, origins: Column) -> Column:
    """Where the line begins: ``origins`` is the metadata's array of origin substations by line. Null for no line."""
    return A.gather(origins, line)


def screening_label(rho: Column, status: Column, maintenance: Column) -> Column:
    """The coarse ladder: overload, line_down, maintenance, normal; empty or null arrays decide nothing."""
    return (
        F.when(A.nan_max(rho) > OVERLOAD, "overload")
        .when(F.exists(status, lambda s: ~s), "line_down")
        .when(F.exists(maintenance, lambda m: m), "maintenance")
        .otherwise("normal")
    )
