"""The set of tripped lines through an episode, in batch and as a stateful stream.

A step may reconnect a line, inject a trip, and bring trips of its own; the set is cleared after an episode's last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ("episode", "step", "reconnect", "inject", "trips", "done")
OUTPUT = "episode long, step long, tripped array<long>, n_tripped long"


def advance(tripped: set[int], row) -> list[int]:
    """Applies one step to the set and returns it sorted; cleared in place if the episode is done."""
    if pd.notna(row.reconnect):
        tripped.discard(int(row.reconnect))
    if pd.notna(row.inject):
        tripped.add(int(row.inject))
    tripped.update(int(x) for x in (row.trips if row.trips is not None else ()))
    now = sorted(tripped)
    if row.done:
        tripped.clear()
    return now


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["episode", "step", "tripped", "n_tripped"])


def tripped_sets(steps: DataFrame) -> DataFrame:
    """``steps``: episode, step, reconnect, inject, trips (array), done. episode, step, tripped, n_tripped for each step.

    A line's state changes only at steps that name it, so each change holds from its step to the line's next one, or to
    the end of the stretch between two final steps. Stays are spread over their steps and gathered for each; a stretch is
    ordered in windows by Spark, and no step is looked at one by one.
    """
    stretch = Window.partitionBy("episode").orderBy("step")
    rows = steps.select(*COLUMNS).withColumn("stretch", F.coalesce(F.count_if("done").over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("episode", "stretch").orderBy("step")
    rows = rows.withColumn("at", F.row_number().over(inside)).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("episode", "stretch")).cast("int"))
    nothing = F.array().cast("array<bigint>")
    on = F.array_distinct(F.concat(F.coalesce(F.col("trips").cast("array<bigint>"), nothing), F.array_compact(F.array(F.col("inject").cast("bigint")))))
    off = F.array_except(F.array_compact(F.array(F.col("reconnect").cast("bigint"))), on)
    change = F.explode(F.concat(F.transform(on, lambda x: F.struct(x.alias("line"), F.lit(True).alias("on"))), F.transform(off, lambda x: F.struct(x.alias("line"), F.lit(False).alias("on")))))
    changes = rows.select("episode", "stretch", "at", "last", change.alias("c"))
    following = F.lead("at").over(Window.partitionBy("episode", "stretch", "c.line").orderBy("at"))
    stays = changes.withColumn("until", F.coalesce(following - 1, F.col("last"))).where("c.on AND until >= at")
    spread = stays.select("episode", "stretch", F.explode(F.sequence("at", "until")).alias("at"), F.col("c.line").alias("line"))
    sets = spread.groupBy("episode", "stretch", "at").agg(F.array_sort(F.collect_list("line")).alias("tripped"))
    out = rows.join(sets, ["episode", "stretch", "at"], "left").withColumn("tripped", F.coalesce("tripped", nothing))
    return out.select("episode", "step", "tripped", F.size("tripped").cast("long").alias("n_tripped"))


def tripped_stream(steps: DataFrame) -> DataFrame:
    """The same over a stream: steps of an episode arrive in order over batches, and the set is kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tripped = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for row in rows.itertuples():
            now = advance(tripped, row)
            out.append((row.episode, row.step, now, len(now)))
        if bool(rows["done"].iloc[-1]):
            state.remove()
        else:
            state.update((sorted(tripped),))
        yield _frame(out)

    return steps.select(*COLUMNS).groupBy("episode").applyInPandasWithState(run, OUTPUT, "tripped array<long>", "append", GroupStateTimeout.NoTimeout)


def label_counts_stream(events: DataFrame, time_col: str, label_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Labels per tumbling window with a watermark; an extension beyond the batch operators."""
    timed = events.select(F.col(time_col).cast("timestamp").alias("time"), F.col(label_col).alias("label")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window).alias("w"), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "n")
