"""Progress events: throttled in batch, and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LEAST_MS = 80  # fixed value: time between two shown events of one phase


def _finished(phase: Column, total: Column, completed: Column) -> Column:
    return F.coalesce((phase == "complete") | ((total > 0) & (completed >= total)), F.lit(False))


def throttled(events: DataFrame, group: str, time_ms: str, phase: str, total: str | None = None, completed: str | None = None, ties: list[str] = (), least_ms: int = LEAST_MS) -> DataFrame:
    """Events that are shown: a group's first; a change of phase or total; a finished one (phase ``complete``, or
    ``completed`` reaches a total above 0); or one that comes ``least_ms`` or more after the event SHOWN last.

    Events are taken in the order of time, phase, then ``ties``; that should be an order without ties. A gap of
    ``least_ms`` shows the event behind it in any case, so only runs of closer events of one phase and total depend on
    what was shown before: those are cut out by a window and stepped through, one run at a time.
    """
    columns = events.columns
    order = Window.partitionBy(group).orderBy(time_ms, phase, *ties)
    whole = F.col(total) if total else F.lit(0)
    done = F.col(completed) if completed else F.lit(0)
    marked = events.withColumn("__total", whole).withColumn("__finished", _finished(F.col(phase), whole, done)).withColumn("__t", F.col(time_ms).cast("long"))
    before = lambda c: F.lag(c).over(order)
    starts = F.row_number().over(order) == 1
    starts = starts | ~before(phase).eqNullSafe(F.col(phase)) | ~before("__total").eqNullSafe(F.col("__total")) | (F.col("__t") - before("__t") >= least_ms) | F.col("__finished")
    runs = marked.withColumn("__run", F.sum(starts.cast("long")).over(order)).withColumn("__r", F.row_number().over(order))
    runs = runs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group, "__run")))

    def stepped(run: pa.Table) -> pa.Table:
        import numpy as np

        run = run.sort_by("__r")
        times, at, shown = run.column("__t").to_numpy(), 0, []
        while at < len(times):
            shown.append(at)
            at = int(np.searchsorted(times, times[at] + least_ms))
        return run.select(columns).take(shown)

    alone, dense = runs.where("__n = 1").select(*columns), runs.where("__n > 1")
    return alone.union(dense.groupBy(group, "__run").applyInArrow(stepped, events.schema))


def throttled_stream(events: DataFrame, least_ms: int = LEAST_MS, idle_ms: int | None = None) -> DataFrame:
    """The same rule on a stream (source string, phase string, time_ms long), with total long and completed long if
    the stream has them: exact to the event last shown, in the order in which batches come and of time inside one.

    State is a phase, a total and a time for each source, kept by ``applyInPandasWithState``. With ``idle_ms`` it is
    dropped after that time without events; such a query runs batches without data too, so it never comes to rest.
    """
    counted = {"total", "completed"} <= set(events.columns)

    def show(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        phase, total, shown = state.get if state.exists else (None, 0, None)
        out = []
        for frame in frames:
            for row in frame.sort_values(["time_ms", "phase"]).itertuples():
                whole, done = (int(row.total), int(row.completed)) if counted else (0, 0)
                finished = row.phase == "complete" or (whole > 0 and done >= whole)
                if shown is None or row.phase != phase or whole != total or finished or row.time_ms - shown >= least_ms:
                    out.append((key[0], row.phase, row.time_ms))
                    phase, total, shown = row.phase, whole, int(row.time_ms)
        if shown is not None:
            state.update((phase, total, shown))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "phase", "time_ms"])

    return events.groupBy("source").applyInPandasWithState(show, "source string, phase string, time_ms long", "phase string, total long, shown long", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and kind; on a stream, rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
