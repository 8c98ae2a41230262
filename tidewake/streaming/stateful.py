"""Stops and gaps of streams of reports ``(mmsi, ts, sog)``: keyed state, event-time timers, reports in any order within a lateness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewake.operators.tracks import HOUR, MINUTE

_STATE = "us array<long>, sog array<double>, before long, first long, last long, n long"
#: What a report does to a track's state (before, first, last, n): the state after it, and a row that it completes.
Step = Callable[[tuple, int, float], tuple[tuple, tuple | None]]


def _in_order(reports: DataFrame, late: str, step: Step, columns: str) -> DataFrame:
    """Rows of ``(mmsi, <columns>)`` that ``step`` completes over each vessel's reports in order of time.

    A vessel's state holds the reports that the watermark hasn't passed yet and four numbers; once it has, reports are taken in order, so
    arrivals within ``late`` may be in any order.  Later ones are dropped.  A timer wakes vessels that send nothing more.  State is in the
    checkpoint: a query that starts again goes on where it was.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, sog, *rest = state.get if state.exists else ([], [], None, None, None, 0)
        held = list(zip(us, sog))
        if not state.hasTimedOut:
            for frame in frames:
                held += zip(frame["us"].tolist(), frame["sog"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        held.sort()
        now, out = tuple(rest), []
        for t, s in (h for h in held if h[0] < passed):
            now, row = step(now, t, s)
            if row:
                out.append((*key, *row))
        held = [h for h in held if h[0] >= passed]
        state.update(([h[0] for h in held], [h[1] for h in held], *now))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, passed // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=["mmsi", *names])

    rows = reports.withWatermark("ts", late).select("mmsi", "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("sog").cast("double"), F.lit(0.0)).alias("sog"))
    kind = reports.schema["mmsi"].dataType.simpleString()
    return rows.groupBy("mmsi").applyInPandasWithState(work, f"mmsi {kind}, {columns}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stops(reports: DataFrame, knots: float = 0.5, minutes: float = 30, late: str = "10 minutes") -> DataFrame:
    """``(mmsi, us0, us1, reports)`` of runs slower than ``knots`` (NULL speed is 0) that last ``minutes`` or more, each when a faster report ends
    it: what ``anomalies.stops`` gives for the reports that the watermark has passed, but for runs that are still going on."""
    span = int(minutes * MINUTE)

    def step(now: tuple, us: int, sog: float) -> tuple[tuple, tuple | None]:
        _, first, last, n = now
        if sog < knots:
            return (us, us if first is None else first, us, n + 1), None
        return (us, None, None, 0), ((first, last, n) if first is not None and last - first >= span else None)

    return _in_order(reports, late, step, "us0 long, us1 long, reports long")


def gaps(reports: DataFrame, max_hours: float = 6.0, late: str = "10 minutes") -> DataFrame:
    """``(mmsi, us0, us1, hours)`` of consecutive reports more than ``max_hours`` apart, each when the later one is passed by the watermark."""

    def step(now: tuple, us: int, sog: float) -> tuple[tuple, tuple | None]:
        before = now[0]
        hours = None if before is None else (us - before) / HOUR
        return (us, None, None, 0), ((before, us, hours) if hours is not None and hours > max_hours else None)

    return _in_order(reports, late, step, "us0 long, us1 long, hours double")
