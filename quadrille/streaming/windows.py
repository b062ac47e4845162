"""Sliding windows over event time: which windows an event is in, which fire, and what they hold.

Windows are [open, close) with close a multiple of the slide.  ``WindowState`` takes events one by
one, in any order; ``firings`` and ``contents`` give the same for a whole table of ordered events,
as DataFrames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fired:
    open: int
    close: int
    ts: int
    items: tuple


@dataclass
class WindowState:
    """One window's active extents.  Strategies are (name, period); all of them must agree to report."""

    width: int
    slide: int
    report: tuple = (("ON_WINDOW_CLOSE", None),)
    tick: str = "TIME_DRIVEN"
    default_period: int = 1000
    active: dict = field(default_factory=dict)
    app_time: int = 0
    last_content: dict | None = None

    def extents(self, ts: int) -> list[tuple[int, int]]:
        out, o = [], math.ceil(abs(ts) / self.slide) * self.slide - self.width
        while o <= ts:
            out.append((max(o, 0), max(o + self.width, 0)))
            o += self.slide
        return out

    def _reports(self, extent, content, ts) -> bool:
        for name, period in self.report:
            if name == "NON_EMPTY_CONTENT":
                ok = bool(content)
            elif name == "ON_CONTENT_CHANGE":  # holds while the content stays the same
                ok = content == (self.last_content or {})
                self.last_content = dict(content)
            elif name == "PERIODIC":
                ok = ts % (period or self.default_period) == 0
            else:
                ok = extent[1] <= ts
            if not ok:
                return False
        return True

    def add(self, item, ts: int) -> Fired | None:
        for e in self.extents(ts):
            self.active.setdefault(e, {})
        ready = [e for e, c in sorted(self.active.items()) if self._reports(e, c, ts)]
        fired = None
        if ready and self.tick == "TIME_DRIVEN" and ts > self.app_time:
            best = max(ready, key=lambda e: e[1])
            self.app_time = ts
            fired = Fired(*best, ts, tuple(self.active[best]))
        kept = {}
        for e, c in self.active.items():
            if e[0] <= ts < e[1]:
                c[item] = max(ts, c.get(item, ts))
                kept[e] = c
        self.active = kept
        return fired

    def times(self, extent) -> dict:
        return dict(self.active.get(extent, {}))

    def flush(self) -> tuple:
        """Everything still in a window, once."""
        out: dict = {}
        for c in self.active.values():
            for item, t in c.items():
                out[item] = max(t, out.get(item, t))
        return tuple(out)


def assign(events: DataFrame, width: int, slide: int, ts: str = "ts") -> DataFrame:
    """events with open and close: a row for each window that holds the event."""
    t = F.col(ts)
    first = F.floor(t / slide) * slide + slide  # the first close after ts
    closes = F.sequence(first, F.floor((t + width) / slide) * slide, F.lit(slide).cast("long"))
    out = events.withColumn("close", F.explode(F.when(first <= F.floor((t + width) / slide) * slide, closes)))
    return out.withColumn("open", F.greatest(F.col("close") - width, F.lit(0)))


def firings(times: DataFrame, width: int, slide: int, before: int | None = None) -> DataFrame:
    """fire_ts, open, close for a column ts of event times: at each new time, the open window with the last close not after it.

    A time that is a multiple of the slide fires the window that closes there, even an empty one;
    other times fire a window of the event before them, as later ones are not open yet.  One row
    per distinct time goes through the ordered window, never the events.
    """
    t = times.select("ts").distinct().where("ts > 0")
    prev = F.coalesce(F.lag("ts").over(Window.orderBy("ts")), F.lit(before).cast("long"))
    t = t.withColumn("prev", prev)
    late = F.floor(F.least(F.col("ts"), F.col("prev") + width) / slide) * slide
    close = F.when(F.col("ts") % slide == 0, F.col("ts")).when((late > F.col("prev")) & (late - width <= F.col("prev")), late)
    t = t.withColumn("close", close.cast("long")).where("close is not null")
    return t.select(F.col("ts").alias("fire_ts"), F.greatest(F.col("close") - width, F.lit(0)).alias("open"), "close")


def contents(events: DataFrame, fired: DataFrame, width: int, slide: int, columns=("s", "p", "o")) -> DataFrame:
    """fire_ts, the columns and ts (the last time of each item): the set that each firing sees."""
    inside = assign(events.select(*columns, "ts"), width, slide).drop("open")
    both = inside.join(fired.select("fire_ts", "close"), "close").where(F.col("ts") < F.col("fire_ts"))
    return both.groupBy("fire_ts", *columns).agg(F.max("ts").alias("ts"))
