"""From relations back to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_stream(operator: str, old: list, new: list) -> list:
    """RSTREAM: all; ISTREAM: what is new, copies kept; DSTREAM: what is gone, as a set."""
    if operator == "ISTREAM":
        seen = set(old)
        return [r for r in new if r not in seen]
    if operator == "DSTREAM":
        seen = set(new)
        return [r for r in dict.fromkeys(old) if r not in seen]
    return list(new)


def stream_of(operator: str, results: DataFrame, fired: DataFrame, columns: list[str]) -> DataFrame:
    """The same for all firings at once: results has fire_ts and the columns, fired one row per firing."""
    if operator == "RSTREAM":
        return results
    steps = fired.select("fire_ts", F.lag("fire_ts").over(Window.orderBy("fire_ts")).alias("before"), F.lead("fire_ts").over(Window.orderBy("fire_ts")).alias("after"))

    def without(a: DataFrame, b: DataFrame, a_time: str, b_time: str) -> DataFrame:
        right = b.select(F.col(b_time).alias("__t"), *[F.col(c).alias(f"__{c}") for c in columns]).distinct()
        on = F.col(a_time) == F.col("__t")
        for c in columns:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return a.join(right, on, "left_anti")

    if operator == "ISTREAM":
        now = results.join(steps, "fire_ts")
        return without(now, results, "before", "fire_ts").select("fire_ts", *columns)
    gone = results.distinct().join(steps.where("after is not null"), "fire_ts")
    return without(gone, results, "after", "fire_ts").select(F.col("after").alias("fire_ts"), *columns)
