"""Reasoning across windows: every fact has an expiry, a derived one the least of its premises, and of several derivations the last counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..reason.fixpoint import tagged_fixpoint
from ..reason.rules import Rule

FOREVER = 2**62


def base_facts(windows: dict[str, tuple[int, DataFrame]], static: DataFrame | None = None, now: int = 0) -> DataFrame:
    """s, p, o, tag: each window's facts (s, p, o, ts) with predicate `<window>p` and expiry ts + width, static ones without end.

    windows: name -> (width, facts).
    """
    out = None
    for name, (width, facts) in windows.items():
        one = facts.select("s", F.concat(F.lit(name), F.col("p")).alias("p"), "o", (F.col("ts") + width).cast("long").alias("tag"))
        out = one if out is None else out.unionByName(one)
    if static is not None:
        own = static.select("s", "p", "o", F.lit(FOREVER).cast("long").alias("tag"))
        out = own if out is None else out.unionByName(own)
    return out.where(F.col("tag") > now).groupBy("s", "p", "o").agg(F.max("tag").alias("tag"))


def materialise(base: DataFrame, rules: list[Rule], now: int = 0) -> DataFrame:
    """All facts with their expiry, from scratch."""
    return tagged_fixpoint(base.where(F.col("tag") > now), rules, "expiration")


def update(previous: DataFrame, base: DataFrame, rules: list[Rule], now: int) -> DataFrame:
    """The same from the result before: only facts that are new or last longer are worked through again."""
    live = base.where(F.col("tag") > now)
    old = previous.where(F.col("tag") > now)
    longer = live.join(old.withColumnRenamed("tag", "had"), ["s", "p", "o"], "left").where("had is null or tag > had").drop("had")
    return tagged_fixpoint(old, rules, "expiration", delta=longer)
