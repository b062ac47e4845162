"""Solution sequences: a DataFrame with a column per variable, where null means unbound.

A variable keeps its native type as long as nothing asks for the term, so keys join as numbers and
filters reach the scan.  ``kinds`` has the type of each variable, ``maybe`` those that may be unbound.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mapping import lexical
from ..terms import number

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")
TIMES = ("timestamp", "timestamp_ntz", "date")


@dataclass
class Rel:
    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)

    def lex(self, v: str) -> Column:
        """The variable's term."""
        return lexical(F.col(f"`{v}`"), self.kinds[v])

    def num(self, v: str) -> Column:
        """The variable's value as a number, null if it is none."""
        kind = self.kinds[v]
        if kind in NUMERIC:
            return F.col(f"`{v}`").cast("double")
        if kind.startswith("decimal"):
            return F.col(f"`{v}`").cast("double")
        return number(self.lex(v))

    def where(self, cond: Column) -> Rel:
        return Rel(self.df.where(cond), self.kinds, self.maybe)

    def with_column(self, v: str, c: Column, kind: str = "string", maybe: bool = False) -> Rel:
        return Rel(self.df.withColumn(v, c), self.kinds | {v: kind}, (self.maybe - {v}) | ({v} if maybe else set()))

    def as_terms(self, names) -> Rel:
        """The same solutions with these variables as terms."""
        names = [v for v in names if self.kinds[v] != "string"]
        if not names:
            return self
        return Rel(self.df.withColumns({v: self.lex(v) for v in names}), self.kinds | dict.fromkeys(names, "string"), self.maybe)

    def project(self, names) -> Rel:
        have = [v for v in names if v in self.kinds]
        df = self.df.select(*[F.col(f"`{v}`") for v in have], *[F.lit(None).cast("string").alias(v) for v in names if v not in self.kinds])
        return Rel(df, {v: self.kinds.get(v, "string") for v in names}, {v for v in names if v in self.maybe or v not in self.kinds})


def unit(spark) -> Rel:
    """One solution without variables."""
    return Rel(spark.range(1).select())


def join(a: Rel, b: Rel) -> Rel:
    """Joins compatible solutions: equal where both are bound, unbound fits anything.

    Variables that both sides bind are plain equi-join keys.  For one that may be unbound the sides
    are split into bound and unbound parts, so each part is an equi-join again and no condition
    with OR turns the join into a nested loop.
    """
    shared = [v for v in a.kinds if v in b.kinds]
    differ = [v for v in shared if a.kinds[v] != b.kinds[v]]
    a, b = a.as_terms(differ), b.as_terms(differ)
    loose = [v for v in shared if v in a.maybe or v in b.maybe]
    if loose:
        v = loose[0]
        is_bound = F.col(f"`{v}`").isNotNull()
        bound = lambda r: Rel(r.df.where(is_bound), r.kinds, r.maybe - {v})
        free = lambda r: Rel(r.df.where(~is_bound).drop(v), {k: x for k, x in r.kinds.items() if k != v}, r.maybe - {v})
        parts = [join(bound(a), bound(b))]
        if v in a.maybe:
            parts.append(join(free(a), b))
        if v in b.maybe:
            parts.append(join(bound(a), free(b)))
        return reduce(union, parts)
    kinds, maybe = a.kinds | b.kinds, (a.maybe | b.maybe) - set(shared)
    if not shared:
        return Rel(a.df.crossJoin(b.df), kinds, maybe)
    return Rel(a.df.join(b.df, shared, "inner"), kinds, maybe)


def union(a: Rel, b: Rel) -> Rel:
    """All solutions of both; variables of one side only are unbound in the other."""
    differ = [v for v in a.kinds if v in b.kinds and a.kinds[v] != b.kinds[v]]
    a, b = a.as_terms(differ), b.as_terms(differ)
    kinds = a.kinds | b.kinds
    maybe = a.maybe | b.maybe | (set(a.kinds) ^ set(b.kinds))
    if not kinds:
        return Rel(a.df.union(b.df))
    return Rel(a.df.unionByName(b.df, allowMissingColumns=True), kinds, maybe)
