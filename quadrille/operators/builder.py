"""The fluent query over triples: filters, joins, order, limits; and the same over windows of a stream."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import number


@dataclass(frozen=True)
class TripleQuery:
    """Immutable; each call gives a new query, and nothing runs before the result is asked for."""

    ds: object
    conditions: tuple = ()
    joined: tuple = ()  # (dataset, kind or function)
    is_distinct: bool = False
    order: tuple = ()
    size: int | None = None
    skip: int = 0
    stream: object = None

    def _and(self, c: Column) -> TripleQuery:
        return replace(self, conditions=(*self.conditions, c))

    # -- filters
    def with_subject(self, x: str) -> TripleQuery:
        return self._and(F.col("s") == x)

    def with_predicate(self, x: str) -> TripleQuery:
        return self._and(F.col("p") == x)

    def with_object(self, x: str) -> TripleQuery:
        return self._and(F.col("o") == x)

    def with_subject_like(self, x: str) -> TripleQuery:
        return self._and(F.col("s").contains(x))

    def with_predicate_like(self, x: str) -> TripleQuery:
        return self._and(F.col("p").contains(x))

    def with_object_like(self, x: str) -> TripleQuery:
        return self._and(F.col("o").contains(x))

    def with_subject_starting(self, x: str) -> TripleQuery:
        return self._and(F.col("s").startswith(x))

    def with_predicate_starting(self, x: str) -> TripleQuery:
        return self._and(F.col("p").startswith(x))

    def with_object_starting(self, x: str) -> TripleQuery:
        return self._and(F.col("o").startswith(x))

    def with_subject_ending(self, x: str) -> TripleQuery:
        return self._and(F.col("s").endswith(x))

    def with_predicate_ending(self, x: str) -> TripleQuery:
        return self._and(F.col("p").endswith(x))

    def with_object_ending(self, x: str) -> TripleQuery:
        return self._and(F.col("o").endswith(x))

    def filter(self, test) -> TripleQuery:
        """A Column over s, p, o, or a Python function of the three strings."""
        return self._and(test if isinstance(test, Column) else _python_test(test, ["s", "p", "o"]))

    # -- joins
    def join(self, other) -> _Join:
        return _Join(self, other)

    # -- order and size
    def distinct(self) -> TripleQuery:
        return replace(self, is_distinct=True)

    def order_by(self, key="s", desc: bool = False) -> TripleQuery:
        """A column name or Column; numbers sort as numbers."""
        return replace(self, order=(*self.order, (key, desc)))

    def asc(self) -> TripleQuery:
        return replace(self, order=tuple((k, False) for k, _ in self.order))

    def desc(self) -> TripleQuery:
        return replace(self, order=tuple((k, True) for k, _ in self.order))

    def limit(self, n: int) -> TripleQuery:
        return replace(self, size=n)

    def offset(self, n: int) -> TripleQuery:
        return replace(self, skip=n)

    # -- results
    def triples(self) -> DataFrame:
        """s, p, o: a set, in the order asked for."""
        df = self.ds.query_default()
        for c in self.conditions:
            df = df.where(c)
        if self.joined:
            out = None
            for other, kind in self.joined:
                one = _join(df, other.query_default(), kind)
                out = one if out is None else out.unionByName(one)
            df = out.distinct()
        elif self.is_distinct:
            df = df.distinct()
        if self.order:
            keys = []
            for k, desc in self.order:
                c = F.col(k) if isinstance(k, str) else k
                for x in (number(c.cast("string")).isNull(), number(c.cast("string")), c):
                    keys.append(x.desc() if desc else x.asc())
            df = df.orderBy(*keys)
        elif self.skip or self.size is not None:
            df = df.orderBy("s", "p", "o")
        if self.skip:
            df = df.offset(self.skip)
        return df.limit(self.size) if self.size is not None else df

    get_decoded_triples = get_triples = triples

    def subjects(self) -> DataFrame:
        return self.triples().select("s").distinct()

    def predicates(self) -> DataFrame:
        return self.triples().select("p").distinct()

    def objects(self) -> DataFrame:
        return self.triples().select("o").distinct()

    get_subjects, get_predicates, get_objects = subjects, predicates, objects

    def count(self) -> int:
        return self.triples().count()

    def group_by(self, key="s") -> DataFrame:
        """key, n and triples: the triples of each group."""
        c = F.col(key) if isinstance(key, str) else key
        return self.triples().groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("s", "p", "o")).alias("triples"))

    def group_by_subject(self) -> DataFrame:
        return self.group_by("s")

    def group_by_predicate(self) -> DataFrame:
        return self.group_by("p")

    def group_by_object(self) -> DataFrame:
        return self.group_by("o")

    # -- streams
    def window(self, width: int, slide: int) -> StreamQuery:
        return StreamQuery(self, width, slide)


@dataclass(frozen=True)
class _Join:
    query: TripleQuery
    other: object

    def _on(self, kind) -> TripleQuery:
        return replace(self.query, joined=(*self.query.joined, (self.other, kind)))

    def join_on_subject(self) -> TripleQuery:
        return self._on("s")

    def join_on_predicate(self) -> TripleQuery:
        return self._on("p")

    def join_on_object(self) -> TripleQuery:
        return self._on("o")

    def join_with(self, test) -> TripleQuery:
        """A Column over ls, lp, lo, rs, rp, ro, or a Python function of the six strings."""
        return self._on(test)


def _join(left: DataFrame, right: DataFrame, kind) -> DataFrame:
    a, b = left.toDF("ls", "lp", "lo"), right.toDF("rs", "rp", "ro")
    if isinstance(kind, str):
        both = a.join(b, F.col(f"l{kind}") == F.col(f"r{kind}"))
    elif isinstance(kind, Column):
        both = a.join(b, kind)
    else:
        both = a.crossJoin(b).where(_python_test(kind, ["ls", "lp", "lo", "rs", "rp", "ro"]))
    return both.select(F.col("ls").alias("s"), F.col("rp" if kind == "o" else "lp").alias("p"), F.col("ro").alias("o")).distinct()


def _python_test(f, columns: list[str]) -> Column:
    @F.pandas_udf(T.BooleanType())
    def test(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(f(*r)) for r in rows.itertuples(index=False, name=None)], dtype=bool)

    return test(F.struct(*columns))


@dataclass
class StreamQuery:
    """Windows over triples with event times; results are those of the query at each firing."""

    query: TripleQuery
    width: int
    slide: int
    report: tuple = (("ON_WINDOW_CLOSE", None),)
    tick: str = "TIME_DRIVEN"
    operator: str = "RSTREAM"

    def __post_init__(self):
        self.events: list[tuple] = []
        self.results: list[list[tuple]] = []
        self.open = False

    is_streaming = True

    def with_report_strategy(self, name: str, period: int | None = None) -> StreamQuery:
        self.report = ((name, period),)
        return self

    def with_periodic_report(self, period: int) -> StreamQuery:
        return self.with_report_strategy("PERIODIC", period)

    def with_tick_strategy(self, name: str) -> StreamQuery:
        self.tick = name
        return self

    def with_stream_operator(self, name: str) -> StreamQuery:
        self.operator = name
        return self

    def as_stream(self) -> StreamQuery:
        from ..streaming.windows import WindowState

        self.state, self.last, self.open = WindowState(self.width, self.slide, self.report, self.tick), [], True
        return self

    def add_stream_triple(self, s: str, p: str, o: str, ts: int) -> None:
        fired = self.state.add((s, p, o), ts)
        if fired is not None:
            self._emit(fired.items)

    def _emit(self, items) -> None:
        from ..dataset import Dataset
        from ..streaming.relations import to_stream

        rows = [tuple(r) for r in replace(self.query, ds=Dataset.of(self.query.ds.spark, items)).triples().collect()]
        self.results.append(to_stream(self.operator, self.last, rows))
        self.last = rows

    def get_stream_results(self) -> list[tuple]:
        return self.results[-1] if self.results else []

    def get_all_stream_results(self) -> list[list[tuple]]:
        return self.results

    def clear_stream_results(self) -> None:
        self.results = []

    def stop_stream(self) -> None:
        rest = self.state.flush()
        if rest:
            self._emit(rest)
        self.open = False
