"""Continuous queries: REGISTER ... AS SELECT over windows, replayed over tables, run on streams, or fed by hand.

``replay`` computes all firings of an ordered event table in one plan: a firing's content is a named
graph whose name is the firing's time, so the window's patterns are a GRAPH pattern with that
variable and every firing is solved at once.  ``StreamRunner`` does the same per micro-batch of a
Structured Streaming source and keeps what windows still need in a table between batches.
``ContinuousQuery`` takes single events and follows the several-window policies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators.solutions import Rel, join
from ..plans import ast as A
from ..plans.compile import Scope, finish, group, visible_order
from ..plans.parser import parse
from .relations import stream_of, to_stream
from .windows import WindowState, contents, firings

FIRE = "__fire"


def normal(iri) -> str:
    """Stream and window names: without brackets and leading colon."""
    return iri.strip("<>").lstrip(":")


@dataclass
class Plan:
    """A registered query: its windows, the patterns of each, the patterns of the static data, and what to give."""

    register: A.Register
    windows: dict[str, A.WindowSpec]
    blocks: dict[str, list[A.Triple]]
    static: list[A.Triple]
    rest: list
    names: list[str]
    select: A.Select

    @staticmethod
    def of(text: str, prefixes: dict | None = None) -> Plan:
        r = parse(text, prefixes).register
        if r is None:
            raise ValueError("expected REGISTER ... AS SELECT")
        g = r.select.where
        blocks: dict[str, list] = {}
        for w in g.all(A.Window):
            blocks.setdefault(normal(w.name), []).extend(w.triples)
        static = [t for e in g.all(A.Triples) for t in e.triples]
        rest = [e for e in g.elements if not isinstance(e, (A.Window, A.Triples))]
        names = [i.name for i in r.select.items] if r.select.items is not None else visible_order(g)
        return Plan(r, {normal(w.name): w for w in r.windows}, blocks, static, rest, names, r.select)

    def slide(self, w: A.WindowSpec) -> int:
        return w.step or w.width

    def listens(self, w: A.WindowSpec, stream: str) -> bool:
        return isinstance(w.stream, A.Var) or normal(w.stream.value) == normal(stream)


def _on_static(plan: Plan, rel: Rel, static: Dataset | None, spark) -> Rel:
    if plan.static:
        ds = static or Dataset.empty(spark)
        other, _ = group(ds, A.Group([A.Triples(plan.static)]), Scope())
        rel = join(rel, other)
    if plan.rest:
        from ..functions.expressions import bind, condition
        from ..plans.compile import inline

        ds = static or Dataset.empty(spark)
        for e in plan.rest:
            if isinstance(e, A.Values):
                rel = join(rel, inline(ds, e))
            elif isinstance(e, A.Bind):
                rel = bind(rel, e.call, e.var, ds.udfs)
        for e in plan.rest:
            if isinstance(e, A.Filter):
                rel = rel.where(condition(e.expr, rel))
    return rel


def replay(events: DataFrame, text: str, static: Dataset | None = None, rules: list | None = None, before: int | None = None) -> DataFrame:
    """fire_ts and the query's columns for all firings of ordered events (stream, s, p, o, ts).

    Windows report when they close.  With several windows, those that fire at one time are joined.
    """
    spark = events.sparkSession
    plan = Plan.of(text, static.prefixes if static else None)
    rel, fired_all = None, None
    for name, triples in plan.blocks.items():
        w = plan.windows[name]
        own = events if isinstance(w.stream, A.Var) else events.where(F.regexp_replace("stream", r"^[<:]+|>$", "") == normal(w.stream.value))
        fired = firings(own.select("ts"), w.width, plan.slide(w), before)
        held = contents(own, fired, w.width, plan.slide(w))
        quads = held.select(F.col("fire_ts").cast("string").alias("g"), "s", "p", "o")
        if rules:
            from ..reason.fixpoint import derive

            quads = quads.unionByName(derive(quads, rules, by="g")).distinct()
        content = Dataset(spark, quads, quads.select("g").distinct())
        r, _ = group(content, A.Group([A.Graph(A.Var(FIRE), A.Group([A.Triples(triples)]))]), Scope())
        rel = r if rel is None else join(rel, r)
        fired_all = fired if fired_all is None else fired_all.unionByName(fired)
    rel = _on_static(plan, rel, static, spark)
    if any(i.fn for i in plan.select.items or []):
        rel = grouped(rel, plan.select)
    out = finish(rel.project([FIRE, *[n for n in plan.names if n != FIRE]])).withColumn("fire_ts", F.col(FIRE).cast("long")).drop(FIRE)
    return stream_of(plan.register.operator, out, fired_all.select("fire_ts").distinct(), plan.names).select("fire_ts", *plan.names)


class StreamRunner:
    """A continuous query on a streaming DataFrame (stream, s, p, o, ts), micro-batch by micro-batch.

    Events of a batch may come in any order inside it; between batches they are in order, and later
    ones are dropped.  The state is the events that open windows still need and the last result.
    """

    def __init__(self, text: str, sink, static: Dataset | None = None):
        self.text, self.sink, self.static = text, sink, static
        self.plan = Plan.of(text)
        self.held: DataFrame | None = None
        self.last_ts: int | None = None
        self.done = -1

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Used with foreachBatch; a batch that comes again is left out."""
        from ..storage import materialize

        if batch_id <= self.done or batch.isEmpty():
            return
        new = batch.select("stream", "s", "p", "o", F.col("ts").cast("long").alias("ts"))
        if self.last_ts is not None:
            new = new.where(F.col("ts") >= self.last_ts)
        width = max(w.width for w in self.plan.windows.values())
        both = new if self.held is None else self.held.unionByName(new)
        both = materialize(both, "stream")
        # all firings again from what is held, then those of this batch: ISTREAM and DSTREAM see the one before
        rows = replay(both, self.text, self.static)
        if self.last_ts is not None:
            rows = rows.where(F.col("fire_ts") > self.last_ts)
        self.sink(rows, batch_id)
        self.last_ts = both.agg(F.max("ts")).first()[0]
        step = max(self.plan.slide(w) for w in self.plan.windows.values())
        self.held = materialize(both.where(F.col("ts") >= self.last_ts - 2 * width - 2 * step), "held")
        self.done = batch_id

    def start(self, stream: DataFrame, checkpoint: str | None = None):
        writer = stream.writeStream.foreachBatch(self.process)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class ContinuousQuery:
    """A continuous query that is fed single events; results go to `consumer`, one call per result row set."""

    def __init__(self, spark, text: str, consumer=None, static: Dataset | None = None, rules: list | None = None, policy: tuple | None = None, clock=None):
        import time

        self.spark, self.plan, self.static, self.rules = spark, Plan.of(text), static, rules
        self.consumer = consumer or (lambda rows: None)
        self.state = {n: WindowState(w.width, self.plan.slide(w), tuple(w.report) or (("ON_WINDOW_CLOSE", None),), w.tick) for n, w in self.plan.windows.items()}
        own = next((w.policy for w in self.plan.windows.values() if w.policy), None)
        self.policy = own or policy or ("wait",)
        self.latest: dict[str, list | None] = dict.fromkeys(self.plan.blocks)
        self.fresh: set[str] = set()
        self.last: list = []
        self.clock, self.since = clock or time.monotonic, None
        self.seeds: dict[int, tuple] = {}
        self.results: list[list[tuple]] = []

    def add(self, triple: tuple, ts: int) -> None:
        """An event of every stream."""
        for name in self.plan.windows:
            self._push(name, tuple(triple), ts)

    def add_to_stream(self, stream: str, triple: tuple, ts: int) -> None:
        for name, w in self.plan.windows.items():
            if self.plan.listens(w, stream):
                self._push(name, tuple(triple), ts)

    def add_probabilistic_to_stream(self, stream: str, triple: tuple, prob: float, ts: int) -> int:
        """One identity for the occurrence, whatever windows it is in."""
        seed = len(self.seeds) + 1
        self.seeds[seed] = (*triple, prob, stream, ts)
        self.add_to_stream(stream, triple, ts)
        return seed

    def _push(self, name: str, triple: tuple, ts: int) -> None:
        fired = self.state[name].add(triple, ts)
        if fired is not None and name in self.plan.blocks:
            self._fired(name, fired.items)
        self.tick()

    def _solve(self, name: str, items) -> Rel:
        content = Dataset.of(self.spark, list(items))
        if self.rules:
            from ..reason.fixpoint import derive

            content = Dataset.from_quads(content.quads.unionByName(derive(content.quads, self.rules)))
        rel, _ = group(content, A.Group([A.Triples(self.plan.blocks[name])]), Scope())
        rows = [tuple(r) for r in finish(rel).collect()]
        return list(rel.kinds), rows

    def _fired(self, name: str, items) -> None:
        self.latest[name] = self._solve(name, items)
        self.fresh.add(name)
        if self.since is None:
            self.since = self.clock()
        everyone = all(v is not None for v in self.latest.values())
        kind = self.policy[0]
        if len(self.latest) == 1 or kind == "steal" and everyone or self.fresh == set(self.latest):
            self._emit()

    def tick(self) -> None:
        """Lets a timeout pass: missing windows are taken from before (steal) or the round is dropped."""
        if self.policy[0] != "timeout" or self.since is None or self.clock() - self.since < self.policy[1]:
            return
        if self.policy[2] == "steal" and all(v is not None for v in self.latest.values()):
            self._emit()
        else:
            self.fresh, self.since = set(), None

    def _emit(self) -> None:
        rel = None
        for names, rows in self.latest.values():
            df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)) if names else self.spark.range(len(rows)).select()
            r = Rel(df, dict.fromkeys(names, "string"))
            rel = r if rel is None else join(rel, r)
        rel = _on_static(self.plan, rel, self.static, self.spark)
        new = [tuple(r) for r in finish(rel.project(self.plan.names)).collect()]
        out = to_stream(self.plan.register.operator, self.last, new)
        self.last = list(new)
        self.fresh, self.since = set(), None
        if out:
            self.results.append(out)
            self.consumer(out)

    def stop(self) -> None:
        """Delivers once what open windows still hold."""
        for name, s in self.state.items():
            rest = s.flush()
            if rest and name in self.plan.blocks:
                self._fired(name, rest)


def retrieve(ds: Dataset, text: str) -> DataFrame:
    """RETRIEVE: the union of the triples that match each pattern by itself."""
    r = parse(text, ds.prefixes).retrieve
    out = None
    for t in r.triples:
        df = ds.query_default(*[x.value if isinstance(x, A.Const) else None for x in (t.s, t.p, t.o)])
        out = df if out is None else out.unionByName(df)
    return out.distinct()


def grouped(plan_rel: Rel, select: A.Select) -> Rel:
    """Aggregates of a continuous SELECT, per firing."""
    from ..plans.compile import aggregate

    return aggregate(plan_rel, [A.Item(FIRE), *(select.items or [])], [FIRE, *select.group_by])


__all__ = ["Plan", "replay", "StreamRunner", "ContinuousQuery", "retrieve", "grouped"]
