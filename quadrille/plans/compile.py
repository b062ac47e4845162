"""Queries to DataFrames.

The compiler makes ordinary joins, filters and aggregates and leaves their strategy to Catalyst and
adaptive execution.  What it adds is what Catalyst cannot see: which patterns are one scan (all
patterns of a subject over one table), an order of joins that never makes an accidental product,
graph scopes, and which variables may be unbound.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.expressions import bind, condition, equals_constant, order_keys, term_text
from ..mapping import lexical
from ..operators.solutions import NUMERIC, TIMES, Rel, join, union, unit
from ..terms import RDF_TYPE, quoted_parts
from . import ast as A
from .parser import ParseError, parse


@dataclass(frozen=True)
class Scope:
    """Which graphs patterns see: `froms` make the default graph, `named` the visible named graphs (None: all), `graph` is the active one."""

    froms: tuple | None = None
    named: tuple | None = None
    graph: object = None  # None: default; Const or Var

    def quads(self, df: DataFrame) -> DataFrame:
        if self.graph is None:
            if self.froms is None:
                return df.where("g is null")
            df = df.where(F.col("g").isin(*self.froms)) if self.froms else df.limit(0)
            # a triple that several of the merged graphs hold is one triple
            return df.select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct() if len(self.froms) > 1 else df
        df = df.where("g is not null") if self.named is None else df.where(F.col("g").isin(*self.named)) if self.named else df.limit(0)
        return df.where(F.col("g") == self.graph.value) if isinstance(self.graph, A.Const) else df

    def catalogue(self, ds: Dataset) -> DataFrame:
        return ds.graphs if self.named is None else ds.graphs.where(F.col("g").isin(*self.named)) if self.named else ds.graphs.limit(0)


# -- patterns ---------------------------------------------------------------------------------
def match(df: DataFrame, columns: list[tuple[object, object]]) -> Rel:
    """Solutions of a scan: (term, column) pairs; repeated variables must agree."""
    conds, found = [], {}

    def one(term, c):
        if isinstance(term, A.Var):
            if term.name in found:
                conds.append(found[term.name] == c)
            else:
                found[term.name] = c
        elif isinstance(term, A.Quoted) and not A.variables(term):
            conds.append(c == term_text(term))
        elif isinstance(term, A.Quoted):
            parts = quoted_parts(c)
            conds.append(c.startswith("<< "))
            conds.append(parts.isNotNull())
            for x, k in ((term.s, "s"), (term.p, "p"), (term.o, "o")):
                one(x, parts[k])
        else:
            conds.append(c == term.value)

    for term, c in columns:
        one(term, c)
    if conds:
        df = df.where(reduce(lambda a, b: a & b, conds))
    return Rel(df.select(*[c.alias(v) for v, c in found.items()]), dict.fromkeys(found, "string"))


def scan_quads(ds: Dataset, t: A.Triple, scope: Scope, bound: dict | None = None) -> Rel:
    """A pattern over the quads.  Where its subject is known, or bound to rows of a table, only tables that may hold it are read."""
    wide = ds.tables is not None and scope.graph is None and scope.froms is None and not (isinstance(t.p, A.Const) and t.p.value != RDF_TYPE)
    kind = (bound or {}).get(t.s.name, "") if isinstance(t.s, A.Var) else ""
    subject = t.s.value if isinstance(t.s, A.Const) else f"urn:{kind[4:]}:" if kind.startswith("ref:") else None
    df = scope.quads(ds.all_quads(subject) if wide else ds.quads)
    columns = [(t.s, F.col("s")), (t.p, F.col("p")), (t.o, F.col("o"))]
    if isinstance(scope.graph, A.Var):
        columns.insert(0, (scope.graph, F.col("g")))
    return match(df, columns)


def scan_table(ds: Dataset, table: str, subject, triples: list[A.Triple]) -> Rel:
    """All patterns of one subject over one table: a single scan of the columns they name."""
    m = ds.tables
    df = m.scan(table)
    rel = Rel(df, {c: k for c, k in m.types[table].items()})
    kinds: dict[str, str] = {}
    cols: dict[str, object] = {}
    conds = []
    tests: list[tuple[str, str]] = []

    def take(term, name: str, kind: str):
        if isinstance(term, A.Var):
            if term.name not in cols:
                cols[term.name], kinds[term.name] = F.col(f"`{name}`"), kind
            elif kinds[term.name] == kind:
                conds.append(cols[term.name] == F.col(f"`{name}`"))
            else:
                conds.append(lexical(cols[term.name], kinds[term.name]) == lexical(F.col(f"`{name}`"), kind))
        else:
            own = Rel(df, {name: kind})
            conds.append(equals_constant(own, name, term_text(term)) if isinstance(term, A.Const) or not A.variables(term) else F.lit(False))

    take(subject, "__s", m.subject_kind(table))
    for t in triples:
        if t.p.value == RDF_TYPE:
            continue
        _, column = m.find(t.p.value)
        conds.append(F.col(f"`{column}`").isNotNull())
        take(t.o, column, m.kind(table, column))
    del rel, tests
    if conds:
        df = df.where(reduce(lambda a, b: a & b, conds))
    return Rel(df.select(*[c.alias(v) for v, c in cols.items()]), kinds)


def units(ds: Dataset, triples: list[A.Triple], scope: Scope) -> list[tuple[list[A.Triple], object]]:
    """Patterns that are one scan each: stars over tables, and single patterns over quads; each is made from the kinds of the variables bound before it."""
    plain, stars = [], {}
    mapped = ds.tables is not None and scope.graph is None and scope.froms is None
    for t in triples:
        table = None
        if mapped and isinstance(t.p, A.Const) and not isinstance(t.s, A.Quoted):
            if t.p.value == RDF_TYPE and isinstance(t.o, A.Const) and t.o.value[:4] == "urn:" and t.o.value[4:] in ds.tables.tables:
                table = t.o.value[4:]
            elif found := ds.tables.find(t.p.value):
                table = found[0]
        if table:
            stars.setdefault((t.s, table), []).append(t)
        else:
            plain.append(t)
    return [(ts, (lambda bound, ts=ts, s=s, table=table: scan_table(ds, table, s, ts))) for (s, table), ts in stars.items()] + [([t], (lambda bound, t=t: scan_quads(ds, t, scope, bound))) for t in plain]


def basic(ds: Dataset, triples: list[A.Triple], scope: Scope, start: Rel | None = None) -> Rel:
    """Joins the patterns: the most constants first, then always one that shares a variable."""
    rest = units(ds, triples, scope)
    constants = lambda ts: -sum(isinstance(x, A.Const) for t in ts for x in (t.s, t.o)) * 10 + -len(ts)
    names = lambda ts: set().union(*[A.variables(t) for t in ts]) | (A.variables(scope.graph) if scope.graph is not None else set())
    rest.sort(key=lambda u: constants(u[0]))
    out, bound = start, set(start.kinds) if start is not None else set()
    while rest:
        i = next((i for i, u in enumerate(rest) if names(u[0]) & bound), 0) if bound else 0
        ts, make = rest.pop(i)
        rel = make({} if out is None else {v: k for v, k in out.kinds.items() if v not in out.maybe})
        out = rel if out is None else join(out, rel)
        bound |= set(rel.kinds)
    return out if out is not None else unit(ds.spark)


# -- groups -------------------------------------------------------------------------------------
def group(ds: Dataset, g: A.Group, scope: Scope, hook=None) -> tuple[Rel, list]:
    """Solutions of a group, and the filters that its enclosing group has to decide.

    A filter holds for its whole group, wherever it stands.  One that names a variable which only
    the enclosing group binds is decided there.
    """
    rel: Rel | None = None
    filters = [f.expr for f in g.all(A.Filter)]
    add = lambda r: r if rel is None else join(rel, r)
    i = 0
    elements = [e for e in g.elements if not isinstance(e, A.Filter)]
    while i < len(elements):
        e = elements[i]
        i += 1
        if isinstance(e, A.Triples):
            triples = list(e.triples)
            while i < len(elements) and isinstance(elements[i], A.Triples):
                triples += elements[i].triples
                i += 1
            rel = basic(ds, triples, scope, rel)
        elif isinstance(e, A.Graph):
            inner = replace(scope, graph=e.name)
            r, up = group(ds, e.group, inner, hook)
            names = scope.catalogue(ds)
            if isinstance(e.name, A.Var) and e.name.name not in r.kinds:
                r = join(r, Rel(names.select(F.col("g").alias(e.name.name)), {e.name.name: "string"}))
            elif isinstance(e.name, A.Const) and not any(isinstance(x, (A.Triples, A.Graph)) for x in e.group.elements):
                r = join(r, Rel(names.where(F.col("g") == e.name.value).select()))
            rel = add(r)
            filters += up
        elif isinstance(e, A.Union):
            parts = []
            for b in e.branches:
                r, up = group(ds, b, scope, hook)
                for f in up:
                    r = r.where(condition(f, r))
                parts.append(r)
            rel = add(reduce(union, parts))
        elif isinstance(e, A.Group):
            r, up = group(ds, e, scope, hook)
            rel = add(r)
            filters += up
        elif isinstance(e, A.Select):
            rel = add(solve(ds, e, replace(scope, graph=scope.graph), hook, sub=True))
        elif isinstance(e, A.Values):
            rel = add(inline(ds, e))
        elif isinstance(e, A.Bind):
            rel = bind(rel if rel is not None else unit(ds.spark), e.call, e.var, ds.udfs)
        elif isinstance(e, A.Window) and hook is not None:
            rel = add(hook(e))
        elif isinstance(e, A.Not):
            rel = absent(ds, rel if rel is not None else unit(ds.spark), e.triples, scope)
    rel = rel if rel is not None else unit(ds.spark)
    up = []
    for f in filters:
        if A.variables(f) <= set(rel.kinds):
            rel = rel.where(condition(f, rel))
        else:
            up.append(f)
    return rel, up


def absent(ds: Dataset, rel: Rel, triples: list[A.Triple], scope: Scope) -> Rel:
    """The solutions for which none of the triples is there (all variables bound before)."""
    for t in triples:
        other = basic(ds, [t], scope)
        shared = [v for v in other.kinds if v in rel.kinds]
        differ = [v for v in shared if other.kinds[v] != rel.kinds[v]]
        rel, other = rel.as_terms(differ), other.as_terms(differ)
        if shared:
            rel = Rel(rel.df.join(other.df.select(*shared).distinct(), shared, "left_anti"), rel.kinds, rel.maybe)
        else:
            none = other.df.limit(1).agg(F.count(F.lit(1)).alias("__n")).where("__n = 0").select()
            rel = Rel(rel.df.crossJoin(none), rel.kinds, rel.maybe)
    return rel


def inline(ds: Dataset, v: A.Values) -> Rel:
    rows = [tuple(None if x is None else term_text(x) for x in r) for r in v.rows]
    df = ds.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in v.vars))
    return Rel(df, dict.fromkeys(v.vars, "string"), {n for i, n in enumerate(v.vars) if any(r[i] is None for r in rows)})


def visible_order(g) -> list[str]:
    """Variables in the order in which they first appear."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, A.Var):
            out.append(x.name)
        elif isinstance(x, (A.Triple, A.Quoted)):
            for y in (x.s, x.p, x.o):
                walk(y)
        elif isinstance(x, (A.Triples, A.Window)):
            for t in x.triples:
                walk(t)
        elif isinstance(x, A.Bind):
            out.append(x.var)
        elif isinstance(x, A.Values):
            out.extend(x.vars)
        elif isinstance(x, A.Graph):
            walk(x.name)
            walk(x.group)
        elif isinstance(x, A.Union):
            for b in x.branches:
                walk(b)
        elif isinstance(x, A.Group):
            for e in x.elements:
                walk(e)
        elif isinstance(x, A.Select):
            for v in [i.name for i in x.items] if x.items is not None else visible_order(x.where):
                out.append(v)

    walk(g)
    return list(dict.fromkeys(out))


# -- select --------------------------------------------------------------------------------------
def aggregate(rel: Rel, items: list[A.Item], group_by: list[str]) -> Rel:
    """GROUP BY and aggregates.  Numbers only are summed; an empty group has COUNT and SUM 0 and no other value."""
    aggs, kinds, maybe = [], {}, set()
    keys = [v for v in group_by if v in rel.kinds]
    absent_keys = [v for v in group_by if v not in rel.kinds]
    for it in items:
        if it.fn is None:
            if it.var not in group_by:
                c = F.first(F.col(f"`{it.var}`")) if it.var in rel.kinds else F.lit(None).cast("string")
                aggs.append(c.alias(it.var))
                kinds[it.var] = rel.kinds.get(it.var, "string")
                maybe.add(it.var)
            continue
        if it.fn == "COUNT":
            aggs.append(F.count(F.lit(1) if it.var is None else F.col(f"`{it.var}`") if it.var in rel.kinds else F.lit(None)).alias(it.name))
            kinds[it.name] = "bigint"
            continue
        native = rel.kinds.get(it.var) in NUMERIC or it.fn in ("MIN", "MAX") and rel.kinds.get(it.var) in TIMES
        x = F.lit(None).cast("double") if it.var not in rel.kinds else F.col(f"`{it.var}`") if native else rel.num(it.var)
        c = {"SUM": lambda: F.coalesce(F.sum(x), F.lit(0)), "AVG": lambda: F.avg(x), "MIN": lambda: F.min(x), "MAX": lambda: F.max(x)}[it.fn]()
        aggs.append(c.alias(it.name))
        kind = rel.kinds.get(it.var, "double") if native else "double"
        kinds[it.name] = "double" if it.fn == "AVG" else "bigint" if it.fn == "SUM" and kind not in ("double", "float") else "double" if kind == "float" and it.fn == "SUM" else kind
        if it.fn != "SUM":
            maybe.add(it.name)
    if keys:
        df = rel.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs) if aggs else rel.df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    else:
        df = rel.df.agg(*aggs) if aggs else rel.df.limit(1).select()
    out = Rel(df, {k: rel.kinds[k] for k in keys} | kinds, {k for k in keys if k in rel.maybe} | maybe)
    for v in absent_keys:
        out = out.with_column(v, F.lit(None).cast("string"), maybe=True)
    return out


def solve(ds: Dataset, q: A.Select, scope: Scope, hook=None, sub: bool = False) -> Rel:
    """A whole SELECT: pattern, aggregates, order, projection, distinct, limit."""
    if not sub and (q.froms or q.named):
        scope = Scope(tuple(dict.fromkeys(q.froms)), tuple(dict.fromkeys(q.named)))
    rel, up = group(ds, q.where, scope, hook)
    for f in up:
        rel = rel.where(condition(f, rel))
    items = q.items if q.items is not None else [A.Item(v) for v in visible_order(q.where)]
    if any(i.fn for i in items) or sub and q.group_by:
        rel = aggregate(rel, items, q.group_by)
    names = list(dict.fromkeys(i.name for i in items))
    if not names:
        return rel
    for v, _ in q.order_by:
        if v not in rel.kinds:
            rel = rel.with_column(v, F.lit(None).cast("string"), maybe=True)
    keys = {f"__k{i}_{j}": (k.desc() if desc else k.asc(), k) for i, (v, desc) in enumerate(q.order_by) for j, k in enumerate(order_keys(rel, v))}
    if not keys:
        out = rel.project(names)
        df = out.df.distinct() if q.distinct else out.df
        return Rel(df.limit(q.limit) if q.limit is not None else df, out.kinds, out.maybe)
    by = lambda: [F.col(k).desc() if i.endswith("desc") else F.col(k).asc() for k, i in directions]
    directions = [(f"__k{i}_{j}", "desc" if desc else "asc") for i, (v, desc) in enumerate(q.order_by) for j, _ in enumerate(order_keys(rel, v))]
    keyed = rel.df.withColumns({k: c for k, (_, c) in keys.items()})
    out = rel.project(names)
    full = keyed.select(*[F.col(f"`{v}`") if v in rel.kinds else F.lit(None).cast("string").alias(v) for v in names], *keys)
    if q.distinct:
        if all(v in names for v, _ in q.order_by):
            full = full.dropDuplicates(names)
        else:  # the first occurrence of each row in the order
            w = Window.partitionBy(*[F.col(f"`{v}`") for v in names]).orderBy(*by())
            full = full.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    full = full.orderBy(*by())
    if q.limit is not None:
        full = full.limit(q.limit)
    return Rel(full.drop(*keys), out.kinds, out.maybe)


def finish(rel: Rel, typed: bool = False) -> DataFrame:
    """The solutions for the caller: terms with "" for unbound, or native types."""
    if typed:
        return rel.df
    return rel.df.select(*[F.coalesce(rel.lex(v), F.lit("")).alias(v) for v in rel.kinds])


def select(ds: Dataset, text: str, typed: bool = False, prefixes: dict | None = None) -> DataFrame:
    """Runs a SELECT.  With typed, columns keep native types."""
    request = parse(text, ds.prefixes | (prefixes or {}))
    if request.models or request.neural or request.training or request.predict or request.rules:
        from ..engine import run

        return run(ds, request, typed)
    if request.select is None:
        raise ParseError("expected a SELECT query")
    return finish(solve(ds, request.select, Scope()), typed)


def explain(ds: Dataset, text: str, mode: str = "formatted") -> str:
    """The algebra of a query and Spark's plan for it."""
    request = parse(text, ds.prefixes)
    if request.register is not None:
        return f"Streaming\n{request.register}"
    df = finish(solve(ds, request.select, Scope()))
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return f"Static\n{request.select}\n{plan}"
