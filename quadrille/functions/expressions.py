"""Filters and BIND as columns: two-valued logic, numbers read from terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.solutions import NUMERIC, TIMES, Rel
from ..plans import ast as A
from ..terms import is_quoted, number, parse_number, quote_triple, quoted_parts

_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def _apply(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def term_text(x) -> str:
    """A constant's term, quoted triples included."""
    if isinstance(x, A.Quoted):
        return f"<< {term_text(x.s)} {term_text(x.p)} {term_text(x.o)} >>"
    return x.value


def _plain(d: float) -> str:
    return str(int(d)) if d == int(d) and abs(d) < 1e15 else repr(d)


def equals_constant(rel: Rel, v: str, value: str) -> Column:
    """The variable's term is `value`, compared natively where a native value can have that term."""
    kind, c = rel.kinds[v], F.col(f"`{v}`")
    if kind.startswith("ref:"):
        prefix = f"urn:{kind[4:]}:"
        if not value.startswith(prefix):
            return F.lit(False)
        return c == F.lit(value[len(prefix):]).try_cast(rel.df.schema[v].dataType)
    if kind in NUMERIC:
        d = parse_number(value)
        if d is None or d != d or abs(d) == float("inf") or _plain(d) != value:
            return F.lit(False)
        return c == (F.lit(d) if kind in ("double", "float") else F.lit(int(d)) if d == int(d) else F.lit(None))
    if kind == "string":
        return c == value
    return rel.lex(v) == value


def numeric(x, rel: Rel) -> Column:
    """An operand as a double; null for what is no number."""
    if isinstance(x, A.Arith):
        a, b = numeric(x.left, rel), numeric(x.right, rel)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[x.op]
    if isinstance(x, A.Var):
        return rel.num(x.name) if x.name in rel.kinds else F.lit(None).cast("double")
    if isinstance(x, A.Const):
        d = parse_number(x.value)
        return F.lit(d).cast("double") if d is not None else F.lit(None).cast("double")
    return F.lit(None).cast("double")


def _not_nan(op: str, c: Column, kind: str) -> Column | None:
    return ~F.isnan(c) if op in (">", ">=") and kind in ("double", "float") else None


def comparison(e: A.Compare, rel: Rel) -> Column:
    """May be null for what counts as false."""
    left, right, op = e.left, e.right, e.op
    if isinstance(left, A.Const) and isinstance(right, A.Var):
        left, right, op = right, left, _FLIP[op]
    if isinstance(left, A.Arith) or isinstance(right, A.Arith):
        a, b = numeric(left, rel), numeric(right, rel)
        return _apply(op, a, b) & ~F.isnan(a) & ~F.isnan(b)
    if isinstance(left, A.Var) and left.name not in rel.kinds or isinstance(right, A.Var) and right.name not in rel.kinds:
        return F.lit(False)
    if isinstance(left, A.Const):
        if isinstance(right, A.Const):
            if op in ("=", "!="):
                return F.lit((left.value == right.value) == (op == "="))
            a, b = parse_number(left.value) or 0.0, parse_number(right.value) or 0.0
            return F.lit({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        return F.lit(False)
    if not isinstance(left, A.Var):
        return F.lit(False)
    v, kind, c = left.name, rel.kinds[left.name], F.col(f"`{left.name}`")
    if isinstance(right, A.Var):
        w = right.name
        if op in ("=", "!="):
            return _apply(op, c, F.col(f"`{w}`")) if kind == rel.kinds[w] else _apply(op, rel.lex(v), rel.lex(w))
        if kind in TIMES and rel.kinds[w] in TIMES:
            return _apply(op, c, F.col(f"`{w}`"))
        if kind in NUMERIC and rel.kinds[w] in NUMERIC:
            out = _apply(op, c, F.col(f"`{w}`"))
            for n, x in ((kind, c), (rel.kinds[w], F.col(f"`{w}`"))):
                out = out & ~F.isnan(x) if n in ("double", "float") else out
            return out
        a, b = F.coalesce(rel.num(v), F.lit(0.0)), F.coalesce(rel.num(w), F.lit(0.0))
        return _apply(op, a, b) & ~F.isnan(a) & ~F.isnan(b) & c.isNotNull() & F.col(f"`{w}`").isNotNull()
    value = term_text(right)
    if op in ("=", "!="):
        if kind == "string" and '"' not in value:
            # the stored term may carry quotes and a datatype of its own
            same = (c == value) | (c.startswith('"') & (F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z-]+)?$', 1) == value))
        else:
            same = equals_constant(rel, v, value)
        return same if op == "=" else ~same & c.isNotNull()
    if kind in TIMES and re.match(r"\d{4}-\d\d-\d\d", value):
        return _apply(op, c, F.lit(value).try_cast("timestamp"))
    d = parse_number(value)
    d = 0.0 if d is None else d
    if kind in NUMERIC:
        out = _apply(op, c, F.lit(d if kind in ("double", "float") or d != int(d) else int(d)))
        guard = _not_nan(op, c, kind)
        return out if guard is None else out & guard
    x = F.coalesce(rel.num(v), F.lit(0.0))
    return _apply(op, x, F.lit(d)) & ~F.isnan(x) & c.isNotNull()


def condition(e, rel: Rel, top: bool = True) -> Column:
    """A filter.  Below NOT and OR a null would spread, so each leaf is made false there; a bare
    conjunct keeps its plain form and can reach the scan."""
    if isinstance(e, A.Logic):
        if e.op == "and":
            parts = [condition(a, rel, top) for a in e.args]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if e.op == "or":
            parts = [condition(a, rel, False) for a in e.args]
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            return out
        return ~condition(e.args[0], rel, False)
    if isinstance(e, A.Compare):
        out = comparison(e, rel)
    elif isinstance(e, A.Call):
        out = is_quoted(rel.lex(e.args[0].name)) if e.name.upper() == "ISTRIPLE" and len(e.args) == 1 and isinstance(e.args[0], A.Var) and e.args[0].name in rel.kinds else F.lit(False)
        if e.name.upper() == "ISTRIPLE" and len(e.args) == 1 and isinstance(e.args[0], A.Quoted):
            out = F.lit(True)
    else:
        x = numeric(e, rel)
        out = (x != 0.0) & ~F.isnan(x)
    return out if top else F.coalesce(out, F.lit(False))


def argument(x, rel: Rel) -> Column:
    """An argument of BIND as a term, null if unbound."""
    if isinstance(x, A.Var):
        return rel.lex(x.name) if x.name in rel.kinds else F.lit(None).cast("string")
    if isinstance(x, A.Quoted):
        return quote_triple(*[argument(y, rel) for y in (x.s, x.p, x.o)])
    return F.lit(x.value)


def bind(rel: Rel, call: A.Call, var: str, udfs: dict) -> Rel:
    """The solutions with `var` bound to a function's value; an unknown function leaves it unbound."""
    args = [argument(a, rel) for a in call.args]
    name = call.name.upper()
    part = {"SUBJECT": "s", "PREDICATE": "p", "OBJECT": "o"}.get(name)
    if call.name in udfs:
        f = udfs[call.name]
        filled = [F.coalesce(a, F.lit("")) for a in args]
        return rel.with_column(var, (f if getattr(f, "is_column_function", False) else as_udf(f))(*filled))
    if name == "CONCAT":
        return rel.with_column(var, F.concat(*[F.when(is_quoted(a), F.lit("")).otherwise(F.coalesce(a, F.lit(""))) for a in args]) if args else F.lit(""))
    if part and len(args) == 1:
        return rel.with_column(var, quoted_parts(args[0])[part], maybe=True)
    if name == "TRIPLE" and len(args) == 3:
        loose = any(isinstance(a, A.Var) and (a.name in rel.maybe or a.name not in rel.kinds) for a in call.args)
        return rel.with_column(var, quote_triple(*args), maybe=loose)
    if name == "ISTRIPLE" and len(args) == 1:
        return rel.with_column(var, F.when(F.coalesce(is_quoted(args[0]), F.lit(False)), F.lit("true")).otherwise(F.lit("false")))
    if var in rel.kinds:
        return rel
    return rel.with_column(var, F.lit(None).cast("string"), maybe=True)


def column_function(f):
    """Marks a Column -> Column function for BIND: it stays in the JVM."""
    f.is_column_function = True
    return f


def as_udf(f):
    """A Python function of strings as an Arrow-batched function of columns."""
    # one argument of type struct: the number of the function's arguments is free
    @F.pandas_udf(T.StringType())
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([f(list(r)) for r in rows.itertuples(index=False, name=None)], dtype="object")

    return lambda *cols: run(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)])) if cols else F.lit(f([]))


def order_keys(rel: Rel, v: str) -> list[Column]:
    """Keys of a total order: numbers by value, then other terms by code point; unbound as an empty term."""
    kind, c = rel.kinds[v], F.col(f"`{v}`")
    if kind in NUMERIC or kind in TIMES:
        return [c]
    text = F.coalesce(rel.lex(v), F.lit(""))
    n = number(text)
    return [n.isNull(), n, text]
