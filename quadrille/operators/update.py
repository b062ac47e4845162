"""Updates: the WHERE part is solved once, both templates are filled from it, deletes come before inserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, null_safe
from ..functions.expressions import condition, term_text
from ..plans import ast as A
from ..plans.parser import ParseError, parse
from ..terms import QUAD_SCHEMA, is_quoted, quote_triple
from .solutions import Rel, unit

_SAME = ["g", "s", "p", "o"]


@dataclass(frozen=True)
class UpdateSummary:
    """How many quads really came or went."""

    inserted_quads: int
    deleted_quads: int


def _fill(term, rel: Rel, blanks: bool):
    if isinstance(term, A.Var):
        return rel.lex(term.name) if term.name in rel.kinds else F.lit(None).cast("string")
    if isinstance(term, A.Quoted):
        return quote_triple(*[_fill(x, rel, blanks) for x in (term.s, term.p, term.o)])
    if blanks and isinstance(term, A.Const) and term.kind == "blank":
        # one fresh node per solution and label
        return F.concat(F.lit(f"{term.value}_"), F.col("__row"))
    return F.lit(term.value)


def _legal(c, term, subject: bool):
    """Terms from variables: no literal-looking subject or predicate (an IRI or blank node has no blank and has a colon)."""
    if not isinstance(term, A.Var):
        return c.isNotNull()
    iri = c.rlike(r"^[A-Za-z_][A-Za-z0-9+.-]*:[^\s]*$|^_:[\w-]+$")
    return c.isNotNull() & ((iri | is_quoted(c)) if subject else iri & ~c.startswith("_:"))


def instantiate(rel: Rel, t: A.Template) -> DataFrame:
    """The quads of a template for all solutions; a quad with an unbound or illegal term is left out."""
    out = []
    for g, q in t.quads:
        s, p, o = (_fill(x, rel, True) for x in (q.s, q.p, q.o))
        graph = F.lit(None).cast("string") if g is None else _fill(g, rel, False)
        ok = _legal(s, q.s, True) & _legal(p, q.p, False) & o.isNotNull() & (F.lit(True) if g is None else _legal(graph, g, False))
        out.append(F.when(ok, F.struct(graph.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"))))
    rows = rel.df.select(F.explode(F.array(*out)).alias("q")).where("q is not null")
    return rows.select("q.g", "q.s", "q.p", "q.o").distinct()


def _ground(ds: Dataset, t: A.Template | None) -> DataFrame:
    rows = [] if t is None else [(None if g is None else g.value, term_text(q.s), term_text(q.p), term_text(q.o)) for g, q in t.quads]
    return ds.spark.createDataFrame(rows, QUAD_SCHEMA).distinct()


def apply(ds: Dataset, deletes: DataFrame | None, inserts: DataFrame | None) -> tuple[Dataset, UpdateSummary]:
    """Changes the dataset and counts the effective changes."""
    from ..storage import materialize

    gone = come = 0
    new = ds
    if deletes is not None:
        deletes = materialize(null_safe(deletes, ds.quads, _SAME, "left_semi"), "deletes")
        gone = deletes.count()
        new = new.delete_quads(deletes) if gone else new
    if inserts is not None:
        inserts = materialize(null_safe(inserts, new.quads, _SAME, "left_anti"), "inserts")
        come = inserts.count()
        new = new.add_quads(inserts) if come else new
    return new, UpdateSummary(come, gone)


def run(ds: Dataset, u: A.Update) -> tuple[Dataset, UpdateSummary]:
    from ..plans.compile import Scope, group
    from ..storage import materialize

    if u.where is None:
        return apply(ds, _ground(ds, u.delete) if u.delete else None, _ground(ds, u.insert) if u.insert else None)
    rel, up = group(ds, u.where, Scope()) if u.where.elements else (unit(ds.spark), [])
    for f in up:
        rel = rel.where(condition(f, rel))
    # solved once, with a number for each solution that a re-run does not change
    numbered = rel.df.withColumn("__row", F.concat_ws("x", F.lit(str(ds.depth)), F.monotonically_increasing_id().cast("string")))
    rel = Rel(materialize(numbered, "solutions"), rel.kinds, rel.maybe)
    return apply(ds, instantiate(rel, u.delete) if u.delete else None, instantiate(rel, u.insert) if u.insert else None)


def update(ds: Dataset, text: str, prefixes: dict | None = None) -> tuple[Dataset, UpdateSummary]:
    """One of the six update forms; gives the new dataset and what changed."""
    request = parse(text, ds.prefixes | (prefixes or {}))
    if request.update is None:
        raise ParseError("expected INSERT or DELETE")
    return run(ds, request.update)
