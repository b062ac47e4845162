"""Terms are strings: the lexical form decides equality, and numbers are read where they are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
QUAD_SCHEMA = "g string, s string not null, p string not null, o string not null"
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def strip_annotation(c: Column) -> Column:
    """`"x"^^<dt>` and `"x"` as x; anything else as it is."""
    return F.when(c.startswith('"'), F.regexp_extract(c, r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z-]+)?$', 1)).otherwise(c)


def number(c: Column) -> Column:
    """The term as a double, or null: surrounding blanks and suffixed literals are not numbers."""
    x = strip_annotation(c)
    return F.when(x.rlike(_NUMBER), F.regexp_replace(F.lower(x), "^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))


def format_number(d: Column) -> Column:
    """Shortest decimal form: no exponent, no `.0` on whole numbers."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    text = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(whole, F.when(d == 0, F.lit("0")).otherwise(d.cast("long").cast("string"))).when(text.contains("E") & (F.abs(d) < 1e19), plain).when(F.isnan(d), F.lit("NaN")).when(
        F.abs(d) == float("inf"), F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(text)


def parse_number(text: str) -> float | None:
    """The same rule for constants of a query."""
    import re

    return float(text) if re.fullmatch(_NUMBER[1:-1], text) else None


def quote_triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


def is_quoted(c: Column) -> Column:
    return c.startswith("<< ") & c.endswith(" >>")


def quoted_parts(c: Column) -> Column:
    """struct<s,p,o> of a quoted triple of any nesting, null for other terms.

    The subject ends where the nesting depth is back at zero; the predicate is one word; the object
    is the rest.  All of it runs in the JVM.
    """
    toks = F.split(c, " ")
    inner = F.slice(toks, F.lit(2), F.size(toks) - 2)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("e"))
    depth = lambda a, t: a["d"] + F.when(t == "<<", 1).when(t == ">>", -1).otherwise(0)
    step = lambda a, t: F.struct(depth(a, t).alias("d"), (a["i"] + 1).alias("i"), F.when((a["e"] == 0) & (depth(a, t) == 0), a["i"] + 1).otherwise(a["e"]).alias("e"))
    end = F.aggregate(inner, start, step, lambda a: a["e"])
    parts = F.struct(F.array_join(F.slice(inner, F.lit(1), end), " ").alias("s"), F.get(inner, end).alias("p"), F.array_join(F.slice(inner, end + 2, F.greatest(F.size(inner) - end - 1, F.lit(0))), " ").alias("o"))
    return F.when(is_quoted(c) & (F.size(toks) >= 5), parts)
