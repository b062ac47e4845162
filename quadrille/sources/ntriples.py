"""N-Triples and N-Quads, line by line in the JVM; lines with quoted triples go through a parser of their own."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IRI, _BLANK, _LITERAL = r"<[^<>\s]*>", r"_:[\w-]+", r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s+({_IRI}|a)\s+({_IRI}|{_BLANK}|{_LITERAL})(?:\s+({_IRI}|{_BLANK}))?\s*\.\s*(?:#.*)?$"
_TERM = re.compile(rf"\s*(<<|>>|{_IRI}|{_BLANK}|{_LITERAL}|a(?=\s)|\.)")


def _clean(c):
    """The term of a token: brackets and quotes go, datatypes are dropped, languages stay."""
    body = F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    lang = F.regexp_extract(c, r'"(@[A-Za-z-]+)$', 1)
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))
    return F.when(c == "a", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")).when(c.startswith("<"), F.regexp_extract(c, r"^<(.*)>$", 1)).when(c.startswith('"'), F.concat(plain, lang)).otherwise(c)


def clean(token: str) -> str:
    """The same in Python, with \\u escapes."""
    from ..plans.parser import unescape

    if token == "a":
        return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    if token.startswith("<"):
        return unescape(token[1:-1])
    if token.startswith('"'):
        end = token.rfind('"')
        lang = token[end + 1 :]
        return unescape(token[1:end]) + (lang if lang.startswith("@") else "")
    return token


def parse_line(line: str, kind: str):
    """(g, s, p, o) of a line, or None: for lines that hold quoted triples or escapes."""
    tokens = []
    at = 0
    while at < len(line) and not line[at:].lstrip().startswith("#"):
        m = _TERM.match(line, at)
        if not m:
            if line[at:].strip():
                return None
            break
        tokens.append(m[1])
        at = m.end()
    if not tokens or tokens[-1] != ".":
        return None
    pos = 0

    def term():
        nonlocal pos
        t = tokens[pos]
        pos += 1
        if t == "<<":
            parts = [term(), term(), term()]
            if tokens[pos] != ">>":
                raise IndexError
            pos += 1
            return f"<< {' '.join(parts)} >>"
        if t in (">>", "."):
            raise IndexError
        return clean(t)

    try:
        s, p, o = term(), term(), term()
        g = term() if kind == "nquads" and tokens[pos] != "." else None
        return (g, s, p, o) if tokens[pos] == "." and pos == len(tokens) - 1 else None
    except IndexError:
        return None


def parse_line_column(lines: DataFrame, kind: str) -> DataFrame:
    """g, s, p, o of a DataFrame with the column value.  Lines that are no statement are left out."""
    lines = lines.select("value")
    odd = F.col("value").contains("<<") | F.col("value").rlike(r"\\[uU]")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    good = lines.where(~odd & F.col("value").rlike(_LINE))
    if kind == "ntriples":
        good = good.where(part(4) == "")
    plain = good.select(F.when(part(4) != "", _clean(part(4))).alias("g"), _clean(part(1)).alias("s"), _clean(part(2)).alias("p"), _clean(part(3)).alias("o"))

    def run(batches):
        for pdf in batches:
            rows = [r for r in (parse_line(x, kind) for x in pdf["value"]) if r]
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return plain.unionByName(lines.where(odd).mapInPandas(run, "g string, s string, p string, o string"))
