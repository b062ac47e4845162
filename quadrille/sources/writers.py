"""Writers: a column of lines per format, and the same as text files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import is_quoted

_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$"


def _simple(c: Column) -> Column:
    text = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tagged = c.rlike(r'(?s)^".*"(\^\^<[^>]*>|@[A-Za-z-]+)?$')
    return F.when(c.startswith("_:") | tagged, c).when(c.rlike(_IRI), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def token(c: Column) -> Column:
    """A plain term as N-Triples writes it."""
    return _simple(c)


def _python_token(x: str) -> str:
    """Any term, quoted triples included."""
    if x.startswith("<< ") and x.endswith(" >>"):
        words, depth, end = x[3:-3].split(" "), 0, 0
        for i, w in enumerate(words):
            depth += (w == "<<") - (w == ">>")
            if depth == 0:
                end = i + 1
                break
        return f"<< {_python_token(' '.join(words[:end]))} {_python_token(words[end])} {_python_token(' '.join(words[end + 1 :]))} >>"
    if x.startswith("_:") or re.fullmatch(r'".*"(\^\^<[^>]*>|@[A-Za-z-]+)?', x, re.S):
        return x
    if re.fullmatch(_IRI[1:-1], x):
        return f"<{x}>"
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = x.replace(a, b)
    return f'"{x}"'


def tokens(quads: DataFrame) -> DataFrame:
    """g, s, p, o as tokens: in the JVM, but for rows with quoted triples."""
    quads = quads.select(*[F.col(c) if c in quads.columns else F.lit(None).cast("string").alias(c) for c in ("g", "s", "p", "o")])
    odd = is_quoted(F.col("s")) | is_quoted(F.col("o"))

    def run(batches):
        for pdf in batches:
            yield pdf.apply(lambda c: [None if x is None else _python_token(x) for x in c])

    plain = quads.where(~odd).select(*[token(F.col(c)).alias(c) for c in ("g", "s", "p", "o")])
    return plain.unionByName(quads.where(odd).mapInPandas(run, "g string, s string, p string, o string"))


def _default(quads: DataFrame) -> DataFrame:
    return quads.where("g is null") if "g" in quads.columns else quads


def to_ntriples(quads: DataFrame) -> DataFrame:
    return tokens(_default(quads)).select(F.concat(F.concat_ws(" ", "s", "p", "o"), F.lit(" .")).alias("value"))


def to_nquads(quads: DataFrame) -> DataFrame:
    return tokens(quads).select(F.concat(F.concat_ws(" ", "s", "p", "o", "g"), F.lit(" .")).alias("value"))


def to_turtle(quads: DataFrame) -> DataFrame:
    """One statement per subject: predicates by `;`, objects by `,`."""
    df = tokens(_default(quads))
    by = df.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("o"))
    by = by.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("po"))
    return by.select(F.concat_ws("", "s", F.lit(" "), "po", F.lit(" .")).alias("value"))


def to_rdfxml(quads: DataFrame) -> DataFrame:
    """One rdf:Description element per subject, without the envelope; names are split at the last # or /."""
    df = _default(quads)
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    space, local = F.regexp_extract("p", r"^(.*[#/:])([A-Za-z_][\w.-]*)$", 1), F.regexp_extract("p", r"^(.*[#/:])([A-Za-z_][\w.-]*)$", 2)
    head = F.concat(F.lit("    <q:"), local, F.lit(' xmlns:q="'), esc(space), F.lit('"'))
    line = F.when(F.col("o").rlike(_IRI), F.concat(head, F.lit(' rdf:resource="'), esc(F.col("o")), F.lit('"/>'))).otherwise(F.concat(head, F.lit(">"), esc(F.col("o")), F.lit("</q:"), local, F.lit(">")))
    by = df.where(local != "").select("s", line.alias("line")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return by.select(F.concat(F.lit('  <rdf:Description rdf:about="'), esc(F.col("s")), F.lit('">\n'), F.col("lines"), F.lit("\n  </rdf:Description>")).alias("value"))


def _write(lines: DataFrame, path: str, most: int = 0) -> None:
    """Text files, of so many lines at most where ``most`` is given."""
    lines.write.mode("overwrite").option("maxRecordsPerFile", most).text(path)


def write_ntriples(quads: DataFrame, path: str) -> None:
    _write(to_ntriples(quads), path)


def write_nquads(quads: DataFrame, path: str) -> None:
    _write(to_nquads(quads), path)


#: Statements in a file of Turtle, which one task reads whole.
SUBJECTS = 20_000


def write_turtle(quads: DataFrame, path: str) -> None:
    _write(to_turtle(quads), path, SUBJECTS)


def write_rdfxml(quads: DataFrame, path: str) -> None:
    """Whole documents, one per part: each partition gets its own envelope."""
    import pandas as pd

    def wrap(batches):
        yield pd.DataFrame({"value": ['<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">']})
        yield from batches
        yield pd.DataFrame({"value": ["</rdf:RDF>"]})

    _write(to_rdfxml(quads).mapInPandas(wrap, "value string"), path)
