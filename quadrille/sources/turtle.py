"""Turtle and N3 data, with quoted triples and annotations; statements may span lines.

A file is cut at statement ends in a pass over it, so a document is one task, which holds its text
and a batch of its triples; large data belongs in many files (the writer makes them so) or in
N-Triples, which split anywhere.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.parser import literal, unescape
from ..terms import RDF_TYPE

_TOKEN = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n]*)+)|(?P<iri><(?!<)[^<>\s]*>)|(?P<string>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix|@base)|(?P<lang>@[A-Za-z-]+)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w-]+)
    |(?P<sign><<|>>|\{\||\|\}|\^\^|[.;,\[\]()])|(?P<name>(?:[A-Za-z_][\w.-]*)?:(?:[\w%-]|\.(?=[\w%-]))*|[A-Za-z_]\w*)""",
    re.X | re.S,
)


def parse_turtle(text: str):
    """(s, p, o) of a document; a statement that does not parse is left out."""
    prefixes: dict[str, str] = {}
    base = ""
    tokens: list[tuple[str, str]] = []
    at = 0
    blank = 0
    out: list[tuple[str, str, str]] = []

    def resolve(name: str) -> str:
        p, colon, local = name.partition(":")
        return prefixes[p] + local if colon and p in prefixes else name

    def statement(ts: list[tuple[str, str]]):
        nonlocal blank
        pos, made = 0, []

        def peek(v):
            return pos < len(ts) and ts[pos][1] == v and ts[pos][0] in ("sign", "name")

        def need(v):
            nonlocal pos
            if not peek(v):
                raise ValueError(v)
            pos += 1

        def term():
            nonlocal pos, blank
            kind, v = ts[pos]
            pos += 1
            if kind == "iri":
                x = unescape(v[1:-1])
                return x if not base or re.match(r"[A-Za-z][\w+.-]*:", x) else base + x
            if kind == "string":
                x = literal(v)
                if pos < len(ts) and ts[pos][0] == "lang":
                    x += ts[pos][1]
                    pos += 1
                elif peek("^^"):
                    pos += 2
                return x
            if kind in ("number", "blank"):
                return v
            if kind == "name":
                return RDF_TYPE if v == "a" else resolve(v)
            if v == "<<":
                parts = [term(), term(), term()]
                need(">>")
                return f"<< {' '.join(parts)} >>"
            if v == "[":
                blank += 1
                node = f"_:anon{blank}"
                if not peek("]"):
                    properties(node)
                need("]")
                return node
            raise ValueError(v)

        def properties(s):
            nonlocal pos
            while pos < len(ts) and not peek("]") and not peek("|}"):
                p = term()
                while True:
                    o = term()
                    made.append((s, p, o))
                    if peek("{|"):
                        pos += 1
                        properties(f"<< {s} {p} {o} >>")
                        need("|}")
                    if not peek(","):
                        break
                    pos += 1
                if not peek(";"):
                    break
                while peek(";"):
                    pos += 1

        s = term()
        properties(s)
        if pos != len(ts):
            raise ValueError(ts[pos][1])
        out.extend(made)

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:  # skip what is no token, to the end of its line
            end = text.find("\n", at)
            at = len(text) if end < 0 else end + 1
            tokens = []
            continue
        at = m.end()
        kind, v = m.lastgroup, m[0]
        if kind == "space":
            continue
        head = tokens[0][1].lower() if tokens else ""
        if head in ("@prefix", "prefix") and len(tokens) == 2 and kind == "iri":
            prefixes[tokens[1][1].rstrip(":")] = unescape(v[1:-1])
            tokens = [("sign", "skip")] if head == "@prefix" else []
            continue
        if head in ("@base", "base") and kind == "iri" and len(tokens) == 1:
            base = unescape(v[1:-1])
            tokens = [("sign", "skip")] if head == "@base" else []
            continue
        if kind == "sign" and v == "." and not (tokens and tokens[0][1] == "skip"):
            try:
                if tokens:
                    statement(tokens)
            except (ValueError, IndexError, KeyError):
                pass
            yield from out
            out.clear()
            tokens = []
            continue
        if tokens and tokens[0] == ("sign", "skip"):
            tokens = [] if v == "." else [(kind, v)]
            continue
        tokens.append((kind, v))
    if tokens and tokens[0] != ("sign", "skip"):
        try:
            statement(tokens)
        except (ValueError, IndexError, KeyError):
            pass
    yield from out


#: Triples in a batch from a Python worker.
BATCH = 10_000


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    schema = pa.schema([(c, pa.string()) for c in ("g", "s", "p", "o")])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.string()), *[pa.array(c, pa.string()) for c in zip(*rows)]], schema=schema)

    def run(batches):
        for batch in batches:
            for value in batch.column(0):  # one text at a time
                rows = []
                for t in parse_turtle(value.as_py()):
                    rows.append(t)
                    if len(rows) >= BATCH:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return spark.read.text(path, wholetext=True).mapInArrow(run, "g string, s string, p string, o string")
