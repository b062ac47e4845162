"""RDF/XML: rdf:Description and typed nodes, property elements with text, resource or one nested node."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..terms import RDF_TYPE

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def parse_rdfxml(text: str):
    """(s, p, o) of a document, streamed node by node."""
    count = 0
    depth = 0
    nodes = ET.iterparse(io.BytesIO(text.encode()), events=("start", "end"))

    def node(e):
        nonlocal count
        s = e.get(f"{_RDF}about") or e.get("about")
        if s is None and e.get(f"{_RDF}ID"):
            s = "#" + e.get(f"{_RDF}ID")
        if s is None:
            if e.get(f"{_RDF}nodeID"):
                s = "_:" + e.get(f"{_RDF}nodeID")
            else:
                count += 1
                s = f"_:node{count}"
        if e.tag != f"{_RDF}Description":
            yield s, RDF_TYPE, _name(e.tag)
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((_RDF, "{http://www.w3.org/XML/1998/namespace}")):
                yield s, _name(k), v
        for p in e:
            target = p.get(f"{_RDF}resource") or p.get("resource")
            if target is not None:
                yield s, _name(p.tag), target
            elif p.get(f"{_RDF}nodeID"):
                yield s, _name(p.tag), "_:" + p.get(f"{_RDF}nodeID")
            elif len(p):
                for child in p:
                    inner = list(node(child))
                    own = child.get(f"{_RDF}about") or (inner[0][0] if inner else f"_:node{count}")
                    yield s, _name(p.tag), own
                    yield from inner
            else:
                lang = p.get("{http://www.w3.org/XML/1998/namespace}lang")
                yield s, _name(p.tag), (p.text or "").strip() + (f"@{lang}" if lang else "")

    try:
        for event, e in nodes:
            depth += 1 if event == "start" else -1
            if event == "end" and depth == 1:
                yield from node(e)
                e.clear()
    except ET.ParseError:
        return


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                rows = []
                for t in parse_rdfxml(text):
                    rows.append((None, *t))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])
                        rows = []
                yield pd.DataFrame(rows, columns=["g", "s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "g string, s string, p string, o string")
