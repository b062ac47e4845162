"""Readers and writers of RDF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ntriples import parse_line_column
from .rdfxml import read_rdfxml
from .turtle import read_turtle
from .writers import to_nquads, to_ntriples, to_rdfxml, to_turtle, write_nquads, write_ntriples, write_rdfxml, write_turtle

FORMATS = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "n3": "n3", "rdf": "rdfxml", "xml": "rdfxml", "rdfxml": "rdfxml", "owl": "rdfxml", "parquet": "parquet"}


def guess(path: str) -> str:
    name = path.rstrip("/").split("/")[-1].removesuffix(".gz")
    kind = FORMATS.get(name.rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"cannot tell the format of {path}: give one of {sorted(set(FORMATS.values()))}")
    return kind


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Quads of a file, folder or pattern."""
    kind = FORMATS[format.lower()] if format else guess(path)
    if kind == "parquet":
        return spark.read.parquet(path).select("g", "s", "p", "o")
    if kind in ("ntriples", "nquads"):
        return parse_line_column(spark.read.text(path), kind)
    if kind in ("turtle", "n3"):
        return read_turtle(spark, path)
    return read_rdfxml(spark, path)


def parse(spark: SparkSession, text: str, format: str) -> DataFrame:
    """Quads of a text that is at hand."""
    kind = FORMATS[format.lower()]
    if kind in ("ntriples", "nquads"):
        return parse_line_column(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"), kind)
    from ..terms import QUAD_SCHEMA

    if kind in ("turtle", "n3"):
        from .turtle import parse_turtle

        rows = list(parse_turtle(text))
    else:
        from .rdfxml import parse_rdfxml

        rows = list(parse_rdfxml(text))
    return spark.createDataFrame([(None, *r) for r in rows], QUAD_SCHEMA)


__all__ = ["read", "parse", "guess", "to_ntriples", "to_nquads", "to_turtle", "to_rdfxml", "write_ntriples", "write_nquads", "write_turtle", "write_rdfxml"]
