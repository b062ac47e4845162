"""Command line: ``python -m quadrille --file data.nt --query "SELECT ..."``.

Prints the rows of a query as tab-separated lines, an update's summary, or what a rule derives.
``--query`` may be given several times; each runs on what the one before it left.  Rows come to
the driver one partition at a time; ``--output`` writes them as Parquet instead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .engine import QueryEngine


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser(prog="quadrille", description="Runs queries over RDF files.")
    cli.add_argument("--file", action="append", default=[], help="N-Triples, N-Quads, Turtle, N3 or RDF/XML; may be repeated")
    cli.add_argument("--format", help="format of the files where their names do not say it")
    cli.add_argument("--query", action="append", required=True, help="SELECT, update or RULE; may be repeated")
    cli.add_argument("--output", help="folder for the rows of the last query, as Parquet")
    given = cli.parse_args(arguments)
    engine = QueryEngine(spark or SparkSession.builder.appName("quadrille").getOrCreate())
    for path in given.file:
        engine.load(path, given.format)
    for k, text in enumerate(given.query, 1):
        out = engine.execute(text)
        if not isinstance(out, DataFrame):
            print(out)
        elif given.output and k == len(given.query):
            out.write.parquet(given.output)
        else:
            print("\t".join(out.columns))
            for row in out.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
