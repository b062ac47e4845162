"""A dataset: quads as a DataFrame (null graph: default graph), a catalogue of named graphs, and tables seen as triples.

A Dataset is immutable; every change gives a new one.  Quads are a set on (g, s, p, o).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import QUAD_SCHEMA, XSD

_SAME = ["g", "s", "p", "o"]


def null_safe(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A semi or anti join on columns that may be null."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(other, on, how)


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    quads: DataFrame
    graphs: DataFrame
    tables: object | None = None  # mapping.TableMapping
    seeds: DataFrame | None = None  # s, p, o, prob
    prefixes: dict = field(default_factory=dict)
    udfs: dict = field(default_factory=dict)
    depth: int = 0

    #: After so many changes the quads are written out, so that plans stay short.
    CUT = 8

    # -- making ---------------------------------------------------------------
    @staticmethod
    def empty(spark: SparkSession) -> Dataset:
        return Dataset(spark, spark.createDataFrame([], QUAD_SCHEMA), spark.createDataFrame([], "g string"))

    @staticmethod
    def of(spark: SparkSession, rows) -> Dataset:
        """From tuples (s, p, o) or (s, p, o, g)."""
        rows = [(r[3] if len(r) > 3 else None, str(r[0]), str(r[1]), str(r[2])) for r in rows]
        return Dataset.from_quads(spark.createDataFrame(rows, QUAD_SCHEMA) if rows else spark.createDataFrame([], QUAD_SCHEMA))

    @staticmethod
    def from_quads(quads: DataFrame, distinct: bool = True) -> Dataset:
        quads = quads.select(*_SAME)
        quads = quads.distinct() if distinct else quads
        return Dataset(quads.sparkSession, quads, quads.where("g is not null").select("g").distinct())

    @staticmethod
    def from_tables(spark: SparkSession, tables: dict[str, DataFrame], keys: dict | None = None, links: dict | None = None) -> Dataset:
        from .mapping import TableMapping

        return replace(Dataset.empty(spark), tables=TableMapping(tables, keys, links))

    def load(self, path: str, format: str | None = None) -> Dataset:
        from .sources import read

        return self.union(Dataset.from_quads(read(self.spark, path, format)))

    # -- changes ----------------------------------------------------------------
    def _changed(self, **what) -> Dataset:
        new = replace(self, depth=self.depth + 1, **what)
        if new.depth % self.CUT:
            return new
        from .storage import materialize

        return replace(new, quads=materialize(new.quads, "quads"), graphs=materialize(new.graphs, "graphs"))

    def add_quads(self, more: DataFrame) -> Dataset:
        more = more.select(*_SAME)
        graphs = self.graphs.unionByName(more.where("g is not null").select("g")).distinct()
        return self._changed(quads=self.quads.unionByName(more).distinct(), graphs=graphs)

    def delete_quads(self, gone: DataFrame) -> Dataset:
        return self._changed(quads=null_safe(self.quads, gone.select(*_SAME), _SAME, "left_anti"))

    def _row(self, s, p, o, g=None) -> DataFrame:
        return self.spark.createDataFrame([(g, s, p, o)], QUAD_SCHEMA)

    def add_triple(self, s: str, p: str, o: str) -> Dataset:
        return self.add_quads(self._row(s, p, o))

    def add_quad(self, s: str, p: str, o: str, g: str | None) -> Dataset:
        return self.add_quads(self._row(s, p, o, g))

    def delete_triple(self, s: str, p: str, o: str) -> Dataset:
        return self.delete_quads(self._row(s, p, o))

    def delete_quad(self, s: str, p: str, o: str, g: str | None) -> Dataset:
        return self.delete_quads(self._row(s, p, o, g))

    def add_tagged_triple(self, s: str, p: str, o: str, prob: float) -> Dataset:
        row = self.spark.createDataFrame([(s, p, o, float(prob))], "s string, p string, o string, prob double")
        return replace(self.add_triple(s, p, o), seeds=row if self.seeds is None else self.seeds.unionByName(row))

    def create_graph(self, g: str) -> Dataset:
        return self._changed(graphs=self.graphs.unionByName(self.spark.createDataFrame([(g,)], "g string")).distinct())

    def clear_graph(self, g: str | None) -> Dataset:
        """Empties a graph; a named one stays in the catalogue."""
        keep = F.col("g").isNotNull() if g is None else F.coalesce(F.col("g") != g, F.lit(True))
        return self._changed(quads=self.quads.where(keep))

    def drop_graph(self, g: str) -> Dataset:
        cleared = self.clear_graph(g)
        return replace(cleared, graphs=cleared.graphs.where(F.col("g") != g))

    def clear(self) -> Dataset:
        return replace(Dataset.empty(self.spark), tables=self.tables, udfs=self.udfs, prefixes=self.prefixes)

    def union(self, other: Dataset) -> Dataset:
        seeds = [d for d in (self.seeds, other.seeds) if d is not None]
        out = self._changed(quads=self.quads.unionByName(other.quads).distinct(), graphs=self.graphs.unionByName(other.graphs).distinct())
        tables = self.tables if other.tables is None else other.tables if self.tables is None else self.tables.merge(other.tables)
        return replace(out, seeds=seeds[0].unionByName(seeds[1]) if len(seeds) == 2 else seeds[0] if seeds else None, tables=tables, udfs=self.udfs | other.udfs, prefixes=self.prefixes | other.prefixes)

    def register_udf(self, name: str, function) -> Dataset:
        """A Column -> Column function, or a Python function of strings, by name, for BIND."""
        return replace(self, udfs=self.udfs | {name: function})

    # -- look-ups -----------------------------------------------------------------
    def all_quads(self, subject: str | None = None) -> DataFrame:
        """Stored quads and, where tables are mapped, the triples of their rows; only tables that may hold the subject, if one is given."""
        rows = None if self.tables is None else self.tables.as_quads(subject)
        return self.quads if rows is None else self.quads.unionByName(rows)

    def query_quads(self, s=None, p=None, o=None, g=..., **_) -> DataFrame:
        df = self.all_quads(s)
        for c, v in (("s", s), ("p", p), ("o", o)):
            df = df if v is None else df.where(F.col(c) == v)
        return df if g is ... else df.where(F.col("g").isNull() if g is None else F.col("g") == g)

    def query_default(self, s=None, p=None, o=None) -> DataFrame:
        return self.query_quads(s, p, o, g=None).select("s", "p", "o")

    def query_graph(self, g: str, s=None, p=None, o=None) -> DataFrame:
        return self.query_quads(s, p, o, g=g).select("s", "p", "o")

    def query_named_graphs(self, s=None, p=None, o=None) -> DataFrame:
        return self.query_quads(s, p, o).where("g is not null")

    def query_merged_graphs(self, graphs: list[str | None], s=None, p=None, o=None) -> DataFrame:
        """The union of several graphs: a triple that several of them hold comes once."""
        named = [g for g in graphs if g is not None]
        keep = F.coalesce(F.col("g").isin(named), F.lit(False)) | (F.col("g").isNull() if None in graphs else F.lit(False))
        return self.query_quads(s, p, o).where(keep).select("s", "p", "o").distinct()

    def contains_quad(self, s: str, p: str, o: str, g: str | None = None) -> bool:
        return not self.query_quads(s, p, o, g=g).isEmpty()

    def graphs_for_triple(self, s: str, p: str, o: str) -> DataFrame:
        return self.query_quads(s, p, o).select("g").distinct()

    def graph_exists(self, g: str) -> bool:
        return not self.graphs.where(F.col("g") == g).isEmpty()

    def len_default(self) -> int:
        return self.query_quads(g=None).count()

    def len_graph(self, g: str) -> int:
        return self.query_quads(g=g).count()

    def named_graphs(self) -> DataFrame:
        return self.graphs

    def stats(self) -> DataFrame:
        """One row per predicate: quads, distinct subjects and objects (HyperLogLog)."""
        return self.all_quads().groupBy("p").agg(F.count(F.lit(1)).alias("quads"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))

    # -- queries ------------------------------------------------------------------
    def query(self, text: str, typed: bool = False, **options) -> DataFrame:
        from .plans.compile import select

        return select(self, text, typed=typed, **options)

    def update(self, text: str, **options):
        from .operators.update import update

        return update(self, text, **options)

    def explain(self, text: str, mode: str = "formatted") -> str:
        from .plans.compile import explain

        return explain(self, text, mode)

    def builder(self):
        from .operators.builder import TripleQuery

        return TripleQuery(self)

    def annotated(self, tags: DataFrame, predicate: str = "http://www.w3.org/ns/prob#value") -> DataFrame:
        """Quads `<< s p o >> predicate "tag"^^double` for a DataFrame s, p, o, tag."""
        from .terms import quote_triple

        value = F.concat(F.lit('"'), F.col("tag").cast("string"), F.lit(f'"^^<{XSD}double>'))
        return tags.select(F.lit(None).cast("string").alias("g"), quote_triple(F.col("s"), F.col("p"), F.col("o")).alias("s"), F.lit(predicate).alias("p"), value.alias("o"))
