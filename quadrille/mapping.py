"""Relational tables seen as triples, without copying them.

A row is a subject ``urn:<table>:<key>``, a column a predicate ``urn:<table>#<column>``, a foreign
key an object ``urn:<table>:<key>``; null cells have no triple.  A table without a key gets a
surrogate per row: a digest of all its columns and a number among identical rows, computed only
by queries that use the subject itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .terms import RDF_TYPE, format_number

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
LINKS = {
    ("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation", ("supplier", "s_nationkey"): "nation", ("orders", "o_custkey"): "customer",
    ("lineitem", "l_orderkey"): "orders", ("lineitem", "l_partkey"): "part", ("lineitem", "l_suppkey"): "supplier", ("labels", "doc_id"): "documents",
}


def lexical(c: Column, kind: str) -> Column:
    """The term of a value of a native kind; ``ref:<table>`` is a key of that table."""
    if kind.startswith("ref:"):
        return F.concat(F.lit(f"urn:{kind[4:]}:"), c.cast("string"))
    if kind == "string":
        return c
    if kind in ("double", "float"):
        return format_number(c.cast("double"))
    return c.cast("string")


class TableMapping:
    def __init__(self, tables: dict[str, DataFrame], keys: dict | None = None, links: dict | None = None):
        self.tables = dict(tables)
        self.keys = {**KEYS, **(keys or {})}
        self.links = {**LINKS, **(links or {})}
        self.types = {t: {f.name: f.dataType.simpleString() for f in df.schema.fields} for t, df in self.tables.items()}

    def merge(self, other: TableMapping) -> TableMapping:
        return TableMapping(self.tables | other.tables, self.keys | other.keys, self.links | other.links)

    def find(self, predicate: str) -> tuple[str, str] | None:
        """(table, column) of a predicate."""
        if predicate.startswith("urn:") and "#" in predicate:
            t, _, c = predicate[4:].partition("#")
            if t in self.types and c in self.types[t]:
                return t, c
        return None

    def kind(self, table: str, column: str) -> str:
        target = self.links.get((table, column))
        if target in self.types and len(self.keys.get(target, [])) == 1:
            return f"ref:{target}"
        return self.types[table][column]

    def scan(self, table: str) -> DataFrame:
        """The table with its subject's key as __s."""
        df = self.tables[table]
        key = [k for k in self.keys.get(table, []) if k in df.columns]
        if len(key) == 1:
            return df.withColumn("__s", F.col(key[0]))
        if key:
            return df.withColumn("__s", F.concat_ws("-", *[F.col(k).cast("string") for k in key]))
        simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        digest = F.md5(F.to_json(F.struct(*simple)))
        same = F.row_number().over(Window.partitionBy(*simple).orderBy(F.lit(0)))
        return df.withColumn("__s", F.concat_ws("-", digest, same.cast("string")))

    def subject_kind(self, table: str) -> str:
        return f"ref:{table}"

    def may_hold(self, table: str, subject: str) -> bool:
        """Whether a row of the table may be the subject, given as a whole term or as `urn:<table>:` for any row of a table."""
        own = f"urn:{table}:"
        return subject.startswith(own) or subject.endswith(":") and own.startswith(subject)

    def as_quads(self, within: str | None = None) -> DataFrame | None:
        """All triples of all tables: the fallback for patterns with a variable predicate.  Within a subject, as may_hold takes it, only its tables are read."""
        out = None
        for t in self.tables:
            if within is not None and not self.may_hold(t, within):
                continue
            df = self.scan(t)
            subject = lexical(F.col("__s"), f"ref:{t}")
            cells = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"urn:{t}").alias("o"))]
            cells += [F.struct(F.lit(f"urn:{t}#{c}").alias("p"), lexical(F.col(c), self.kind(t, c)).alias("o")) for c in self.types[t]]
            one = df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("x")).select(F.lit(None).cast("string").alias("g"), "s", "x.p", "x.o").where("o is not null")
            out = one if out is None else out.unionByName(one)
        return out
