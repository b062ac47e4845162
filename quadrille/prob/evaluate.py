"""Probabilities of derived facts: numbers per semiring, or lineage first and then an exact or bounded count per fact."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .semirings import LINEAGE, named, weighted
from .wmc import HybridOptions, best_proofs, evaluate, probability



def _prepared(facts: DataFrame) -> DataFrame:
    cols = facts.columns
    return facts.select("s", "p", "o", (F.col("prob") if "prob" in cols else F.lit(1.0)).cast("double").alias("prob"), (F.col("grp") if "grp" in cols else F.lit(None)).cast("long").alias("grp"), *([F.col("seed").cast("long").alias("seed")] if "seed" in cols else []))


def _numbered(facts: DataFrame) -> tuple[DataFrame, bool]:
    """seeds_of for facts without numbers of their own, and whether each comes once.  Facts of one probability are numbered by a plain aggregate."""
    keys = ["s", "p", "o"]
    what = _prepared(facts)
    n = F.count(F.lit(1))
    same = (F.count("prob") == n) & (F.min("prob") == F.max("prob")) & ((F.count("grp") == 0) | (F.count("grp") == n) & (F.min("grp") == F.max("grp")))
    number = F.monotonically_increasing_id() * 2
    all_ = materialize(what.groupBy(*keys).agg(F.max("prob").alias("prob"), F.max("grp").alias("grp"), same.alias("same")).withColumn("seed", number + 1), "seeds")
    one, several = all_.where("same").drop("same"), all_.where("not coalesce(same, false)").select(*[F.col(c).alias(f"__{c}") for c in keys])
    if several.isEmpty():
        return one, True
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return one.unionByName(materialize(what.distinct().join(several, on, "left_semi").withColumn("seed", number + 2), "seeds")), False


def seeds_of(facts: DataFrame) -> DataFrame:
    """s, p, o, prob, grp, seed: a number for each uncertain fact (prob < 1 or a group)."""
    return _prepared(facts) if "seed" in facts.columns else _numbered(facts)[0]


def lineage(facts: DataFrame, rules: list) -> DataFrame:
    """s, p, o, tag (proofs) and seeds (number, probability and group of each seed of the proofs)."""
    from ..reason.fixpoint import tagged_fixpoint

    certain = (F.col("prob") >= 1) & F.col("grp").isNull()
    df, unique = (_prepared(facts), False) if "seed" in facts.columns else _numbered(facts)
    what = ["seed", "prob", *(["grp"] if "grp" in facts.columns else [])]
    kind = "array<struct<" + ",".join(f"{c}:{'double' if c == 'prob' else 'bigint'}" for c in what) + ">>"
    proofs = F.when(certain, F.array(F.array().cast("array<bigint>"))).otherwise(F.array(F.array(F.col("seed"))))
    seeds = F.when(certain, F.array().cast(kind)).otherwise(F.array(F.struct(*what)))
    tagged = tagged_fixpoint(df.select("s", "p", "o", F.struct(proofs.alias("d"), seeds.alias("w")).alias("tag")), rules, weighted(kind), unique=unique)
    return tagged.select("s", "p", "o", F.col("tag.d").alias("tag"), F.col("tag.w").alias("seeds"))


def _flat(df: DataFrame) -> list:
    """Columns of tag and seeds as arrays of numbers, which workers read fastest."""
    grp = F.transform("seeds", lambda x: F.coalesce(x["grp"], F.lit(NO_GROUP))) if "grp" in df.schema["seeds"].dataType.elementType.names else F.array().cast("array<bigint>")
    return [F.flatten("tag"), F.transform("tag", F.size), F.transform("seeds", lambda x: x["seed"]), F.transform("seeds", lambda x: x["prob"]), grp]


NO_GROUP = -(2**63)


def _lineages(flat, sizes, ids, probs, grps):
    """Per fact its proofs, and probabilities and groups by seed."""
    for f, n, i, p, g in zip(flat, sizes, ids, probs, grps):
        f, i = f.tolist(), i.tolist()
        d, at = [], 0
        for k in n.tolist():
            d.append(f[at : at + k])
            at += k
        yield d, dict(zip(i, p.tolist())), {x: y for x, y in zip(i, g.tolist()) if y != NO_GROUP}


def _weigh(k: int | None):
    @F.pandas_udf(T.DoubleType())
    def run(flat: pd.Series, sizes: pd.Series, ids: pd.Series, probs: pd.Series, grps: pd.Series) -> pd.Series:
        out = [probability(best_proofs(d, prob, k) if k else d, prob, group) for d, prob, group in _lineages(flat, sizes, ids, probs, grps)]
        return pd.Series(out, dtype="float64")

    return run


def _hybrid(o: HybridOptions):
    schema = T.StructType([T.StructField("status", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("estimate", T.DoubleType()), T.StructField("k", T.IntegerType()), T.StructField("exact", T.BooleanType())])

    @F.pandas_udf(schema)
    def run(flat: pd.Series, sizes: pd.Series, ids: pd.Series, probs: pd.Series, grps: pd.Series) -> pd.DataFrame:
        out = [evaluate(d, prob, group, o) for d, prob, group in _lineages(flat, sizes, ids, probs, grps)]
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return run


def recursive(rules: list) -> bool:
    """Whether a predicate depends on itself."""
    edges: dict = {}
    for r in rules:
        for h in r.predicates(r.conclusion):
            edges.setdefault(h, set()).update(r.predicates(r.premise) | r.predicates(r.negative))

    def reach(x, goal, path):
        return any(y == goal or y is None or (y not in path and reach(y, goal, path | {y})) for y in edges.get(x, ()))

    return any(h is None or reach(h, h, {h}) for h in edges)


def probabilities(facts: DataFrame, rules: list, semiring: str = "minmax", k: int = 5, options: dict | None = None) -> DataFrame:
    """s, p, o, tag for all facts; lineage kinds also keep proofs, hybrid gives its bounds and decision."""
    from ..reason.fixpoint import tagged_fixpoint

    name = named(semiring)
    prob = F.col("prob").cast("double") if "prob" in facts.columns else F.lit(1.0)
    if name not in LINEAGE:
        tag = {"boolean": prob > 0, "expiration": prob.cast("long")}.get(name, prob)
        return tagged_fixpoint(facts.select("s", "p", "o", tag.alias("tag")), rules, name)
    if name == "hybrid" and recursive(rules):
        raise ValueError("hybrid evaluation takes no recursive rules")
    if not 1 <= k <= 63:
        raise ValueError("k is between 1 and 63")
    both = lineage(facts, rules)
    if name == "hybrid":
        o = HybridOptions.of(options or {})
        return both.select("s", "p", "o", F.col("tag").alias("proofs"), _hybrid(o)(*_flat(both)).alias("r")).select("s", "p", "o", "proofs", F.col("r.estimate").alias("tag"), "r.*")
    return both.select("s", "p", "o", F.col("tag").alias("proofs"), _weigh(k if name == "topk" else None)(*_flat(both)).alias("tag"))


PROB = "http://www.w3.org/ns/prob#"
XSD_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"


def annotations(tagged: DataFrame) -> DataFrame:
    """Quads about quoted triples: value, and what else the evaluation says (proofs, bounds, decision)."""
    from ..terms import quote_triple

    subject = quote_triple(F.col("s"), F.col("p"), F.col("o"))
    typed = lambda c, t: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{t}>'))
    pairs = [(f"{PROB}value", typed(F.col("tag"), "double"))]
    cols = tagged.columns
    if "proofs" in cols:
        pairs.append((f"{PROB}proofCount", typed(F.size("proofs"), "integer")))
        pairs.append((f"{PROB}formula", F.array_join(F.transform("proofs", lambda c: F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: x.cast("string")), " & "), F.lit(")"))), " | ")))
    for c, n in (("status", "status"), ("decision", "decision"), ("reason", "reason")):
        if c in cols:
            pairs.append((f"{PROB}{n}", F.col(c)))
    for c, n, t in (("lower", "lowerBound", "double"), ("upper", "upperBound", "double"), ("estimate", "estimate", "double"), ("k", "kUsed", "integer"), ("exact", "exactUsed", "boolean")):
        if c in cols:
            pairs.append((f"{PROB}{n}", typed(F.col(c), t)))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), v.alias("o")) for p, v in pairs])
    out = tagged.select(subject.alias("s"), F.explode(rows).alias("x")).select(F.lit(None).cast("string").alias("g"), "s", "x.p", "x.o").where("o is not null")
    if "proofs" in cols:
        proofs = tagged.select(subject.alias("s"), F.posexplode("proofs").alias("i", "c"))
        node = F.concat(F.lit("_:proof-"), F.md5("s"), F.lit("-"), F.col("i").cast("string"))
        has = proofs.select(F.lit(None).cast("string").alias("g"), "s", F.lit(f"{PROB}hasProof").alias("p"), node.alias("o"))
        seeds = proofs.select(node.alias("n"), F.explode("c").alias("x"))
        kind = F.when(F.col("x") > 0, F.lit(f"{PROB}hasSeed")).otherwise(F.lit(f"{PROB}hasNegatedSeed"))
        out = out.unionByName(has).unionByName(seeds.select(F.lit(None).cast("string").alias("g"), F.col("n").alias("s"), kind.alias("p"), F.abs("x").cast("string").alias("o")))
    return out


__all__ = ["probabilities", "annotations", "lineage", "seeds_of", "recursive", "PROB"]
