"""The reasoner's face: facts, rules, forward and backward chaining, constraints and repairs, levels, and a picture."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.solutions import Rel
from ..plans import ast as A
from ..plans.compile import match
from .fixpoint import bodies, fixpoint
from .rules import Rule, triple

DEPTH = 10
#: Repairs are listed on the driver: conflicts beyond this are refused, not cut.
MAX_CONFLICTS = 10_000
CERTAINTY = {"base": 1.0, "deductive": 0.9, "abductive": 0.6, "meta": 0.4}


@dataclass(frozen=True)
class Reasoner:
    spark: SparkSession
    facts: DataFrame
    rules: tuple[Rule, ...] = ()
    constraints: tuple[Rule, ...] = ()
    seeds: dict = field(default_factory=dict)

    @staticmethod
    def of(spark: SparkSession, facts, rules=(), constraints=()) -> Reasoner:
        """facts: a DataFrame s, p, o or tuples (s, p, o) or (s, p, o, probability)."""
        if not isinstance(facts, DataFrame):
            rows = [tuple(f) for f in facts]
            tagged = any(len(r) > 3 for r in rows)
            facts = spark.createDataFrame([(*r[:3], float(r[3]) if len(r) > 3 else 1.0) if tagged else r for r in rows], "s string, p string, o string" + (", prob double" if tagged else ""))
        return Reasoner(spark, facts, tuple(rules), tuple(constraints))

    def add_abox_triple(self, s: str, p: str, o: str) -> Reasoner:
        row = self.spark.createDataFrame([(s, p, o)], "s string, p string, o string")
        return replace(self, facts=self.facts.select("s", "p", "o").unionByName(row).distinct())

    insert_ground_triple = add_abox_triple

    def add_rule(self, r: Rule) -> Reasoner:
        return replace(self, rules=(*self.rules, r.check()))

    def try_add_rule(self, r: Rule) -> tuple[Reasoner, str | None]:
        try:
            return self.add_rule(r), None
        except ValueError as e:
            return self, str(e)

    def add_constraint(self, r: Rule) -> Reasoner:
        return replace(self, constraints=(*self.constraints, r))

    def query_abox(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        df = self.facts.select("s", "p", "o")
        for c, v in (("s", s), ("p", p), ("o", o)):
            df = df if v is None else df.where(F.col(c) == v)
        return df

    # -- forward
    def infer(self, max_rounds: int | None = None) -> DataFrame:
        """The new facts."""
        base = self.facts.select("s", "p", "o")
        everything = fixpoint(base, list(self.rules), **({"max_rounds": max_rounds} if max_rounds else {}))
        return everything.join(base.distinct(), ["s", "p", "o"], "left_anti")

    infer_new_facts = infer_new_facts_naive = infer_new_facts_semi_naive = infer_new_facts_semi_naive_parallel = infer

    def closure(self) -> DataFrame:
        return fixpoint(self.facts.select("s", "p", "o"), list(self.rules))

    def infer_with_provenance(self, semiring: str = "minmax", **options) -> DataFrame:
        """s, p, o and the semiring's tag for every fact, from a probability column `prob` (default 1)."""
        from ..prob.evaluate import probabilities

        return probabilities(self.facts, list(self.rules), semiring, **options)

    # -- backward
    def backward_chaining(self, pattern: A.Triple | tuple, depth: int = DEPTH) -> DataFrame:
        """Bindings of the pattern's variables.  Only rules that can reach the goal run, for `depth` rounds at most."""
        goal = triple(*pattern) if isinstance(pattern, tuple) else pattern
        wanted = {goal.p.value if isinstance(goal.p, A.Const) else None}
        chosen: list[Rule] = []
        while True:
            more = [r for r in self.rules if r not in chosen and (None in wanted or None in r.predicates(r.conclusion) or r.predicates(r.conclusion) & wanted)]
            if not more:
                break
            chosen += more
            for r in more:
                wanted |= r.predicates(r.premise) | r.predicates(r.negative)
        base = self.facts.select("s", "p", "o")
        base = base if None in wanted else base.where(F.col("p").isin(*wanted))
        known = fixpoint(base, chosen, max_rounds=depth) if chosen else base.distinct()
        return match(known, [(goal.s, F.col("s")), (goal.p, F.col("p")), (goal.o, F.col("o"))]).df.distinct()

    # -- constraints
    def conflicts(self, facts: DataFrame | None = None) -> DataFrame:
        """facts: one array of s|p|o structs per violation, minimal ones only."""
        facts = self.facts.select("s", "p", "o") if facts is None else facts
        out = []
        for c in self.constraints:
            rel: Rel = bodies(c, [facts] * len(c.premise), 0, None)
            one = lambda x: F.col(f"`{x.name}`") if isinstance(x, A.Var) else F.lit(x.value)
            out.append(rel.df.select(F.array_sort(F.array_distinct(F.array(*[F.struct(one(t.s).alias("s"), one(t.p).alias("p"), one(t.o).alias("o")) for t in c.premise]))).alias("facts")))
        if not out:
            return self.spark.createDataFrame([], "facts array<struct<s:string,p:string,o:string>>")
        found = reduce(DataFrame.unionByName, out).distinct()
        # a conflict that holds a smaller one is none of its own
        a, b = found.alias("a"), found.select(F.col("facts").alias("other")).alias("b")
        larger = a.select("facts", F.explode("facts").alias("x")).join(b.select("other", F.explode("other").alias("x")), "x").where(F.size("other") < F.size("facts"))
        larger = larger.groupBy("facts", "other").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("other")).select("facts").distinct()
        return found.join(larger, "facts", "left_anti")

    def violates(self) -> bool:
        return not self.conflicts().isEmpty()

    def repairs(self) -> list[DataFrame]:
        """All maximal consistent subsets: facts without a minimal hitting set of the conflicts."""
        base = self.facts.select("s", "p", "o").distinct()
        return [base if not h else base.join(self.spark.createDataFrame(sorted(h), "s string, p string, o string"), ["s", "p", "o"], "left_anti") for h in self._hitting_sets()]

    compute_repairs = repairs

    def _hitting_sets(self) -> list[frozenset]:
        rows = self.conflicts().limit(MAX_CONFLICTS + 1).collect()
        if len(rows) > MAX_CONFLICTS:
            raise ValueError(f"more than {MAX_CONFLICTS} conflicts: list no repairs, use query_with_repairs")
        sets = [frozenset()]
        for r in rows:
            edge = frozenset(tuple(x) for x in r["facts"])
            grown = {h for h in sets if h & edge} | {h | {x} for h in sets if not h & edge for x in edge}
            sets = [h for h in grown if not any(g < h for g in grown)]
        return sorted(sets, key=lambda h: (len(h), sorted(h)))

    def query_with_repairs(self, pattern) -> DataFrame:
        """Answers that hold in every repair: facts in no minimal conflict; nothing is collected."""
        goal = triple(*pattern) if isinstance(pattern, tuple) else pattern
        bad = self.conflicts().select(F.explode("facts").alias("x")).select("x.s", "x.p", "x.o").distinct()
        safe = self.facts.select("s", "p", "o").distinct().join(bad, ["s", "p", "o"], "left_anti")
        return match(safe, [(goal.s, F.col("s")), (goal.p, F.col("p")), (goal.o, F.col("o"))]).df.distinct()

    def infer_with_repairs(self) -> DataFrame:
        """New facts from the largest repair; a derived fact that would make a conflict is left out."""
        start = self.repairs()[0]

        def reject(new: DataFrame, everything: DataFrame) -> DataFrame:
            bad = self.conflicts(everything.unionByName(new)).select(F.explode("facts").alias("x")).select("x.s", "x.p", "x.o").distinct()
            return new.join(bad, ["s", "p", "o"], "left_anti")

        everything = fixpoint(start, list(self.rules), reject=reject)
        return everything.join(start, ["s", "p", "o"], "left_anti")

    infer_new_facts_semi_naive_with_repairs = infer_with_repairs

    # -- a picture
    def to_dot(self, limit: int = 1000) -> str:
        """Graphviz text of the facts, up to `limit` edges (the picture is for looking at)."""
        esc = lambda x: x.replace("\\", "\\\\").replace('"', '\\"')
        rows = self.facts.select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(limit).collect()
        return "digraph facts {\n" + "".join(f'  "{esc(r.s)}" -> "{esc(r.o)}" [label="{esc(r.p)}"];\n' for r in rows) + "}\n"


@dataclass(frozen=True)
class Hierarchy:
    """Levels of reasoning: each has its rules; cross rules lift facts of one level to another."""

    base: DataFrame
    rules: dict[str, tuple[Rule, ...]]
    cross: tuple[tuple[str, str, Rule], ...] = ()

    def infer(self) -> DataFrame:
        """s, p, o, level, certainty: each fact at the first level that has it."""
        known = self.base.select("s", "p", "o").distinct()
        out = known.withColumn("level", F.lit("base"))
        for level in ("base", "deductive", "abductive", "meta"):
            own = list(self.rules.get(level, ())) + [r for _, to, r in self.cross if to == level]
            if not own:
                continue
            everything = fixpoint(known, own)
            new = everything.join(known, ["s", "p", "o"], "left_anti")
            out = out.unionByName(new.withColumn("level", F.lit(level)))
            known = everything
        certainty = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in CERTAINTY.items()])
        return out.withColumn("certainty", certainty)


__all__ = ["Reasoner", "Hierarchy"]
