"""Forward chaining as loops of joins: semi-naive, stratified negation, and tags of a semiring.

Each round joins the last round's facts with all others, so a derivation is made once: premises
before the one that takes the new facts see only older ones.  New facts are written to the shared
folder at the end of a round, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import condition
from ..operators.solutions import Rel, join
from ..plans import ast as A
from ..plans.compile import match
from ..prob.semirings import SEMIRINGS, Semiring
from ..storage import materialize
from .rules import Rule

MAX_ROUNDS = 10_000
BY = "__by"


def _scan(t: A.Triple, facts: DataFrame, by: str | None, tag: str | None = None) -> Rel:
    cols = [(t.s, F.col("s")), (t.p, F.col("p")), (t.o, F.col("o"))]
    if by:
        cols.insert(0, (A.Var(BY), F.col(by)))
    if tag is None:
        return match(facts, cols)
    rel = match(facts, [*cols, (A.Var(tag), F.col("tag"))])
    return Rel(rel.df, {k: v for k, v in rel.kinds.items()})


def _order(premise: tuple, first: int) -> list[int]:
    """The premise with the new facts, then always one that shares a variable."""
    out, rest = [first], [i for i in range(len(premise)) if i != first]
    bound = A.variables(premise[first])
    while rest:
        i = next((i for i in rest if A.variables(premise[i]) & bound), rest[0])
        rest.remove(i)
        out.append(i)
        bound |= A.variables(premise[i])
    return out


def bodies(rule: Rule, sources: list[DataFrame], first: int, by: str | None, tagged: bool = False) -> Rel:
    """Bindings of the premise; source i gives premise i its facts."""
    rel = None
    for i in _order(rule.premise, first):
        one = _scan(rule.premise[i], sources[i], by, f"__tag{i}" if tagged else None)
        rel = one if rel is None else join(rel, one)
    for f in rule.filters:
        rel = rel.where(condition(f, rel))
    return rel


def heads(rule: Rule, rel: Rel, by: str | None, extra: list | None = None) -> DataFrame:
    one = lambda x: F.col(f"`{x.name}`") if isinstance(x, A.Var) else F.lit(x.value)
    if any(isinstance(x, A.Quoted) for t in rule.conclusion for x in (t.s, t.p, t.o)):
        from ..functions.expressions import argument

        one = lambda x: argument(x, rel)
    rows = F.array(*[F.struct(one(t.s).alias("s"), one(t.p).alias("p"), one(t.o).alias("o")) for t in rule.conclusion])
    keep = ([F.col(BY).alias(by)] if by else []) + (extra or [])
    df = rel.df.select(*keep, F.explode(rows).alias("x"))
    names = [c for c in df.columns if c != "x"]
    return df.select(*names, "x.s", "x.p", "x.o")


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in layers: a layer's negated predicates are complete before it runs."""
    heads_of = [r.predicates(r.conclusion) for r in rules]
    meets = lambda a, b: None in a or None in b or bool(a & b)
    level = [0] * len(rules)
    for _ in range(len(rules) + 1):
        changed = False
        for i, r in enumerate(rules):
            for j in range(len(rules)):
                need = max(level[j] if r.premise and meets(r.predicates(r.premise), heads_of[j]) else 0, level[j] + 1 if r.negative and meets(r.predicates(r.negative), heads_of[j]) else 0)
                if need > level[i]:
                    level[i], changed = need, True
        if not changed:
            return [[r for r, k in zip(rules, level) if k == n] for n in sorted(set(level))]
    raise ValueError("rules negate what they derive: there is no order to run them in")


def _without(rel: Rel, rule: Rule, facts: DataFrame, by: str | None) -> Rel:
    for t in rule.negative:
        other = _scan(t, facts, by)
        shared = list(other.kinds)
        if shared:
            rel = Rel(rel.df.join(other.df.distinct(), shared, "left_anti"), rel.kinds, rel.maybe)
        elif not facts.where((F.col("s") == t.s.value) & (F.col("p") == t.p.value) & (F.col("o") == t.o.value)).isEmpty():
            rel = Rel(rel.df.limit(0), rel.kinds, rel.maybe)
    return rel


def fixpoint(facts: DataFrame, rules: list[Rule], by: str | None = None, max_rounds: int = MAX_ROUNDS, reject=None) -> DataFrame:
    """All facts, given and derived: (by,) s, p, o.  `reject(new, all)` may take facts out of a round."""
    keys = ([by] if by else []) + ["s", "p", "o"]
    everything = facts.select(*keys).distinct()
    for layer in strata(list(rules)):
        everything = materialize(everything, "facts")
        old, delta, parts = everything.limit(0), everything, 0
        for _ in range(max_rounds):
            new = []
            for r in layer:
                for i in range(len(r.premise)):
                    sources = [old if j < i else delta if j == i else everything for j in range(len(r.premise))]
                    rel = bodies(r, sources, i, by)
                    new.append(heads(r, _without(rel, r, everything, by) if r.negative else rel, by))
            if not new:
                break
            fresh = reduce(DataFrame.unionByName, new).select(*keys).distinct().join(everything, keys, "left_anti")
            if reject is not None:
                fresh = reject(fresh, everything)
            fresh = materialize(fresh, "derived")
            if fresh.isEmpty():
                break
            old, delta = everything, fresh
            everything = everything.unionByName(fresh)
            parts += 1
            if parts % 8 == 0:
                everything = materialize(everything, "facts")
        else:
            if max_rounds == MAX_ROUNDS:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return everything


def derive(facts: DataFrame, rules: list[Rule], by: str | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Only what is new, with the columns of facts."""
    if by == "g":
        return fixpoint(facts, rules, "g", max_rounds).join(facts.select("g", "s", "p", "o"), ["g", "s", "p", "o"], "left_anti").select("g", "s", "p", "o")
    base = facts.where("g is null") if "g" in facts.columns else facts
    new = fixpoint(base, rules, None, max_rounds).join(base.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")


def _tags(rule: Rule, ring: Semiring, rel: Rel):
    return ring.times([F.col(f"__tag{i}") for i in range(len(rule.premise))])


def _negated(rule: Rule, rel: Rel, facts: DataFrame, ring: Semiring):
    """Bindings with a tag for each NOT: the negation of the fact's tag, or one where there is no fact."""
    cols = []
    for k, t in enumerate(rule.negative):
        other = _scan(t, facts, None, f"__not{k}")
        shared = [v for v in other.kinds if v != f"__not{k}"]
        df = rel.df.join(other.df, shared, "left") if shared else rel.df.crossJoin(other.df.unionByName(other.df.sparkSession.createDataFrame([], other.df.schema)))
        rel = Rel(df, rel.kinds | {f"__not{k}": "tag"}, rel.maybe)
        cols.append(F.when(F.col(f"__not{k}").isNull(), ring.one()).otherwise(ring.negate(F.col(f"__not{k}"))))
    return rel, cols


def tagged_fixpoint(facts: DataFrame, rules: list[Rule], semiring: str | Semiring, delta: DataFrame | None = None, max_rounds: int = 1000, unique: bool = False) -> DataFrame:
    """s, p, o, tag for all facts.  A fact whose tag changes is worked through again.

    Rules with NOT come after the fixpoint of the others, in one pass.  Where no predicate depends
    on itself, each rule runs once, after those that it reads from.  ``unique`` says that facts hold
    each s, p, o once and are a table already.  Otherwise, for a semiring whose plus is
    not idempotent, tags are computed anew each round from all derivations, until they stay.
    """
    ring = SEMIRINGS[semiring] if isinstance(semiring, str) else semiring
    keys = ["s", "p", "o"]
    positive, negative = [r for r in rules if not r.negative], [r for r in rules if r.negative]
    base = facts.select(*keys, "tag")
    base = base if unique else base.groupBy(*keys).agg(ring.plus("tag").alias("tag"))
    layers = levels(positive) if delta is None else None
    if layers is not None:
        everything = _by_levels(base if unique else materialize(base, "tagged"), layers, ring)
    elif not ring.idempotent:
        everything = _anew(base, positive, ring, max_rounds)
    else:
        if delta is not None:
            base = base.unionByName(delta.select(*keys, "tag")).groupBy(*keys).agg(ring.plus("tag").alias("tag"))
        everything = materialize(base, "tagged")
        changed = everything if delta is None else materialize(delta.select(*keys, "tag"), "changed")
        for _ in range(max_rounds):
            new = []
            for r in positive:
                for i in range(len(r.premise)):
                    rel = bodies(r, [changed if j == i else everything for j in range(len(r.premise))], i, None, True)
                    new.append(heads(r, rel, None, [_tags(r, ring, rel).alias("tag")]))
            if not new:
                break
            made = reduce(DataFrame.unionByName, new).where(ring.nonzero(F.col("tag"))).groupBy(*keys).agg(ring.plus("tag").alias("tag"))
            had = everything.withColumnRenamed("tag", "had")
            both = made.join(had, keys, "left").withColumn("now", F.when(F.col("had").isNull(), F.col("tag")).otherwise(ring.plus2(F.col("had"), F.col("tag"))))
            changed = materialize(both.where(F.col("had").isNull() | ring.differs(F.col("had"), F.col("now"))).select(*keys, F.col("now").alias("tag")), "changed")
            if changed.isEmpty():
                break
            everything = materialize(everything.join(changed.select(*keys), keys, "left_anti").unionByName(changed), "tagged")
        else:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    if negative:
        new = []
        for r in negative:
            rel = bodies(r, [everything] * len(r.premise), 0, None, True)
            rel, nots = _negated(r, rel, everything, ring)
            new.append(heads(r, rel, None, [ring.times([*[F.col(f"__tag{i}") for i in range(len(r.premise))], *nots]).alias("tag")]))
        made = reduce(DataFrame.unionByName, new).where(ring.nonzero(F.col("tag")))
        everything = everything.unionByName(made).groupBy(*keys).agg(ring.plus("tag").alias("tag"))
    return everything.where(ring.nonzero(F.col("tag")))


def levels(rules: list[Rule]) -> list[list[Rule]] | None:
    """Rules in an order in which each one's premises are complete before it runs, or None if there is none."""
    if any(None in r.predicates(r.conclusion) for r in rules):
        return None
    heads_of = [r.predicates(r.conclusion) for r in rules]
    reads = [{j for j, h in enumerate(heads_of) if None in r.predicates(r.premise) or r.predicates(r.premise) & h} for r in rules]
    out: list[list[Rule]] = []
    done: set[int] = set()
    while len(done) < len(rules):
        ready = [i for i in range(len(rules)) if i not in done and reads[i] <= done]
        if not ready:
            return None
        out.append([rules[i] for i in ready])
        done |= set(ready)
    return out


def _by_levels(base: DataFrame, layers: list[list[Rule]], ring: Semiring) -> DataFrame:
    """Each rule once.  Only facts of a level's own predicates are merged with what it makes."""
    keys = ["s", "p", "o"]
    everything = base
    for layer in layers:
        own = F.col("p").isin(*sorted(set().union(*[r.predicates(r.conclusion) for r in layer])))
        new = [everything.where(own)]
        for r in layer:
            if not r.premise:
                continue
            rel = bodies(r, [everything] * len(r.premise), 0, None, True)
            new.append(heads(r, rel, None, [_tags(r, ring, rel).alias("tag")]))
        made = reduce(DataFrame.unionByName, new).where(ring.nonzero(F.col("tag"))).groupBy(*keys).agg(ring.plus("tag").alias("tag"))
        everything = everything.where(~own | F.col("p").isNull()).unionByName(materialize(made, "tagged"))
    return everything


def _anew(base: DataFrame, rules: list[Rule], ring: Semiring, max_rounds: int) -> DataFrame:
    keys = ["s", "p", "o"]
    everything = materialize(base, "tagged")
    for _ in range(max_rounds):
        new = [base]
        for r in rules:
            rel = bodies(r, [everything] * len(r.premise), 0, None, True)
            new.append(heads(r, rel, None, [_tags(r, ring, rel).alias("tag")]))
        made = reduce(DataFrame.unionByName, new).where(ring.nonzero(F.col("tag"))).groupBy(*keys).agg(ring.plus("tag").alias("tag"))
        made = materialize(made, "tagged")
        had = everything.withColumnRenamed("tag", "had")
        moved = made.join(had, keys, "full").where(F.col("had").isNull() | F.col("tag").isNull() | ring.differs(F.col("had"), F.col("tag")))
        everything = made
        if moved.isEmpty():
            return everything
    raise RuntimeError(f"tags still move after {max_rounds} rounds")
