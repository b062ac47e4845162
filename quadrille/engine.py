"""The engine: one dataset that changes, its learned relations, rules, queries, and how they are explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset
from .ml import neural
from .plans import ast as A
from .plans.compile import Scope, finish, solve
from .plans.parser import parse


def predicates(x) -> set[str]:
    """Constant predicates in a group or a list of triples."""
    if isinstance(x, A.Triple):
        return {x.p.value} if isinstance(x.p, A.Const) else set()
    if isinstance(x, (list, tuple)):
        return set().union(set(), *[predicates(y) for y in x])
    if isinstance(x, (A.Triples, A.Window, A.Not)):
        return predicates(x.triples)
    if isinstance(x, A.Group):
        return predicates(x.elements)
    if isinstance(x, A.Graph):
        return predicates(x.group)
    if isinstance(x, A.Union):
        return predicates(x.branches)
    if isinstance(x, A.Select):
        return predicates(x.where)
    return set()


def run(ds: Dataset, request: A.Request, typed: bool = False, registry: neural.Registry | None = None) -> DataFrame:
    """A query text with declarations before it."""
    registry = registry or neural.Registry()
    registry.declare(request)
    for t in request.training:
        neural.train(ds, registry, t)
    if request.predict:
        ds, _ = neural.ml_predict(ds, registry, request.predict)
    if request.rules:
        for d in request.rules:
            ds, _ = define_rule(ds, d, registry)
    if request.select is None:
        return ds.quads
    ds = neural.materialise(ds, registry, predicates(request.select.where))
    return finish(solve(ds, request.select, Scope()), typed)


def define_rule(ds: Dataset, d: A.RuleDecl, registry: neural.Registry | None = None) -> tuple[Dataset, DataFrame]:
    """Runs a RULE at once: the dataset with what it derives, and the derived facts (with tags under PROB)."""
    from .prob.evaluate import annotations, probabilities
    from .reason.fixpoint import derive
    from .reason.rules import from_declaration
    from .storage import materialize

    registry = registry or neural.Registry()
    if d.predict:
        out = {t.p.value for t in d.head if isinstance(t.o, A.Var) and t.o.name == d.predict.output and isinstance(t.p, A.Const)}
        if len(out) != 1:
            raise ValueError("the output of ML.PREDICT has to be the object of one predicate of the rule's conclusion")
        ds, made = neural.ml_predict(ds, registry, d.predict, out.pop())
        return ds, made
    ds = neural.materialise(ds, registry, predicates(d.body))
    complex_body = any(isinstance(e, (A.Bind, A.Values, A.Select, A.Union, A.Graph)) for e in d.body.elements)
    base = ds.all_quads().where("g is null")
    if complex_body and not d.prob:
        # one pass of the body as a query, the conclusion as its template
        from .operators.update import instantiate
        from .plans.compile import group

        rel, _ = group(ds, d.body, Scope())
        new = materialize(instantiate(rel, A.Template([(None, t) for t in d.head])), "derived")
        return ds.add_quads(new), new.select("s", "p", "o")
    r = from_declaration(d)
    if d.windows:
        from .streaming.windows import contents, firings

        w = d.windows[0]
        slide = w.width if w.kind == "TUMBLING" else (w.step or 1) if w.kind == "SLIDING" else 1
        # the stored triples are replayed at times 1..n, in term order
        from pyspark.sql import Window

        timed = base.select("s", "p", "o", F.row_number().over(Window.orderBy("s", "p", "o")).cast("long").alias("ts"))
        fired = firings(timed, w.width, slide)
        held = contents(timed, fired, w.width, slide).select(F.col("fire_ts").cast("string").alias("g"), "s", "p", "o")
        new = materialize(derive(held, [r], by="g").select("s", "p", "o").distinct(), "derived")
        return ds.add_quads(new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")), new
    if d.prob is not None:
        facts = base.select("s", "p", "o").withColumn("prob", F.lit(1.0))
        if ds.seeds is not None:
            seeds = ds.seeds.groupBy("s", "p", "o").agg(F.max("prob").alias("prob"))
            facts = facts.drop("prob").join(seeds, ["s", "p", "o"], "left").select("s", "p", "o", F.coalesce("prob", F.lit(1.0)).alias("prob"))
        name = str(d.prob.get("provenance", "addmult"))
        k = int(d.prob["threshold"]) if name == "topk" and "threshold" in d.prob else 5
        tagged = materialize(probabilities(facts, [r], name, k, d.prob if name == "hybrid" else None), "tagged")
        new = tagged.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        quads = new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
        return ds.add_quads(quads).add_quads(annotations(new)), new
    new = materialize(derive(base, [r]), "derived")
    return ds.add_quads(new), new.select("s", "p", "o")


class QueryEngine:
    """Holds a dataset; every update replaces it."""

    def __init__(self, spark: SparkSession, dataset: Dataset | None = None):
        self.spark, self.dataset, self.registry = spark, dataset or Dataset.empty(spark), neural.Registry()

    def load(self, path: str, format: str | None = None) -> None:
        self.dataset = self.dataset.load(path, format)

    load_file = load

    def load_ntriples_to_memory(self, text: str) -> None:
        self.parse(text, "ntriples")

    def parse(self, text: str, format: str) -> None:
        from .sources import parse as parse_text

        self.dataset = self.dataset.union(Dataset.from_quads(parse_text(self.spark, text, format)))

    def add_triple_to_memory(self, s: str, p: str, o: str) -> None:
        self.dataset = self.dataset.add_triple(s, p, o)

    def add_tagged_triple(self, s: str, p: str, o: str, prob: float) -> None:
        self.dataset = self.dataset.add_tagged_triple(s, p, o, prob)

    def register_udf(self, name: str, function) -> None:
        self.dataset = self.dataset.register_udf(name, function)

    def query(self, text: str, typed: bool = False) -> DataFrame:
        request = parse(text, self.dataset.prefixes)
        if request.retrieve is not None and request.select is None:
            from .streaming.continuous import retrieve

            return retrieve(self.dataset, text)
        if request.update is not None:
            raise ValueError("this is an update: use update()")
        return run(self.dataset, request, typed, self.registry)

    def update(self, text: str):
        self.dataset, summary = self.dataset.update(text)
        return summary

    def execute(self, text: str):
        """A query's rows, an update's summary, or what a rule derives."""
        request = parse(text, self.dataset.prefixes)
        if request.update is not None:
            return self.update(text)
        if request.rules and request.select is None:
            return self.define_rule(text)
        return self.query(text)

    def define_rule(self, text: str) -> DataFrame:
        request = parse(text, self.dataset.prefixes)
        self.registry.declare(request)
        for t in request.training:
            neural.train(self.dataset, self.registry, t)
        out = None
        for d in request.rules:
            self.dataset, out = define_rule(self.dataset, d, self.registry)
        return out

    process_rule_definition = define_rule

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.dataset.explain(text, mode)

    def stats(self) -> DataFrame:
        return self.dataset.stats()

    def builder(self):
        return self.dataset.builder()


__all__ = ["QueryEngine", "run", "define_rule"]
