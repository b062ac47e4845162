"""Learned relations: declared models, training from a query, and predictions as triples.

Training data is collected to the driver: at most ``MAX_SAMPLES`` rows, more are refused.
Predictions run where the data is, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset
from ..operators.solutions import Rel
from ..plans import ast as A
from ..plans.compile import Scope, group, solve
from .mlp import MLP

MAX_SAMPLES = 200_000
PROBABILITY = "_prob"


class UnknownModel(ValueError):
    """A model or relation that nobody declared, or that several answer to."""


@dataclass
class Registry:
    models: dict[str, A.ModelDecl] = field(default_factory=dict)
    relations: dict[str, A.NeuralDecl] = field(default_factory=dict)
    trained: dict[str, MLP] = field(default_factory=dict)
    materialised: dict[tuple, DataFrame] = field(default_factory=dict)

    def declare(self, request: A.Request) -> None:
        for m in request.models:
            self.models[m.name] = m
        for n in request.neural:
            if n.model not in self.models:
                raise UnknownModel(f"relation {n.predicate} uses the undeclared model {n.model}")
            self.relations[n.predicate] = n

    def relation_of(self, model: str) -> A.NeuralDecl:
        found = [n for n in self.relations.values() if n.model == model]
        if len(found) != 1:
            raise UnknownModel(f"model {model} has {len(found)} relations, one is needed")
        return found[0]


def _solved(ds: Dataset, data) -> Rel:
    if isinstance(data, A.Select):
        return solve(ds, data, Scope(), sub=True)
    return group(ds, data, Scope())[0]


def _features(rel: Rel, names: list[str]):
    missing = [n for n in names if n not in rel.kinds]
    if missing:
        raise UnknownModel(f"features {missing} are not bound")
    return [F.coalesce(rel.num(n), F.lit(0.0)).alias(n) for n in names]


def train(ds: Dataset, registry: Registry, d: A.TrainDecl, seed: int = 0, rules: list | None = None) -> float:
    """Fits the relation's model.  With a TARGET and rules, the loss is on the target's exact probability."""
    n = registry.relations.get(d.predicate)
    if n is None:
        raise UnknownModel(f"no relation {d.predicate}")
    m = registry.models[n.model]
    rel = _solved(ds, d.data if d.data is not None else n.input)
    if d.label not in rel.kinds:
        raise UnknownModel(f"the label ?{d.label} is not bound")
    df = rel.df.select(*_features(rel, n.features), rel.lex(d.label).alias("__y"))
    rows = df.limit(MAX_SAMPLES + 1).toPandas()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} training rows: sample in the training query")
    if not len(rows):
        raise ValueError("no training rows")
    labels = m.labels or sorted(rows["__y"].unique())
    x = rows[n.features].to_numpy(float)
    order = np.lexsort(np.column_stack((x, rows["__y"].astype("category").cat.codes))[:, ::-1].T)
    x, y = x[order], rows["__y"].to_numpy()[order]
    net = MLP(x.shape[1], m.hidden, labels, m.kind, seed)
    if m.kind == "exclusive":
        at = {v: i for i, v in enumerate(labels)}
        y = np.array([at[v] for v in y])
    else:
        yes = {"1", "true", "1.0", *(labels[-1:] if len(labels) == 2 else labels[:1])}
        y = np.array([v in yes for v in y], int)
    loss = net.fit(x, y, d.loss, d.optimizer, d.rate, d.epochs, d.batch, seed)
    registry.trained[n.model] = net
    if d.save_to:
        with open(d.save_to, "w") as f:
            f.write(net.dump())
    return loss


def predict(rel: Rel, anchor: str, features: list[str], net: MLP, predicate: str, with_probability: bool = False) -> DataFrame:
    """g, s, p, o: (anchor, predicate, label); for binary models only those at 0.5 or more."""
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("label", T.StringType()), T.StructField("prob", T.DoubleType())])
    text = net.dump()

    # not a function of columns: filters on its result would be inferred once per subset of the features
    def run(batches):
        own = MLP.load(text)
        for x in batches:
            p = own.probabilities(x[features].to_numpy(float))
            if own.kind == "exclusive":
                label, prob = [own.labels[i] for i in p.argmax(axis=1)], p.max(axis=1)
            else:
                yes = own.labels[-1] if len(own.labels) == 2 else own.labels[0] if own.labels else "true"
                label, prob = [yes if q >= 0.5 else None for q in p[:, 0]], p[:, 0]
            yield pd.DataFrame({"s": x["__s"], "label": label, "prob": prob})

    rows = rel.df.select(rel.lex(anchor).alias("__s"), *_features(rel, features)).distinct()
    out = rows.mapInPandas(run, schema)
    none = F.lit(None).cast("string").alias("g")
    found = out.where("label is not null").select(none, "s", F.lit(predicate).alias("p"), F.col("label").alias("o"))
    if with_probability and net.kind != "exclusive":
        found = found.unionByName(out.select(none, "s", F.lit(predicate + PROBABILITY).alias("p"), F.col("prob").cast("string").alias("o")))
    return found


def network(registry: Registry, model: str) -> MLP:
    if model not in registry.trained:
        raise UnknownModel(f"model {model} is not trained")
    return registry.trained[model]


def materialise(ds: Dataset, registry: Registry, wanted: set[str]) -> Dataset:
    """The dataset with the triples of the learned relations that a query uses."""
    for p in sorted(wanted & set(registry.relations)):
        n = registry.relations[p]
        rel, _ = group(ds, n.input, Scope())
        ds = ds.add_quads(predict(rel, n.anchor, n.features, network(registry, n.model), p))
    return ds


def ml_predict(ds: Dataset, registry: Registry, c: A.MLPredict, predicate: str | None = None) -> tuple[Dataset, DataFrame]:
    """Runs a prediction clause: earlier triples of the same clause go, the new ones come."""
    n = registry.relation_of(c.model)
    key = (c.model, predicate or n.predicate)
    if key in registry.materialised:
        ds = ds.delete_quads(registry.materialised[key])
    rel = solve(ds, c.input, Scope(), sub=True)
    if n.anchor not in rel.kinds or any(f not in rel.kinds for f in n.features):
        rel, _ = group(ds, c.input.where, Scope())
    made = predict(rel, n.anchor, n.features, network(registry, c.model), key[1], with_probability=True)
    from ..storage import materialize

    made = materialize(made, "predictions")
    registry.materialised[key] = made
    return ds.add_quads(made), made
