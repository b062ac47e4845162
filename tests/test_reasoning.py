"""Rules: closures, negation, constraints, probabilities, against values worked out by hand or by enumeration."""

import itertools
import random

import pytest

from quadrille.engine import QueryEngine
from quadrille.prob import wmc
from quadrille.prob.evaluate import recursive
from quadrille.reason.fixpoint import fixpoint
from quadrille.reason.reasoner import Hierarchy, Reasoner
from quadrille.reason.rules import parse_n3, rule
from tests.conftest import rows

PARENT = rule([("?x", "parent", "?y")], [("?x", "ancestor", "?y")])
STEP = rule([("?x", "parent", "?y"), ("?y", "ancestor", "?z")], [("?x", "ancestor", "?z")])
PATH = rule([("?x", "edge", "?y")], [("?x", "path", "?y")])
PATHS = rule([("?x", "path", "?y"), ("?y", "edge", "?z")], [("?x", "path", "?z")])


def facts(spark, *triples):
    return spark.createDataFrame(list(triples), "s string, p string, o string")


def test_closure_with_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")]
    r = Reasoner.of(spark, [(a, "parent", b) for a, b in pairs], [PARENT, STEP])
    got = {(s, o) for s, p, o in rows(r.infer()) if p == "ancestor"}
    ring = "abcd"
    assert got == {(a, b) for a in ring for b in ring} | {("x", "y")}
    assert rows(r.infer_new_facts_semi_naive()) == rows(r.infer_new_facts_naive())


def test_patterns_of_premises(spark):
    f = [("a", "likes", "a"), ("a", "likes", "b"), ("n", "age", "20"), ("m", "age", "5"), ("likes", "kind", "sym")]
    r = lambda *a, **k: rows(Reasoner.of(spark, f, [rule(*a, **k)]).infer())
    assert r([("?x", "likes", "?x")], [("?x", "is", "narcissist")]) == [("a", "is", "narcissist")]
    assert r([("?x", "?p", "?y"), ("?p", "kind", "sym")], [("?y", "?p", "?x")]) == [("b", "likes", "a")]
    assert r([("?x", "age", "?v")], [("?x", "is", "adult"), ("?x", "may", "vote")], filters=["?v >= 18"]) == [("n", "is", "adult"), ("n", "may", "vote")]
    with pytest.raises(ValueError):
        rule([("?x", "p", "?y")], [("?x", "q", "?z")])


def test_stratified_negation(spark):
    f = [("a", "edge", "b"), ("b", "edge", "c"), ("a", "node", "1"), ("b", "node", "1"), ("c", "node", "1")]
    far = rule([("?x", "node", "1"), ("?y", "node", "1")], [("?x", "unreached", "?y")], negative=[("?x", "path", "?y")])
    got = {(s, o) for s, p, o in rows(Reasoner.of(spark, f, [far, PATH, PATHS]).infer()) if p == "unreached"}
    assert got == set(itertools.product("abc", "abc")) - {("a", "b"), ("b", "c"), ("a", "c")}
    with pytest.raises(ValueError):
        fixpoint(facts(spark, *f), [rule([("?x", "node", "1")], [("?x", "p", "1")], negative=[("?x", "q", "1")]), rule([("?x", "node", "1")], [("?x", "q", "1")], negative=[("?x", "p", "1")])])


def test_backward_chaining(spark):
    r = Reasoner.of(spark, [("a", "parent", "b"), ("b", "parent", "c"), ("a", "other", "z")], [PARENT, STEP])
    assert rows(r.backward_chaining(("a", "ancestor", "?w"))) == [("b",), ("c",)]
    assert rows(r.backward_chaining(("?x", "parent", "c"))) == [("b",)]


def test_repairs(spark):
    never = rule([("?x", "is", "dead"), ("?x", "is", "alive")], [("?x", "conflict", "1")])
    r = Reasoner.of(spark, [("c", "is", "dead"), ("c", "is", "alive"), ("d", "is", "alive")], [], [never])
    assert r.violates() and sorted(rows(x) for x in r.repairs()) == [[("c", "is", "alive"), ("d", "is", "alive")], [("c", "is", "dead"), ("d", "is", "alive")]]
    assert rows(r.query_with_repairs(("?x", "is", "?v"))) == [("d", "alive")]
    grow = Reasoner.of(spark, [("c", "is", "dead"), ("c", "breathes", "1"), ("d", "breathes", "1")], [rule([("?x", "breathes", "1")], [("?x", "is", "alive")])], [never])
    assert rows(grow.infer_with_repairs()) == [("d", "is", "alive")]


def test_hierarchy(spark):
    h = Hierarchy(facts(spark, ("a", "p", "b")), {"deductive": (rule([("?x", "p", "?y")], [("?x", "q", "?y")]),), "meta": (rule([("?x", "q", "?y")], [("?x", "r", "?y")]),)})
    assert [(r.p, r.level, r.certainty) for r in h.infer().orderBy("p").collect()] == [("p", "base", 1.0), ("q", "deductive", 0.9), ("r", "meta", 0.4)]


def test_n3_rules_and_dot(spark):
    rules = parse_n3("@prefix ex: <http://e/> . { ?x ex:p ?y . ?y ex:p ?z } => { ?x ex:pp ?z } .")
    r = Reasoner.of(spark, [("a", "http://e/p", "b"), ("b", "http://e/p", "c")], rules)
    assert rows(r.infer()) == [("a", "http://e/pp", "c")] and '"a" -> "b"' in r.to_dot()


EDGES = [("a", "edge", "b", 0.8), ("b", "edge", "d", 0.6), ("a", "edge", "c", 0.9), ("c", "edge", "d", 0.5)]
PAIR = rule([("?x", "edge", "?y"), ("?y", "edge", "?z")], [("?x", "two", "?z")])


@pytest.mark.parametrize("ring,want", [("minmax", 0.6), ("addmult", 0.714), ("wmc", 0.714), ("sdd", 0.714), ("topk", 0.714)])
def test_semirings(spark, ring, want):
    got = {(r.s, r.p, r.o): r.tag for r in Reasoner.of(spark, EDGES, [PAIR]).infer_with_provenance(ring).collect()}
    assert abs(got[("a", "two", "d")] - want) < 1e-6 and abs(got[("a", "edge", "b")] - 0.8) < 1e-6


def test_boolean_and_topk(spark):
    r = Reasoner.of(spark, [*EDGES, ("z", "edge", "y", 0.0)], [PAIR, PATH])
    got = {(x.s, x.p, x.o): x.tag for x in r.infer_with_provenance("boolean").collect()}
    assert got[("a", "two", "d")] is True and ("z", "path", "y") not in got
    one = {(x.s, x.p, x.o): x.tag for x in r.infer_with_provenance("topk", k=1).collect()}
    assert abs(one[("a", "two", "d")] - 0.48) < 1e-6


def test_shared_seeds_and_negation(spark):
    f = [("a", "edge", "b", 0.5), ("b", "edge", "c", 0.5), ("n", "node", "m", 1.0)]
    both = rule([("?x", "edge", "?y"), ("?x", "edge", "?y")], [("?x", "both", "?y")])
    no = rule([("n", "node", "m")], [("n", "free", "m")], negative=[("a", "edge", "b")])
    got = {(x.s, x.p, x.o): x.tag for x in Reasoner.of(spark, f, [both, no]).infer_with_provenance("wmc").collect()}
    assert abs(got[("a", "both", "b")] - 0.5) < 1e-9 and abs(got[("n", "free", "m")] - 0.5) < 1e-9
    near = {(x.s, x.p, x.o): x.tag for x in Reasoner.of(spark, f, [no]).infer_with_provenance("minmax").collect()}
    assert abs(near[("n", "free", "m")] - 0.5) < 1e-9


def enumerate_probability(dnf, prob, group):
    ids, total = sorted(prob), 0.0
    loose = [i for i in ids if i not in group]
    groups = [[i for i in ids if group.get(i) == g] for g in sorted(set(group.values()))]
    for bits in itertools.product([0, 1], repeat=len(loose)):
        for picks in itertools.product(*[[None, *g] for g in groups]):
            true = {i for i, b in zip(loose, bits) if b} | {p for p in picks if p}
            w = 1.0
            for i, b in zip(loose, bits):
                w *= prob[i] if b else 1 - prob[i]
            for g, p in zip(groups, picks):
                w *= prob[p] if p else 1 - sum(prob[i] for i in g)
            if any(all((abs(x) in true) == (x > 0) for x in c) for c in dnf):
                total += w
    return total


def test_exact_count_and_bounds_against_enumeration():
    rng = random.Random(3)
    for _ in range(120):
        n = rng.randint(1, 8)
        prob = {i: rng.random() for i in range(1, n + 1)}
        group = {}
        if n >= 4 and rng.random() < 0.5:
            group = {1: 0, 2: 0}
            prob[1], prob[2] = 0.3, 0.5
        dnf = [sorted({rng.choice([1, 1, -1]) * rng.randint(1, n) for _ in range(rng.randint(1, 3))}) for _ in range(rng.randint(1, 5))]
        dnf = [c for c in dnf if not any(-x in c for x in c)]
        want = enumerate_probability(dnf, prob, group)
        assert abs(wmc.probability(dnf, prob, group) - want) < 1e-9
        out = wmc.evaluate(dnf, prob, group, wmc.HybridOptions(threshold=0.5, k_initial=1, k_max=2))
        assert out["lower"] - 1e-9 <= want <= out["upper"] + 1e-9
        for v, g in wmc.gradient([c for c in dnf if c], prob, {}).items():
            assert abs(g - (wmc.probability(dnf, prob | {v: 1.0}) - wmc.probability(dnf, prob | {v: 0.0}))) < 1e-9


def test_hybrid_options_and_recursion(spark):
    assert wmc.HybridOptions.of({"threshold": ("auto:cost", {"fp": 1.0, "fn": 3.0})}).threshold == 0.25
    with pytest.raises(ValueError):
        wmc.HybridOptions.of({"nonsense": 1.0})
    assert recursive([PATH, PATHS]) and not recursive([PAIR])
    got = {(x.s, x.p, x.o): x for x in Reasoner.of(spark, EDGES, [PAIR]).infer_with_provenance("hybrid", options={"threshold": 0.7}).collect()}
    assert got[("a", "two", "d")].decision == "Alert" and abs(got[("a", "two", "d")].tag - 0.714) < 1e-6


def test_rule_text(spark):
    e = QueryEngine(spark)
    e.update('INSERT DATA { <urn:a> <urn:parent> <urn:b> . <urn:b> <urn:parent> <urn:c> }')
    new = e.define_rule("RULE <urn:R> :- CONSTRUCT { ?x <urn:grand> ?z . } WHERE { ?x <urn:parent> ?y . ?y <urn:parent> ?z }")
    assert rows(new) == [("urn:a", "urn:grand", "urn:c")]
    assert rows(e.query("SELECT ?x WHERE { ?x <urn:grand> ?z }")) == [("urn:a",)]
    e.add_tagged_triple("urn:s", "urn:hot", "1", 0.8)
    e.define_rule("RULE <urn:A> PROB(provenance=hybrid, threshold=0.7) :- CONSTRUCT { ?x <urn:alert> ?v . } WHERE { ?x <urn:hot> ?v }")
    assert rows(e.query("SELECT ?d WHERE { << <urn:s> <urn:alert> ?v >> <http://www.w3.org/ns/prob#decision> ?d }")) == [("Alert",)]
    assert rows(e.query("SELECT ?s WHERE { << ?s <urn:alert> ?v >> <http://www.w3.org/ns/prob#value> ?p . FILTER(?p > 0.7) }")) == [("urn:s",)]


def test_proofs_that_share_nothing_are_counted_apart():
    dnf = [[2 * i + 1, 2 * i + 2] for i in range(40)]
    prob = {x: 0.1 + x / 200 for x in range(1, 81)}
    none = 1.0
    for a, b in dnf:
        none *= 1 - prob[a] * prob[b]
    assert abs(wmc.probability(dnf, prob, nodes=500) - (1 - none)) < 1e-9
    small, group = [[1, 2], [2, -3], [4, 5], [6, 7], [8]], {5: 1, 6: 1}
    prob = {x: prob[x] for x in range(1, 9)}
    assert abs(wmc.probability(small, prob, group) - enumerate_probability(small, prob, group)) < 1e-9


def test_registered_provenance_over_all_lines(spark, tmp_path):
    from quadrille import catalog

    lines = [(1, 1, 1.0, 0.05), (1, 1, 2.0, 0.08), (1, 2, 50.0, 0.1), (1, 3, 3.0, 0.02), (1, 4, 9.0, 0.07), (2, 2, 4.0, 0.03), (2, 3, 4.0, 0.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    proofs = {("s:1", "x"): [0.08, 0.1, 0.02], ("s:1", "y"): [0.07], ("s:2", "x"): [0.03]}
    want = []
    for (s, o), ds in proofs.items():
        dnf = [[2 * i + 1, 2 * i + 2] for i in range(len(ds))]
        prob = {x: p for i, d in enumerate(ds) for x, p in ((2 * i + 1, d), (2 * i + 2, 0.9))}
        want.append((s, o, round(enumerate_probability(dnf, prob, {}), 9)))
    for name in ("wmc", "sdd", "addmult"):
        assert sorted(tuple(r) for r in catalog.QUERIES[f"provenance_{name}_all"](spark, str(tmp_path)).collect()) == sorted(want)


def test_members_that_no_proof_names_are_one_case():
    import time

    n, named = 20_000, 50
    prob, group = {i: 1 / n for i in range(1, n + 1)}, {i: 7 for i in range(1, n + 1)}
    began = time.perf_counter()
    assert abs(wmc.probability([[i] for i in range(1, named + 1)], prob, group) - named / n) < 1e-9
    assert time.perf_counter() - began < 2
    rng = random.Random(5)
    for _ in range(80):
        prob = {i: rng.random() / 4 for i in range(1, 9)}
        group = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
        dnf = [sorted({rng.choice([1, 1, -1]) * rng.randint(1, 8) for _ in range(rng.randint(1, 3))}) for _ in range(rng.randint(1, 6))]
        dnf = [c for c in dnf if not any(-x in c for x in c)]
        assert abs(wmc.probability(dnf, prob, group) - enumerate_probability(dnf, prob, group)) < 1e-9


@pytest.mark.parametrize("ring", ["wmc", "sdd", "topk", "hybrid"])
def test_many_proofs_of_one_fact(spark, ring):
    import time

    n = 500
    f = [("s", "edge", f"p{i}", 0.001 + i / 1e5) for i in range(n)] + [(f"p{i}", "edge", "b", 0.5) for i in range(n)]
    options = {"topk": {"k": 2}, "hybrid": {"options": {"threshold": 0.5}}}.get(ring, {})
    began = time.perf_counter()
    got = [x for x in Reasoner.of(spark, f, [PAIR]).infer_with_provenance(ring, **options).where("p = 'two'").collect()]
    assert time.perf_counter() - began < 40
    none = 1.0
    for i in range(n - 2 if ring == "topk" else 0, n):
        none *= 1 - (0.001 + i / 1e5) * 0.5
    assert len(got) == 1 and len(got[0].proofs) == n
    assert got[0].decision == "Alert" if ring == "hybrid" else abs(got[0].tag - (1 - none)) < 1e-9


@pytest.mark.parametrize("ring", ["addmult", "minmax", "boolean", "wmc"])
def test_rules_that_read_no_own_conclusion_run_once(spark, ring, monkeypatch):
    from quadrille.reason import fixpoint as module

    four = rule([("?x", "two", "?y"), ("?y", "edge", "?z")], [("?x", "three", "?z")])
    assert module.levels([four, PAIR]) == [[PAIR], [four]] and module.levels([PATH, PATHS]) is None
    calls, bodies = [], module.bodies
    monkeypatch.setattr(module, "bodies", lambda r, *a: calls.append(r) or bodies(r, *a))
    f = [*EDGES, ("d", "edge", "e", 0.5), ("a", "two", "d", 0.1)]
    got = {(x.s, x.p, x.o): x.tag for x in Reasoner.of(spark, f, [four, PAIR]).infer_with_provenance(ring).collect()}
    assert calls == [PAIR, four] and len(got) == 9
    two = {"addmult": 1 - 0.286 * 0.9, "wmc": 1 - 0.286 * 0.9, "minmax": 0.6, "boolean": True}[ring]
    three = {"addmult": two * 0.5, "wmc": two * 0.5, "minmax": 0.5, "boolean": True}[ring]
    assert abs(got[("a", "two", "d")] - two) < 1e-9 and abs(got[("a", "three", "e")] - three) < 1e-9


def test_a_fact_given_with_several_probabilities(spark):
    f = [("a", "edge", "b", 0.5), ("a", "edge", "b", 0.2), ("a", "edge", "b", 0.2), ("a", "edge", "b", 0.3), ("b", "edge", "c", 0.5)]
    got = {(x.s, x.p, x.o): x.tag for x in Reasoner.of(spark, f, [PAIR]).infer_with_provenance("wmc").collect()}
    assert abs(got[("a", "edge", "b")] - 0.72) < 1e-9 and abs(got[("a", "two", "c")] - 0.36) < 1e-9


def test_proofs_that_hold_others(spark):
    from pyspark.sql import functions as F

    from quadrille.prob.semirings import prune

    rng = random.Random(9)
    tags = [[sorted({rng.choice([1, 1, -1]) * rng.randint(1, 5) for _ in range(rng.randint(0, 3))}) for _ in range(rng.randint(0, 7))] for _ in range(100)]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(tags)], "i int, d array<array<bigint>>").select("i", prune(F.col("d")).alias("d")).collect()
    for r in got:
        sound = {tuple(c) for c in tags[r.i] if not any(-x in c for x in c)}
        assert [tuple(c) for c in r.d] == sorted(c for c in sound if not any(set(o) < set(c) for o in sound))
