"""Queries against small datasets with the rows they have to give."""

from itertools import permutations

import pytest

from quadrille.dataset import Dataset
from quadrille.functions.expressions import column_function
from quadrille.plans.parser import ParseError, parse
from tests.conftest import rows


@pytest.fixture(scope="module")
def scoped(spark):
    return Dataset.of(spark, [
        ("urn:default-keep", "urn:p", "keep"), ("urn:default-drop", "urn:p", "drop"),
        ("urn:named-keep", "urn:p", "keep", "urn:g1"), ("urn:named-drop", "urn:p", "drop", "urn:g2"),
    ])


@pytest.fixture(scope="module")
def values(spark):
    return Dataset.of(spark, [("urn:s1", "urn:value", "1"), ("urn:s2", "urn:value", "2"), ("urn:s3", "urn:value", "3"), ("urn:s3", "urn:name", "abc")])


def test_filter_holds_for_its_whole_group(scoped):
    for body in ('FILTER(?v = "keep") ?s <urn:p> ?v', '?s <urn:p> ?v FILTER(?v = "keep")', '{ ?s <urn:p> ?v } FILTER(?v = "keep")'):
        assert rows(scoped.query(f"SELECT ?s WHERE {{ {body} }}")) == [("urn:default-keep",)]


def test_graphs(scoped):
    assert rows(scoped.query("SELECT ?g ?s WHERE { GRAPH ?g { ?s <urn:p> ?v } }")) == [("urn:g1", "urn:named-keep"), ("urn:g2", "urn:named-drop")]
    assert rows(scoped.query("SELECT ?s WHERE { GRAPH <urn:g2> { ?s <urn:p> ?v } }")) == [("urn:named-drop",)]
    assert rows(scoped.query("SELECT ?s FROM <urn:g1> FROM <urn:g2> WHERE { ?s <urn:p> ?v }")) == [("urn:named-drop",), ("urn:named-keep",)]
    assert rows(scoped.query("SELECT ?g FROM NAMED <urn:g1> WHERE { GRAPH ?g { ?s <urn:p> ?v } }")) == [("urn:g1",)]
    assert rows(scoped.query("SELECT ?s FROM NAMED <urn:g1> WHERE { ?s <urn:p> ?v }")) == []


def test_empty_graph_stays_in_the_catalogue(scoped):
    ds = scoped.create_graph("urn:empty")
    assert rows(ds.query("SELECT ?g WHERE { GRAPH ?g { } }")) == [("urn:empty",), ("urn:g1",), ("urn:g2",)]
    ds, n = ds.update('DELETE DATA { GRAPH <urn:g1> { <urn:named-keep> <urn:p> "keep" } }')
    assert n.deleted_quads == 1 and ds.graph_exists("urn:g1") and not ds.drop_graph("urn:g1").graph_exists("urn:g1")


def test_union_is_a_bag(scoped):
    branch = "{ GRAPH <urn:g1> { ?s <urn:p> ?v } }"
    assert len(rows(scoped.query(f"SELECT ?s WHERE {{ {branch} UNION {branch} }}"))) == 2
    assert len(rows(scoped.query(f"SELECT DISTINCT ?s WHERE {{ {branch} UNION {branch} }}"))) == 1


def test_values_graph_filter_and_bind(scoped):
    got = scoped.query('SELECT ?g ?s ?t WHERE { VALUES ?wanted { "keep" } GRAPH ?g { ?s <urn:p> ?v . FILTER(?v = ?wanted) } BIND(CONCAT(?v, "-ok") AS ?t) }')
    assert rows(got) == [("urn:g1", "urn:named-keep", "keep-ok")]


def test_arithmetic_and_logic(values):
    q = lambda f: rows(values.query(f"SELECT ?s WHERE {{ ?s <urn:value> ?v . FILTER({f}) }}"))
    assert q("?v + 1 >= 2 * 2") == [("urn:s3",)]
    assert q("?v / 0 > 1") == []
    assert q("!(?v / 0 > 1)") == [("urn:s1",), ("urn:s2",), ("urn:s3",)]
    assert q("2 < ?v") == [("urn:s3",)]
    assert q("?v = 1 || ?v = 3") == [("urn:s1",), ("urn:s3",)]
    assert q("?v - 1") == [("urn:s2",), ("urn:s3",)]
    assert q("?v = 1.0") == []
    assert rows(values.query("SELECT ?s WHERE { ?s <urn:name> ?v . FILTER(?v < 1) }")) == [("urn:s3",)]  # no number counts as 0


def test_literal_quotes(spark):
    ds, _ = Dataset.empty(spark).update("INSERT DATA { <urn:a> <urn:v> \"same\" . <urn:b> <urn:v> 'same' . <urn:c> <urn:v> \"\"\"same\"\"\" . <urn:d> <urn:v> '''same''' }")
    assert len(rows(ds.query('SELECT ?s WHERE { ?s <urn:v> "same" }'))) == 4


@pytest.mark.parametrize("triples,patterns,n", [
    ([(f"urn:{c}{i}", "urn:next", f"urn:{c}{i + 1}") for c in "nde" for i in range(4)] + [("urn:n0", "urn:type", "urn:Anchor")], ["?a <urn:type> <urn:Anchor>", "?a <urn:next> ?b", "?b <urn:next> ?c"], 1),
    ([("s1", f"urn:{k}", str(i)) for i, k in enumerate("abcd")] + [("s2", f"urn:{k}", "0") for k in "abc"], ["?s <urn:a> ?a", "?s <urn:b> ?b", "?s <urn:d> ?d"], 1),
    ([("a", "urn:e", "b"), ("b", "urn:e", "c"), ("c", "urn:e", "a")], ["?x <urn:e> ?y", "?y <urn:e> ?z", "?z <urn:e> ?x"], 3),
    ([("a", "urn:p", "b"), ("c", "urn:q", "d"), ("e", "urn:q", "f")], ["?x <urn:p> ?y", "?z <urn:q> ?w"], 2),
    ([("a", "urn:p", "a"), ("a", "urn:p", "b")], ["?x <urn:p> ?x"], 1),
])
def test_join_order_changes_nothing(spark, triples, patterns, n):
    ds = Dataset.of(spark, triples)
    variables = " ".join(sorted({w for p in patterns for w in p.split() if w[0] == "?"}))
    got = [rows(ds.query(f"SELECT {variables} WHERE {{ {' . '.join(p)} }}")) for p in permutations(patterns)]
    assert len(got[0]) == n and all(g == got[0] for g in got)


def test_unbound_fits_anything(spark):
    ds = Dataset.of(spark, [("urn:a", "urn:p", "1"), ("urn:b", "urn:p", "2")])
    assert rows(ds.query('SELECT ?s ?v WHERE { VALUES (?s ?v) { (<urn:a> UNDEF) (UNDEF "2") (<urn:a> "2") } ?s <urn:p> ?v }')) == [("urn:a", "1"), ("urn:b", "2")]
    got = ds.query("SELECT ?s ?v ?w WHERE { { ?s <urn:p> ?v } UNION { ?s <urn:p> ?w } { ?s <urn:p> ?w } }")
    assert rows(got) == [("urn:a", "", "1"), ("urn:a", "1", "1"), ("urn:b", "", "2"), ("urn:b", "2", "2")]


def test_aggregates(spark):
    ds = Dataset.of(spark, [("s1", "urn:g", "a"), ("s2", "urn:g", "a"), ("s3", "urn:g", "b"), ("s1", "urn:v", "1"), ("s2", "urn:v", "2"), ("s3", "urn:v", "4"), ("s3", "urn:v", "x")])
    body = "{ ?s <urn:g> ?g ; <urn:v> ?v }"
    assert rows(ds.query(f"SELECT ?g SUM(?v) AS ?t COUNT(?v) AS ?n AVG(?v) AS ?a MIN(?v) AS ?lo MAX(?v) AS ?hi WHERE {body} GROUP BY ?g")) == [("a", "3", "2", "1.5", "1", "2"), ("b", "4", "2", "4", "4", "4")]
    assert rows(ds.query(f"SELECT ?g ?t WHERE {{ {{ SELECT ?g SUM(?v) AS ?t WHERE {body} GROUP BY ?g ORDER BY DESC(?t) LIMIT 1 }} }}")) == [("b", "4")]
    assert rows(ds.query("SELECT COUNT(?v) AS ?n SUM(?v) AS ?t AVG(?v) AS ?a WHERE { ?s <urn:none> ?v }")) == [("0", "0", "")]
    assert rows(ds.query("SELECT ?g WHERE { ?s <urn:g> ?g } GROUP BY ?g")) == [("a",), ("a",), ("b",)]  # no aggregate: no grouping


def test_order_distinct_limit(spark):
    ds = Dataset.of(spark, [(f"s{i}", "urn:v", v) for i, v in enumerate(["10", "9", "b", "a", "9"])])
    assert [r[0] for r in ds.query("SELECT ?v WHERE { ?s <urn:v> ?v } ORDER BY ?v").collect()] == ["9", "9", "10", "a", "b"]
    assert [r[0] for r in ds.query("SELECT DISTINCT ?v WHERE { ?s <urn:v> ?v } ORDER BY DESC(?v) LIMIT 3").collect()] == ["b", "a", "10"]
    assert [r[0] for r in ds.query("SELECT DISTINCT ?v WHERE { ?s <urn:v> ?v } ORDER BY DESC(?s)").collect()] == ["9", "a", "b", "10"]


def test_updates(spark):
    ds, n = Dataset.empty(spark).update('INSERT DATA { <urn:a> <urn:p> "1" . <urn:a> <urn:p> "1" . GRAPH <urn:g> { <urn:b> <urn:p> "2" } }')
    assert (n.inserted_quads, n.deleted_quads) == (2, 0)
    ds, n = ds.update('INSERT DATA { <urn:a> <urn:p> "1" }')
    assert n.inserted_quads == 0
    ds, n = ds.update('DELETE { ?s <urn:p> ?v } INSERT { ?s <urn:q> ?v . ?s <urn:r> ?unbound } WHERE { ?s <urn:p> ?v }')
    assert (n.inserted_quads, n.deleted_quads) == (1, 1)
    ds, n = ds.update("INSERT { _:x <urn:of> ?s . _:x <urn:is> ?v } WHERE { ?s <urn:q> ?v }")
    assert n.inserted_quads == 2 and len({r[0] for r in rows(ds.query_default(p="urn:of").unionByName(ds.query_default(p="urn:is")))}) == 1
    ds, n = ds.update("INSERT { ?v <urn:bad> ?s } WHERE { ?s <urn:q> ?v }")
    assert n.inserted_quads == 0  # a literal is no subject
    ds, n = ds.update("DELETE WHERE { GRAPH ?g { ?s <urn:p> ?v } }")
    assert n.deleted_quads == 1 and ds.graph_exists("urn:g")
    for bad in ("INSERT DATA { ?x <urn:p> <urn:o> }", "DELETE DATA { _:b <urn:p> <urn:o> }", "SELECT ?x WHERE { ?x <urn:p> } trailing", "SELECT WHERE { }"):
        with pytest.raises(ParseError):
            parse(bad)


def test_quoted_triples(spark):
    ds, _ = Dataset.empty(spark).update('INSERT DATA { << <urn:a> <urn:b> "c d" >> <urn:says> <urn:x> . << << <urn:a> <urn:b> <urn:c> >> <urn:in> <urn:d> >> <urn:says> <urn:y> }')
    assert rows(ds.query("SELECT ?o ?x WHERE { << <urn:a> <urn:b> ?o >> <urn:says> ?x }")) == [("c d", "urn:x")]
    assert rows(ds.query("SELECT ?o WHERE { << << ?s ?p ?o >> <urn:in> ?d >> <urn:says> ?x }")) == [("urn:c",)]
    got = ds.query("SELECT ?s ?o ?is WHERE { ?t <urn:says> <urn:y> . BIND(SUBJECT(?t) AS ?s) BIND(OBJECT(?t) AS ?o) BIND(isTRIPLE(?s) AS ?is) FILTER(isTRIPLE(?t)) }")
    assert rows(got) == [("<< urn:a urn:b urn:c >>", "urn:d", "true")]
    assert rows(ds.query("SELECT ?t WHERE { ?q <urn:says> <urn:x> . BIND(PREDICATE(?q) AS ?p) BIND(TRIPLE(?p, ?p, ?p) AS ?t) }")) == [("<< urn:b urn:b urn:b >>",)]


def test_user_functions(spark):
    from pyspark.sql import functions as F

    ds = Dataset.of(spark, [("urn:a", "urn:p", "ab")]).register_udf("TWICE", lambda a: a[0] * 2).register_udf("UP", column_function(lambda c: F.upper(c)))
    assert rows(ds.query("SELECT ?t ?u ?n WHERE { ?s <urn:p> ?v . BIND(TWICE(?v) AS ?t) BIND(UP(?v) AS ?u) BIND(NONE(?v) AS ?n) }")) == [("abab", "AB", "")]


def test_builder(spark):
    people = Dataset.of(spark, [("ex:p1", "ex:name", "John"), ("ex:p1", "ex:age", "30"), ("ex:p2", "ex:name", "Jane"), ("ex:p2", "ex:age", "9"), ("ex:c1", "ex:name", "Co")])
    jobs = Dataset.of(spark, [("ex:p1", "ex:worksFor", "ex:c1")])
    b = people.builder()
    assert rows(b.with_predicate("ex:age").order_by("o").limit(1).triples()) == [("ex:p2", "ex:age", "9")]
    assert b.with_subject_starting("ex:p").with_object_like("J").count() == 2
    assert rows(b.filter(lambda s, p, o: o.endswith("e")).subjects()) == [("ex:p2",)]
    assert rows(b.with_predicate("ex:name").join(jobs).join_on_subject().triples()) == [("ex:p1", "ex:name", "ex:c1")]
    assert rows(b.with_predicate("ex:name").join(jobs).join_with(lambda ls, lp, lo, rs, rp, ro: ls == ro).triples()) == [("ex:c1", "ex:name", "ex:c1")]
    assert [r.n for r in b.group_by_predicate().orderBy("key").collect()] == [2, 3]
    assert b.with_predicate("ex:name").offset(1).count() == 2 and b.offset(99).count() == 0


def test_tables_as_triples(spark):
    item = spark.createDataFrame([(1, 5.0, "A"), (1, 5.0, "A"), (2, 7.5, None)], "l_orderkey long, l_quantity double, l_returnflag string")
    orders = spark.createDataFrame([(1, 10), (2, 20)], "o_orderkey long, o_custkey long")
    ds = Dataset.from_tables(spark, {"lineitem": item, "orders": orders})
    assert rows(ds.query("PREFIX l: <urn:lineitem#> SELECT ?f SUM(?q) AS ?t WHERE { ?x l:l_returnflag ?f ; l:l_quantity ?q . FILTER(?q > 4) } GROUP BY ?f")) == [("A", "10")]
    assert rows(ds.query("PREFIX l: <urn:lineitem#> PREFIX o: <urn:orders#> SELECT ?c ?q WHERE { ?x l:l_orderkey ?o ; l:l_quantity ?q . ?o o:o_custkey ?c }")) == [("10", "5"), ("10", "5"), ("20", "7.5")]
    assert rows(ds.query("SELECT ?p ?o WHERE { <urn:orders:2> ?p ?o }")) == [("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "urn:orders"), ("urn:orders#o_custkey", "20"), ("urn:orders#o_orderkey", "2")]
    assert len({r[0] for r in rows(ds.query("SELECT ?x WHERE { ?x <urn:lineitem#l_orderkey> <urn:orders:1> }"))}) == 2
    plan = ds.query("SELECT ?q WHERE { ?x <urn:lineitem#l_quantity> ?q ; <urn:lineitem#l_returnflag> ?f }", typed=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
