"""More named queries with their SQL: sources and sinks, the dataset's own methods, rule texts, repairs, exclusive facts, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _BASE, _BUY, _E, _EDGES, _NAMED, OFFERS, PREFIXES, SLIDE, WIDTH, _continuous, _fired, _hierarchy, event_stream, query, regional, sparql, tables
from .dataset import Dataset
from .engine import QueryEngine, define_rule
from .operators.update import update
from .plans.parser import parse
from .reason.reasoner import Reasoner
from .reason.rules import parse_n3, rule
from .storage import shared_path
from .streaming.continuous import replay


# -- sources and sinks -------------------------------------------------------------------------------
def _tables(spark, sf_dir, *names: str) -> Dataset:
    return replace(Dataset.from_tables(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}), prefixes=PREFIXES)


_CUSTOMERS = "SELECT 'urn:customer:' || c_custkey AS s, 'urn:customer#' || p AS p, o FROM (SELECT c_custkey, unnest([{p: 'c_name', o: c_name}, {p: 'c_mktsegment', o: c_mktsegment}], recursive := true) FROM customer)"


def _named(spark, sf_dir) -> DataFrame:
    return _tables(spark, sf_dir, "customer").query_quads().where("p in ('urn:customer#c_name', 'urn:customer#c_mktsegment')")


@query("nquads_round_trip", f"{_BASE} UNION ALL {_NAMED}")
def nquads_round_trip(spark, sf_dir):
    from .sources import read, write_nquads

    path = shared_path(spark, "nq")
    write_nquads(regional(spark, sf_dir).quads, path)
    return read(spark, path, "nq").select(F.coalesce("g", F.lit("")).alias("g"), "s", "p", "o")


@query("turtle_round_trip", _CUSTOMERS)
def turtle_round_trip(spark, sf_dir):
    from .sources import read, write_turtle

    path = shared_path(spark, "ttl")
    write_turtle(_named(spark, sf_dir), path)
    return read(spark, path, "ttl").select("s", "p", "o")


@query("n3_data_round_trip", _CUSTOMERS)
def n3_data_round_trip(spark, sf_dir):
    from .sources import read, write_turtle

    path = shared_path(spark, "n3")
    write_turtle(_named(spark, sf_dir), path)
    return read(spark, path, "n3").select("s", "p", "o")


@query("rdfxml_round_trip", _CUSTOMERS)
def rdfxml_round_trip(spark, sf_dir):
    from .sources import read, write_rdfxml

    path = shared_path(spark, "rdf")
    write_rdfxml(_named(spark, sf_dir), path)
    return read(spark, path, "rdfxml").select("s", "p", "o")


@query("load_by_name", _CUSTOMERS)
def load_by_name(spark, sf_dir):
    """The loader tells the format from the file's name."""
    from .sources import write_ntriples

    path = shared_path(spark, "load") + ".nt"
    write_ntriples(_named(spark, sf_dir), path)
    return Dataset.empty(spark).load(path).query_default()


# -- the dataset's own methods -------------------------------------------------------------------------
@query("edit_quads", f"SELECT g, s, p, o FROM ({_BASE} UNION ALL {_NAMED}) WHERE NOT (g = 'urn:g:all' AND s = 'urn:nation:3') UNION ALL SELECT '', 'urn:x', 'urn:name', 'X' UNION ALL SELECT 'urn:g:new', 'urn:y', 'urn:name', 'Y' UNION ALL SELECT '', 'urn:z', 'urn:name', 'Z'")
def edit_quads(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 3").first()["n_name"]
    ds = regional(spark, sf_dir).add_triple("urn:x", "urn:name", "X").add_quad("urn:y", "urn:name", "Y", "urn:g:new").add_tagged_triple("urn:z", "urn:name", "Z", 0.5)
    ds = ds.add_triple("urn:gone", "urn:name", "G").delete_triple("urn:gone", "urn:name", "G").delete_quad("urn:nation:3", "urn:name", name, "urn:g:all")
    return ds.quads.select(F.coalesce("g", F.lit("")).alias("g"), "s", "p", "o")


@query("graph_catalogue", "SELECT g, n FROM (SELECT 'urn:g:' || n_regionkey AS g, CASE WHEN n_regionkey = 1 THEN 0 ELSE count(*) END::BIGINT AS n FROM nation WHERE n_regionkey <> 2 GROUP BY n_regionkey UNION ALL SELECT 'urn:g:all', count(*) FROM nation UNION ALL SELECT 'urn:g:new', 0)")
def graph_catalogue(spark, sf_dir):
    """A graph that is cleared stays known, a dropped one does not."""
    ds = regional(spark, sf_dir).create_graph("urn:g:new").clear_graph("urn:g:1").drop_graph("urn:g:2")
    counts = ds.quads.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return ds.named_graphs().join(counts, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"))


@query("merged_graphs", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:name' AS p, n_name AS o FROM nation WHERE n_regionkey IN (0, 3) OR 'urn:nation:' || n_nationkey < 'urn:nation:2'")
def merged_graphs(spark, sf_dir):
    return regional(spark, sf_dir).query_merged_graphs(["urn:g:0", "urn:g:3", None])


@query("graphs_for_triple", "SELECT 'urn:g:' || n_regionkey AS g FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'urn:g:all'")
def graphs_for_triple(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 7").first()["n_name"]
    return regional(spark, sf_dir).graphs_for_triple("urn:nation:7", "urn:name", name).where("g is not null")


@query("engine_stats", "SELECT 'urn:customer#c_name' AS p, count(*) AS quads FROM customer UNION ALL SELECT 'urn:customer#c_nationkey', count(c_nationkey) FROM customer UNION ALL SELECT 'urn:nation#n_name', count(*) FROM nation")
def engine_stats(spark, sf_dir):
    stats = QueryEngine(spark, _tables(spark, sf_dir, "customer", "nation")).stats()
    return stats.where("p in ('urn:customer#c_name', 'urn:customer#c_nationkey', 'urn:nation#n_name')").select("p", "quads")


# -- filters, groups, updates ----------------------------------------------------------------------------
sparql("filter_bare_arithmetic", "SELECT ?k ?q WHERE { ?x l:l_linenumber ?k ; l:l_quantity ?q . FILTER(?k - 3) }", "SELECT l_linenumber AS k, l_quantity AS q FROM lineitem WHERE l_linenumber - 3 <> 0")
sparql("filter_scope", "SELECT ?n ?b WHERE { ?s s:s_name ?n . { ?s s:s_acctbal ?b . FILTER(?b > 5000) } }", "SELECT s_name AS n, s_acctbal AS b FROM supplier WHERE s_acctbal > 5000")
# without aggregates a subquery's groups count, the outer ones do not
sparql("group_without_aggregates", "SELECT ?f ?s WHERE { ?x l:l_returnflag ?f ; l:l_linestatus ?s } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem")
sparql("group_in_subquery", "SELECT ?f ?s WHERE { { SELECT ?f ?s WHERE { ?x l:l_returnflag ?f ; l:l_linestatus ?s } GROUP BY ?f ?s } }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
sparql("bind_unknown_function", "SELECT ?a ?t WHERE { ?n n:n_name ?a . BIND(NOSUCH(?a) AS ?t) }", "SELECT n_name AS a, NULL::VARCHAR AS t FROM nation")


@query("aggregate_number_text", "SELECT r_name AS r, CAST(count(*) AS VARCHAR) AS n, CAST(sum(n_nationkey) AS VARCHAR) AS t FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def aggregate_number_text(spark, sf_dir):
    """Aggregates as terms: whole numbers have no fraction."""
    return _tables(spark, sf_dir, "nation", "region").query("SELECT ?r COUNT(?k) AS ?n SUM(?k) AS ?t WHERE { ?x n:n_nationkey ?k ; n:n_regionkey ?y . ?y r:r_name ?r } GROUP BY ?r")


@query("update_summary", "SELECT (SELECT count(DISTINCT 'urn:g:' || n_regionkey) FROM nation)::BIGINT AS inserted, (SELECT count(*) FROM nation WHERE 'urn:nation:' || n_nationkey < 'urn:nation:2')::BIGINT AS deleted")
def update_summary(spark, sf_dir):
    """Quads that really came or went: the inserted ones are one per region, however many solutions give them."""
    said = update(regional(spark, sf_dir), "DELETE { ?s <urn:name> ?o } WHERE { ?s <urn:name> ?o }")[1]
    grew = update(regional(spark, sf_dir), "INSERT { ?g <urn:is> <urn:graph> } WHERE { GRAPH ?g { ?s <urn:name> ?o } FILTER(?g != <urn:g:all>) }")[1]
    return spark.createDataFrame([(grew.inserted_quads, said.deleted_quads)], "inserted long, deleted long")


@query("retrieve", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:nation#n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, 'urn:region#r_name', r_name FROM region")
def retrieve(spark, sf_dir):
    return QueryEngine(spark, _tables(spark, sf_dir, "nation", "region")).query("RETRIEVE SOME ACTIVE STREAM ?s FROM <urn:catalogue> WITH { ?x n:n_name ?a . ?y r:r_name ?b . }")


# -- rules, repairs, exclusive facts ------------------------------------------------------------------------
@query("rules_n3", f"SELECT a.s, 'near' AS p, b.o FROM ({_EDGES}) a JOIN ({_EDGES}) b ON a.o = b.s")
def rules_n3(spark, sf_dir):
    rules = parse_n3("@prefix u: <urn:u#> . { ?x u:within ?y . ?y u:within ?z } => { ?x u:near ?z } .")
    facts = _hierarchy(spark, sf_dir).withColumn("p", F.lit("urn:u#within"))
    return Reasoner(spark, facts, tuple(rules)).infer().where("p = 'urn:u#near'").select("s", F.lit("near").alias("p"), "o")


@query("rules_several_conclusions", f"SELECT o AS s, 'within' AS p, s AS o FROM ({_EDGES}) UNION ALL SELECT DISTINCT s, 'kind', 'place' FROM ({_EDGES})")
def rules_several_conclusions(spark, sf_dir):
    """Two conclusions, a constant, and a predicate that is a variable."""
    r = rule([("?x", "?p", "?y")], [("?y", "?p", "?x"), ("?x", "kind", "place")])
    new = Reasoner(spark, _hierarchy(spark, sf_dir), (r,)).infer(max_rounds=1)
    old = _hierarchy(spark, sf_dir)
    return new.join(old, ["s", "p", "o"], "left_anti")


@query("abox", "SELECT 'n:' || n_nationkey AS s, 'within' AS p, 'r:1' AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'moon', 'within', 'r:1'")
def abox(spark, sf_dir):
    return Reasoner(spark, _hierarchy(spark, sf_dir)).add_abox_triple("moon", "within", "r:1").query_abox(None, "within", "r:1")


@query("repairs_all", "SELECT r::BIGINT AS repair, (SELECT count(*) FROM region)::BIGINT AS n FROM (SELECT unnest([0, 1]) AS r)")
def repairs_all(spark, sf_dir):
    """One region is said to lie in two worlds: each repair drops one of both facts."""
    never = rule([("?x", "within", "world"), ("?x", "within", "void")], [("?x", "conflict", "1")])
    regions = _hierarchy(spark, sf_dir).where("s like 'r:%'")
    odd = spark.createDataFrame([("r:1", "within", "void")], "s string, p string, o string")
    all_ = Reasoner(spark, regions.unionByName(odd), (), (never,)).repairs()
    parts = [d.agg(F.lit(i).cast("long").alias("repair"), F.count(F.lit(1)).alias("n")) for i, d in enumerate(all_)]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


@query("rules_with_repairs", "SELECT 'n:' || n_nationkey AS s, 'in' AS p, 'r:' || n_regionkey AS o FROM nation WHERE n_regionkey <> 2")
def rules_with_repairs(spark, sf_dir):
    """A conclusion that breaks the constraint is left out."""
    never = rule([("?x", "in", "r:2")], [("?x", "conflict", "1")])
    facts = _hierarchy(spark, sf_dir).where("s like 'n:%'")
    return Reasoner(spark, facts, (rule([("?x", "within", "?y")], [("?x", "in", "?y")]),), (never,)).infer_with_repairs()


@query("exclusive_groups", "WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS c FROM a) SELECT 's:' || l_suppkey AS s, p_brand AS o, round(count(*)::DOUBLE / min(c), 9) AS tag FROM g JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def exclusive_groups(spark, sf_dir):
    """Each supplier supplies one of its parts, all equally likely: a brand's chance is its share of them."""
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    a = a.join(a.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c")), "l_suppkey")
    term = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    facts = a.select(term("s:", "l_suppkey").alias("s"), F.lit("supplies").alias("p"), term("p:", "l_partkey").alias("o"), (1 / F.col("c")).alias("prob"), F.col("l_suppkey").cast("long").alias("grp"))
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(term("p:", "p_partkey").alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("o"), F.lit(1.0).alias("prob"), F.lit(None).cast("long").alias("grp"))
    out = Reasoner(spark, facts.unionByName(brands), (OFFERS,)).infer_with_provenance("wmc").where("p = 'offers'")
    return out.select("s", "o", F.round(F.col("tag").cast("double"), 9).alias("tag"))


@query("rules_windowed", "SELECT DISTINCT 'urn:nation:' || n_nationkey AS s, 'urn:seen' AS p, n_name AS o FROM nation WHERE n_nationkey <> 99")
def rules_windowed(spark, sf_dir):
    """A RULE over a sliding window of the stored triples, wide enough for all of them."""
    d = parse("RULE :Seen :- RSTREAM FROM NAMED WINDOW :w ON ?s [RANGE 1000 STEP 1] CONSTRUCT { ?n <urn:seen> ?a . } WHERE { ?n n:n_name ?a }", PREFIXES).rules[0]
    quads = _tables(spark, sf_dir, "nation").query_quads(p="urn:nation#n_name")
    last = spark.createDataFrame([(None, "zz", "zz", "zz")], "g string, s string, p string, o string")
    return define_rule(replace(Dataset.from_quads(quads.unionByName(last)), prefixes=PREFIXES), d)[1]


# -- streams ----------------------------------------------------------------------------------------------
@query("continuous_reasoning", _BUY + "SELECT fire_ts, s AS u FROM h WHERE o IN ('purchase', 'click')")
def continuous_reasoning(spark, sf_dir):
    """Rules run on what the window holds at each firing."""
    rules = [rule([("?u", "urn:did", w)], [("?u", "urn:active", w)]) for w in ("purchase", "click")]
    text = _continuous("RSTREAM").replace('?u <urn:did> "purchase"', "?u <urn:active> ?w")
    return replay(event_stream(spark, sf_dir), text, rules=rules)


@query("continuous_routing", _E.rstrip(", ") + " SELECT 0 AS fire_ts, '' AS u FROM e WHERE false")
def continuous_routing(spark, sf_dir):
    """A window hears its own stream only: none of these events are on it."""
    return replay(event_stream(spark, sf_dir).withColumn("stream", F.lit("views")), _continuous("RSTREAM"))


@query("continuous_group", _E + _fired(WIDTH, SLIDE) + f", h AS (SELECT DISTINCT fire_ts, s, o FROM f JOIN e ON e.t >= close - {WIDTH} AND e.t < close AND e.t < fire_ts) SELECT fire_ts, o AS w, count(*) AS n FROM h GROUP BY ALL")
def continuous_group(spark, sf_dir):
    text = f"REGISTER RSTREAM <urn:out> AS SELECT ?w COUNT(?u) AS ?n FROM NAMED WINDOW :w ON :clicks [RANGE {WIDTH} STEP {SLIDE}] WHERE {{ WINDOW :w {{ ?u <urn:did> ?w }} }} GROUP BY ?w"
    return replay(event_stream(spark, sf_dir), text)


__all__ = ["tables"]
