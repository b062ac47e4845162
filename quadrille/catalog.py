"""Named queries over the driver's tables, one per operator, with the SQL that gives the same rows.

Tables are seen as triples (``mapping``), so the queries are ordinary queries of the engine.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset
from .engine import QueryEngine, define_rule
from .functions.expressions import column_function
from .operators.update import update
from .plans.parser import parse
from .reason.fixpoint import fixpoint
from .reason.reasoner import Hierarchy, Reasoner
from .reason.rules import rule
from .streaming import crosswindow
from .streaming.continuous import replay
from .streaming.windows import assign, contents, firings

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
PREFIXES = {"r": "urn:region#", "n": "urn:nation#", "c": "urn:customer#", "s": "urn:supplier#", "p": "urn:part#", "o": "urn:orders#", "l": "urn:lineitem#", "e": "urn:events#"}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Dataset:
    return replace(Dataset.from_tables(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RELATIONAL}), prefixes=PREFIXES)


def sparql(name: str, text: str, sql: str | None, round_: dict | None = None) -> None:
    """A SELECT with native types; round_ gives decimals of sums whose order of adding is free."""
    def run(spark, sf_dir):
        df = tables(spark, sf_dir).query(text, typed=True)
        return df.withColumns({c: F.round(c, d) for c, d in (round_ or {}).items()})

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- scans, filters, expressions -----------------------------------------------------------------
sparql("scan_projection", "SELECT ?f ?q WHERE { ?x l:l_returnflag ?f ; l:l_quantity ?q . }", "SELECT l_returnflag AS f, l_quantity AS q FROM lineitem")
sparql("filter_compare", "SELECT ?o ?q ?d WHERE { ?x l:l_orderkey ?k ; l:l_linenumber ?o ; l:l_quantity ?q ; l:l_discount ?d . FILTER(?q > 45 && ?d <= 0.02 && ?o != 3) }",
       "SELECT l_linenumber AS o, l_quantity AS q, l_discount AS d FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_linenumber <> 3")
sparql("filter_two_valued_logic", "SELECT ?q ?f WHERE { ?x l:l_quantity ?q ; l:l_returnflag ?f . FILTER(!(?q / 0 > 1) && (?f = \"A\" || !(?q < 49))) }",
       "SELECT l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_returnflag = 'A' OR NOT l_quantity < 49")
sparql("filter_arithmetic", "SELECT ?e ?d WHERE { ?x l:l_extendedprice ?e ; l:l_discount ?d . FILTER(?e * (1 - ?d) + 10 > 60000 - 5 * 100) }",
       "SELECT l_extendedprice AS e, l_discount AS d FROM lineitem WHERE l_extendedprice * (1 - l_discount) + 10 > 60000 - 5 * 100")
sparql("filter_constant_left", "SELECT ?z WHERE { ?p p:p_size ?z . FILTER(45 < ?z) }", "SELECT p_size AS z FROM part WHERE 45 < p_size")
sparql("filter_date", "SELECT ?t ?s WHERE { ?o o:o_totalprice ?t ; o:o_orderdate ?d ; o:o_orderstatus ?s . FILTER(?d >= \"1997-06-01\" && ?d < \"1997-09-01\") }",
       "SELECT o_totalprice AS t, o_orderstatus AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-09-01'")
sparql("constant_subject", "SELECT ?p ?v WHERE { <urn:orders:1> ?p ?v }", """
SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:orders' AS v FROM orders WHERE o_orderkey = 1
UNION ALL SELECT 'urn:orders#o_orderkey', '1' FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 'urn:orders#o_custkey', 'urn:customer:' || o_custkey FROM orders WHERE o_orderkey = 1
UNION ALL SELECT 'urn:orders#o_orderstatus', o_orderstatus FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 'urn:orders#o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders WHERE o_orderkey = 1
UNION ALL SELECT 'urn:orders#o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 'urn:orders#o_orderpriority', o_orderpriority FROM orders WHERE o_orderkey = 1""")
sparql("variable_predicate", "SELECT ?p COUNT(?v) AS ?n WHERE { ?s ?p ?v . ?s a <urn:nation> } GROUP BY ?p",
       "SELECT p, count(*) AS n FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:nation#n_nationkey', 'urn:nation#n_name', 'urn:nation#n_regionkey']) AS p FROM nation) GROUP BY p")
sparql("repeated_variable", "SELECT ?k WHERE { ?x l:l_linenumber ?k ; l:l_quantity ?k }", "SELECT l_linenumber AS k FROM lineitem WHERE CAST(l_linenumber AS DOUBLE) = l_quantity")
sparql("bind_concat", "SELECT ?t WHERE { ?n n:n_name ?a ; n:n_regionkey ?r . ?r r:r_name ?b . BIND(CONCAT(?a, \" in \", ?b) AS ?t) }", "SELECT n_name || ' in ' || r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey")
sparql("bind_quoted_triple", "SELECT ?t ?o ?is WHERE { ?n n:n_name ?a . BIND(TRIPLE(?n, \"urn:named\", ?a) AS ?t) BIND(OBJECT(?t) AS ?o) BIND(isTRIPLE(?t) AS ?is) FILTER(isTRIPLE(?t)) }",
       "SELECT '<< urn:nation:' || n_nationkey || ' urn:named ' || n_name || ' >>' AS t, n_name AS o, 'true' AS is FROM nation")
sparql("values_with_undef", "SELECT ?a ?k WHERE { VALUES (?f ?k) { (\"A\" 3) (\"R\" UNDEF) } ?x l:l_returnflag ?f ; l:l_linenumber ?k ; l:l_tax ?a . FILTER(?a > 0.07) }",
       "SELECT l_tax AS a, CAST(l_linenumber AS VARCHAR) AS k FROM lineitem WHERE (l_returnflag = 'A' AND l_linenumber = 3 OR l_returnflag = 'R') AND l_tax > 0.07")


@query("bind_udf", "SELECT upper(n_name) AS u, n_name || n_name AS d FROM nation")
def bind_udf(spark, sf_dir):
    ds = tables(spark, sf_dir).register_udf("UP", column_function(lambda c: F.upper(c))).register_udf("TWICE", lambda a: a[0] * 2)
    return ds.query("SELECT ?u ?d WHERE { ?n n:n_name ?a . BIND(UP(?a) AS ?u) BIND(TWICE(?a) AS ?d) }")


# -- joins ---------------------------------------------------------------------------------------
sparql("join_two_hops", "SELECT ?name ?t WHERE { ?o o:o_custkey ?c ; o:o_totalprice ?t . ?c c:c_name ?name . FILTER(?t > 400000) }",
       "SELECT c_name AS name, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
REVENUE = "SELECT ?name SUM(?p) AS ?revenue COUNT(?p) AS ?n WHERE { ?l l:l_orderkey ?o ; l:l_extendedprice ?p ; l:l_quantity ?q . ?o o:o_custkey ?c . ?c c:c_nationkey ?n2 . ?n2 n:n_name ?name . FILTER(?q > 10) } GROUP BY ?name"
sparql("join_four_hops", REVENUE, """SELECT n_name AS name, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 10 GROUP BY n_name""", {"revenue": 2})
sparql("join_star", "SELECT ?b SUM(?q) AS ?t WHERE { ?l l:l_partkey ?p ; l:l_suppkey ?s ; l:l_quantity ?q . ?p p:p_brand ?b ; p:p_size ?z . ?s s:s_acctbal ?a . FILTER(?z > 25 && ?a > 0) } GROUP BY ?b",
       "SELECT p_brand AS b, sum(l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25 AND s_acctbal > 0 GROUP BY p_brand")
sparql("join_cycle", "SELECT ?cn ?sn COUNT(*) AS ?k WHERE { ?l l:l_orderkey ?o ; l:l_suppkey ?s . ?o o:o_custkey ?c . ?c c:c_nationkey ?n ; c:c_mktsegment ?cn . ?s s:s_nationkey ?n . ?n n:n_name ?sn } GROUP BY ?cn ?sn",
       "SELECT c_mktsegment AS cn, n_name AS sn, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
sparql("join_product", "SELECT ?a ?b WHERE { ?x r:r_name ?a . ?y n:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation")

# -- aggregates, order, sets ---------------------------------------------------------------------
sparql("group_aggregates", "SELECT ?f ?s SUM(?q) AS ?sum_q AVG(?d) AS ?avg_d MIN(?e) AS ?min_e MAX(?e) AS ?max_e COUNT(*) AS ?n WHERE { ?x l:l_returnflag ?f ; l:l_linestatus ?s ; l:l_quantity ?q ; l:l_discount ?d ; l:l_extendedprice ?e } GROUP BY ?f ?s",
       "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_q, round(avg(l_discount), 6) AS avg_d, min(l_extendedprice) AS min_e, max(l_extendedprice) AS max_e, count(*) AS n FROM lineitem GROUP BY ALL", {"avg_d": 6})
sparql("aggregate_of_nothing", "SELECT COUNT(?q) AS ?n SUM(?q) AS ?t WHERE { ?x l:l_quantity ?q . FILTER(?q > 1000) }", "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS t FROM lineitem WHERE l_quantity > 1000")
sparql("aggregate_terms", "SELECT ?t SUM(?v) AS ?total COUNT(?v) AS ?n WHERE { ?e e:event_type ?t ; e:props ?v } GROUP BY ?t", "SELECT event_type AS t, CAST(0 AS DOUBLE) AS total, count(props) AS n FROM events WHERE props IS NOT NULL GROUP BY event_type")
sparql("select_distinct", "SELECT DISTINCT ?f ?s WHERE { ?x l:l_returnflag ?f ; l:l_linestatus ?s }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
sparql("order_by_limit", "SELECT ?k ?t WHERE { ?o o:o_totalprice ?t ; o:o_orderkey ?k } ORDER BY DESC(?t) ?k LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 25")
sparql("distinct_order_by_hidden", "SELECT DISTINCT ?seg WHERE { ?c c:c_mktsegment ?seg ; c:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 3",
       "SELECT seg FROM (SELECT c_mktsegment AS seg, max(c_acctbal) AS b FROM customer GROUP BY seg) ORDER BY b DESC LIMIT 3")
sparql("union_bag", "SELECT ?name ?bal WHERE { { ?c c:c_name ?name ; c:c_acctbal ?bal } UNION { ?s s:s_name ?name ; s:s_acctbal ?bal } FILTER(?bal > 9000) }",
       "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000")
sparql("union_unbound", "SELECT ?a ?b WHERE { { ?x r:r_name ?a } UNION { ?y n:n_name ?b } }", "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")
sparql("subquery_modifiers", "SELECT ?name ?t WHERE { ?c c:c_name ?name . { SELECT ?c SUM(?p) AS ?t WHERE { ?o o:o_custkey ?c ; o:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?t) LIMIT 10 } }",
       "SELECT c_name AS name, round(t, 2) AS t FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY t DESC LIMIT 10) ON o_custkey = c_custkey", {"t": 2})
sparql("first_of_group", "SELECT ?n ?name COUNT(?c) AS ?k WHERE { ?c c:c_nationkey ?n . ?n n:n_name ?name } GROUP BY ?n", "SELECT n_nationkey AS n, n_name AS name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")


# -- graphs and updates ----------------------------------------------------------------------------
def regional(spark, sf_dir) -> Dataset:
    """Nations as quads, a named graph for each region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    q = n.select(F.concat(F.lit("urn:g:"), F.col("n_regionkey").cast("string")).alias("g"), F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("urn:name").alias("p"), F.col("n_name").alias("o"))
    both = q.unionByName(q.withColumn("g", F.lit("urn:g:all"))).unionByName(q.withColumn("g", F.lit(None).cast("string")).where("s < 'urn:nation:2'"))
    return Dataset.from_quads(both)


@query("graph_variable", "SELECT 'urn:g:' || n_regionkey AS g, n_name AS o FROM nation UNION ALL SELECT 'urn:g:all', n_name FROM nation")
def graph_variable(spark, sf_dir):
    return regional(spark, sf_dir).query("SELECT ?g ?o WHERE { GRAPH ?g { ?s <urn:name> ?o } }")


@query("from_merged", "SELECT n_name AS o FROM nation")
def from_merged(spark, sf_dir):
    return regional(spark, sf_dir).query("SELECT ?o FROM <urn:g:0> FROM <urn:g:all> WHERE { ?s <urn:name> ?o }")


@query("from_named", "SELECT 'urn:g:' || n_regionkey AS g, n_name AS o FROM nation WHERE n_regionkey IN (1, 2)")
def from_named(spark, sf_dir):
    return regional(spark, sf_dir).query("SELECT ?g ?o FROM NAMED <urn:g:1> FROM NAMED <urn:g:2> WHERE { GRAPH ?g { ?s <urn:name> ?o } }")


@query("dataset_union", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT n_regionkey AS g, n_name FROM nation UNION ALL SELECT 99, n_name FROM nation UNION ALL SELECT 98, n_name FROM nation WHERE 'urn:nation:' || n_nationkey < 'urn:nation:2'))")
def dataset_union(spark, sf_dir):
    ds = regional(spark, sf_dir)
    return ds.union(ds).quads.agg(F.count(F.lit(1)).alias("n"))


def _updated(text: str):
    return lambda spark, sf_dir: update(regional(spark, sf_dir), text)[0].quads.select(F.coalesce("g", F.lit("")).alias("g"), "s", "p", "o")


_BASE = "SELECT '' AS g, 'urn:nation:' || n_nationkey AS s, 'urn:name' AS p, n_name AS o FROM nation WHERE 'urn:nation:' || n_nationkey < 'urn:nation:2'"
_NAMED = "SELECT 'urn:g:' || n_regionkey, 'urn:nation:' || n_nationkey, 'urn:name', n_name FROM nation UNION ALL SELECT 'urn:g:all', 'urn:nation:' || n_nationkey, 'urn:name', n_name FROM nation"
QUERIES["update_insert_data"] = _updated('INSERT DATA { <urn:x> <urn:name> "X" . GRAPH <urn:g:0> { <urn:y> <urn:name> "Y" } }')
SQL["update_insert_data"] = f"{_BASE} UNION ALL {_NAMED} UNION ALL SELECT '', 'urn:x', 'urn:name', 'X' UNION ALL SELECT 'urn:g:0', 'urn:y', 'urn:name', 'Y'"
QUERIES["update_delete_data"] = _updated('DELETE DATA { <urn:nation:0> <urn:name> "no such name" . <urn:none> <urn:name> "n" }')
SQL["update_delete_data"] = f"{_BASE} UNION ALL {_NAMED}"
QUERIES["update_insert_where"] = _updated("INSERT { ?s <urn:in> ?g } WHERE { GRAPH ?g { ?s <urn:name> ?o } }")
SQL["update_insert_where"] = f"{_BASE} UNION ALL {_NAMED} UNION ALL SELECT '', 'urn:nation:' || n_nationkey, 'urn:in', 'urn:g:' || n_regionkey FROM nation UNION ALL SELECT '', 'urn:nation:' || n_nationkey, 'urn:in', 'urn:g:all' FROM nation"
QUERIES["update_modify"] = _updated("DELETE { ?s <urn:name> ?o } INSERT { ?s <urn:label> ?o } WHERE { ?s <urn:name> ?o }")
SQL["update_modify"] = f"SELECT g, s, 'urn:label' AS p, o FROM ({_BASE}) UNION ALL {_NAMED}"
QUERIES["update_delete_where"] = _updated("DELETE WHERE { GRAPH <urn:g:all> { ?s <urn:name> ?o } }")
SQL["update_delete_where"] = f"{_BASE} UNION ALL SELECT 'urn:g:' || n_regionkey, 'urn:nation:' || n_nationkey, 'urn:name', n_name FROM nation"


@query("quoted_triple_pattern", "SELECT n_name AS o, n_regionkey::VARCHAR AS w FROM nation")
def quoted_triple_pattern(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    q = n.select(F.lit(None).cast("string").alias("g"), F.concat(F.lit("<< urn:n:"), F.col("n_nationkey").cast("string"), F.lit(" urn:name "), F.col("n_name"), F.lit(" >>")).alias("s"), F.lit("urn:region").alias("p"), F.col("n_regionkey").cast("string").alias("o"))
    return Dataset.from_quads(q).query("SELECT ?o ?w WHERE { << ?s <urn:name> ?o >> <urn:region> ?w }")


@query("builder_join", "SELECT 'urn:customer:' || c_custkey AS s, 'urn:customer#c_name' AS p, c_mktsegment AS o FROM customer WHERE c_name LIKE '%1'")
def builder_join(spark, sf_dir):
    ds = Dataset.from_tables(spark, {"customer": spark.read.parquet(f"{sf_dir}/customer.parquet")})
    segments = Dataset.from_quads(ds.query_quads(p="urn:customer#c_mktsegment"))
    return ds.builder().with_predicate("urn:customer#c_name").with_object_ending("1").join(segments).join_on_subject().triples()


@query("builder_order", "SELECT s, o FROM (SELECT 'urn:supplier:' || s_suppkey AS s, s_acctbal AS b, CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END AS o FROM supplier ORDER BY b DESC LIMIT 7 OFFSET 2)")
def builder_order(spark, sf_dir):
    ds = Dataset.from_tables(spark, {"supplier": spark.read.parquet(f"{sf_dir}/supplier.parquet")})
    return ds.builder().with_predicate("urn:supplier#s_acctbal").order_by("o", desc=True).offset(2).limit(7).triples().select("s", "o")


@query("ntriples_round_trip", "SELECT 'urn:region:' || r_regionkey AS s, r_name AS o FROM region")
def ntriples_round_trip(spark, sf_dir):
    from .sources import read, write_ntriples
    from .storage import shared_path

    ds = Dataset.from_tables(spark, {"region": spark.read.parquet(f"{sf_dir}/region.parquet")})
    path = shared_path(spark, "nt")
    write_ntriples(ds.all_quads(), path)
    return read(spark, path, "nt").where("p = 'urn:region#r_name'").select("s", "o")


# -- rules and probabilities -----------------------------------------------------------------------
def _hierarchy(spark, sf_dir) -> DataFrame:
    """within: supplier in nation, nation in region, region in the world."""
    r, n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier"))
    k = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    parts = [r.select(k("r", "r_regionkey").alias("s"), F.lit("world").alias("o")), n.select(k("n", "n_nationkey").alias("s"), k("r", "n_regionkey").alias("o")), s.select(k("s", "s_suppkey").alias("s"), k("n", "s_nationkey").alias("o"))]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return df.select("s", F.lit("within").alias("p"), "o")


_EDGES = "SELECT 'r:' || r_regionkey AS s, 'world' AS o FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier"
_CLOSURE = f"WITH RECURSIVE e AS ({_EDGES}), t(s, o) AS (SELECT s, o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) "
INSIDE = [rule([("?x", "within", "?y")], [("?x", "inside", "?y")]), rule([("?x", "inside", "?y"), ("?y", "within", "?z")], [("?x", "inside", "?z")])]


@query("rules_closure", _CLOSURE + "SELECT s, 'inside' AS p, o FROM t UNION ALL SELECT s, 'within', o FROM e")
def rules_closure(spark, sf_dir):
    return fixpoint(_hierarchy(spark, sf_dir), INSIDE)


@query("rules_negation", _CLOSURE + "SELECT a.s, 'outside' AS p, b.o FROM (SELECT DISTINCT s FROM e WHERE s LIKE 'n:%') a, (SELECT DISTINCT o FROM e WHERE o LIKE 'r:%') b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s = a.s AND t.o = b.o)")
def rules_negation(spark, sf_dir):
    f = _hierarchy(spark, sf_dir)
    kinds = f.where("s like 'n:%'").select("s", F.lit("is").alias("p"), F.lit("nation").alias("o")).unionByName(f.where("o like 'r:%'").select(F.col("o").alias("s"), F.lit("is").alias("p"), F.lit("region").alias("o"))).distinct()
    outside = rule([("?n", "is", "nation"), ("?r", "is", "region")], [("?n", "outside", "?r")], negative=[("?n", "inside", "?r")])
    return fixpoint(f.unionByName(kinds), [*INSIDE, outside]).where("p = 'outside'")


@query("rules_backward", _CLOSURE + "SELECT s AS x FROM t WHERE o = 'r:1'")
def rules_backward(spark, sf_dir):
    return Reasoner(spark, _hierarchy(spark, sf_dir), tuple(INSIDE)).backward_chaining(("?x", "inside", "r:1"))


@query("rules_filter", "SELECT DISTINCT 'urn:orders:' || l_orderkey AS s, 'urn:large' AS p, 'true' AS o FROM lineitem WHERE l_quantity >= 49")
def rules_filter(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("urn:orders:"), F.col("l_orderkey").cast("string")).alias("s"), F.lit("urn:quantity").alias("p"), F.col("l_quantity").cast("long").cast("string").alias("o"))  # noqa: E741
    return fixpoint(l, [rule([("?x", "urn:quantity", "?q")], [("?x", "urn:large", "true")], filters=["?q >= 49"])]).where("p = 'urn:large'")


@query("rules_text", "SELECT 'urn:customer:' || c_custkey AS s, 'urn:rich' AS p, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def rules_text(spark, sf_dir):
    d = parse("RULE <urn:R> :- CONSTRUCT { ?c <urn:rich> ?n . } WHERE { ?c c:c_acctbal ?b ; c:c_nationkey ?k . ?k n:n_name ?n . FILTER(?b > 9000) }", PREFIXES).rules[0]
    ds = replace(Dataset.from_tables(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}), prefixes=PREFIXES)
    return define_rule(ds, d)[1]


@query("constraint_conflicts", "SELECT 's:' || s_suppkey AS s, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY ALL")
def constraint_conflicts(spark, sf_dir):
    never = rule([("?s", "within", "?n"), ("?n", "within", "r:2")], [("?s", "conflict", "1")])
    found = Reasoner(spark, _hierarchy(spark, sf_dir), (), (never,)).conflicts()
    return found.select(F.filter("facts", lambda x: x["s"].startswith("s:"))[0]["s"].alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


@query("repairs_safe_answers", "SELECT 's:' || s_suppkey AS x, 'n:' || s_nationkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation WHERE n_regionkey <> 2 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'r:' || r_regionkey, 'world' FROM region")
def repairs_safe_answers(spark, sf_dir):
    never = rule([("?s", "within", "?n"), ("?n", "within", "r:2"), ("?s", "kind", "supplier")], [("?s", "conflict", "1")])
    f = _hierarchy(spark, sf_dir)
    f = f.unionByName(f.where("s like 's:%'").select("s", F.lit("kind").alias("p"), F.lit("supplier").alias("o")))
    return Reasoner(spark, f, (), (never,)).query_with_repairs(("?x", "within", "?y"))


@query("rules_levels", f"SELECT s, 'within' AS p, o, 'base' AS level, 1.0::DOUBLE AS certainty FROM ({_EDGES}) UNION ALL SELECT a.s, 'near', b.o, 'deductive', 0.9::DOUBLE FROM ({_EDGES}) a JOIN ({_EDGES}) b ON a.o = b.s")
def rules_levels(spark, sf_dir):
    return Hierarchy(_hierarchy(spark, sf_dir), {"deductive": (rule([("?x", "within", "?y"), ("?y", "within", "?z")], [("?x", "near", "?z")]),)}).infer()


def _likely(spark, sf_dir, least: int | None = 48) -> DataFrame:
    """supplies: supplier to part, with the discount as probability (none is no fact); stocked: part in brand.

    Of large orders, or of all lines where ``least`` is None.
    """
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_discount > 0")  # noqa: E741
    if least is not None:
        l = l.where(F.col("l_quantity") > least)  # noqa: E741
    a = l.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("prob")).select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("s"), F.lit("supplies").alias("p"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("o"), "prob")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("o"), F.lit(0.9).alias("prob"))
    return a.unionByName(p)


_LIKELY = "WITH a AS (SELECT 's:' || l_suppkey AS s, p_brand AS o, max(l_discount) AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 AND l_discount > 0 GROUP BY l_suppkey, l_partkey, p_brand) "
_LIKELY_ALL = "WITH a AS (SELECT 's:' || l_suppkey AS s, p_brand AS o, max(l_discount) AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0 GROUP BY l_suppkey, l_partkey, p_brand) "
OFFERS = rule([("?s", "supplies", "?p"), ("?p", "brand", "?b")], [("?s", "offers", "?b")])


def _provenance(name: str, sql: str, **options) -> None:
    """Two queries: over large orders, and (_all) over the whole of lineitem."""
    def run(spark, sf_dir, least=48):
        out = Reasoner(spark, _likely(spark, sf_dir, least), (OFFERS,)).infer_with_provenance(name, **options).where("p = 'offers'")
        return out.select("s", "o", F.round(F.col("tag").cast("double"), 9).alias("tag"))

    QUERIES[f"provenance_{name}"], SQL[f"provenance_{name}"] = run, _LIKELY + sql
    QUERIES[f"provenance_{name}_all"], SQL[f"provenance_{name}_all"] = lambda spark, sf_dir: run(spark, sf_dir, None), _LIKELY_ALL + sql


_provenance("minmax", "SELECT s, o, round(max(least(d, 0.9)), 9) AS tag FROM a GROUP BY s, o")
_provenance("addmult", "SELECT s, o, round(1 - exp(sum(ln(1 - d * 0.9))), 9) AS tag FROM a GROUP BY s, o")
_provenance("boolean", "SELECT DISTINCT s, o, 1.0::DOUBLE AS tag FROM a")
_provenance("wmc", "SELECT s, o, round(1 - exp(sum(ln(1 - d * 0.9))), 9) AS tag FROM a GROUP BY s, o")
_provenance("sdd", "SELECT s, o, round(1 - exp(sum(ln(1 - d * 0.9))), 9) AS tag FROM a GROUP BY s, o")
_provenance("topk", "SELECT s, o, round(1 - exp(sum(ln(1 - d * 0.9))), 9) AS tag FROM (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY d DESC) AS r FROM a) WHERE r <= 2 GROUP BY s, o", k=2)


@query("provenance_hybrid", _LIKELY + "SELECT s, o, CASE WHEN 1 - exp(sum(ln(1 - d * 0.9))) >= 0.0805 THEN 'Alert' ELSE 'NoAlert' END AS decision FROM a GROUP BY s, o")
def provenance_hybrid(spark, sf_dir):
    out = Reasoner(spark, _likely(spark, sf_dir), (OFFERS,)).infer_with_provenance("hybrid", options={"threshold": 0.0805})
    return out.where("p = 'offers'").select("s", "o", "decision")


@query("provenance_annotations", _LIKELY + "SELECT '<< ' || s || ' offers ' || o || ' >>' AS s, 'http://www.w3.org/ns/prob#proofCount' AS p, '\"' || count(*) || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o FROM a GROUP BY s, o")
def provenance_annotations(spark, sf_dir):
    from .prob.evaluate import annotations

    out = Reasoner(spark, _likely(spark, sf_dir), (OFFERS,)).infer_with_provenance("wmc").where("p = 'offers'")
    return annotations(out).where("p like '%proofCount'").select("s", "p", "o")


@query("provenance_hybrid_all", _LIKELY_ALL + "SELECT s, o, CASE WHEN 1 - exp(sum(ln(1 - d * 0.9))) >= 0.6605 THEN 'Alert' ELSE 'NoAlert' END AS decision FROM a GROUP BY s, o")
def provenance_hybrid_all(spark, sf_dir):
    out = Reasoner(spark, _likely(spark, sf_dir, None), (OFFERS,)).infer_with_provenance("hybrid", options={"threshold": 0.6605})
    return out.where("p = 'offers'").select("s", "o", "decision")


@query("provenance_annotations_all", _LIKELY_ALL + "SELECT '<< ' || s || ' offers ' || o || ' >>' AS s, 'http://www.w3.org/ns/prob#proofCount' AS p, '\"' || count(*) || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o FROM a GROUP BY s, o")
def provenance_annotations_all(spark, sf_dir):
    from .prob.evaluate import annotations

    out = Reasoner(spark, _likely(spark, sf_dir, None), (OFFERS,)).infer_with_provenance("wmc").where("p = 'offers'")
    return annotations(out).where("p like '%proofCount'").select("s", "p", "o")


# -- streams ---------------------------------------------------------------------------------------
def event_stream(spark, sf_dir) -> DataFrame:
    """stream, s, p, o, ts (seconds) of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return e.select(F.lit("clicks").alias("stream"), F.concat(F.lit("urn:user:"), F.col("user_id").cast("string")).alias("s"), F.lit("urn:did").alias("p"), F.col("event_type").alias("o"), seconds.cast("long").alias("ts"))


WIDTH, SLIDE = 7200, 3600
_E = "WITH e AS (SELECT epoch_us(ts) // 1000000 AS t, 'urn:user:' || user_id AS s, event_type AS o FROM events), "


def _fired(width: int, slide: int) -> str:
    late = f"(least(t, prev + {width}) // {slide} * {slide})"
    return f"f AS (SELECT * FROM (SELECT t AS fire_ts, CASE WHEN t % {slide} = 0 THEN t WHEN {late} > prev AND {late} - {width} <= prev THEN {late} END AS close FROM (SELECT t, lag(t) OVER (ORDER BY t) AS prev FROM (SELECT DISTINCT t FROM e WHERE t > 0))) WHERE close IS NOT NULL)"


_HELD = f", h AS (SELECT DISTINCT fire_ts, s, o FROM f JOIN e ON e.t >= close - {WIDTH} AND e.t < close AND e.t < fire_ts)"


@query("window_tumbling", _E + "w AS (SELECT t // 3600 * 3600 AS open, o, count(*) AS n FROM e GROUP BY ALL) SELECT open, o, n FROM w")
def window_tumbling(spark, sf_dir):
    return assign(event_stream(spark, sf_dir), 3600, 3600).groupBy("open", "o").agg(F.count(F.lit(1)).alias("n"))


@query("window_sliding", _E + f"w AS (SELECT (t // {SLIDE} + k) * {SLIDE} AS close, o FROM e, (SELECT unnest([1, 2]) AS k)) SELECT close, o, count(*) AS n FROM w GROUP BY ALL")
def window_sliding(spark, sf_dir):
    return assign(event_stream(spark, sf_dir), WIDTH, SLIDE).groupBy("close", "o").agg(F.count(F.lit(1)).alias("n"))


@query("window_firings", _E + _fired(WIDTH, SLIDE) + f" SELECT fire_ts, greatest(close - {WIDTH}, 0) AS open, close FROM f")
def window_firings(spark, sf_dir):
    return firings(event_stream(spark, sf_dir).select("ts"), WIDTH, SLIDE)


@query("window_contents", _E + _fired(WIDTH, SLIDE) + _HELD + " SELECT fire_ts, count(*) AS n FROM h GROUP BY fire_ts")
def window_contents(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    return contents(e, firings(e.select("ts"), WIDTH, SLIDE), WIDTH, SLIDE).groupBy("fire_ts").agg(F.count(F.lit(1)).alias("n"))


def _continuous(op: str) -> str:
    return f'REGISTER {op} <urn:out> AS SELECT ?u FROM NAMED WINDOW :w ON :clicks [RANGE {WIDTH} STEP {SLIDE}] WHERE {{ WINDOW :w {{ ?u <urn:did> "purchase" }} }}'


_BUY = _E + _fired(WIDTH, SLIDE) + _HELD + ", b AS (SELECT fire_ts, s AS u FROM h WHERE o = 'purchase'), k AS (SELECT fire_ts, lag(fire_ts) OVER (ORDER BY fire_ts) AS before, lead(fire_ts) OVER (ORDER BY fire_ts) AS after FROM f) "
for _op, _sql in (("RSTREAM", "SELECT fire_ts, u FROM b"), ("ISTREAM", "SELECT b.fire_ts, b.u FROM b JOIN k USING (fire_ts) WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.fire_ts = k.before AND o.u = b.u)"),
                  ("DSTREAM", "SELECT k.after AS fire_ts, b.u FROM b JOIN k USING (fire_ts) WHERE k.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b o WHERE o.fire_ts = k.after AND o.u = b.u)")):
    QUERIES[f"continuous_{_op.lower()}"] = lambda spark, sf_dir, op=_op: replay(event_stream(spark, sf_dir), _continuous(op))
    SQL[f"continuous_{_op.lower()}"] = _BUY + _sql


@query("continuous_static_join", _BUY + "SELECT b.fire_ts, b.u, c_mktsegment AS g FROM b JOIN customer ON b.u = 'urn:user:' || c_custkey")
def continuous_static_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(None).cast("string").alias("g"), F.concat(F.lit("urn:user:"), F.col("c_custkey").cast("string")).alias("s"), F.lit("urn:segment").alias("p"), F.col("c_mktsegment").alias("o"))
    text = _continuous("RSTREAM").replace("SELECT ?u", "SELECT ?u ?g").replace("} }", "} ?u <urn:segment> ?g }")
    return replay(event_stream(spark, sf_dir), text, Dataset.from_quads(c))


@query("cross_window_expiry", _E + "x AS (SELECT s, o, max(t) AS t FROM e GROUP BY ALL), n AS (SELECT max(t) - 200000 AS now FROM e) SELECT a.s, least(a.t + 86400 * 3, b.t + 86400 * 5) AS tag FROM x a JOIN x b ON a.s = b.s AND a.o = 'click' AND b.o = 'purchase', n WHERE a.t + 86400 * 3 > now AND b.t + 86400 * 5 > now")
def cross_window_expiry(spark, sf_dir):
    e = event_stream(spark, sf_dir).groupBy("s", "p", "o").agg(F.max("ts").alias("ts"))
    now = e.agg(F.max("ts")).first()[0] - 200000
    base = crosswindow.base_facts({"a:": (86400 * 3, e.where("o = 'click'")), "b:": (86400 * 5, e.where("o = 'purchase'"))}, now=now)
    both = rule([("?u", "a:urn:did", "click"), ("?u", "b:urn:did", "purchase")], [("?u", "both", "1")])
    return crosswindow.materialise(base, [both], now).where("p = 'both'").select("s", "tag")


# -- learned relations: rows only ---------------------------------------------------------------------
#: The relation is fitted on about so many rows at most, an equal share for each label; it answers for every row.
FIT_ROWS = 20_000


@query("neural_relation")
def neural_relation(spark, sf_dir):
    """Learns to tell the labels of the embeddings apart, all of them, from the whole vector, and guesses a label for every row.

    Components that a vector lacks are 0.  Labels of more rows than their share of FIT_ROWS are
    fitted on rows chosen by a hash of vec_id; rows without a label are guessed, not fitted.
    """
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).orderBy("label").collect()  # a row per label
    width, labels = max((r["width"] or 0 for r in found), default=0), [r for r in found if r["label"] is not None]
    share, scale = FIT_ROWS / max(len(labels), 1), 1_000_000
    kept = F.lit(scale)
    for r in labels:
        if r["n"] > share:
            kept = F.when(F.col("label") == r["label"], F.lit(int(scale * share / r["n"]))).otherwise(kept)
    gold = F.when(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) < kept, F.col("label"))
    x = [f"x{i}" for i in range(width)]
    table = v.select("vec_id", *[F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(c) for i, c in enumerate(x)], gold.alias("gold"))
    e = QueryEngine(spark, replace(Dataset.from_tables(spark, {"v": table}, {"v": ["vec_id"]}), prefixes={"v": "urn:v#"}))
    body = "?v " + " ; ".join(f"v:{c} ?{c}" for c in x)
    return e.query(f'''MODEL "m" {{ ARCH MLP {{ HIDDEN [16] }} OUTPUT EXCLUSIVE {{ {", ".join(f'"{r["label"]}"' for r in labels)} }} }}
NEURAL RELATION <urn:guess> USING MODEL "m" {{ INPUT {{ {body} }} FEATURES {{ {", ".join(f"?{c}" for c in x)} }} }}
TRAIN NEURAL RELATION <urn:guess> {{ DATA {{ {body} ; v:gold ?label }} LABEL ?label LOSS cross_entropy OPTIMIZER adam LEARNING_RATE 0.01 EPOCHS 30 }}
SELECT ?v ?g WHERE {{ ?v <urn:guess> ?g }}''')


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).query(REVENUE + " ORDER BY DESC(?revenue)", typed=True)
