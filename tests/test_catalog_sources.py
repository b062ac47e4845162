"""The queries of catalog_sources against their SQL in DuckDB."""

import duckdb
import pytest

from quadrille import catalog, catalog_sources

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if n in catalog.SQL and getattr(f, "__module__", "") == catalog_sources.__name__]


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.RELATIONAL:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_there_are_queries():
    assert len(NAMES) > 15


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), names)


@pytest.mark.parametrize("name,table", [("variable_predicate", "nation"), ("constant_subject", "orders")])
def test_a_known_subject_reads_its_own_table(spark, duck, name, table):
    df = catalog.QUERIES[name](spark, SF)
    assert {f.rpartition("/")[2] for f in df.inputFiles()} == {f"{table}.parquet"}
    want = duck.execute(catalog.SQL[name])
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), [d[0] for d in want.description])


def test_a_bound_subject_may_also_be_stored(spark):
    ds = catalog.tables(spark, SF).add_triple("urn:nation:1", "urn:note", "x").add_triple("urn:other", "urn:note", "y")
    got = ds.query("SELECT ?p ?v WHERE { ?s ?p ?v . ?s a <urn:nation> }").collect()
    assert [r.v for r in got if r.p == "urn:note"] == ["x"] and len(got) == 25 * 4 + 1
    assert ds.query_quads("urn:nation:1").count() == 5 and ds.query_quads("urn:other").count() == 1
