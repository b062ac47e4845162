from quadrille import sources
from quadrille.dataset import Dataset
from tests.conftest import rows

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def test_ntriples_and_nquads(spark):
    text = '<urn:a> <urn:p> "x\\ty"^^<urn:t> .\n<urn:a> a _:b .\n# note\n<urn:a> <urn:p> "z"@en .\n<< <urn:a> <urn:p> "z" >> <urn:q> <urn:c> .\nbroken\n<urn:a> <urn:p> <urn:no-dot>\n'
    got = rows(sources.parse(spark, text, "nt").select("s", "p", "o"))
    assert got == sorted([("urn:a", "urn:p", "x\ty"), ("urn:a", TYPE, "_:b"), ("urn:a", "urn:p", "z@en"), ("<< urn:a urn:p z >>", "urn:q", "urn:c")])
    assert rows(sources.parse(spark, "<urn:a> <urn:p> <urn:o> <urn:g> .\n<urn:a> <urn:p> \"\\u00e9\" .", "nq").select("o", "g").fillna("")) == [("urn:o", "urn:g"), ("é", "")]


def test_turtle(spark):
    text = '''@prefix ex: <http://e/> . PREFIX f: <http://f/>
    ex:a a ex:T ; ex:p "v", 'w'@en ;
         f:q 5 .
    << ex:a ex:p ex:b >> ex:says ex:c .
    ex:a ex:r ex:d {| ex:since "2" |} .
    ex:a ex:has [ ex:k "in" ] . '''
    got = rows(sources.parse(spark, text, "ttl").select("s", "p", "o"))
    assert ("http://e/a", "http://f/q", "5") in got and ("http://e/a", "http://e/p", "w@en") in got and ("http://e/a", TYPE, "http://e/T") in got
    assert ("<< http://e/a http://e/r http://e/d >>", "http://e/since", "2") in got and ("_:anon1", "http://e/k", "in") in got
    assert len(got) == 9


def test_rdfxml(spark):
    text = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/"><rdf:Description rdf:about="urn:a"><ex:p>v</ex:p><ex:q rdf:resource="urn:b"/></rdf:Description><ex:T rdf:about="urn:c"/></rdf:RDF>'
    assert rows(sources.parse(spark, text, "xml").select("s", "p", "o")) == [("urn:a", "http://e/p", "v"), ("urn:a", "http://e/q", "urn:b"), ("urn:c", TYPE, "http://e/T")]


def test_round_trips(spark, tmp_path):
    ds = Dataset.of(spark, [("urn:a", "http://e/p", 'say "hi"\n\\'), ("urn:a", "http://e/p", "urn:b"), ("<< urn:a urn:p urn:b >>", "http://e/q", "x y"), ("urn:a", "http://e/p", "g", "urn:g")])
    sources.write_nquads(ds.quads, str(tmp_path / "d.nq"))
    assert rows(Dataset.empty(spark).load(str(tmp_path / "d.nq")).quads.fillna("")) == rows(ds.quads.fillna(""))
    sources.write_turtle(ds.quads, str(tmp_path / "d.ttl"))
    plain = rows(ds.quads.where("g is null").select("s", "p", "o"))
    assert rows(Dataset.empty(spark).load(str(tmp_path / "d.ttl")).quads.select("s", "p", "o")) == plain
    sources.write_ntriples(ds.quads, str(tmp_path / "d.nt"))
    assert rows(Dataset.empty(spark).load(str(tmp_path / "d.nt")).quads.select("s", "p", "o")) == plain
    simple = ds.query_default(p="http://e/p").where("o not like '%hi%'")
    sources.write_rdfxml(simple.coalesce(1), str(tmp_path / "d.xml"))
    assert rows(Dataset.empty(spark).load(str(tmp_path / "d.xml")).quads.select("s", "p", "o")) == [("urn:a", "http://e/p", "urn:b")]


def test_union_of_datasets(spark):
    a, b = Dataset.of(spark, [("urn:a", "urn:p", "1")]).create_graph("urn:e"), Dataset.of(spark, [("urn:a", "urn:p", "1"), ("urn:b", "urn:p", "2", "urn:g")])
    u = a.union(b)
    assert u.quads.count() == 2 and rows(u.graphs) == [("urn:e",), ("urn:g",)]


def test_turtle_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    from quadrille.sources import read, writers, write_turtle
    from quadrille.sources.turtle import parse_turtle

    monkeypatch.setattr(writers, "SUBJECTS", 10)
    quads = spark.range(95).selectExpr("cast(null as string) g", "concat('urn:s', id) s", "'urn:p' p", "concat('line\n', id) o")
    write_turtle(quads, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").selectExpr("input_file_name() f").groupBy("f").count().agg({"count": "max"}).first()[0] <= 10
    assert sorted(map(tuple, read(spark, f"{tmp_path}/t", "ttl").collect())) == sorted(map(tuple, quads.collect()))

    class Text(str):  # how far the parser has looked when it gives the first triple
        def find(self, *a):
            raise AssertionError("the first triple comes before the rest is read")

    assert next(parse_turtle(Text("<urn:a> <urn:p> <urn:b> .\n$ no token\n"))) == ("urn:a", "urn:p", "urn:b")
