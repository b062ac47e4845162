import pytest

from quadrille.engine import QueryEngine
from quadrille.ml.neural import UnknownModel
from tests.conftest import rows

DECLARE = '''MODEL "m" { ARCH MLP { HIDDEN [16, 8] } OUTPUT EXCLUSIVE { "A", "B", "C" } }
NEURAL RELATION <urn:predicted> USING MODEL "m" { INPUT { ?s <urn:x0> ?a ; <urn:x1> ?b ; <urn:x2> ?c } FEATURES { ?a, ?b, ?c } }
TRAIN NEURAL RELATION <urn:predicted> { DATA { ?s <urn:x0> ?a ; <urn:x1> ?b ; <urn:x2> ?c ; <urn:gold> ?label } LABEL ?label LOSS cross_entropy OPTIMIZER adam LEARNING_RATE 0.1 EPOCHS 80 BATCH_SIZE 6 }
'''


@pytest.fixture
def engine(spark):
    e = QueryEngine(spark)
    data = [f'<urn:s{i}> <urn:x{j}> "{int(i // 2 == j)}"' for i in range(6) for j in range(3)] + [f'<urn:s{i}> <urn:gold> "{"ABC"[i // 2]}"' for i in range(6)]
    e.update("INSERT DATA { " + " . ".join(data) + " }")
    return e


def test_learned_relation_in_a_query(engine):
    got = engine.query(DECLARE + "SELECT ?s ?l WHERE { ?s <urn:predicted> ?l }")
    assert rows(got) == [(f"urn:s{i}", "ABC"[i // 2]) for i in range(6)]


def test_prediction_in_a_rule(engine):
    engine.query(DECLARE + "SELECT ?s WHERE { ?s <urn:gold> ?l }")
    rule = 'RULE <urn:R> :- CONSTRUCT { ?s <urn:label> ?l . } WHERE { ?s <urn:x0> ?a } ML.PREDICT(MODEL "m", INPUT { SELECT ?s ?a ?b ?c WHERE { ?s <urn:x0> ?a ; <urn:x1> ?b ; <urn:x2> ?c } }, OUTPUT ?l)'
    engine.define_rule(rule)
    engine.define_rule(rule)  # again: the earlier triples are replaced
    assert rows(engine.query("SELECT ?s ?l WHERE { ?s <urn:label> ?l }")) == [(f"urn:s{i}", "ABC"[i // 2]) for i in range(6)]


def test_binary_and_errors(spark):
    e = QueryEngine(spark)
    e.update("INSERT DATA { " + " . ".join(f'<urn:t{i}> <urn:a> "{i // 2}" . <urn:t{i}> <urn:b> "{i // 2}" . <urn:t{i}> <urn:y> "{i // 2}"' for i in range(4)) + " }")
    text = '''MODEL "b" { ARCH MLP { HIDDEN [4] } OUTPUT BINARY { "1" } }
    NEURAL RELATION <urn:yes> USING MODEL "b" { INPUT { ?s <urn:a> ?x ; <urn:b> ?z } FEATURES { ?x, ?z } }
    TRAIN NEURAL RELATION <urn:yes> { DATA { ?s <urn:a> ?x ; <urn:b> ?z ; <urn:y> ?label } LABEL ?label LOSS bce LEARNING_RATE 0.1 EPOCHS 100 }'''
    assert rows(e.query(text + " SELECT ?s ?v WHERE { ?s <urn:yes> ?v }")) == [("urn:t2", "1"), ("urn:t3", "1")]
    with pytest.raises(UnknownModel):
        e.query('ML.PREDICT(MODEL "none", INPUT { SELECT ?s WHERE { ?s <urn:a> ?x } }, OUTPUT ?l) SELECT ?s WHERE { ?s <urn:a> ?x }')


def test_registered_relation_learns_all_labels_from_the_whole_vector(spark, tmp_path):
    from quadrille import catalog

    # labels 1, 5 and 8 differ in the last of 64 components only; the last row has no label
    data = [(i, [float(i % 3)] * 4 + [0.0] * 59 + [4.0 * (i // 20)], (1, 5, 8)[i // 20]) for i in range(60)] + [(60, [0.0] * 63 + [8.0], None)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = [(f"urn:v:{i}", str(k or 8)) for i, _, k in data]
    assert rows(catalog.neural_relation(spark, str(tmp_path))) == sorted(want)
