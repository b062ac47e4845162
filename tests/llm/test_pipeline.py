"""Each stage of the pipeline on what its predecessor kept."""

import corpus_pipeline
from quadrille.llm import classifier, common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    labels = common.read(spark, SF, "labels")
    names = docs.columns
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near dedup", "decontamination", "mixture", "token output"]
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, SF), "t")
        assert now.columns == names
        kept[name] = ids(now)
    model = classifier.train(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, t in text.items() if model.score(classifier.np.array([classifier.document_statistics(t)]))[0] >= classifier.THRESHOLD}
    assert set(kept["quality classifier"]) == good
    assert set(kept["near dedup"]) < good and len(set(kept["near dedup"])) == len(kept["near dedup"])
    assert set(kept["decontamination"]) < set(kept["near dedup"])
    assert len(kept["mixture"]) > len(kept["decontamination"])
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept["mixture"])
    assert sorted(r.start for r in out)[0] == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
