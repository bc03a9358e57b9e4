"""The corpus pipeline against its stages by brute force."""

import collections

import public_tokenizers

import corpus_pipeline
from tally.llm import mixing, sentencepiece, toxicity
from tally.llm.shared import documents

from test_operators import plain_components, plain_simhash, words

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    import __spark_entry__ as e
    assert e.queries()["pipeline"] is corpus_pipeline.run
    docs = documents(spark, SF)
    grammar = toxicity.learn(docs, documents(spark, SF, "labels"))
    rows = [r for r in docs.collect() if grammar.score(r.text) < toxicity.THRESHOLD]
    component = plain_components([(r.doc_id, plain_simhash(r.text)) for r in rows])
    kept = [r for r, c in zip(rows, component) if r.doc_id == c]
    assert 0 < len(kept) < len(rows) < docs.count()
    copies, c = mixing.mix(spark.createDataFrame(kept, docs.schema))
    want = {r.doc_id: r[c["copies"]] for r in copies.collect() if r[c["copies"]]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in out) == want
    codec = sentencepiece.codec(public_tokenizers.path(sentencepiece.MODEL))
    assert all(r.decoded_text == r.text and words(r.text) for r in out)
    assert [r.token_ids for r in out[:50]] == [codec.encode(r.text).tolist() for r in out[:50]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
