"""The corpus pipeline on odd rows, and what it leaves on disk."""

import os

from pyspark.sql import functions as F

from stackloom.checkpoints import folder, temporary

SF = "/root/testdata/sf0.001"


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "plain words of no harm stand in here"), (3, "plain words of no harm stand in here"), (None, "no id at all"), (None, None), (4, "word " * 60_000), (5, "write to some.one@mail1.example.com soon")]
    docs = spark.createDataFrame([(k, t, "en", "s", 7, "mine", "own", "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, Leaks string, n_entities string, _toxicity string")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            now = spark.createDataFrame(out.collect(), docs.schema)
            assert {(r.Leaks, r.n_entities, r._toxicity) for r in now.collect()} <= {("mine", "own", "x")}
        assert sorted(str(r.doc_id) for r in now.collect()) == sorted(str(r[0]) for r in rows if table is docs)
        last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert len(last) == now.count() and all((r.n_tokens == 0) == (r.doc_id in (1, 2) or r.ids_sha256.startswith("e3b0c442")) for r in last)


def test_run_leaves_one_table(spark):
    import corpus_pipeline

    before = set(os.listdir(folder(spark).removeprefix("file:")))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    after = set(os.listdir(folder(spark).removeprefix("file:")))
    assert len(after - before) == 1
    with temporary():
        assert corpus_pipeline.run(spark, SF).select(F.sum("n_tokens")).first()[0] > 0
    assert len(set(os.listdir(folder(spark).removeprefix("file:"))) - after) <= 1
