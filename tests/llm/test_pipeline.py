import corpus_pipeline
from tidemill.llm import decontaminate, minhash, pii
from tidemill.llm.common import fresh, table
from tidemill.llm.queries import queries
from tidemill.llm.sql import oracle_sql


def test_stages(spark, sf_dir):
    """Each stage does what its operator does to the rows before it, and nothing else."""
    docs = table(spark, sf_dir, "documents")
    before = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        counts.append(after.count())
        before = after
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    assert minhash.find(before).groupBy("root").count().where("count > 1").isEmpty()
    assert decontaminate.find_contamination(before, table(spark, sf_dir, "benchmark")).where("n_hit > 0").count() == 0
    assert all(not pii.base_spans(r.text) for r in before.collect())
    assert all(r.n_chars == len(r.text) for r in before.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == counts[-1]


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"] and got.count() > 100
    assert queries().keys() >= oracle_sql().keys() and {k.split("_")[0] for k in queries()} == {f"op{n}" for n in range(1, 11)}


def test_cases(spark, documents, nothing, sf_dir):
    for df in (documents, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf_dir).columns == df.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()
    assert fresh(documents, "ROW") == "_ROW"
