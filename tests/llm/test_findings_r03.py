"""The whole job where the review of round 3 found less."""

import corpus_pipeline
from quillon.llm import mixing, tokens
from quillon.llm import queries as Q
from quillon.llm import shared
from tests.llm.test_findings_r02 import _largest_group, _random_docs

ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def test_mixing_hands_on_small_pieces(spark, tmp_path, monkeypatch):
    """a caller who writes the fourth stage with Spark's own row groups held 64 MB of texts a task, too much for eight of them in 1 GB."""
    monkeypatch.setattr(mixing, "PIECE_BYTES", 1 << 19, raising=False)
    none = spark.createDataFrame([], "doc_id long, domain string")
    mixed = mixing.mix(_random_docs(spark, 24), none, {"clean": 1.0}).where("mix_rate = 1")
    mixed.write.parquet(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").select("doc_id").distinct().count() == 24_000
    assert _largest_group(tmp_path / "out") < 3 << 19


def test_whole_texts_are_read_a_few_at_a_time(spark, monkeypatch):
    """eight readers with 4,096 texts of some KB each filled the heap in mixing, and then in the token output."""
    seen = []

    def noting(f):
        return lambda *a, **b: (seen.append(int(spark.conf.get(ROWS))), f(*a, **b))[1]

    before = spark.conf.get(ROWS)
    docs = shared.table(spark, "/root/testdata/sf0.001", "documents")
    monkeypatch.setattr(mixing, "written", noting(mixing.written))
    mixing.mix(docs, Q.labelled_domains(spark, "/root/testdata/sf0.001"), Q.TARGETS)
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", noting(frame.mapInArrow))
    tokens.write_tokens(docs, Q.tokenizer_path())
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", noting(lambda spark, docs, sf_dir: docs)), ("two", noting(lambda spark, docs, sf_dir: docs))])
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(seen) == 6 and max(seen) <= 256 and spark.conf.get(ROWS) == before
