"""The whole job where the review of round 2 found less."""

import random
from pathlib import Path

import corpus_pipeline
from quillon.llm import mixing
from quillon.llm import queries as Q
from quillon.llm.shared import SWEEP


def _random_docs(spark, mb: int):
    """Texts that hardly compress, in one partition: a thousand rows a megabyte."""
    r = random.Random(5)
    rows = [(i, " ".join(r.randbytes(8).hex() for _ in range(60))) for i in range(mb * 1000)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def _largest_group(folder) -> int:
    import pyarrow.parquet as pq

    found = [pq.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
    return max(m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups))


def test_pipeline_and_mixing_hold_small_row_groups(spark, tmp_path, monkeypatch):
    """eight writers and readers with 55 MB of texts in one row group each filled a heap of 1 GB in the fourth stage."""
    monkeypatch.setattr("quillon.llm.shared.shared_root", lambda spark: f"file://{tmp_path}/mix")
    docs = _random_docs(spark, 24)
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(docs, none, {"clean": 1.0}).count() == 24_000
    assert _largest_group(tmp_path / "mix") < 12 << 20
    monkeypatch.setattr("quillon.llm.shared.shared_root", lambda spark: f"file://{tmp_path}/run")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda spark, docs, sf_dir: docs), ("two", lambda spark, docs, sf_dir: docs)])
    assert corpus_pipeline.run(spark, "").count() == 24_000
    assert _largest_group(tmp_path / "run") < 12 << 20


def test_jaccard_join_leaves_no_shuffle_files(spark):
    """Second finding (no number): the files of finished steps stayed on the disks until the driver collected its garbage, so the join's peak was the sum of its steps."""
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f: f.stat().st_size for d in disks for f in Path(d).rglob("shuffle_*.data")}

    before = files()
    spark.conf.set(SWEEP, "false")
    try:
        found = Q.op7_jaccard_join(spark, "/root/testdata/sf0.01")
        assert spark.conf.get(SWEEP) == "false"
    finally:
        spark.conf.unset(SWEEP)
    assert sum(n for f, n in files().items() if f not in before) < 50_000
    assert found.count() == 1000
