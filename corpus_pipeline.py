"""A training corpus in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and rereads it
for the next stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import contamination, jaccard, mixing, queries, tokens, toxicity
from quillon.llm.shared import SMALL_GROUPS, small_batches, table, written


#: Tokens of the mixture as a multiple of what the stages before keep.
BUDGET = 1.1


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("tox_score") < queries.TOXIC_AT).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 0.8 on five-word shingles join, the one with the smallest doc_id stays."""
    found = jaccard.similarity_components(docs.select("doc_id", "text"), n=5, threshold="0.8")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def mixed_to_target(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their fitted rate; the least rate is 1, so that none is lost. Domains are learned from all labelled rows, also those dropped before.

    Toxic documents went in the first stage, so that domain's target is none and the others share ``BUDGET`` times the tokens that are left.
    """
    learn = table(spark, sf_dir, "documents").select("doc_id", "text")
    targets = queries.TARGETS | {"toxic": 0.0}
    mixed = mixing.mix(docs, queries.labelled_domains(spark, sf_dir), targets, budget=BUDGET, least=1.0, most=4.0, learn=learn)
    return mixing.repeated(mixed, docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(spark, tokens.write_tokens(docs, queries.tokenizer_path(), end_id=1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_target),
    ("token_output", token_output),
]

#: Sketches, fitted rates and files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name, **SMALL_GROUPS)
        return STAGES[-1][1](spark, docs, sf_dir)
