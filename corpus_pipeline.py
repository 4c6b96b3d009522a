"""A corpus from documents to packed token sequences, each stage written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplescope.llm import decontaminate, near_copies, packing, pii, toxicity
from ripplescope.llm.common import documents, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, documents(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked at a similarity of 0.8 of five-word shingles."""
    return near_copies.drop_near_copies(docs, shingle=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii.QUERY_SECRET)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # workers that have served the stages before have less memory left for known words
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=50_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("decontaminate", without_benchmark),
    ("pii", with_surrogates),
    ("packing", packed),
]

#: Trained scores, fingerprints, keyed permutations and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
