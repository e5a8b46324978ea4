"""The corpus pipeline: toxicity, SimHash near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. ``run`` writes each
stage's rows to shared storage and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import materialize, table
from folia.llm.op3_secrets import redact
from folia.llm.op4_decontaminate import drop_contaminated
from folia.llm.op7_toxicity import drop_toxic
from folia.llm.op8_simhash import one_of_each
from folia.llm.op10_mixing import mix


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus and its labels, rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest doc_id, told apart by doc_id and text."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a test item go, whatever their ids."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets become a mark."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: pieces of documents by shard."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("mixing", mixing)]

#: SQL can't express the classifier, the edit distance or the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
