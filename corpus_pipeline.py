"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages ``run`` writes Parquet to
the shared folder and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listwright.llm import classify, decontaminate, mixing, near_dedup
from listwright.llm.common import crc_mod, keep, table
from listwright.llm.line_dedup import LineDedup


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the FTRL model calls toxic go."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return classify.without_toxic(docs, classify.fit_toxicity(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more in 5 documents and more stay in the largest doc_id only."""
    return LineDedup.of(docs).apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate component stays."""
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in a global random order; adds copy_no and shuffle_key."""
    return mixing.shuffled(mixing.mix(docs, mixing.TARGETS))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]

#: The first stage's fit is not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
