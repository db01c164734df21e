"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cachelens.llm.base import stored, table
from cachelens.llm.decontaminate import decontaminate
from cachelens.llm.mixing import mix_sources
from cachelens.llm.ngram_join import first_of_groups
from cachelens.llm.quality import drop_low_quality
from cachelens.llm.toxicity import drop_toxic


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that it rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked rows one stays, that with the smallest doc_id; see first_of_groups."""
    return first_of_groups(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows with a benchmark passage go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing of sources to weights that grow as the square root of their sizes, in shuffled order."""
    return mix_sources(docs)


STAGES = [("quality classifier", keep_quality), ("toxicity", keep_clean), ("n-gram Jaccard join", keep_one_of_each), ("benchmark decontamination", keep_uncontaminated), ("mixing sources", mix)]

#: The classifiers and the join can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
