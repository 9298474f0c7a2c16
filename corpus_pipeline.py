"""From raw documents to packed token rows, in five stages that each decide on what came before.

Every stage is a function of (session, documents, folder of tables). All but the last return the
columns they were given; a stage's result is written to the shared checkpoint folder and read again
by the next one, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm import decontaminate, mixing, neardup, packing, quality
from verdictflow.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones of ``docs``."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by similarity."""
    return neardup.deduplicate(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of one length."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", keep_first_of_near_duplicates),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("token packing", pack_tokens),
]

# Training, hashing and token ids have no SQL twin; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
