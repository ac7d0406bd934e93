"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before wrote as Parquet in the shared folder, so a lost executor repeats tasks of one stage
only. With a work folder, stages are written there under their own names, and a driver that is started again with the
same folder goes on after the last stage that was finished; a new input needs a new folder. Near-duplicates are found on
sets of five-word shingles with a similarity of 0.8 or more.

Defined cases: null or empty texts fail the quality rules; labels may be missing altogether (the base rules then decide);
null doc_ids are carried; repeated rows are copies; columns besides those of documents are carried to the last stage;
empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm.common import materialize, table, written
from marketloom.llm.exact_dedup import dedup_documents
from marketloom.llm.mixing import mix_documents
from marketloom.llm.near_dedup import near_dedup_documents
from marketloom.llm.packing import pack_documents
from marketloom.llm.quality import judged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return judged(docs, table(spark, sf_dir, "labels"), carry=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source comes to its target."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No stage but exact dedup can be written in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        if work is None:
            docs = materialize(stage(spark, docs, sf_dir), "stage", keep=True)
        else:
            docs = written(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"{work}/{k}-{name.replace(' ', '-')}")
    return docs
