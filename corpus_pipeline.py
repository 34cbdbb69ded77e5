"""From raw documents to packed training sequences.

Defined results, for every stage: a table without rows gives one without rows; further columns are kept by all stages but the
last, whatever their names; rows that repeat are each treated as their operator says; long texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import linededup, mixing, neardup, packing, toxicity
from peerlens.llm.common import discard, materialise, tidied


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    A null or empty text has the score of a text that tells nothing, and stays unless most labelled rows are toxic; a row
    with a null doc_id is scored like others; repeated rows stay or go together; labels that are null are not learnt from."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a larger id keeps.

    A null text stays null, a text that loses all lines is empty; rows with a null doc_id keep all lines and count for
    none; rows that share a doc_id are one document, so they keep or lose a line together; n_chars follows the text."""
    return linededup.apply(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Documents without a word and rows with a null doc_id stay; rows that share a doc_id are one document and all stay or go."""
    return neardup.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as before on average, with equal shares of all sources.

    A null source is a source; a null doc_id counts as the empty id; rows that share a doc_id are repeated equally often."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences.

    A null or empty text is the closing id alone; every row is packed, repeated ones each; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tidied():
            made = materialise(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity models and token ids aren't within SQL's reach; tests/llm holds the stages against brute force.
ORACLE_SQL = None
