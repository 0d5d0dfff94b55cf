"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the caller writes what it returns as Parquet and reads it
again for the next. All but the last return the columns of documents, in their order, extra ones of any name too.

Edge cases: an empty table stays empty through all stages; documents whose text is null or blank fail the base rules of the first stage and go; a null
source, lang or n_chars stays null (n_chars is counted anew for each text where the column is there); rows that repeat a doc_id are judged by
their own texts, except that near dedup takes them as one node, so they stay or go together, and a null doc_id is always kept there; texts
of any length are taken whole; ties are settled by the smallest doc_id in line and near dedup and taken together in mixing. Without labels no rule
is certified, and the base rules alone decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import line_dedup, mixing, near_dedup, quality, transducer
from tandem.llm.common import table
from tandem.llm.queries import PIECE_MODEL


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs, _labels(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts, all but their first place; n_chars follows."""
    clean = line_dedup.remove_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row of the mix."""
    return transducer.encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The last stage can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
