"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, SentencePiece ids.

Each stage takes what the one before kept; all but the last return the columns of documents. Texts change where a stage
decides so: personal data is redacted, and the mix repeats documents; where a source's words run out inside a document,
that copy is the unchanged beginning of its text.

Defined results are those of the operators: null texts count as empty, repeated ids keep a row each up to
near-deduplication, which keeps one document of each class, so ids of different texts may still repeat after it; the mix then
places each distinct (id, text) row. Extra columns of the input go along to the mix. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bagminhash, chains, mixing, pii, segment
from tessitura.llm.common import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the toxic ones."""
    return chains.clean(docs, chains.chain_for(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return bagminhash.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selected spans replaced by their kind; n_chars follows the text."""
    d = pii.redact(docs)
    return d.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in d.columns else d


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    d = mixing.apply(docs, staged(mixing.mix(docs), "mix-plan"))
    return d.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in d.columns else d


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, the next best segmentations as edits of them, and the text that the ids give back.
    A document that the mix repeats has a row for each copy."""
    e = segment.encode(docs, segment.default_model(), back=True)
    return e.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "score", "ids", "alternatives", "decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("sentencepiece", pieces)]

#: No stage but the mix can be said in SQL; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
