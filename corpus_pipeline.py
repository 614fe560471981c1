"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import mixing, quality_rules, simhash, substring_dedup
from dosewise.llm.common import read, stored
from dosewise.llm.queries import piece_digest, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's proven cutoffs go."""
    measured = stored(quality_rules.measure(docs.select(*COLUMNS)), "measured-documents")
    chosen = stored(quality_rules.cutoffs(measured, read(spark, sf_dir, "labels")), "cutoffs")
    return quality_rules.judge(measured, chosen).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=4, max_bits=4)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go; documents without any stay as they are."""
    cut = substring_dedup.remove_repeats(docs, carry=["lang", "source", "n_chars"], as_is=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed corpus, encoded and decoded."""
    return piece_digest(docs, piece_model())


STAGES = [("quality rules", rules), ("simhash", near_duplicates), ("substring dedup", substrings), ("mixing", mix), ("sentencepiece", pieces)]

#: The last stage is not for SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
