"""Raw documents to packed token sequences: quality rules, language, near duplicates, repeated passages, packing.

Every stage but the last returns rows of documents' own columns; `run` writes each stage to the shared folder and reads
it back as the next one's documents. A stage's result depends on its input (and the labels) alone.

Defined cases, as its operator has them: null and blank texts fail the base rule and go; texts of any length are read
whole; of tied copies the smallest doc_id stays; repeated rows share a doc_id, so they stay or go together as copies, and
each is packed; empty tables give empty results; documents' further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatlattice.llm import jaccard, langid, packing, quality, suffix
from heatlattice.llm.common import staged
from heatlattice.llm.queries import table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rule or lies above a certified cutoff of its language."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those beyond their predicted language's calibrated cross-entropy."""
    return langid.filter_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of five-word shingle sets linked at a similarity of 0.8 or more; rows without a doc_id stay."""
    return jaccard.near_duplicates_removed(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes covered by 100-byte strings that start earlier; half a character at a cut goes, too, and n_chars follows."""
    out = suffix.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of the token sequences; null texts cannot come here."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Kneser-Ney models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
