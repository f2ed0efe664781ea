"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, lines, near_copies, quality, sentencepiece_fst
from lumenfold.llm.common import cut, mark, release, table

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the adaptive quality cutoffs of their language and source."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly so, are taken out of the texts; every document stays."""
    kept = lines.remove_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    Fingerprints through the vantage-point tree first, each link verified; what lies beyond two bits by bands.
    """
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip of every document that is left."""
    import public_tokenizers

    return sentencepiece_fst.encode_report(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express fingerprints and token ids; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, start, keep=1)  # all that the stage stored, and its input
    return docs
