"""Five stages from raw documents to packed training sequences.

Each stage takes what the one before it kept. The quality rules drop documents,
line dedup takes repeated lines out of texts, the Jaccard join leaves one
document of each group of near duplicates, the secret scan masks secrets in
texts, and packing cuts the ids of what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simforge.llm import jaccard, lines, packing, quality, secrets
from simforge.llm.common import documents, scratch, written

#: Language histograms, tokens of a vocabulary and links have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, jaccard.Join(n=5, percent=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("secret_scans", secret_scans), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        # What a stage wrote on the way goes once its result is written.
        with scratch(spark) as kept:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.add(docs)
    return docs
