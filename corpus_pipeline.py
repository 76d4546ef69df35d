"""From raw documents to packed sequences: the STAGES, and run() that applies them to a folder of tables.

Each stage's result is written as Parquet into the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import decontaminate, langid, packing, simhash, suffixes
from doclens.llm.common import discard, remainder_of, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or without any letter) go.

    Whether a text has a letter decides alone: neither the predicted language nor its score, however low, removes a row.
    """
    held = F.coalesce(remainder_of("doc_id", 4) == 2, F.lit(False))
    profiles = langid.learn(docs.where(~held))
    known = langid.identify(docs, profiles, carry=tuple(c for c in docs.columns if c != "doc_id"))
    return known.where("lang_pred <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash, the document with the smallest id stays."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts; n_chars is that of what is left."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of the documents and their places in sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]

#: Language profiles, fingerprints by XXH64 and token ids can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            if k:
                discard(before)
    return docs
