"""Corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import bpe, mixing, simhash, suffixdedup, toxicity
from tenderlake.llm._common import DOC_COLUMNS, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on all marked rows, does not reject."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).where("predicted = 0").select(*DOC_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word shingle similarity of 0.8 or more."""
    return simhash.dedup(docs).select(*DOC_COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that start earlier; cut characters go whole."""
    cut = suffixdedup.remove_repeats(docs, carry=["lang", "source"], as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*DOC_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, and a last one cut, as the source targets ask."""
    return mixing.mixture(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the decoded bytes."""
    import public_tokenizers as P

    return bpe.digests(bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the learnt stages; a test holds the simhash stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, written as Parquet between them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
