"""A training corpus from raw documents: five stages, each over all rows its predecessor kept.

Toxic documents go; of equal texts one stays; of near copies one stays; sources are mixed to their
target weights; what is left is encoded. Every stage is written as Parquet in the shared folder and
read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tabsmith.llm.queries import table, vocabulary
from tabsmith.session import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is at the threshold or above; NULL texts count as empty."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, net)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity about 0.8 or more) keep the smallest doc_id."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their targets: a row for each document and pass, with the words taken; n_chars follows."""
    mixed = mixing.mix_texts(docs, weights=(3, 1, 2), share=1.5, most=2.0)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and decode the ids again: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    import public_tokenizers

    ranks = bpe.read_ranks(spark, vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages learn weights and hash, which SQL cannot express; tests/llm compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
