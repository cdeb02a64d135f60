"""From raw documents to packed training sequences: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows the one before kept, and returns them with the columns of documents; the
last returns packed pieces. Between stages the rows are written to the shared folder and read again, so a lost executor never costs
more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import mixing, packing, similar, toxicity
from lexweave.llm.common import settle, table
from lexweave.runtime import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; empty and null texts stay. Learns from the labels of these documents."""
    model = toxicity.trained(toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    named = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}  # an input column may itself be called score
    got = toxicity.scored(docs.withColumnsRenamed(named), model, named["text"])
    return got.where(F.col("score") < toxicity.THRESHOLD).select([F.col(v).alias(k) for k, v in named.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more: the one with the smallest id."""
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document in the mix, repeats included."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage is plain SQL; the tests hold each one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{k}")
    return docs
