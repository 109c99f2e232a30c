"""A corpus pipeline of five stages, each over all that its predecessor kept.

toxicity -> MinHash near-dedup -> suffix-array dedup -> mixing -> byte-level BPE. All but the last return the columns
of ``documents``; the last returns ids. Nothing here needs a local path: tables are read and written by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import byte_bpe, minhash_dedup, mixing, suffix_dedup, toxicity
from tracegrain.llm.common import staged
from tracegrain.shipping import ship

#: Documents that score this high are rejected.
TOXIC = 0.7
#: Words of a shingle, and the similarity in percent from which documents are near-duplicates.
WIDTH, PERCENT = 5, 80
#: What the last stage says of a document's place in the mixture.
MIXED = ("block", "slot", "place")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC. Labels are learned on the rows outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates. Rows without an id stay."""
    found = minhash_dedup.near_duplicates(docs, width=WIDTH, percent=PERCENT)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words, or 400 bytes, and more that occur anywhere else; n_chars follows the text.

    Passages are made of repeated strings of 256 bytes, which 50 words of prose are longer than.
    """
    out = suffix_dedup.without_repeats(docs, suffix_dedup.PASSAGE, suffix_dedup.WORDS)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.mixed(docs).orderBy("_slot", "_place").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of every text, with its block, slot and place in the mixture, in that order.

    A table that is written and read again comes in no order, so the mixture is ranked again, from the same rows to the same places.
    """
    import public_tokenizers

    rows = mixing.mixed(docs.select("doc_id", "source", "text")).withColumnsRenamed({f"_{c}": c for c in MIXED}).orderBy("slot", "place")
    return byte_bpe.encode_with_digests(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=MIXED)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: A learned model and a suffix sort are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.orderBy("slot", "place")
