"""The corpus pipeline: quality rules, near-deduplication, substring deduplication, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, mixing, near_dedup, quality_rules, substring
from riskweave.llm.queries import PATTERN, RANKS, domain, table, weights
from riskweave.session import cut, prepare

MIX_FRACTION = 0.8  # of the tokens that reach the stage; each document once at most

# The last stage is not expressible in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality_rules.apply(docs, table(prepare(spark), sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return near_dedup.near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that occur earlier go; the texts keep the rest."""
    prepare(spark)
    return substring.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budget of their domain, language and source."""
    prepare(spark)
    return mixing.mix(docs, weights(spark), MIX_FRACTION, domain(), epochs=1).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document."""
    prepare(spark)
    ranks = bpe.read_ranks(RANKS)
    coded = bpe.decode(bpe.encode(docs, ranks, PATTERN), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("mixing", mixture),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
