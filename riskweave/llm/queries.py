"""Registered queries of the training-data operators, over the whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, chat, classifier, fingerprint, mixing, near_dedup, pitman_yor, prefix_trie, quality_rules, substring, token_counts, url_graph, whitening
from riskweave.llm.oracle import NEAR, REPEATS, RULES_SQL, TRIE, TURNS, mix_sql, urls_sql
from riskweave.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

# The tree of target weights: domains are groups of sources; names that are not listed weigh 1.
DOMAINS = {"core": 5, "web": 3, "rest": 2}
WEIGHTS = [*(("domain", n, float(w)) for n, w in DOMAINS.items()), ("lang", "en", 4.0), ("lang", "de", 2.0), ("lang", "fr", 2.0), ("lang", "es", 1.0), ("source", "src0", 2.0)]
MIX_FRACTION, MIX_EPOCHS = 0.5, 2
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def domain():
    """The domain of a source: src0 to src4 are core, src5 to src14 web, all else rest."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,9})$", 1).try_cast("int")
    return F.when(number < 5, "core").when(number < 15, "web").otherwise("rest")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "level string, name string, w double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@query("op1_quality_rules", RULES_SQL)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_near_dedup", NEAR)
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), k=2, percent=80)


@query("op3_chat_format", TURNS)
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"  # a text that holds the template's own marks
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return chat.digests(chat.format_chats(chat.events(rows.unionByName(more))))


@query("op4_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), PATTERN)


@query("op5_mixing", mix_sql(WEIGHTS, MIX_FRACTION, MIX_EPOCHS))
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mix(docs, weights(spark), MIX_FRACTION, domain(), epochs=MIX_EPOCHS)
    return taken.select("doc_id", "lang", "source", "mix_domain", "mix_epoch", "mix_tokens")


@query("op6_substring_dedup", REPEATS)
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.cut_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_byte_bpe")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, PATTERN), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_pitman_yor")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


@query("op9_classifier")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_fingerprints")
def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints_and_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "component_id", "kept")


@query("op11_whitening")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query("op12_url_filters", urls_sql(URL_RULES))
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op13_prefix_trie", TRIE)
def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
