"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, decontam, disclosure, langid, licenses, negatives, ngram_lm, oracles, partenum, quality, runs, sharding, toxicity, unigram_count
from .shared import read_table


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id, written as text, has this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out(3, 1)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), "offending")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = ngram_lm.score(docs, ngram_lm.fit(docs.where(~held_out(5, 1)).select("text")))
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", ngram_lm.perplexity().alias("perplexity"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read_table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(~held_out(5, 0)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, language_model(docs)).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "shares")


def vocabulary_path(name: str) -> str:
    """A public tokenizer's file; workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h the crc32 of doc_id, written as text, every text of h % 10 = 0 becomes periodic from its
    word a on: word i is the original word a + (i - a) % p. Other texts stay as they are."""
    repeated = """transform(array(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')), ws ->
        transform(array(g % size(ws)), a -> transform(array(1 + (size(ws) - a) div (3 + g % 8)), p ->
        array_join(transform(sequence(0, size(ws) - 1), i -> get(ws, CAST(if(i < a, i, a + (i - a) % p) AS INT))), ' '))[0])[0])[0]"""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    return out.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(with_planted_repeats(read_table(spark, sf_dir, "documents"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(negatives.scaled(rows, 256), modulus=50)


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(disclosure.sanitised(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ngram_lm": op2_ngram_lm,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_quality_rules": op4_quality_rules,
        "op5_licence_scan": op5_licence_scan,
        "op6_token_counts": op6_token_counts,
        "op7_feistel_shards": op7_feistel_shards,
        "op8_language_id": op8_language_id,
        "op9_bpe_stream": op9_bpe_stream,
        "op10_decontamination": op10_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_disclosure": op13_disclosure,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": oracles.JACCARD, "op4_quality_rules": oracles.QUALITY, "op12_hard_negatives": oracles.NEGATIVES, "op13_disclosure": oracles.DISCLOSURE}
