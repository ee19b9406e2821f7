"""The queries of this package by name, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, conversations, decontaminate, importance, jaccard, langid, mixing, pages, pii, prefixes, repetition, secrets, tokens, whitening


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat")


def op2_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(common.table(spark, sf_dir, "documents"))


def op4_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    held = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.predict(held, learned)


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.train(secrets.samples(docs)))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.inspect(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(common.table(spark, sf_dir, "documents"))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


#: Tokens that op11 allows a text.
LIMIT = 1024


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixes.cuts(prefixes.prefixes(common.table(spark, sf_dir, "documents")), LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars", "fit_tokens")


def op12_digit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond a long


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.repair(conversations.damaged(rows)))


QUERIES = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_bilstm_crf_pii": op2_bilstm_crf_pii,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_zstd_language": op4_zstd_language,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_line_blocks": op7_line_blocks,
    "op8_prefix_join": op8_prefix_join,
    "op9_metric_jaccard": op9_metric_jaccard,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_prefix_counts": op11_prefix_counts,
    "op12_digit_whitening": op12_digit_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_suffix_repetition": repetition.SQL,
    "op7_line_blocks": pages.SQL,
    "op8_prefix_join": decontaminate.SQL,
    "op9_metric_jaccard": jaccard.SQL,
    "op10_poisson_mix": mixing.SQL,
}
