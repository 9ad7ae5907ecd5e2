"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from . import conversation_repair, embedding_dedup, language_id, license_scan, minhash_dedup, mixing, ngram_model, pii, quality_classifier, quality_rules, sentencepiece_codec, token_alignment, token_count
from .common import table


def op1_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model())


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_token_count(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.read_vocabulary())


def op8_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lm_scoring(spark, sf_dir):
    return ngram_model.perplexity(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op1_source_mixing": mixing.oracle_sql(), "op6_license_scan": license_scan.oracle_sql()}
