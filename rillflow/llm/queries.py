"""The queries of the training-data operators, one each, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, langid, loglines, mix, neardup, pieces, rules, suffixdedup, tokenfile, toxic
from .common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; it is read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokenfile(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    files = tokenfile.write(table(spark, sf_dir, "documents"), vocabulary or tokenizer("byte_bpe_50k.json"), end_id=2, special=True)
    return tokenfile.read(files)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mix.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return mix.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), vocabulary or tokenizer("piece_bpe_32k.model"), ["doc_id"])


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_loglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = loglines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_texts")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_tokenfile, op2_mix, op3_fingerprint, op4_langid, op5_suffixdedup, op6_pieces, op7_rules, op8_loglines, op9_toxicity, op10_neardup, pipeline)}
ORACLES = {"op2_mix": mix.ORACLE, "op5_suffixdedup": suffixdedup.ORACLE, "op8_loglines": loglines.ORACLE, "op10_neardup": neardup.ORACLE}
