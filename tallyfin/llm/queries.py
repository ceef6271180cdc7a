"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfin.llm import ann, bpe, decontam, html, licences, linededup, minhash, pii, quality, repeats, spelling, tokencount, vqcode
from tallyfin.llm.common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir)).drop("spans")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir)).drop("found")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeats.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return marked.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vqcode.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a cache of its own, which is empty at first: every distinct text is encoded once, appended and read."""
    return tokencount.count_tokens(documents(spark, sf_dir), tokencount.default_tokenizer(), tokencount.fresh_cache(spark))


QUERIES = {"op1_bpe": op1_bpe, "op2_neighbours": op2_neighbours, "op3_quality": op3_quality, "op4_near_dedup": op4_near_dedup, "op5_line_dedup": op5_line_dedup, "op6_licences": op6_licences, "op7_personal_data": op7_personal_data, "op8_html": op8_html, "op9_repeats": op9_repeats, "op10_decontamination": op10_decontamination, "op11_spelling": op11_spelling, "op12_vector_codes": op12_vector_codes, "op13_token_counts": op13_token_counts}
ORACLES = {"op4_near_dedup": minhash.ORACLE, "op9_repeats": repeats.ORACLE, "op5_line_dedup": linededup.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_spelling": spelling.ORACLE, "op12_vector_codes": vqcode.oracle_sql()}
