"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.  Stages that only drop rows judge
them where they lie, without a shuffle of texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfin.llm import bpe, decontam, linededup, minhash, quality
from tallyfin.llm.common import checkpoint


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go.  It is fitted on labelled rows of this stage's own input."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, machine, 0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common long lines go; text and n_chars are of what stays."""
    kept = linededup.dedup_lines(docs, carry=True)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    flat = kept.select("doc_id", F.col("kept").alias("text"), *(F.col(f"rest.`{c}`").alias(c) for c in rest))
    if "n_chars" in rest:
        flat = flat.withColumn("n_chars", F.length("text").cast("long"))
    return flat.select(*docs.columns)


def _unused(name: str, docs: DataFrame) -> str:
    """A column name like this one that docs does not have, in whatever case."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: that of the least doc_id.

    Of rows that repeat a doc_id with its text, one stays; rows of one doc_id with different texts
    are one document and stay or go together.  A row with a null doc_id is compared like any other,
    under an id made of its text that comes after all others (from 2**62 on); without words it stays.
    """
    made = F.lit(1 << 62).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), made))
    made_up, other = _unused("key", docs), _unused("other", docs)
    keyed = docs.withColumn(made_up, key)
    gone = minhash.near_duplicates(keyed, k=5, percent=80, id_col=made_up).filter("not kept").select(F.col("doc_id").alias(other)).distinct()
    keyless = keyed.filter(F.col(made_up).isNull())  # without words: they take no part, and no join deals them to one task
    keyed = keyed.filter(F.col(made_up).isNotNull())
    rest = keyed.join(gone, F.col(made_up) == F.col(other), "left_anti")
    again = checkpoint(keyed.groupBy(made_up).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(made_up).alias(other)))
    if not again.isEmpty():  # few: only their texts are compared
        same = F.col(made_up) == F.col(other)
        rest = rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates([made_up, "text"]))
    return rest.unionByName(keyless).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's five-word shingles go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the bytes that the ids decode to."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("bpe", token_stage)]

#: Sketches, the fitted model and merge ranks are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
