"""The training-data pipeline: five stages over `documents`, each written as
Parquet to the shared folder and read again as the next one's input.

1. quality classifier: documents that it rejects go.
2. MinHash near-dedup: one document of each class of near copies stays.
3. benchmark decontamination: documents that leak a test item go.
4. secret scans: secrets in the text are replaced by a mark.
5. BPE: the remaining texts are encoded; ids and the decoded text come out.

All stages but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlore.llm import edit_leaks, order_minhash, prefix_bpe, secret_scan, site_quality
from chartlore.llm.common import table, word_model
from chartlore.session import drop_staged, staged, staged_count


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return edit_leaks.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = prefix_bpe.encode_and_decode(rows, word_model(), ids="token_ids", decoded="decoded")
    return coded.select("doc_id", "lang", "source", prefix_bpe.token_counts(F.col("token_ids")).alias("n_tokens"),
                        "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", bpe),
]

#: The classifier and the sketches have no SQL form; tests compare each stage's
#: decisions with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), staged_count(spark)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        drop_staged(spark, mark, keep_last=True)  # the stage's input and what it wrote on the way
    return docs
