"""Corpus pipeline: five stages over ``documents``, each written and read again as Parquet.

1. language ID        documents whose language margin is narrow, or without a letter, go
2. near duplicates    of each class of the n-gram Jaccard join (five words, 0.8) the smallest doc_id stays
3. decontamination    documents contaminated by the benchmark go
4. secrets            every secret in a text is replaced by a mark; all documents stay
5. byte-level BPE     token ids of every document, as digests, with the decoded bytes' digest

A stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``; columns beyond those pass through.  Rows that repeat a kept
document (same doc_id) are one document and stay once; of different texts under
one doc_id the one with the smallest md5 stays.  Rows with a null doc_id are
documents of their own, and of those with equal texts one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark.llm import bpe, decontaminate, jaccard_join, langid, secret_scan
from tailorspark.llm.queries import bpe_digests
from tailorspark.llm.store import id_bucket, stored

#: Words of a gram and least Jaccard in percent of the near-duplicate stage; ``op5`` has values of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    usable = id_bucket(F.col("doc_id"), 3) != 1
    found = langid.identify(docs, langid.fit_dictionaries(docs, usable))
    return found.where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = classes.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.md5("text"), F.lit("~"))).alias("_row")).select("_row.*")
    unnamed = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return named.unionByName(unnamed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark)
    bad = found.where("contaminated").select("text_md5").distinct()
    return docs.join(bad, decontaminate.text_key(docs["text"]) == bad["text_md5"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as t
    return bpe_digests(bpe.round_trip(docs, t.path("byte_bpe_50k.tiktoken"), t.PATTERN))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", byte_bpe),
]

#: Compression sizes and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
