"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, embedding_tiles, langid, license_scan, line_chunks, packing, pii, simhash, suffix_dedup, url_reputation


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of the same number: bad if of low quality or toxic."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_reputation.judge(_read(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_read(spark, sf_dir, "documents")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles.near_links(_read(spark, sf_dir, "embeddings"), least=0.9)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2, keep_ids=False)
    return packed.drop("ids")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedupe(_read(spark, sf_dir, "documents"), width=200, keep_bytes=False))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(_read(spark, sf_dir, "documents"), size=4, most=4))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.digest(_read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_reputation.ORACLE,
        "op3_embedding_dedup": embedding_tiles.ORACLE,
        "op6_suffix_dedup": suffix_dedup.ORACLE,
        "op8_decontamination": decontam.ORACLE,
        "op9_line_dedup": line_chunks.ORACLE,
        "op10_pii": pii.ORACLE,
    }
