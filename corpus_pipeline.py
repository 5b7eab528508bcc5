"""From raw documents to packed training sequences, stage by stage.

Each stage takes the whole table that the one before kept. ``run`` writes every stage to the session's shared
folder and reads it again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, line_chunks, packing, simhash
from quillon.llm.common import numbered, store, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; texts without a letter go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    return docs.where(langid.predict(model, F.col("text"))["lang_pred"] != "und")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two lines or more that stood before taken out of the texts; n_chars follows the text."""
    out = line_chunks.without_passages(docs)
    if "n_chars" in docs.columns:
        changed = F.col("__removed_lines") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word similarity 0.8 or more, and what that joins): the smallest id.

    A row without an id stays if no row of its group has one. Rows are known by a number of their own. What stays
    grows with the corpus, so it is sort-merged."""
    rid = unused(docs, "__rid")
    rows = store(numbered(docs, rid))
    kept = simhash.similar_kept(rows, rid)
    return rows.join(kept.hint("merge"), rid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item, decided row by row."""
    rid = unused(docs, "__rid")
    rows = store(numbered(docs, rid))
    searched = decontam.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rid=rid)
    hit = store(searched.where(F.size("spans") > 0).select(F.col("rid").alias(rid)))
    return rows.join(hit.hint("merge"), rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024 tokens at most with their places in sequences, with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("clean", clean), ("packed", packed)]

#: SQL has neither the tokenizer nor the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
