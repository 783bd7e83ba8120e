"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import (
    codebooks,
    decontam,
    html_text,
    line_dedup,
    media_chunks,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    url_filter,
    warc,
    whitening,
)
from graphlens.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages resolved against the latest earlier full response of their URL."""
    return warc.digest(warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages"))))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as chunked media and read back."""
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat an earlier line, up to one to three edits by length."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), bands=line_dedup.BANDS, exact_chars=1)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shuffled shards with counts at most one apart."""
    return sharding.shards(table(spark, sf_dir, "documents"), 24, seed=7).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of at most 4096."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark items, verbatim or paraphrased."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at two or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by 16 codebooks of 64 entries after two rounds."""
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight whitened components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: patterns, and what the random field adds."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, sf_dir)."""
    import corpus_pipeline

    found = (
        op1_warc_revisits,
        op2_main_text,
        op3_media_chunks,
        op4_quality_scores,
        op5_line_dedup,
        op6_url_verdicts,
        op7_two_pass_shuffle,
        op8_packed_sequences,
        op9_benchmark_leaks,
        op10_simhash_components,
        op11_vector_codes,
        op12_whitened_embeddings,
        op13_personal_data,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_warc_revisits": warc.ORACLE_SQL, "op2_main_text": html_text.ORACLE_SQL, "op11_vector_codes": codebooks.ORACLE_SQL}
