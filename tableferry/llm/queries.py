"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compaction, decontamination, divergence, hyperminhash, kd_search, mixing, pii, pu_quality, repeats, sketches, url_templates, whitening
from .common import documents, scratch_path

#: The rules of op3 as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def rank_file() -> bytes:
    with open(public_tokenizers.path(RANK_FILE), "rb") as f:
        return f.read()


def op1_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = kd_search.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return kd_search.top_k(base, base.where("id % 100 = 0"))


def op2_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op3_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.quality(documents(spark, sf_dir, "doc_id", "text"), labels)


def op6_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals of documents, compacted: the rows as the committed manifest has them, with its version, how
    many tiers are still full, and whether the shards hold the rows that the manifest lists."""
    docs = documents(spark, sf_dir)
    table = compaction.ShardedTable(spark, scratch_path(spark, "sharded"), docs.schema)
    table.append_all(docs, F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    before = table.manifest().count()
    version = table.compact()
    table.vacuum()
    shards = table.manifest()
    listed = shards.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    facts = {"version": version, "full_tiers": len(table.full_tiers(shards)), "fewer_shards": shards.count() < before, "listed_rows": listed, "sound": table.sound()}
    return table.read().select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source", "n_chars", *(F.lit(v).alias(k) for k, v in facts.items()))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), rank_file(), public_tokenizers.PATTERN)


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(documents(spark, sf_dir, "doc_id", "text"))


def op9_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir, "doc_id", "text"))


def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, sf_dir))
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "chance", "kept", "residual")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


def op13_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_top_k,
        op2_threshold_sketch,
        op3_path_templates,
        op4_hyperminhash,
        op5_pu_quality,
        op6_size_tiered_compaction,
        op7_prefix_bpe,
        op8_prefix_doubling,
        op9_disguised_pii,
        op10_raked_mixture,
        op11_embedding_whitening,
        op12_source_divergence,
        op13_positional_index,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_kd_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e)::BIGINT AS score
            FROM v q JOIN v b ON b.vec_id <> q.vec_id AND len(b.e) = len(q.e) WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_size_tiered_compaction": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars, 2 AS version, 0 AS full_tiers, true AS fewer_shards, (SELECT count(*) FROM documents) AS listed_rows, true AS sound FROM documents",
    "op12_source_divergence": divergence.SQL,
    "op13_positional_index": decontamination.SQL,
}
