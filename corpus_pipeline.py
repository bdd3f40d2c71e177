"""A training corpus from raw documents: quality, near-dedup, personal data, mixture, tokens.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents,
whatever further columns there are and whatever their names. An empty table passes all stages.

Null and empty texts are scored like any text, link with nothing, have no personal data and no tokens.
Rows that share a doc_id share the fate of the id in near_dedup and mixture; a row with a null doc_id is
kept by near_dedup. Null languages and sources are values of their own in the mixture.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import bpe, hyperminhash, mixing, pii, pu_quality
from tableferry.llm.common import documents, written
from tableferry.llm.queries import rank_file

#: Documents of a lower score go.
LEAST_QUALITY = 0.3
SCORE = "quality score of the pipeline"
#: Documents are near duplicates from this Jaccard similarity of their word shingles on, in percent.
NEAR = 80
#: Target shares are present shares to this power, as in op10: rare sources, languages and topics gain. The corpus to be had
#: is so many times as large as the one there is: cells lose what goes beyond their share of that, and no more.
MIX_POWER, MIX_SIZE = 0.7, 1.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects: those that score below LEAST_QUALITY."""
    model = pu_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.scored(docs, model, into=SCORE).where(F.col(SCORE) >= LEAST_QUALITY).drop(SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near duplicates, and all that have none."""
    gone = written(hyperminhash.near_duplicates(docs, threshold=NEAR).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = gone.count() <= hyperminhash.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars is counted anew. Other texts stay as they are."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins cells of source, language and topic to what the raked mixture asks of them, by a hash of the ids: a rerun keeps
    the same ones. Cells that have no more than that keep every document; none is repeated."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    return mixing.mixed(rows, power=MIX_POWER, rate=1 / MIX_SIZE).where("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as little-endian unsigned 32-bit integers."""
    rows = bpe.encode(docs, rank_file(), public_tokenizers.PATTERN)
    return rows.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
