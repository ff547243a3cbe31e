"""A corpus pipeline of five stages over ``documents``, each working on what the one before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's input. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.llm import line_dedup, minhash_dedup, mixing, packing, quality

#: No SQL: scores, near-duplicate links and tokens are beyond it; tests compare stages with brute force.
ORACLE_SQL = None

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the input's rows."""
    model = quality.train_on_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    kept = quality.score_texts(rows, model).filter(F.col("quality_score") >= LEAST_QUALITY)
    return kept.select(*[F.col(f"row.`{c}`") for c in columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur on ten sites or more; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, min_sites=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest doc_id) of each group of near duplicates; documents without words stay."""
    return minhash_dedup.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
