"""From raw documents to a token store: quality, near-duplicates, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.  ``run`` writes
every stage's result to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, mixing, neardup, quality, tokenstore


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below their language's threshold."""
    common.prepare(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.prepare(spark)
    return neardup.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    common.prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mixture takes them (0 to 3 times, rounded)."""
    common.prepare(spark)
    return mixing.sampled(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the content-addressed store, read back: doc_id, start, n_tokens, ids_crc32."""
    common.prepare(spark)
    return tokenstore.read_store(tokenstore.write_store(docs, common.shared_dir(spark, "tokens")))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token ids", store_tokens),
]

#: Language model scores and signatures are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
