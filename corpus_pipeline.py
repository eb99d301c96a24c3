"""A corpus pipeline of five stages over `documents`, each of which calls one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm import bpe, decontaminate, jaccard, quality, secrets
from seqweft.llm._arrow import written

#: Least quality score that stays.
LEAST_QUALITY = 0.7
#: What takes the place of a secret.
MASK = "[SECRET]"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of LEAST_QUALITY or more stay. Null and empty texts are scored like others."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words all stay."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts stay; rows that repeat an id are judged one by one."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; findings in their texts are replaced by MASK, and n_chars follows. Null and empty texts stay as
    they are; rows that repeat an id or a text are masked one by one."""
    return secrets.mask(docs, MASK)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left, one row each, repeated ones too. Null and
    empty texts have no tokens; of pairs with equal ranks the leftmost is joined first."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", bpe_stage),
]

#: The classifier, the network and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
