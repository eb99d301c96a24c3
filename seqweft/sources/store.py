"""Edges kept for later comparisons: Parquet by k and colour, in order within files.

Counts add up, so a collection is added without reading what is there: its edges become another batch, and a reader sums
the batches. Colours and columns that aren't asked for aren't read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.operators import bwsd
from seqweft.operators.edges import edges

_SCHEMA = "kmer string, W string, coverage long, batch string, color string"


def _place(path: str, k: int) -> str:
    return f"{path.rstrip('/')}/edges-{k}"


def add(path: str, e: DataFrame, k: int) -> None:
    """Adds edges (color, kmer, W, coverage) of k symbols to the store, which needn't exist yet."""
    placed = e.select("color", F.reverse("kmer").alias("r"), "kmer", "W", "coverage").repartitionByRange("color", "r").sortWithinPartitions("color", "r", "W")
    placed.select("kmer", "W", "coverage", F.lit(uuid.uuid4().hex).alias("batch"), "color").write.mode("append").partitionBy("batch", "color").parquet(_place(path, k))


def read(spark: SparkSession, path: str, k: int, colours: list[str] | None = None) -> DataFrame:
    """(color, kmer, W, coverage) of all colours, or of those named."""
    e = spark.read.schema(_SCHEMA).parquet(_place(path, k))
    e = e if colours is None else e.where(F.col("color").isin(colours))
    return e.groupBy("color", "kmer", "W").agg(F.sum("coverage").alias("coverage"))


def compare_with(spark: SparkSession, path: str, new: DataFrame, k: int, coverage: bool = False) -> DataFrame:
    """(i, j, s, expectation, entropy) of the pairs that have a colour of `new` (color, seq), among themselves and with the
    stored ones; a colour that is stored too counts both. The store stays as it is."""
    own = edges(new, k)
    names = own.select("color").distinct()
    every = read(spark, path, k).unionByName(own.select("color", "kmer", "W", "coverage")).groupBy("color", "kmer", "W").agg(F.sum("coverage").alias("coverage"))
    mark = names.withColumn("is_new", F.lit(True))
    ends = bwsd.pairs(every).join(mark.toDF("i", "a"), "i", "left").join(mark.toDF("j", "b"), "j", "left")
    return bwsd.similarity(every, coverage, ends.where("a or b").select("i", "j"))
