"""Corpus pipeline: quality classifier, near-dedup, substring dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next stage's docs. All stages but the
last return the columns of documents. The mixing stage writes its rows in the order of the mixture, and
packing takes them in the order of the files, so batches follow the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolayers.llm.common import as_given, shared_dir, table
from isolayers.llm.mixing import mixed
from isolayers.llm.near_copies import keep_one_of_each_group
from isolayers.llm.packing import packed
from isolayers.llm.quality_classifier import scored
from isolayers.llm.queries import TARGETS
from isolayers.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    found = scored(docs, table(spark, sf_dir, "labels"))
    return as_given(found.where(found["predicted"] == 1), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash fingerprints within 3 bits, or five-word shingles with Jaccard 0.8 and up) the document with the smallest id stays."""
    return keep_one_of_each_group(docs, by_fingerprint=True)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a document of which nothing is left goes. Untouched texts stay as they are."""
    found = remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return as_given(found, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of sources."""
    found = mixed(docs, TARGETS)
    return as_given(found.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches, filled in the order in which the documents lie in the files."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"part-(\d+)", 1).cast("long")  # names alone would put part-100000 before part-99999
    rows = docs.select("doc_id", "text", F.struct(number.alias("number"), name.alias("name")).alias("file"), F.col("_metadata.row_index").alias("row"))
    return packed(rows, part=F.col("file"), order=[F.col("row")])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier or the dynamic programme.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result a Parquet table in the shared folder."""
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
