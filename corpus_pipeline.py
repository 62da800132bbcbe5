"""A corpus pipeline of five operators: quality rules, near duplicates, benchmark passages, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of docs; the last adds `_shard`, the shard that holds the row.
Null and repeated rows, empty texts and extra columns are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import work_dir, written
from lexmill.llm.decontaminate import decontaminate
from lexmill.llm.mixing import mix
from lexmill.llm.quality_rules import filter_quality, fit_rules
from lexmill.llm.sharding import ShardStore
from lexmill.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the list learned from `labels` reject go."""
    return filter_quality(docs, fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more shared five-word shingles connect, the document of least id stays."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are chosen, some twice, to meet the weights of domains, languages and sources."""
    return mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go through a shard store: appended, compacted, committed, and read back by its last manifest."""
    store = ShardStore(spark, work_dir(spark, "corpus"))
    store.append(docs)
    version = store.compact(at_least=2)
    store.vacuum()
    return store.read(version)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The decision list is learned and SimHash needs XXH64: SQL can't express the rows; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
