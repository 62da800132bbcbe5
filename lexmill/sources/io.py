"""Sources of texts and phrases, and sinks of results, all by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank
from lexmill.operators.dictionary import parse_phrases


def from_texts(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    """(doc_id, text) of a list of texts in its order; blank ones stay and give empty results."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one document a UTF-8 file. A missing path raises."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_parquet(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def read_phrases(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(phrase) of a dictionary file."""
    return parse_phrases(spark.read.text(path), separator=separator)


def nonblank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.where(~is_blank(F.col(text_col)))


def write_texts(rows: DataFrame, path: str, text_col: str) -> None:
    """One column of texts, a folder of UTF-8 files; line feeds inside a text stay."""
    rows.select(text_col).write.mode("errorifexists").text(path)
