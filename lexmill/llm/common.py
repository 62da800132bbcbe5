"""Small pieces that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule, as characters and as a Java class.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_CLASS = "[ \\t-\\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anything that cannot be in a word of ASCII letters, digits and non-ASCII characters (text already lower-cased).
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

NULL_ID = np.int64(2**63 - 1)


def ascii_lower(text: Column) -> Column:
    """The text with A-Z lower-cased; pure ASCII takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """Array of words [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def alnum_words(text: Column) -> Column:
    """Array of words of ASCII letters, digits and non-ASCII characters of the lower-cased text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def row_key(id_col: str, text: Column) -> Column:
    """What tells rows: the id and 128 bits of the text. Rows of one key are equal in both, so they share results."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once a row: no later filter or projection is rewritten to compute them again.

    A generator of one element stands between; the optimizer neither inlines its output nor pushes predicates through.
    """
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df is called so or starts so."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    return [df[f"`{c}`"] for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that the cluster shares.

    The folder is the one in spark.checkpoint.dir; only where that is unset (as in tests) it is a local one.
    """
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"/tmp/lexmill-shared-{sc.applicationId}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again; the lineage ends there. The folder goes with the application."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, told: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with one row a key, when some keys may hold a large part of the rows.

    A key with more than 1/share of the rows is hot. There are fewer than `share` such keys, whatever the size, so
    what is told of them is broadcast; the others meet by shuffle. rows should be cheap to read twice.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = checkpointed(counts.where(F.col("_n") * share > total).select(F.col(key).alias("_hot")))
    rest = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left_anti").join(told, key)
    mine = told.join(F.broadcast(hot), told[key] == hot["_hot"]).drop("_hot")
    return rest.unionByName(rows.join(F.broadcast(mine), key))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that leading bits are even."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def column_bytes(table: pa.Table, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column (binary and string types alike)."""
    return table.column(name).cast(pa.large_binary()).to_pylist()
