"""Subtitle blocks of scenes, with times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.config import subtitle_bounds
from lexmill.functions.block_rules import Rules
from lexmill.functions.blocks import Cutter
from lexmill.functions.text import let
from lexmill.schema import SUBTITLES


def half_up(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("double") / 100


def times(blocks: Column, duration: Column, parent: Column, method: str = "proportional") -> Column:
    """Subtitle records: rounded durations by length (or equal), each starting where the one before ends."""
    total = F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(b))
    start = F.struct(F.array().cast(SUBTITLES).alias("done"), F.lit(0.0).alias("at"), total.alias("total"), F.size(blocks).alias("n"))

    def step(a: Column, b: Column) -> Column:
        own = duration / a["n"] if method == "equal" else F.when(a["total"] > 0, F.length(b) / a["total"] * duration).otherwise(duration / a["n"])
        rounded = half_up(own)
        row = F.struct(b.alias("text"), F.size(a["done"]).alias("display_order"), a["at"].alias("start_time"), rounded.alias("duration"), parent.cast("int").alias("parent_segment_id"))
        return F.struct(F.concat(a["done"], F.array(row)).alias("done"), half_up(a["at"] + rounded).alias("at"), a["total"].alias("total"), a["n"].alias("n"))

    return F.aggregate(blocks, start, step, lambda a: a["done"])


def cut_texts(low: int, high: int, rules: Rules | None = None):
    """An Arrow function from texts of scenes to their blocks."""
    cutter = Cutter(low, high, rules or Rules())

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def cut(scenes: pd.Series) -> pd.Series:
        return scenes.map(lambda texts: [cutter.blocks(t or "") for t in texts])

    return cut


def add_subtitles(docs: DataFrame, config: dict, scenes_col: str = "scenes") -> DataFrame:
    """Adds a field `subtitles` to the scenes; one Arrow pass over the texts, times in expressions."""
    low, high = subtitle_bounds(config)
    rules = Rules.load(config["subtitle"]["rules_path"]) if config["subtitle"]["rules_path"] else None
    out = let(docs, _blocks=cut_texts(low, high, rules)(F.transform(F.col(scenes_col), lambda s: s["text"])))
    method = config["subtitle"]["time_calculation_method"]
    timed = F.zip_with(F.col(scenes_col), F.col("_blocks"), lambda s, b: s.withField("subtitles", times(b, s["estimated_duration"], s["segment_id"], method)))
    return out.withColumn("_timed", timed).drop(scenes_col, "_blocks").withColumnRenamed("_timed", scenes_col)
