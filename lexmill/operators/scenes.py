"""Scenes: sentences packed greedily to a target length, with durations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import let
from lexmill.schema import SCENE, SCENES

#: Characters after which scene text needs no full stop.
TERMINAL = "。！？；.!?;\n"


def target_words(scene: dict[str, Any]) -> int:
    own = int(scene["target_seconds"] * scene["base_words_per_second"] * scene["speech_rate"])
    return max(scene["min_words"], min(own, scene["max_words"]))


def _glued(before: Column, text: Column) -> Column:
    """Text appended to a scene's text, with a full stop between unless one end mark is there or the text is blank."""
    stop = ~F.substring(before, F.length(before), F.lit(1)).isin(*TERMINAL) & (before != "") & text.rlike(r"(?U)[^\s\x1C-\x1F]")
    return F.concat(before, F.when(stop, F.lit("。")).otherwise(""), text)


def pack(sentences: Column, scene: dict[str, Any]) -> Column:
    """Array of scenes from sentence records (text, is_topic_boundary).

    A scene takes the next sentence while the target allows, and always a second one if single sentences may overflow.
    A topic boundary starts a scene; a text with boundaries has three times the target.
    """
    rate, words = scene["base_words_per_second"] * scene["speech_rate"], target_words(scene)
    target = F.when(F.exists(sentences, lambda s: s["is_topic_boundary"]), F.lit(3 * words)).otherwise(F.lit(words))
    empty = F.array().cast("array<struct<text:string,words:int,n:int,first:int>>")
    zero = F.struct(empty.alias("done"), F.lit("").alias("text"), F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(0).alias("first"), target.alias("target"))
    now = lambda a: F.struct(a["text"].alias("text"), a["words"].alias("words"), a["n"].alias("n"), a["first"].alias("first"))

    def step(a: Column, s: Column) -> Column:
        size = F.length(s["text"])
        fits = (a["words"] + size <= a["target"]) | ((a["n"] <= 1) if scene["allow_single_sentence_overflow"] else F.lit(False))
        starts = (a["n"] > 0) & (s["is_topic_boundary"] | ~fits)
        return F.struct(
            F.when(starts, F.concat(a["done"], F.array(now(a)))).otherwise(a["done"]).alias("done"),
            F.when(starts | (a["n"] == 0), s["text"]).otherwise(_glued(a["text"], s["text"])).alias("text"),
            F.when(starts, size).otherwise(a["words"] + size).alias("words"),
            F.when(starts, F.lit(1)).otherwise(a["n"] + 1).alias("n"),
            F.when(starts, a["first"] + a["n"]).otherwise(a["first"]).alias("first"),
            a["target"].alias("target"),
        )

    packed = F.aggregate(sentences, zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(now(a)))).otherwise(a["done"]))
    return F.transform(
        packed,
        lambda x, i: F.struct(i.alias("segment_id"), x["text"].alias("text"), (x["words"] / F.lit(rate)).alias("estimated_duration"), x["words"].alias("target_words"), x["n"].alias("n_sentences"), x["first"].alias("first_sentence")),
    ).cast(SCENES)


def combined(a: Column, b: Column, fields: list[str]) -> Column:
    """Two scenes as one: texts, durations, sentences and subtitles follow each other, characters are united in order, the
    first setting and mood that aren't empty stay, and so do the first one's target words and numbers."""
    first = lambda k: F.when(a[k] != "", a[k]).otherwise(b[k])
    follow = lambda k: F.concat(a[k], b[k])
    ways = {"text": follow, "subtitles": follow, "estimated_duration": lambda k: a[k] + b[k], "n_sentences": lambda k: a[k] + b[k], "characters": lambda k: F.array_union(a[k], b[k]), "setting": first, "mood": first}
    return F.struct(*(ways.get(k, lambda k: a[k])(k).alias(k) for k in fields))


def merge_short(scenes: Column, threshold: float, kind: str = SCENE) -> Column:
    """Each scene (of the struct type `kind`) takes in the ones behind it until its duration reaches the threshold."""
    fields = T.StructType.fromDDL(kind[len("struct<") : -1]).names
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def step(a: Column, s: Column) -> Column:
        now = a["now"]
        short = now.isNotNull() & (now["estimated_duration"] < threshold)
        return F.struct(F.when(now.isNull() | short, a["done"]).otherwise(F.concat(a["done"], F.array(now))).alias("done"), F.when(short, combined(now, s, fields)).otherwise(s).alias("now"))

    return F.aggregate(scenes, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def renumber(scenes: Column) -> Column:
    return F.transform(scenes, lambda s, i: s.withField("segment_id", i))


def scene_rows(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes") -> DataFrame:
    return docs.select(id_col, F.inline(scenes_col))


def totals(docs: DataFrame, scenes_col: str = "scenes") -> DataFrame:
    """Adds total_scenes, total_duration and total_words."""
    s = F.col(scenes_col)
    return docs.withColumns({
        "total_scenes": F.size(s), "total_duration": F.aggregate(s, F.lit(0.0), lambda a, x: a + x["estimated_duration"]),
        "total_words": F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x["text"])),
    })


def offsets(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds the start of each scene: the durations of those before it."""
    before = Window.partitionBy(id_col).orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("scene_start", F.coalesce(F.sum("estimated_duration").over(before), F.lit(0.0)))


def pack_documents(docs: DataFrame, scene: dict[str, Any], sentences_col: str = "sentences") -> DataFrame:
    return let(docs, scenes=pack(F.col(sentences_col), scene))
