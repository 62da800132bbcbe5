"""Subtitle files, storyboards and prompt requests from scenes with subtitles, as expressions on the scene array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import two_decimals

#: The header and style of the ASS format, platforms by language, styles by era.
ASS_HEADER = "[Script Info]\nTitle: {title}\nScriptType: v4.00+\nCollisions: Normal\nPlayResX: 1920\nPlayResY: 1080\n\n"
ASS_STYLE = (
    "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, "
    "BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,10,1"
)
ASS_EVENTS = "[Events]"
ASS_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
PLATFORMS = {"zh": "midjourney", "en": "stable_diffusion", "ja": "jimeng", "auto": "generic", "mixed": "midjourney"}
STYLES = {"ancient": "classical", "modern": "contemporary", "mixed": "eclectic"}


def _clock(seconds: Column, parts: int, form: str) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    rest = F.floor((s - whole) * parts)
    return F.format_string(form, F.floor(whole / 3600).cast("int"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("int"), F.pmod(whole, F.lit(60)).cast("int"), rest.cast("int"))


def srt_time(seconds: Column) -> Column:
    return _clock(seconds, 1000, "%02d:%02d:%02d,%03d")


def ass_time(seconds: Column) -> Column:
    return _clock(seconds, 100, "%d:%02d:%02d.%02d")


def cues(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes") -> DataFrame:
    """(id, n, start, stop, text, name): subtitles of a document in order, on its clock."""
    scenes = docs.select(id_col, F.inline(scenes_col))
    before = Window.partitionBy(id_col).orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    scenes = scenes.withColumn("_at", F.coalesce(F.sum("estimated_duration").over(before), F.lit(0.0)))
    names = F.array_join("characters", ",") if "characters" in scenes.columns else F.lit("")
    rows = scenes.select(id_col, "segment_id", "_at", names.alias("name"), F.explode("subtitles").alias("s"))
    order = Window.partitionBy(id_col).orderBy("segment_id", "s.display_order")
    start = F.col("_at") + F.col("s.start_time")
    return rows.select(id_col, F.row_number().over(order).alias("n"), start.alias("start"), (start + F.col("s.duration")).alias("stop"), F.col("s.text").alias("text"), "name")


def _joined(rows: DataFrame, id_col: str, line: Column, between: str) -> DataFrame:
    lines = rows.select(id_col, "n", line.alias("line")).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return lines.select(id_col, F.array_join(F.col("l.line"), between).alias("body"))


def to_srt(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes") -> DataFrame:
    """(id, srt) for every document; one without subtitles has an empty text."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("stop")), F.lit("\n"), text, F.lit("\n"))
    body = _joined(cues(docs, id_col, scenes_col), id_col, block, "\n")
    return docs.select(id_col).join(body, id_col, "left").select(id_col, F.coalesce("body", F.lit("")).alias("srt"))


def to_ass(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes", title: str = "Subtitles") -> DataFrame:
    """(id, ass) for every document."""
    header = ASS_HEADER.replace("{title}", title)
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\\N"))
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("stop")), F.lit(",Default,"), F.col("name"), F.lit(",0,0,0,,"), text)
    body = _joined(cues(docs, id_col, scenes_col), id_col, line, "\n")
    full = "\n".join([header, ASS_STYLE, "", ASS_EVENTS, ASS_FORMAT])
    empty = header + ASS_STYLE + f"\n\n{ASS_EVENTS}\n"
    told = F.when(F.size(scenes_col) <= 0, empty).otherwise(F.concat(F.lit(full), F.coalesce(F.concat(F.lit("\n"), F.col("body")), F.lit(""))))
    return docs.join(body, id_col, "left").select(id_col, told.alias("ass"))


def subtitle_totals(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes") -> DataFrame:
    s = F.col(scenes_col)
    return docs.select(id_col, F.aggregate(s, F.lit(0), lambda a, x: a + F.size(x["subtitles"])).alias("n_subtitles"), F.aggregate(s, F.lit(0.0), lambda a, x: a + x["estimated_duration"]).alias("total_duration"))


def image_hint(text: Column, characters: Column, setting: Column, mood: Column, era: Column) -> Column:
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    return F.concat_ws(", ", F.when(text != "", text), part("角色:", F.array_join(characters, ",")), part("场景:", setting), part("氛围:", mood), part("风格:", era))


def storyboard(docs: DataFrame, id_col: str = "doc_id", scenes_col: str = "scenes") -> DataFrame:
    """(id, storyboard): one JSON text a document. Scenes may have characters, setting, mood and era; the document script."""
    fields = {f.name for f in docs.schema[scenes_col].dataType.elementType.fields}
    has = lambda s, name, default: s[name] if name in fields else default
    none, empty = F.array().cast("array<string>"), F.lit("")

    def item(s: Column) -> Column:
        who, where, mood, era = has(s, "characters", none), has(s, "setting", empty), has(s, "mood", empty), has(s, "era", F.lit(None).cast("string"))
        return F.struct(
            s["segment_id"].alias("scene_id"), s["text"].alias("text"), two_decimals(s["estimated_duration"]).alias("duration_s"), who.alias("characters"), where.alias("setting"), mood.alias("mood"),
            empty.alias("phase"), image_hint(s["text"], who, where, mood, era).alias("image_hint"), era.alias("era"),
            F.struct(empty.alias("previous_setting"), empty.alias("next_setting"), who.alias("characters_here")).alias("scene_context"))

    script = "script" in docs.columns
    board = F.struct(
        (F.col("script.synopsis") if script else empty).alias("story_synopsis"),
        (F.transform("script.characters", lambda c: F.struct(c.alias("name"))) if script else F.array().cast("array<struct<name:string>>")).alias("characters"),
        (F.col("script.settings") if script else none).alias("settings"), F.size(scenes_col).alias("total_scenes"),
        two_decimals(F.aggregate(F.col(scenes_col), F.lit(0.0), lambda a, s: a + s["estimated_duration"])).alias("total_duration"), F.transform(scenes_col, item).alias("scenes"))
    return docs.select(id_col, F.to_json(board, {"ignoreNullFields": "false"}).alias("storyboard"))


def _lookup(key: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def prompt_requests(rows: DataFrame, platform: str | None = None, level: int = 5, longest: int = 500) -> DataFrame:
    """Sentences (text, language, length_status; maybe era, context) with the fields of a prompt request."""
    long_, short = F.col("length_status") == "too_long", F.col("length_status") == "too_short"
    style = _lookup(F.col("era"), STYLES, F.lit(None).cast("string")) if "era" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "prompt": F.col("text"), "platform": _lookup(F.col("language"), PLATFORMS, F.lit(platform or "generic")),
        "creative_level": F.when(short, F.lit(min(level + 3, 10))).when(long_, F.lit(max(level - 2, 1))).otherwise(F.lit(level)),
        "max_length": F.when(long_, F.lit(min(longest, 200))).when(short, F.lit(max(longest, 700))).otherwise(F.lit(longest)),
        "num_candidates": F.lit(1), "auto_detect_style": F.lit(True), "style_hint": style,
    })


def from_results(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """Prompt requests of a document's sentences; contexts of scene sentences are matched by their position in the document."""
    fields = {f.name for f in docs.schema["scenes"].dataType.elementType.fields}
    script = "script" in docs.columns
    null = F.lit(None).cast("string")

    def of(s: Column) -> Column:
        who = F.try_element_at(s["characters"], F.lit(1)) if "characters" in fields else null
        where = F.when(s["setting"] != "", s["setting"]) if "setting" in fields else null
        context = F.struct(
            (F.when(F.col("script.synopsis") != "", F.col("script.synopsis")) if script else null).alias("synopsis"), who.alias("character"), where.alias("setting"),
            (F.col("script.characters") if script else F.lit(None).cast("array<string>")).alias("character_list"))
        return F.array_repeat(F.struct((s["era"] if "era" in fields else null).alias("era"), context.alias("context")), s["n_sentences"])

    pairs = F.arrays_zip(F.col("sentences").alias("s"), F.flatten(F.transform("scenes", of)).alias("c"))
    both = docs.select(id_col, F.posexplode(F.filter(pairs, lambda p: p["s"].isNotNull())).alias("position", "p"))
    rows = both.select(id_col, "position", F.col("p.s.text").alias("text"), F.col("p.s.language").alias("language"), F.col("p.s.length_status").alias("length_status"), F.col("p.c.era").alias("era"), F.col("p.c.context").alias("context"))
    return prompt_requests(rows, **more)


def optimize_payload(rows: DataFrame) -> DataFrame:
    """Requests with the two fields that default."""
    have = rows.columns
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in (("num_candidates", 1), ("auto_detect_style", True))})


def optimize_response(body: Column) -> Column:
    """Fields of a JSON response with their defaults; raw is the whole text."""
    kind = "optimized_prompt string, platform string, style string, model_used string, tokens_used long, duration_ms double, candidates array<string>, error string"
    r = F.from_json(body, kind)
    text = lambda k: F.coalesce(r[k], F.lit("")).alias(k)
    return F.struct(
        text("optimized_prompt"), text("platform"), r["style"].alias("style"), text("model_used"), F.coalesce(r["tokens_used"], F.lit(0).cast("long")).alias("tokens_used"),
        F.coalesce(r["duration_ms"], F.lit(0.0)).alias("duration_ms"), F.coalesce(r["candidates"], F.array().cast("array<string>")).alias("candidates"), r["error"].alias("error"), body.alias("raw"))
