"""The whole segmentation of documents as one chain of DataFrame steps.

Every step works on arrays inside a document's row, so the default chain has no shuffle. Topic boundaries, chunked
large texts and paragraphs explode and regroup by document.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import config as settings
from lexmill.functions.text import is_blank, let, row_key, two_decimals
from lexmill.operators import dictionary, era, length, scenes, script, sentences, subtitles, topics
from lexmill.operators.language import detect, paragraphs, route
from lexmill.operators.model_tier import Model, with_model_tier
from lexmill.schema import SENTENCES


def _rules(config: dict[str, Any]) -> dict[str, Any]:
    s = config["sentence"]
    return {"longest": s["max_sentence_length"], "extra": tuple(s["extra_abbreviations"]), "ellipsis": s["handle_ellipsis"], "window": s["eos_window"]}


def _records(docs: DataFrame, starts: bool) -> DataFrame:
    language = F.col("language")
    own = F.when(route(language) == "ja", "tier3_rule_ja").otherwise("tier3_rule")
    confidence = F.when(language == "ja", F.lit(0.9)).otherwise(F.lit(1.0))
    return let(docs, sentences=sentences.records(F.col("texts"), language, own, confidence, F.col("topic_starts") if starts else None))


def split(docs: DataFrame, config: dict[str, Any], model: Model | None = None) -> DataFrame:
    """Adds language, tier_used and sentences by the tiers that the settings allow."""
    tier = settings.effective_tier(config)
    blank = is_blank(F.col("text"))
    out = sentences.split_texts(detect(docs, "text", config["language"]).drop("confidence"), **_rules(config))
    out = out.withColumn("tier_used", F.when(blank, "tier3_rule").otherwise(sentences.tier_of(F.col("texts"), F.col("language"))))
    topical = (config["enable_topic_segmentation"] or config["mode"] == "precise") and tier <= 2
    if topical:
        t = config["texttiling"]
        eligible = out.withColumn("_rows", F.when(F.col("language") == "ja", F.array().cast("array<string>")).otherwise(F.col("texts")))
        out = topics.mark_topics(eligible, "_rows", t["min_text_length"], window=t["sentence_window"], step=t["step_size"], threshold=t["depth_score_threshold"], smoothing=t["smoothing_passes"]).drop("_rows")
        valid = sentences.is_valid(F.col("texts")) & (F.col("language") != "ja")
        out = out.withColumn("tier_used", F.when(valid & ~blank, "tier2_semantic").otherwise(F.col("tier_used")))
    if config["enable_llm"] and model is not None and tier <= 1:
        out = with_model_tier(out, model, language=config["language"])
    out = out.withColumn("language", F.when(blank, "zh").otherwise(F.col("language")))
    return _records(out, topical).drop("texts", "topic_starts")


def by_chunks(docs: DataFrame, config: dict[str, Any], model: Model | None = None) -> DataFrame:
    """As split, with texts over the limit cut into chunks whose sentences are renumbered through the document.

    The language is the whole text's, the tier the last chunk's; sentences keep their chunk's language.
    """
    keyed = docs.withColumn("_row", row_key())
    pieces = sentences.chunked(keyed, config["max_input_length"], "_row")
    done = split(pieces, config, model)
    gathered = done.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("chunk_no", "tier_used", "sentences"))).alias("c"))
    flat = F.transform(F.flatten(F.transform("c", lambda c: c["sentences"])), lambda s, i: s.withField("index", i)).cast(SENTENCES)
    found = gathered.select(F.col("_row").alias("_key"), F.element_at("c", -1)["tier_used"].alias("tier_used"), flat.alias("sentences"))
    none = F.array().cast(SENTENCES)
    told = detect(keyed, "text", config["language"]).drop("confidence").withColumn("language", F.when(is_blank(F.col("text")), "zh").otherwise(F.col("language")))
    return told.join(found, told["_row"].eqNullSafe(found["_key"]), "left").drop("_row", "_key").withColumns({"tier_used": F.coalesce("tier_used", F.lit("tier3_rule")), "sentences": F.coalesce("sentences", none)})


def by_paragraphs(docs: DataFrame, config: dict[str, Any], model: Model | None = None) -> DataFrame:
    """(key, scenes): scenes of each line for itself, short ones merged, numbered through the document, by `row_key`."""
    lines = paragraphs(docs.select(row_key().alias("key"), "text"), "key", separator="\n").where(~sentences.is_separator(F.col("text"))).select("key", "paragraph", "text")
    done = split(lines, config, model)
    packed = let(scenes.pack_documents(done, config["scene"]), merged=scenes.merge_short(F.col("scenes"), config["scene"]["target_seconds"]))
    gathered = packed.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("paragraph", "merged"))).alias("p"))
    return gathered.select("key", scenes.renumber(F.flatten(F.transform("p", lambda p: p["merged"]))).alias("scenes"))


def segment(docs: DataFrame, config: dict[str, Any] | None = None, model: Model | None = None, with_subtitles: bool = True) -> DataFrame:
    """Documents (doc_id, text) with language, tier_used, sentences, scenes (with subtitles), totals and, if enabled, script and eras."""
    config = settings.load(config)
    docs = docs.select("doc_id", "text")
    long_ = F.length("text") > config["max_input_length"]
    plain = split(docs.where(~F.coalesce(long_, F.lit(False))), config, model)
    large = by_chunks(docs.where(long_), config, model).select(*plain.columns)
    out = plain.unionByName(large)
    rule = config["length"]
    controlled = let(out, _s=length.apply(F.col("sentences"), rule["strategy"], rule["min_chars"], rule["max_chars"], rule["prefer_punctuation"]))
    out = controlled.withColumn("sentences", sentences.without_separators(F.col("_s"))).drop("_s")
    if config["enable_paragraph_aware"]:
        none = F.array().cast("array<struct<segment_id:int,text:string,estimated_duration:double,target_words:int,n_sentences:int,first_sentence:int>>")
        lines = by_paragraphs(docs, config, model)
        out = out.withColumn("_row", row_key())
        out = out.join(lines, out["_row"].eqNullSafe(lines["key"]), "left").drop("_row", "key").withColumn("scenes", F.coalesce("scenes", none))
    else:
        out = scenes.pack_documents(out, config["scene"])
    if config["enable_script_analysis"]:
        out = let(out, script=script.analyse(F.col("text")))
        out = out.withColumn("_e", script.enrich(F.col("scenes"), F.col("script"))).drop("scenes").withColumnRenamed("_e", "scenes")
    if with_subtitles:
        out = subtitles.add_subtitles(out, config)
    if config["enable_era"]:
        out = out.withColumn("scenes", era.add_era(F.col("scenes"), F.col("language")))
    if config["user_dict_path"]:
        out = around_phrases(out, dictionary.parse_phrases(docs.sparkSession.read.text(config["user_dict_path"])))
    return scenes.totals(out)


def around_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Sentences rebuilt around a user's phrases where that changes their number; scenes stay."""
    texts = F.transform("sentences", lambda s: s["text"])
    out = dictionary.adjust(let(docs, _texts=texts), phrases, segments_col="_texts")
    made = sentences.records(F.col("_texts"), F.col("language"), F.col("tier_used"))
    return let(out, _s=F.when(F.size("_texts") != F.size("sentences"), made).otherwise(F.col("sentences"))).drop("sentences", "_texts").withColumnRenamed("_s", "sentences")


def to_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json): a document's result as one JSON text, durations with two decimals, nulls kept."""
    rounded = F.transform("scenes", lambda s: s.withField("estimated_duration", two_decimals(s["estimated_duration"])))
    fields = [c for c in ("language", "tier_used", "total_words", "total_scenes", "script") if c in docs.columns]
    counted = F.struct(*fields, two_decimals(F.col("total_duration")).alias("total_duration"), F.size("sentences").alias("sentence_count"), "sentences", rounded.alias("scenes"))
    return docs.select("doc_id", F.to_json(counted, {"ignoreNullFields": "false"}).alias("json"))


def response(docs: DataFrame) -> DataFrame:
    """Documents in the flat shape of a service response."""
    keep = ("text", "index", "language", "tier", "confidence", "char_count", "is_topic_boundary", "topic_depth_score")
    names = {f.name for f in docs.schema["scenes"].dataType.elementType.fields}
    own = [n for n in ("segment_id", "text", "estimated_duration", "target_words", "era", "era_confidence", "subtitles") if n in names]
    flat = F.transform("scenes", lambda s: F.struct(*(s[n].alias(n) for n in own), *([F.size(s["subtitles"]).alias("subtitle_count")] if "subtitles" in names else [])))
    return docs.select("doc_id", "language", "tier_used", F.transform("sentences", lambda s: F.struct(*(s[k].alias(k) for k in keep))).alias("sentences"), flat.alias("scenes"), "total_duration", "total_words", "total_scenes")


def compare(a: DataFrame, b: DataFrame, array: str = "sentences") -> DataFrame:
    """(doc_id, position, a, b, same_count): the texts of two results side by side."""
    texts = lambda df, name: df.select("doc_id", F.size(array).alias(f"n_{name}"), F.posexplode(F.transform(array, lambda s: s["text"])).alias("position", name))
    both = texts(a, "a").join(texts(b, "b"), ["doc_id", "position"], "full")
    doc: Any = Window.partitionBy("doc_id")
    same: Column = F.coalesce(F.max("n_a").over(doc), F.lit(0)) == F.coalesce(F.max("n_b").over(doc), F.lit(0))
    return both.select("doc_id", "position", "a", "b", same.alias("same_count"))
