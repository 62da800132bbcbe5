"""Queries over the whole tables, one or more for each operator, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import config
from lexmill.functions.text import is_blank, let, strip
from lexmill.operators import chinese, dictionary, english, era, exports, japanese, language, length, scenes, script, sentences, subtitles, topics
from lexmill.plans import segment as plan

SETTINGS = config.DEFAULTS
#: Latin words that stand for the eras, since the tables have no Chinese.
LATIN = era.Vocabulary(("tion", "ingsh"), ("the ", "and "), ("éen", "ungsch"), ("der ", "le "))
LATIN_MOODS = {"idiot": "angry", "the ": "calm", "une ": "happy", "der ": "tense"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    # a few small files would leave most cores idle; many files are read where they are
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(_docs(spark, sf_dir))


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return let(_docs(spark, sf_dir), texts=english.sentences(F.col("text")))


def _scened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.pack_documents(_split(spark, sf_dir), SETTINGS["scene"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("texts").alias("index", "text"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.col(text), " "), lambda w: w != "")


def lang_detect(spark, sf_dir):
    return language.detect(_docs(spark, sf_dir)).select("doc_id", "language", F.col("confidence").cast("double").alias("confidence"))


def lang_summary(spark, sf_dir):
    return language.detect(_docs(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("n_docs"))


def lang_route(spark, sf_dir):
    return language.detect(_docs(spark, sf_dir)).select("doc_id", language.route(F.col("language")).alias("chain"))


def blank_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", is_blank(F.col("text")).alias("blank"))


def paragraphs(spark, sf_dir):
    return language.paragraphs(_docs(spark, sf_dir), separator="\n").select("doc_id", "paragraph", "text", "language")


def separator_filter(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.where(~sentences.is_separator(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def en_sentences(spark, sf_dir):
    return _rows(_english(spark, sf_dir))


def en_tokens(spark, sf_dir):
    found = english.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


def en_abbrev_protect(spark, sf_dir):
    masked = english.mask_abbreviations(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", (F.length("text") - F.length(F.replace(masked, F.lit(chr(0xE000)), F.lit("")))).cast("long").alias("n_masked"))


def zh_rule_sentences(spark, sf_dir):
    return _rows(let(_docs(spark, sf_dir), texts=chinese.sentences(F.col("text"))))


def zh_tokens(spark, sf_dir):
    found = chinese.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, "|")).alias("tokens_md5"))


def ja_rule_sentences(spark, sf_dir):
    return _rows(let(_docs(spark, sf_dir), texts=japanese.sentences(F.col("text"))))


def split_tiers(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "language", "tier_used", F.size("sentences").cast("long").alias("n_sentences"))


def sentence_records(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", F.inline("sentences")).select("doc_id", "index", "text", "char_count", "language", "tier", "confidence")


def length_status(spark, sf_dir):
    told = length.apply(F.col("sentences"), "B")
    return _split(spark, sf_dir).select("doc_id", F.inline(told)).select("doc_id", "index", "length_status", "length_strategy_applied")


def length_status_hist(spark, sf_dir):
    return length_status(spark, sf_dir).groupBy("length_status").agg(F.count("*").alias("n"))


def length_warnings(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", F.explode(length.warnings(F.col("sentences"))).alias("warning"))


def length_resplit(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", F.inline(length.apply(F.col("sentences"), "A"))).select("doc_id", "index", "text", "length_status")


def text_chunks(spark, sf_dir):
    return sentences.chunked(_docs(spark, sf_dir), 2000)


def chunk_pipeline(spark, sf_dir):
    return plan.segment(_docs(spark, sf_dir), {"max_input_length": 5000}, with_subtitles=False).select("doc_id", "language", F.size("sentences").cast("long").alias("n_sentences"), "total_scenes")


def scene_pack(spark, sf_dir):
    found = scenes.scene_rows(_scened(spark, sf_dir))
    return found.select("doc_id", "segment_id", "target_words", "n_sentences", F.round("estimated_duration", 6).alias("estimated_duration"))


def scene_text(spark, sf_dir):
    return scenes.scene_rows(_scened(spark, sf_dir)).select("doc_id", "segment_id", "text")


def doc_totals(spark, sf_dir):
    found = scenes.totals(_scened(spark, sf_dir))
    return found.select("doc_id", "language", F.size("sentences").cast("long").alias("n_sentences"), F.col("total_scenes").cast("long").alias("total_scenes"), F.col("total_words").cast("long").alias("total_words"), F.round("total_duration", 4).alias("total_duration"))


def label_totals(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return doc_totals(spark, sf_dir).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"), F.sum("total_scenes").alias("n_scenes"))


def scene_merge_short(spark, sf_dir):
    merged = scenes.renumber(scenes.merge_short(F.col("scenes"), SETTINGS["scene"]["target_seconds"]))
    return _scened(spark, sf_dir).select("doc_id", F.inline(merged)).select("doc_id", "segment_id", "text", "n_sentences")


def paragraph_scenes(spark, sf_dir):
    return plan.by_paragraphs(_docs(spark, sf_dir), SETTINGS).select(F.col("key.id").alias("doc_id"), F.inline("scenes")).select("doc_id", "segment_id", "text")


def tt_terms(spark, sf_dir):
    return _rows(_english(spark, sf_dir)).select("doc_id", "index", F.size(topics.terms(F.col("text"))).cast("long").alias("n_terms"))


def tt_similarity(spark, sf_dir):
    sims = topics.similarities(topics.tiles(_rows(_english(spark, sf_dir))))
    return sims.select("doc_id", "tile", F.round("similarity", 6).alias("similarity"))


def tt_depth(spark, sf_dir):
    found = topics.depths(topics.similarities(topics.tiles(_rows(_english(spark, sf_dir)))), smoothing=1)
    return found.select("doc_id", "tile", F.round("similarity", 6).alias("similarity"), F.round("depth", 6).alias("depth"))


def tt_boundaries(spark, sf_dir):
    found = topics.find_topics(_english(spark, sf_dir), threshold=0.3).select("doc_id", F.inline("topics"))
    return found.select("doc_id", "index", F.col("position").cast("long").alias("position"), F.round("depth_score", 6).alias("depth_score"), "text_before", "text_after")


def tt_token_boundaries(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.transform(_words("text"), F.lower)).alias("index", "text"))
    return topics.token_boundaries(rows, window=10, step=5).select("doc_id", "index", F.col("position").cast("long").alias("position"))


def topic_pipeline(spark, sf_dir):
    found = plan.segment(_docs(spark, sf_dir), {"mode": "precise"}, with_subtitles=False)
    marks = F.size(F.filter("sentences", lambda s: s["is_topic_boundary"]))
    return found.select("doc_id", "tier_used", marks.cast("long").alias("n_topics"), F.col("total_scenes").cast("long").alias("total_scenes"))


def jaccard_adjacent(spark, sf_dir):
    texts = F.col("texts")
    pairs = F.transform(F.sequence(F.lit(0), F.size(texts) - 2), lambda i: F.struct(i.alias("index"), topics.jaccard(F.array_distinct(topics.terms(texts[i])), F.array_distinct(topics.terms(texts[i + 1]))).alias("jaccard")))
    return _english(spark, sf_dir).where(F.size("texts") >= 2).select("doc_id", F.inline(pairs)).select("doc_id", "index", F.round("jaccard", 6).alias("jaccard"))


def _timed(spark, sf_dir, method="proportional"):
    blocks = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    return _docs(spark, sf_dir).select("doc_id", F.array(F.struct(F.lit(0).alias("segment_id"), F.col("text").alias("text"), F.lit(60.0).alias("estimated_duration"), subtitles.times(blocks, F.lit(60.0), F.lit(0), method).alias("subtitles"))).alias("scenes"))


def subtitle_times(spark, sf_dir):
    return _timed(spark, sf_dir).select("doc_id", F.inline("scenes")).select("doc_id", F.inline("subtitles")).select("doc_id", "display_order", "start_time", "duration")


def srt_cues(spark, sf_dir):
    found = exports.cues(_timed(spark, sf_dir, "equal"))
    return found.select("doc_id", "n", exports.srt_time(F.col("start")).alias("start"), exports.srt_time(F.col("stop")).alias("stop"))


def ass_cues(spark, sf_dir):
    found = exports.cues(_timed(spark, sf_dir))
    return found.select("doc_id", "n", exports.ass_time(F.col("start")).alias("start"), exports.ass_time(F.col("stop")).alias("stop"))


def srt_files(spark, sf_dir):
    return exports.to_srt(_timed(spark, sf_dir)).select("doc_id", F.md5("srt").alias("srt_md5"))


def ass_files(spark, sf_dir):
    return exports.to_ass(_timed(spark, sf_dir)).select("doc_id", F.md5("ass").alias("ass_md5"))


def srt_offsets(spark, sf_dir):
    found = scenes.offsets(scenes.scene_rows(_scened(spark, sf_dir)))
    return found.select("doc_id", "segment_id", F.round("scene_start", 4).alias("scene_start"))


def subtitle_totals(spark, sf_dir):
    return exports.subtitle_totals(_timed(spark, sf_dir)).select("doc_id", F.col("n_subtitles").cast("long").alias("n_subtitles"), "total_duration")


def subtitle_blocks(spark, sf_dir):
    found = plan.segment(_docs(spark, sf_dir))
    return found.select("doc_id", F.inline("scenes")).select("doc_id", "segment_id", F.inline("subtitles")).select("doc_id", "segment_id", "display_order", "text", "start_time", "duration")


def storyboard(spark, sf_dir):
    rows = F.from_json("storyboard", "total_scenes long, total_duration double, scenes array<struct<scene_id:int,text:string,duration_s:double,image_hint:string>>")
    found = exports.storyboard(_scened(spark, sf_dir)).select("doc_id", rows.alias("b"))
    return found.select("doc_id", "b.total_scenes", F.posexplode("b.scenes").alias("pos", "s")).select("doc_id", "total_scenes", "s.scene_id", "s.text", "s.image_hint")


def result_json(spark, sf_dir):
    found = plan.to_json(plan.segment(_docs(spark, sf_dir), with_subtitles=False))
    told = F.from_json("json", "language string, total_scenes long, sentence_count long")
    return found.select("doc_id", told.alias("j")).select("doc_id", "j.*")


def service_response(spark, sf_dir):
    found = plan.response(plan.segment(_docs(spark, sf_dir), with_subtitles=False))
    return found.select("doc_id", "language", F.size("sentences").cast("long").alias("n_sentences"), F.size("scenes").cast("long").alias("n_scenes"))


def prompt_requests(spark, sf_dir):
    found = _split(spark, sf_dir).select("doc_id", F.inline(length.apply(F.col("sentences"), "B")))
    return exports.prompt_requests(found).select("doc_id", "index", "prompt", "platform", "creative_level", "max_length", "num_candidates")


def prompt_contexts(spark, sf_dir):
    found = plan.segment(_docs(spark, sf_dir), {"enable_script_analysis": True}, with_subtitles=False)
    return exports.from_results(found).select("doc_id", "position", "prompt", "platform", F.col("context.synopsis").alias("synopsis"))


def compare_strategies(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    a, b = plan.segment(docs, with_subtitles=False), plan.segment(docs, {"scene": {"target_seconds": 12.0}}, with_subtitles=False)
    return plan.compare(a, b, "scenes").groupBy("doc_id").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"))


def era_classify(spark, sf_dir):
    found = era.detect(F.col("text"), LATIN)
    return let(_docs(spark, sf_dir), e=found).select("doc_id", "e.era", F.round("e.confidence", 6).alias("confidence"), F.array_join("e.keywords", ",").alias("keywords"))


def mood_first_match(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", script.mood(F.col("text"), LATIN_MOODS).alias("mood"))


def script_analysis(spark, sf_dir):
    found = let(_docs(spark, sf_dir), s=script.analyse(F.col("text")))
    return found.select("doc_id", "s.synopsis", F.size("s.characters").cast("long").alias("n_characters"), F.size("s.settings").cast("long").alias("n_settings"))


def scene_enrich(spark, sf_dir):
    given = F.struct(F.array(F.lit("erat"), F.lit("lich")).alias("characters"), F.array(F.lit("tion"), F.lit("ung")).alias("settings"))
    found = _scened(spark, sf_dir).select("doc_id", F.inline(script.enrich(F.col("scenes"), given)))
    return found.select("doc_id", "segment_id", F.array_join("characters", ",").alias("characters"), "setting", "mood")


def synopsis(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", script.synopsis(F.col("text")).alias("synopsis"))


def occurrence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(script.occurrences(F.col("text"), F.lit(w)).cast("long").alias(f"n_{w}") for w in ("the", "en", "anan")))


def key_terms_top10(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(english.tokens(F.col("text"))).alias("index", "term"))
    return script.key_terms(rows).select("doc_id", "rank", "term", "n")


def _phrases(spark, sf_dir):
    """A dictionary: the last words of benchmark items, and some that overlap; phrases of one character are none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.element_at(F.split(strip(F.col("text")), " "), -1).alias("phrase"))
    more = spark.createDataFrame([(p,) for p in ("the", "then", "hen", "ation", "tion")], "phrase string")
    return items.unionByName(more).where(F.length("phrase") >= 2).distinct()


def dict_match_all(spark, sf_dir):
    return dictionary.matches(_docs(spark, sf_dir), _phrases(spark, sf_dir))


def dict_match_longest(spark, sf_dir):
    return dictionary.longest(dict_match_all(spark, sf_dir))


def interval_merge(spark, sf_dir):
    return dictionary.merged_ranges(dict_match_all(spark, sf_dir))


def _segmented(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "text", F.filter(F.split("text", "(?<= )", -1), lambda s: s != "").alias("segments"))


def dict_split(spark, sf_dir):
    found = dictionary.adjust(_segmented(spark, sf_dir), _phrases(spark, sf_dir))
    return found.select("doc_id", F.posexplode("segments").alias("position", "segment"))


def dag_segment(spark, sf_dir):
    found = dictionary.segment_by_weight(_segmented(spark, sf_dir), _phrases(spark, sf_dir))
    return found.select("doc_id", F.size("path").cast("long").alias("n_pieces"))


def conversation_sentences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct("conv_id", "turn", "role").alias("doc_id"), "text")
    found = sentences.split_sentences(rows)
    return found.groupBy("doc_id.conv_id", "doc_id.role").agg(F.sum(F.size("sentences")).alias("n_sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_totals, lang_detect, lang_summary, lang_route, blank_filter, paragraphs, separator_filter, en_sentences, en_tokens, en_abbrev_protect, zh_rule_sentences, zh_tokens, ja_rule_sentences, split_tiers,
        sentence_records, length_status, length_status_hist, length_warnings, length_resplit, text_chunks, chunk_pipeline, scene_pack, scene_text, label_totals, scene_merge_short,
        paragraph_scenes, tt_terms, tt_similarity, tt_depth, tt_boundaries, tt_token_boundaries, topic_pipeline, jaccard_adjacent, subtitle_times, srt_cues, ass_cues, srt_files, ass_files,
        srt_offsets, subtitle_totals, subtitle_blocks, storyboard, result_json, service_response, prompt_requests, prompt_contexts, compare_strategies, era_classify, mood_first_match,
        script_analysis, scene_enrich, synopsis, occurrence_count, key_terms_top10, dict_match_all, dict_match_longest, interval_merge, dict_split, dag_segment, conversation_sentences)
}
