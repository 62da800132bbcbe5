"""Queries of the rules for Chinese and Japanese, and of steps that the Latin tables don't reach, each with DuckDB SQL.

The tables' texts are in Latin letters. Here every letter stands for a Han character (or vowels for kana), so that whole
tables run through names, places, conjunctions, terminators and eras. Both engines write the texts by the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import let
from lexmill.operators import chinese, dictionary, era, exports, japanese, language, length, model_tier, script, sentences
from lexmill.oracles import ORACLES as LATIN_SQL
from lexmill.oracles import EN, SENT, _chunks, _long, strip
from lexmill.queries import _docs, _rows, _split
from lexmill.streaming import chunks as stream

#: Characters for a-z, digits and marks; blanks and double quotes, which come last, go.
HAN_FROM, HAN_TO = 'abcdefghijklmnopqrstuvwxyz0123456789.,!? "', "大我云小海林去果走你但森明校学说桥边来如生却到天家阿一二三四五六七八九十。，！？"
KANA_FROM, KANA_TO = 'aeiout.!? "', "あいうえお日。！？"
HAN_ERAS = era.Vocabulary(("如果", "学校"), ("校去", "小说"), ("海边", "来如"), ("云学", "大校"))


def _han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), HAN_FROM, HAN_TO))


def _kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), KANA_FROM, KANA_TO))


def _told(docs: DataFrame) -> DataFrame:
    found = language.detect(let(docs, c=language.counters(F.col("text"))))
    return found.select("doc_id", *(F.col(f"c.{k}").cast("long").alias(f"n_{k}") for k in ("cjk", "kana", "ascii", "total")), "language", F.col("confidence").cast("double").alias("confidence"))


def lang_han(spark, sf_dir):
    return _told(_han(spark, sf_dir))


def lang_kana(spark, sf_dir):
    return _told(_kana(spark, sf_dir))


def lang_forced(spark, sf_dir):
    found = sentences.split_sentences(_docs(spark, sf_dir), forced="en")
    return found.select("doc_id", F.inline("sentences")).select("doc_id", "index", "text", "language")


def length_off(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", F.inline(length.apply(F.col("sentences"), "off"))).select("doc_id", "index", "length_status", "length_strategy_applied")


def zh_sentences_han(spark, sf_dir):
    return _rows(let(_han(spark, sf_dir), texts=chinese.sentences(F.col("text"))))


def ja_sentences_kana(spark, sf_dir):
    return _rows(let(_kana(spark, sf_dir), texts=japanese.sentences(F.col("text"))))


def era_scenes(spark, sf_dir):
    docs = let(language.detect(_han(spark, sf_dir)), texts=chinese.sentences(F.col("text")))
    told = era.add_era(F.transform("texts", lambda t, i: F.struct(i.alias("index"), t.alias("text"))), F.col("language"), HAN_ERAS)
    found = docs.select("doc_id", F.inline(told))
    return found.select("doc_id", "index", "era", F.round("era_confidence", 6).alias("confidence"), F.array_join("era_keywords", ",").alias("keywords"))


def script_characters(spark, sf_dir):
    return _han(spark, sf_dir).select("doc_id", F.array_join(script.characters(F.col("text")), ",").alias("characters"))


def script_settings(spark, sf_dir):
    return _han(spark, sf_dir).select("doc_id", F.array_join(script.settings(F.col("text")), ",").alias("settings"))


def script_changes(spark, sf_dir):
    docs = let(_han(spark, sf_dir), texts=chinese.sentences(F.col("text")))
    found = script.scene_changes(F.transform("texts", lambda t: F.struct(t.alias("text"))))
    return docs.select("doc_id", F.inline(found))


def model_sentences(spark, sf_dir):
    """A model that answers with the lines of its text."""

    def lines(messages: list[dict[str, str]]) -> str:
        text = messages[-1]["content"].split("：\n", 1)[1][:-1]
        return json.dumps(text.split("\n"))

    return _rows(model_tier.split_with_model(_docs(spark, sf_dir), lines))


def stream_progress(spark, sf_dir):
    found = stream.progress(sentences.chunked(_docs(spark, sf_dir), 2000))
    return found.select("doc_id", "chunk_index", "chunks_total", "sentences_so_far")


def phrase_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return dictionary.parse_phrases(lines)


def prompt_responses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    body = F.to_json(F.struct(F.col("text").alias("optimized_prompt"), F.col("lang").alias("platform")))
    found = let(docs, r=exports.optimize_response(body))
    return found.select("doc_id", F.md5("r.optimized_prompt").alias("prompt_md5"), "r.platform", "r.style", "r.model_used", "r.tokens_used", "r.duration_ms", F.size("r.candidates").cast("long").alias("n_candidates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (lang_han, lang_kana, lang_forced, length_off, zh_sentences_han, ja_sentences_kana, era_scenes, script_characters, script_settings, script_changes, model_sentences, stream_progress, phrase_lines, prompt_responses)
}

_HAN = f"han AS (SELECT doc_id, translate(lower(text), '{HAN_FROM}', '{HAN_TO}') AS text FROM documents)"
_KANA = f"kana AS (SELECT doc_id, translate(lower(text), '{KANA_FROM}', '{KANA_TO}') AS text FROM documents)"


def _counted(source: str) -> str:
    outside = lambda inside: f"length(regexp_replace(text, '[^{inside}]+', '', 'g'))"
    return rf"""n AS (SELECT doc_id, {outside(language.CJK)} AS cjk, {outside(language.KANA)} AS kana, {outside('A-Za-z')} AS ascii, length(regexp_replace(text, '[\s\x0b.,!?;:"''()\[\]{{}}，。！？；：（）【】]+', '', 'g')) AS total FROM {source}),
l AS (SELECT *, CASE WHEN total = 0 THEN 'zh' WHEN kana / total > 0.1 THEN 'ja' WHEN cjk / total > 0.3 THEN CASE WHEN ascii / total > 0.2 THEN 'mixed' ELSE 'zh' END WHEN ascii / total > 0.9 THEN 'en' ELSE 'mixed' END AS language, cjk + kana + ascii AS own FROM n)"""


def _language(source: str, cte: str) -> str:
    ties = ", ".join(f"{k / 200}e0: {round(k / 200, 2)}e0" for k in range(1, 200, 2))
    share = "CASE language WHEN 'ja' THEN kana + cjk WHEN 'zh' THEN cjk ELSE ascii END"
    return f"WITH {cte}, {_counted(source)} SELECT doc_id, cjk AS n_cjk, kana AS n_kana, ascii AS n_ascii, total AS n_total, language, CAST(CASE WHEN own = 0 THEN 0 WHEN language = 'mixed' THEN 0.5 ELSE coalesce(MAP {{{ties}}}[({share}) / own], round(({share}) / own, 2)) END AS DOUBLE) AS confidence FROM l"


#: A terminator ends a sentence unless one of the five characters' windows before it holds a conjunction.
_SENTENCES = rf"""{_HAN},
h0 AS (SELECT doc_id, {strip('text')} AS t FROM han),
h1 AS (SELECT doc_id, t, unnest(rs) AS r, unnest(range(0, len(rs))) AS a FROM (SELECT doc_id, t, regexp_extract_all(t, '[^{chinese.ENDS}\n]*[{chinese.ENDS}\n]|[^{chinese.ENDS}\n]+') AS rs FROM h0)),
h2 AS (SELECT *, CAST(sum(length(r)) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM h1),
h3 AS (SELECT doc_id, r, a, CASE WHEN regexp_matches(substr(t, greatest(1, e - 5), least(5, e - 1)), '{'|'.join(chinese.CONJUNCTIONS)}') THEN 0 ELSE 1 END AS closed FROM h2),
h4 AS (SELECT doc_id, r, a, coalesce(sum(closed) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM h3),
h5 AS (SELECT doc_id, g AS a, {strip("string_agg(r, '' ORDER BY a)")} AS s FROM h4 GROUP BY doc_id, g),
zh AS ({_long("h5", r"([；，,;])[ \t\n\r]*")})"""

_BRACKETS = rf"""WITH {_KANA},
j0 AS (SELECT doc_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS a FROM (SELECT doc_id, regexp_extract_all(text, '\([^)]*\)|[。！？\n]|[^。！？\n(]+|\(') AS ts FROM kana)),
j1 AS (SELECT *, coalesce(sum(CASE WHEN t IN ('。', '！', '？', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM j0),
j2 AS (SELECT doc_id, g, {strip("string_agg(t, '' ORDER BY a)")} AS text FROM j1 GROUP BY doc_id, g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS index, text FROM j2 WHERE text <> ''"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _eras() -> str:
    """The SQL of whole texts' eras, over sentences and with other words."""
    sql = LATIN_SQL["era_classify"].replace("FROM documents", "FROM zh").replace("SELECT doc_id,", "SELECT doc_id, index,")
    for old, new in zip(("['tion', 'ingsh']", "['the ', 'and ']", "['éen', 'ungsch']", "['der ', 'le ']"), (HAN_ERAS.modern, HAN_ERAS.modern_common, HAN_ERAS.ancient, HAN_ERAS.ancient_common), strict=True):
        sql = sql.replace(old, _list(new))
    short = "length(text) < 3"
    return f"""WITH {_SENTENCES}, {_counted('han')}, e AS ({sql})
SELECT zh.doc_id, zh.index, CASE WHEN language = 'zh' THEN CASE WHEN {short} THEN 'mixed' ELSE era END END AS era, CASE WHEN language = 'zh' THEN CASE WHEN {short} THEN 0.0::DOUBLE ELSE e.confidence END END AS confidence,
CASE WHEN language = 'zh' THEN CASE WHEN {short} THEN '' ELSE keywords END END AS keywords FROM zh JOIN e ON e.doc_id = zh.doc_id AND e.index = zh.index JOIN l ON l.doc_id = zh.doc_id"""


_CLASS = r"[\x{4E00}-\x{9FFF}]"
_BEFORE = [rf"list_transform(parts, lambda s: regexp_extract(s, '^({_CLASS}{{2,{n}}}){w}', 1))" for n, words in ((3, script.SIGNALS), (4, [*script.TRANSITIONS, *script.ACTIONS])) for w in words]
_CHARACTERS = rf"""WITH {_HAN}, p AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[。！？；.!?;]'), lambda s: {strip('s')}) AS parts, regexp_extract_all(text, '[小阿老]{_CLASS}') AS nick FROM han),
c AS (SELECT doc_id, list_filter(flatten([{', '.join(_BEFORE)}]), lambda c: c <> '' AND NOT list_contains({_list(script.NO_NAMES)}, c)) AS told, nick FROM p)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(told, nick), lambda c: NOT list_contains({_list(script.NOUNS)}, c) AND NOT regexp_matches(c, '({'|'.join(script.NO_ENDINGS)})$')))), ',') AS characters FROM c"""

_PLACE = f"length(c) > 1 AND NOT regexp_matches(c, '^({'|'.join(script.NO_PLACE_STARTS)})')"
_NAMED = ", ".join(f"regexp_extract_all(text, '(^|[^{_CLASS[1:-1]}])({_CLASS}{{1,4}}{p})', 2)" for p in script.PLACES)
_SETTINGS = f"""WITH {_HAN} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter({_list(script.PLACES)}, lambda p: contains(text, p)), list_filter(flatten([{_NAMED}]), lambda c: {_PLACE})))), ',') AS settings FROM han"""


def _behind(verb: str) -> str:
    after = f"regexp_replace(substr(text, instr(text, '{verb}') + {len(verb)}), '^[了着过的]+', '')"
    return f"CASE WHEN contains(text, '{verb}') THEN list_filter(list_transform(list_filter({_list(script.PLACES)}, lambda p: contains({after}, p)), lambda p: substr({after}, 1, instr({after}, p) + length(p) - 1)), lambda c: {_PLACE})[1] END"


#: The turns of the progress: chunks are the documents of the sentences' SQL.
_PROGRESS = (
    f"WITH RECURSIVE src AS (SELECT * FROM documents),{_chunks(2000)}, documents AS (SELECT doc_id * 100000 + chunk_no AS doc_id, text FROM chunk),{SENT},"
    " m AS (SELECT doc_id, count(*) AS m FROM sent GROUP BY doc_id)"
    " SELECT chunk.doc_id, chunk_no AS chunk_index, chunks_total, CAST(sum(coalesce(m, 0)) OVER (PARTITION BY chunk.doc_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sentences_so_far FROM chunk LEFT JOIN m ON m.doc_id = chunk.doc_id * 100000 + chunk_no"
)

ORACLES: dict[str, str] = {
    "lang_han": _language("han", _HAN),
    "lang_kana": _language("kana", _KANA),
    "lang_forced": f"WITH {EN} SELECT doc_id, index, text, 'en' AS language FROM en",
    "length_off": f"WITH {SENT} SELECT doc_id, index, 'ok' AS length_status, 'none' AS length_strategy_applied FROM sent",
    "zh_sentences_han": f"WITH {_SENTENCES} SELECT doc_id, index, text FROM zh",
    "ja_sentences_kana": _BRACKETS,
    "era_scenes": _eras(),
    "script_characters": _CHARACTERS,
    "script_settings": _SETTINGS,
    "script_changes": f"WITH {_SENTENCES} SELECT doc_id, sentence_idx, location FROM (SELECT doc_id, index AS sentence_idx, coalesce({', '.join(map(_behind, script.TRANSITIONS))}) AS location FROM zh) WHERE location IS NOT NULL",
    "model_sentences": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS index, text FROM (SELECT doc_id, unnest(range(0, len(ls))) AS a, unnest(ls) AS text FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) AS ls FROM documents)) WHERE text <> ''",
    "stream_progress": _PROGRESS,
    "phrase_lines": rf"SELECT DISTINCT phrase FROM (SELECT array_to_string(list_transform(regexp_split_to_array(line, '\s+'), lambda w: string_split(w, '/')[1]), '') AS phrase FROM (SELECT {strip('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE line <> '' AND NOT starts_with(line, '#')) WHERE length(phrase) >= 2",
    "prompt_responses": "SELECT doc_id, md5(coalesce(text, '')) AS prompt_md5, coalesce(lang, '') AS platform, CAST(NULL AS VARCHAR) AS style, '' AS model_used, 0::BIGINT AS tokens_used, 0.0::DOUBLE AS duration_ms, 0::BIGINT AS n_candidates FROM documents",
}
