"""DuckDB SQL that gives the rows of the queries, written for the tables' Latin texts."""

from __future__ import annotations

import re

from lexmill.operators import exports
from lexmill.operators.english import ABBREVIATIONS

_SPACE = r"[ \t\n\r\x0b\x0c]"
_ABBR = "|".join(a[:-1].replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)) if a.count(".") == 1 and a.endswith("."))


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def masked(c: str) -> str:
    """Dots of abbreviations as chr(57344); twice, since neighbours share the character between them."""
    for _ in range(2):
        c = rf"regexp_replace({c}, '(^|[^\pL\pN_])({_ABBR})\.($|[^\pL\pN_])', '\1\2' || chr(57344) || '\3', 'g')"
    return c


_LONG = r"""SELECT doc_id, a, b, c, {strip_piece} AS text FROM (
  SELECT doc_id, a, b, unnest(range(0, CAST(ceil(length(p) / 200.0) AS BIGINT))) AS c, p FROM (
    SELECT doc_id, a, unnest(range(0, len(ps))) AS b, {strip_part} AS p FROM (
      SELECT doc_id, a, s, CASE WHEN length(s) > 200 THEN string_split(regexp_replace(s, '{cut}', '\1' || chr(2), 'g'), chr(2)) ELSE [s] END AS ps FROM {source} WHERE s <> '')) WHERE p <> '')"""


def _long(source: str, cut: str) -> str:
    """Sentences over 200 characters cut at commas, then by size, with a dense index."""
    sql = _LONG.format(source=source, cut=cut, strip_part=strip("ps[b + 1]").replace("ps[b + 1]", "unnest(ps)"), strip_piece=strip("substr(p, 200 * c + 1, 200)"))
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1 AS INTEGER) AS index, text FROM ({sql}) WHERE text <> ''"


_EN_CUT = r"""'([.!?;])([ \t\n\r\x0b\x0c]+)([A-Z"(])', '\1\2' || chr(1) || '\3', 'g'"""
_EN_MARK = rf"regexp_replace(regexp_replace({masked(strip('text'))}, {_EN_CUT}), chr(1) || '([A-Za-z]+' || chr(57344) || ')', '\1', 'g')"
EN = rf"""
en0 AS (SELECT doc_id, string_split({_EN_MARK}, chr(1)) AS ps FROM documents),
en1 AS (SELECT doc_id, unnest(range(0, len(ps))) AS a, replace({strip("regexp_replace(unnest(ps), '[' || chr(9) || ' ]+', ' ', 'g')")}, chr(57344), '.') AS s FROM en0),
en AS ({_long("en1", r"([,;:])[ \t\n\r]+")})"""

_ZH_MARK = strip("text")
for pattern, put in ((r"([.!?;\n])", r"\1' || chr(1) || '"), (r"\x01([a-zA-Z0-9]{5})", r"\1"), (r"\x01([a-zA-Z0-9]{4}\n)", r"\1"), (r"\x01([a-zA-Z0-9]{4})$", r"\1")):
    _ZH_MARK = f"regexp_replace({_ZH_MARK}, '{pattern}', '{put}', 'g')"
ZH = rf"""
zh0 AS (SELECT doc_id, string_split({_ZH_MARK}, chr(1)) AS ps FROM documents),
zh1 AS (SELECT doc_id, unnest(range(0, len(ps))) AS a, {strip("unnest(ps)")} AS s FROM zh0),
zh AS ({_long("zh1", r"([,;])[ \t\n\r]*")})"""

_NOT_COUNTED = r"""'[\s\x0b.,!?;:"''()\[\]{}，。！？；：（）【】]+'"""
LANG = r"""
lc AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS ascii, length(regexp_replace(text, '[\s\x0b.,!?;:"''()\[\]{}，。！？；：（）【】]+', '', 'g')) AS total FROM documents),
lang AS (SELECT doc_id, CASE WHEN total = 0 THEN 'zh' WHEN ascii / total > 0.9 THEN 'en' ELSE 'mixed' END AS language, CASE WHEN total = 0 OR ascii = 0 THEN 0.0 WHEN ascii / total > 0.9 THEN 1.0 ELSE 0.5 END AS confidence FROM lc)"""

SENT = f"""{LANG},{EN},{ZH},
sent AS (SELECT en.*, 'en' AS language FROM en JOIN lang USING (doc_id) WHERE language = 'en' UNION ALL SELECT zh.*, language FROM zh JOIN lang USING (doc_id) WHERE language <> 'en')"""

#: Scenes by a walk over sentences: target 19 characters, a second sentence always fits.
SCENES = SENT + r""",
clean AS (SELECT doc_id, language, text, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS i FROM sent),
walk(doc_id, i, scene, acc, n) AS (
  SELECT doc_id, i, 0, length(text), 1 FROM clean WHERE i = 1
  UNION ALL
  SELECT c.doc_id, c.i, CASE WHEN fits THEN scene ELSE scene + 1 END, CASE WHEN fits THEN acc + size ELSE size END, CASE WHEN fits THEN n + 1 ELSE 1 END
  FROM (SELECT c.doc_id, c.i, length(c.text) AS size, w.scene, w.acc, w.n, (w.acc + length(c.text) <= 19 OR w.n <= 1) AS fits FROM walk w JOIN clean c ON c.doc_id = w.doc_id AND c.i = w.i + 1) c),
placed AS (SELECT c.*, w.scene, lag(c.text) OVER (PARTITION BY c.doc_id, w.scene ORDER BY c.i) AS before FROM clean c JOIN walk w ON w.doc_id = c.doc_id AND w.i = c.i),
scenes AS (SELECT doc_id, CAST(scene AS INTEGER) AS segment_id, CAST(sum(length(text)) AS INTEGER) AS target_words, CAST(count(*) AS INTEGER) AS n_sentences,
  sum(length(text)) / 3.3::DOUBLE AS duration, string_agg(CASE WHEN before IS NOT NULL AND right(before, 1) NOT IN ('。', '！', '？', '；', '.', '!', '?', ';', chr(10)) THEN '。' ELSE '' END || text, '' ORDER BY i) AS text
  FROM placed GROUP BY doc_id, scene)"""

_NONE = "SELECT doc_id FROM documents"
_SCENE_SIDE = "documents d LEFT JOIN lang USING (doc_id)"

TERMS = EN + r""",
terms AS (SELECT doc_id, index, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*'), lambda t: lower(t))) AS term FROM en),
ns AS (SELECT doc_id, count(*) AS n FROM en GROUP BY doc_id HAVING count(*) >= 6),
tile AS (SELECT ns.doc_id, unnest(range(0, n - 2)) AS tile FROM ns),
counts AS (SELECT tile.doc_id, tile, term, count(*) AS n FROM tile JOIN terms ON terms.doc_id = tile.doc_id AND terms.index BETWEEN tile AND tile + 2 GROUP BY ALL),
norm AS (SELECT doc_id, tile, sum(n * n) AS q FROM counts GROUP BY ALL),
dots AS (SELECT a.doc_id, a.tile, sum(a.n * b.n) AS dot FROM counts a JOIN counts b ON b.doc_id = a.doc_id AND b.tile = a.tile + 1 AND b.term = a.term GROUP BY ALL),
sims AS (SELECT t.doc_id, t.tile, CASE WHEN a.q > 0 AND b.q > 0 THEN coalesce(dot, 0) / (sqrt(a.q) * sqrt(b.q)) ELSE 0.0 END AS similarity
  FROM tile t JOIN tile u ON u.doc_id = t.doc_id AND u.tile = t.tile + 1 LEFT JOIN norm a ON a.doc_id = t.doc_id AND a.tile = t.tile LEFT JOIN norm b ON b.doc_id = t.doc_id AND b.tile = t.tile + 1
  LEFT JOIN dots d ON d.doc_id = t.doc_id AND d.tile = t.tile)"""


def _depth(source: str) -> str:
    return f"SELECT *, coalesce(greatest(0.0, lag(similarity) OVER w + lead(similarity) OVER w - 2 * similarity), 0.0) AS depth FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY tile)"


_HALF = lambda x: f"(floor(({x}) * 100 + 0.5) / 100)"


def _timed(method: str) -> str:
    own = "60.0::DOUBLE / n" if method == "equal" else "length(t) / total * 60.0::DOUBLE"
    return rf"""
bl AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ts FROM documents),
bt AS (SELECT doc_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS o, len(ts) AS n, list_sum(list_transform(ts, lambda x: length(x)))::DOUBLE AS total FROM bl),
bd AS (SELECT doc_id, CAST(o AS INTEGER) AS o, t, {_HALF(own)} AS d FROM bt),
cue AS (SELECT doc_id, o AS display_order, t, d AS duration, coalesce(round(sum(d) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2), 0.0) AS start_time FROM bd)"""


def _clock(x: str, parts: int) -> str:
    whole = f"CAST(floor({x}) AS BIGINT)"
    rest = f"CAST(floor(({x} - floor({x})) * {parts}) AS BIGINT)"
    hours = f"printf('%02d', {whole} // 3600)" if parts == 1000 else f"CAST({whole} // 3600 AS VARCHAR)"
    last = f"',' || printf('%03d', {rest})" if parts == 1000 else f"'.' || printf('%02d', {rest})"
    return f"{hours} || ':' || printf('%02d', {whole} % 3600 // 60) || ':' || printf('%02d', {whole} % 60) || {last}"


_WITH = "WITH RECURSIVE "
_PLATFORM = "CASE language WHEN 'en' THEN 'stable_diffusion' ELSE 'midjourney' END"
_STATUS = "CASE WHEN length(text) < 3 THEN 'too_short' WHEN length(text) > 15 THEN 'too_long' ELSE 'ok' END"
_TIER = "CASE WHEN sum(length(text)) / count(*) > 1 AND sum(length(text)) / count(*) < 1000 THEN 'tier3_rule' ELSE 'tier3_rule_fallback' END"
_q = lambda text: text.replace("'", "''")
_ASS = "\n".join([exports.ASS_HEADER.replace("{title}", "Subtitles"), exports.ASS_STYLE, "", exports.ASS_EVENTS, exports.ASS_FORMAT])

#: Scenes of a whole result: separator lines go before sentences are packed.
_KEPT = SCENES.replace("FROM sent),", r"FROM sent WHERE NOT regexp_matches(text, '^[\s\-—*=~•]{2,}$')),", 1)
_PARAGRAPHS = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS ps FROM documents),
q AS (SELECT doc_id, CAST(unnest(range(0, len(ps))) AS INTEGER) AS paragraph, unnest(ps) AS text FROM p),
c AS (SELECT *, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS ascii, length(regexp_replace(text, {_NOT_COUNTED}, '', 'g')) AS total FROM q)
SELECT doc_id, paragraph, text, CASE WHEN total = 0 THEN 'zh' WHEN ascii / total > 0.9 THEN 'en' ELSE 'mixed' END AS language FROM c"""

#: The same sentences over turns of conversations: the documents of the SQL are turns.
_CONVERSATIONS = "WITH documents AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, role, text FROM conversations)," + SENT + " SELECT conv_id, role, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_sentences FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) USING (doc_id) GROUP BY conv_id, role"

ORACLES: dict[str, str] = {
    "lang_detect": f"WITH {LANG} SELECT doc_id, language, CAST(confidence AS DOUBLE) AS confidence FROM lang",
    "lang_summary": f"WITH {LANG} SELECT language, count(*) AS n_docs FROM lang GROUP BY language",
    "lang_route": f"WITH {LANG} SELECT doc_id, CASE WHEN language = 'en' THEN 'en' ELSE 'zh' END AS chain FROM lang",
    "blank_filter": r"SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '[^\s]') AS blank FROM documents",
    "paragraphs": _PARAGRAPHS,
    "separator_filter": rf"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, {strip('unnest(string_split(text, chr(10)))')} AS l FROM documents) WHERE l <> '' AND NOT regexp_matches(l, '^[\s\-—*=~•]{{2,}}$') GROUP BY doc_id",
    "en_sentences": f"WITH {EN} SELECT doc_id, index, text FROM en",
    "en_tokens": r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[a-z]+)?|\pN+(?:\.\pN+)?|[^\s\x0b\pL\pN\pM_]') AS t FROM documents)",
    "en_abbrev_protect": f"SELECT doc_id, CAST(length(text) - length(replace({masked('text')}, chr(57344), '')) AS BIGINT) AS n_masked FROM documents",
    "zh_rule_sentences": f"WITH {ZH} SELECT doc_id, index, text FROM zh",
    "ja_rule_sentences": rf"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS index, s AS text FROM (SELECT doc_id, unnest(range(0, len(ps))) AS a, {strip('unnest(ps)')} AS s FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\(([^)\n]*)\n([^)]*)\)', '(\1' || chr(3) || '\2)', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) AS ps FROM documents)) WHERE s <> ''",
    "split_tiers": f"WITH {SENT} SELECT doc_id, lang.language, coalesce(tier, 'tier3_rule') AS tier_used, coalesce(n, 0) AS n_sentences FROM lang LEFT JOIN (SELECT doc_id, count(*) AS n, {_TIER} AS tier FROM sent GROUP BY doc_id) USING (doc_id)",
    "sentence_records": f"WITH {SENT} SELECT doc_id, index, text, CAST(length(text) AS INTEGER) AS char_count, language, 'tier3_rule' AS tier, CAST(1.0 AS DOUBLE) AS confidence FROM sent",
    "length_status": f"WITH {SENT} SELECT doc_id, index, {_STATUS} AS length_status, 'B' AS length_strategy_applied FROM sent",
    "length_status_hist": f"WITH {SENT} SELECT {_STATUS} AS length_status, count(*) AS n FROM sent GROUP BY 1",
    "length_warnings": f"WITH {SENT} SELECT doc_id, '[B] Sentence ' || index || ' length=' || length(text) || ' status=' || k || ': ' || substr(text, 1, 30) || '...' AS warning FROM (SELECT *, {_STATUS} AS k FROM sent) WHERE k <> 'ok'",
    "scene_pack": f"{_WITH}{SCENES} SELECT doc_id, segment_id, target_words, n_sentences, round(duration, 6) AS estimated_duration FROM scenes",
    "scene_text": f"{_WITH}{SCENES} SELECT doc_id, segment_id, text FROM scenes",
    "doc_totals": f"{_WITH}{SCENES} SELECT lang.doc_id, lang.language, coalesce(ns, 0) AS n_sentences, coalesce(n, 0) AS total_scenes, CAST(coalesce(w, 0) AS BIGINT) AS total_words, coalesce(round(d, 4), 0.0) AS total_duration FROM lang LEFT JOIN (SELECT doc_id, CAST(sum(n_sentences) AS BIGINT) AS ns, count(*) AS n, sum(length(text)) AS w, sum(duration) AS d FROM scenes GROUP BY doc_id) USING (doc_id)",
    "label_totals": f"{_WITH}{SCENES} SELECT quality, count(*) AS n_docs, CAST(sum(ns) AS BIGINT) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_scenes FROM labels JOIN (SELECT lang.doc_id, coalesce(sum(n_sentences), 0) AS ns, count(segment_id) AS n FROM lang LEFT JOIN scenes USING (doc_id) GROUP BY lang.doc_id) USING (doc_id) GROUP BY quality",
    "tt_terms": f"WITH {EN} SELECT doc_id, index, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*')) AS BIGINT) AS n_terms FROM en",
    "tt_similarity": f"WITH {TERMS} SELECT doc_id, CAST(tile AS INTEGER) AS tile, round(similarity, 6) AS similarity FROM sims",
    "tt_depth": f"WITH {TERMS}, smooth AS (SELECT doc_id, tile, coalesce((lag(similarity) OVER w + 2 * similarity + lead(similarity) OVER w) / 4, similarity) AS similarity FROM sims WINDOW w AS (PARTITION BY doc_id ORDER BY tile)), depths AS ({_depth('smooth')}) SELECT doc_id, CAST(tile AS INTEGER) AS tile, round(similarity, 6) AS similarity, round(depth, 6) AS depth FROM depths",
    "tt_boundaries": f"""WITH {TERMS}, depths AS ({_depth("sims")}),
seen AS (SELECT *, lag(depth) OVER w AS l, lead(depth) OVER w AS r, max(depth) OVER (PARTITION BY doc_id) AS most FROM depths WINDOW w AS (PARTITION BY doc_id ORDER BY tile)),
near AS (SELECT doc_id, index, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position, coalesce(lag(text) OVER w, '') AS before, text || coalesce(lead(text) OVER w, '') AS after FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY index))
SELECT near.doc_id, near.index, CAST(position AS BIGINT) AS position, round(depth, 6) AS depth_score, right(before, 30) AS text_before, left(after, 30) AS text_after
FROM seen JOIN near ON near.doc_id = seen.doc_id AND near.index = seen.tile WHERE depth > greatest(0.3, most * 0.3) AND depth >= l AND depth >= r""",
    "jaccard_adjacent": f"WITH {EN}, s AS (SELECT doc_id, index, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*'), lambda t: lower(t))) AS t FROM en) SELECT a.doc_id, a.index, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END, 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.index = a.index + 1",
    "subtitle_times": f"WITH {_timed('proportional')} SELECT doc_id, display_order, start_time, duration FROM cue",
    "srt_cues": f"WITH {_timed('equal')} SELECT doc_id, CAST(display_order + 1 AS INTEGER) AS n, {_clock('start_time', 1000)} AS start, {_clock('(start_time + duration)', 1000)} AS stop FROM cue",
    "ass_cues": f"WITH {_timed('proportional')} SELECT doc_id, CAST(display_order + 1 AS INTEGER) AS n, {_clock('start_time', 100)} AS start, {_clock('(start_time + duration)', 100)} AS stop FROM cue",
    "srt_files": f"WITH {_timed('proportional')} SELECT doc_id, md5(coalesce(b, '')) AS srt_md5 FROM documents LEFT JOIN (SELECT doc_id, string_agg((display_order + 1) || chr(10) || {_clock('start_time', 1000)} || ' --> ' || {_clock('(start_time + duration)', 1000)} || chr(10) || t || chr(10), chr(10) ORDER BY display_order) AS b FROM cue GROUP BY doc_id) USING (doc_id)",
    "ass_files": f"WITH {_timed('proportional')} SELECT doc_id, md5('{_q(_ASS)}' || coalesce(chr(10) || b, '')) AS ass_md5 FROM documents LEFT JOIN (SELECT doc_id, string_agg('Dialogue: 0,' || {_clock('start_time', 100)} || ',' || {_clock('(start_time + duration)', 100)} || ',Default,,0,0,0,,' || t, chr(10) ORDER BY display_order) AS b FROM cue GROUP BY doc_id) USING (doc_id)",
    "srt_offsets": f"{_WITH}{SCENES} SELECT doc_id, segment_id, round(coalesce(sum(duration) OVER (PARTITION BY doc_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS scene_start FROM scenes",
    "subtitle_totals": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_subtitles, 60.0::DOUBLE AS total_duration FROM documents",
    "storyboard": f"{_WITH}{SCENES} SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS total_scenes, segment_id AS scene_id, text, text AS image_hint FROM scenes",
    "prompt_requests": f"WITH {SENT} SELECT doc_id, index, text AS prompt, {_PLATFORM} AS platform, CASE k WHEN 'too_short' THEN 8 WHEN 'too_long' THEN 3 ELSE 5 END AS creative_level, CASE k WHEN 'too_short' THEN 700 WHEN 'too_long' THEN 200 ELSE 500 END AS max_length, 1 AS num_candidates FROM (SELECT *, {_STATUS} AS k FROM sent)",
    "result_json": f"{_WITH}{_KEPT} SELECT lang.doc_id, lang.language, coalesce(n, 0) AS total_scenes, coalesce(m, 0) AS sentence_count FROM lang LEFT JOIN (SELECT doc_id, count(*) AS n FROM scenes GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM clean GROUP BY doc_id) USING (doc_id)",
    "service_response": f"{_WITH}{_KEPT} SELECT lang.doc_id, lang.language, coalesce(m, 0) AS n_sentences, coalesce(n, 0) AS n_scenes FROM lang LEFT JOIN (SELECT doc_id, count(*) AS n FROM scenes GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM clean GROUP BY doc_id) USING (doc_id)",
    "conversation_sentences": _CONVERSATIONS,
    "era_classify": r"""WITH h AS (SELECT doc_id, list_filter(['tion', 'ingsh'], lambda k: contains(text, k)) AS m, list_filter(['éen', 'ungsch'], lambda k: contains(text, k)) AS a,
  len(list_filter(['the ', 'and '], lambda k: contains(text, k))) AS mc, len(list_filter(['der ', 'le '], lambda k: contains(text, k))) AS ac FROM (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS text FROM documents)),
s AS (SELECT *, 3 * len(m) + mc AS ms, 3 * len(a) + ac AS s FROM h),
r AS (SELECT *, CASE WHEN ms >= 2 AND ms >= s * 1.5 THEN 1 WHEN len(m) >= 1 AND len(a) = 0 THEN 2 WHEN s >= 2 AND s >= ms * 1.5 THEN 3 WHEN len(a) >= 1 AND len(m) = 0 THEN 4 WHEN ms > s AND ms >= 2 THEN 5 WHEN s > ms AND s >= 2 THEN 6 ELSE 7 END AS k FROM s)
SELECT doc_id, CASE WHEN k IN (1, 2, 5) THEN 'modern' WHEN k = 7 THEN 'mixed' ELSE 'ancient' END AS era,
  CAST(CASE k WHEN 1 THEN round(least(0.6 + ms * 0.08, 0.98), 6) WHEN 2 THEN 0.8 WHEN 3 THEN round(least(0.6 + s * 0.08, 0.98), 6) WHEN 4 THEN 0.8 WHEN 7 THEN 0.0 ELSE 0.6 END AS DOUBLE) AS confidence,
  CASE WHEN k IN (1, 2, 5) THEN array_to_string(m, ',') WHEN k = 7 THEN '' ELSE array_to_string(a, ',') END AS keywords FROM r""",
    "mood_first_match": "SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN 'angry' WHEN contains(text, 'the ') THEN 'calm' WHEN contains(text, 'une ') THEN 'happy' WHEN contains(text, 'der ') THEN 'tense' ELSE '' END AS mood FROM documents",
    "scene_enrich": f"{_WITH}{SCENES} SELECT doc_id, segment_id, array_to_string(list_filter(['erat', 'lich'], lambda c: contains(text, c)), ',') AS characters, coalesce(list_filter(['tion', 'ung'], lambda c: contains(text, c))[1], '') AS setting, '' AS mood FROM scenes",
    "synopsis": rf"SELECT doc_id, CASE WHEN length(f) <= 200 THEN f ELSE substr(f, 1, 200) || '...' END AS synopsis FROM (SELECT doc_id, replace({strip(f'''regexp_split_to_array({strip('text')}, '{chr(92)}n{chr(92)}s*{chr(92)}n')[1]''')}, chr(10), '') AS f FROM documents)",
    "occurrence_count": "SELECT doc_id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{w}', ''))) // {len(w)} AS BIGINT) AS n_{w}" for w in ("the", "en", "anan")) + " FROM documents",
    "key_terms_top10": r"""WITH t AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[a-z]+)?|\pN+(?:\.\pN+)?|[^\s\x0b\pL\pN\pM_]') AS w FROM documents)),
c AS (SELECT doc_id, term, count(*) AS n, min(i) AS first FROM t WHERE length(term) >= 2 GROUP BY ALL)
SELECT doc_id, CAST(r AS INTEGER) AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) WHERE r <= 10""",
}


def _again(sql: str, names: tuple[str, ...], suffix: str) -> str:
    """The same table expressions under other names."""
    for name in names:
        sql = re.sub(rf"\b{name}\b", name + suffix, sql)
    return sql


#: Scenes of the target 39 beside those of 19.
_LONGER = _again(_KEPT[_KEPT.index("walk(doc_id") :].replace("<= 19", "<= 39"), ("walk", "placed", "scenes"), "39")

_PHRASES = rf"""p AS (SELECT DISTINCT phrase FROM (SELECT string_split({strip('text')}, ' ')[-1] AS phrase FROM benchmark UNION ALL SELECT unnest(['the', 'then', 'hen', 'ation', 'tion'])) WHERE length(phrase) >= 2),
ls AS (SELECT DISTINCT length(phrase) AS n FROM p),
part AS (SELECT doc_id, 200 * k AS base, substr(text, 200 * k + 1, 199 + (SELECT max(n) FROM ls)) AS t, least(200, length(text) - 200 * k) AS own FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS k FROM documents)),
spot AS (SELECT doc_id, base + i AS start, n, substr(t, CAST(i + 1 AS BIGINT), n) AS phrase FROM (SELECT doc_id, base, t, unnest(range(0, own)) AS i FROM part), ls),
found AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS "end", spot.phrase FROM spot JOIN p ON p.phrase = spot.phrase AND length(p.phrase) = n),
top AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY "end" DESC) = 1),
long AS (SELECT * FROM top QUALIFY coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < "end")"""


def _merged(source: str) -> str:
    return f"""SELECT doc_id, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY doc_id, g"""


_SPLIT = rf"""WITH {_PHRASES}, range_ AS ({_merged("long")}),
word AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS k FROM documents),
edge AS (SELECT doc_id, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM word),
outer_ AS (SELECT edge.doc_id, e FROM edge ASOF LEFT JOIN range_ ON range_.doc_id = edge.doc_id AND range_.start < e WHERE range_."end" IS NULL OR e >= range_."end"),
cut AS (SELECT DISTINCT doc_id, e FROM (SELECT doc_id, 0 AS e FROM documents UNION ALL SELECT doc_id, length(text) FROM documents UNION ALL SELECT * FROM outer_ UNION ALL SELECT doc_id, start FROM range_ UNION ALL SELECT doc_id, "end" FROM range_)),
piece AS (SELECT doc_id, e, lead(e) OVER (PARTITION BY doc_id ORDER BY e) AS f FROM cut),
segment AS (SELECT piece.doc_id, e, substr(text, e + 1, f - e) AS segment, EXISTS (SELECT 1 FROM range_ WHERE range_.doc_id = piece.doc_id) AS has FROM piece JOIN documents d ON d.doc_id = piece.doc_id WHERE f <= length(text) AND e < f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INTEGER) AS position, segment FROM segment WHERE NOT has OR {strip("segment")} <> ''"""


def _chunks(most: int) -> str:
    """(doc_id, chunk_no, chunks_total, text) of texts cut into chunks, from `src`."""
    return rf"""run0 AS (SELECT doc_id, unnest(rs) AS r, unnest(range(0, len(rs))) AS a FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？；!?.\n…])', '\1' || chr(1), 'g'), chr(1)) AS rs FROM src WHERE length(text) > {most})),
run1 AS (SELECT doc_id, a, b, substr(r, {most} * b + 1, {most}) AS r FROM (SELECT doc_id, a, r, unnest(range(0, CAST(ceil(length(r) / {most}.0) AS BIGINT))) AS b FROM run0 WHERE r <> '')),
run AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS i FROM run1),
pack(doc_id, i, c, acc) AS (
  SELECT doc_id, i, 0, length(r) FROM run WHERE i = 1
  UNION ALL
  SELECT run.doc_id, run.i, CASE WHEN acc + length(r) <= {most} THEN c ELSE c + 1 END, CASE WHEN acc + length(r) <= {most} THEN acc + length(r) ELSE length(r) END FROM pack JOIN run ON run.doc_id = pack.doc_id AND run.i = pack.i + 1),
chunk0 AS (SELECT pack.doc_id, c, string_agg(r, '' ORDER BY pack.i) AS t FROM pack JOIN run ON run.doc_id = pack.doc_id AND run.i = pack.i GROUP BY pack.doc_id, c
  UNION ALL SELECT doc_id, 0, text FROM src WHERE length(text) <= {most}),
chunk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS chunk_no, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS chunks_total, t AS text FROM (SELECT doc_id, c, {strip("t")} AS t FROM chunk0) WHERE t <> '')"""


_SRC = "src AS (SELECT * FROM documents)"
#: Chunks are the documents of the sentences' SQL; scenes are packed through all chunks of a text, whose language is its own.
_CHUNKED = (
    f"{_WITH}{_SRC},{_chunks(5000)}, whole AS (SELECT * FROM src), documents AS (SELECT doc_id * 100000 + chunk_no AS doc_id, text FROM chunk),"
    + _KEPT.replace("clean AS (SELECT doc_id, language, text, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS i", "clean AS (SELECT doc_id // 100000 AS doc_id, language, text, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id, index) AS i")
    + ","
    + _again(LANG.replace("FROM documents", "FROM whole"), ("lc", "lang"), "_w")
    + " SELECT lang_w.doc_id, lang_w.language, coalesce(m, 0) AS n_sentences, CAST(coalesce(n, 0) AS INTEGER) AS total_scenes FROM lang_w LEFT JOIN (SELECT doc_id, count(*) AS n FROM scenes GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM clean GROUP BY doc_id) USING (doc_id)"
)


def _shortest(source: str) -> str:
    """Scenes that take in those behind them until they last six seconds."""
    return f"""step(doc_id, segment_id, g, d) AS (
  SELECT doc_id, segment_id, 0, duration FROM {source} WHERE segment_id = 0
  UNION ALL
  SELECT s.doc_id, s.segment_id, CASE WHEN d < 6.0 THEN g ELSE g + 1 END, CASE WHEN d < 6.0 THEN d + duration ELSE duration END FROM step JOIN {source} s ON s.doc_id = step.doc_id AND s.segment_id = step.segment_id + 1),
merged AS (SELECT step.doc_id, g, string_agg(text, '' ORDER BY step.segment_id) AS text, CAST(sum(n_sentences) AS INTEGER) AS n_sentences FROM step JOIN {source} s ON s.doc_id = step.doc_id AND s.segment_id = step.segment_id GROUP BY step.doc_id, g)"""


#: Lines are the documents of the scenes' SQL.
_LINES = (
    rf"{_WITH}{_SRC}, line AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS BIGINT) AS k, unnest(ls) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM src)),"
    + r" documents AS (SELECT doc_id * 100000 + k AS doc_id, text FROM line WHERE NOT regexp_matches(text, '^[\s\-—*=~•]{2,}$')),"
    + SCENES
    + f",{_shortest('scenes')} SELECT doc_id // 100000 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id, g) - 1 AS INTEGER) AS segment_id, text FROM merged"
)

_TOKENS = r"""tok AS (SELECT doc_id, CAST(unnest(range(0, len(ws))) AS BIGINT) AS index, unnest(ws) AS term, len(ws) AS n FROM (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: lower(w)) AS ws FROM documents)),
place AS (SELECT *, coalesce(sum(length(term) + 1) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM tok),
tile AS (SELECT doc_id, unnest(range(0, n - 9, 5)) AS tile FROM (SELECT DISTINCT doc_id, n FROM tok WHERE n >= 20)),
counts AS (SELECT tile.doc_id, tile, term, count(*) AS n FROM tile JOIN tok ON tok.doc_id = tile.doc_id AND tok.index BETWEEN tile AND tile + 9 GROUP BY ALL),
norm AS (SELECT doc_id, tile, sum(n * n) AS q FROM counts GROUP BY ALL),
dots AS (SELECT a.doc_id, a.tile, sum(a.n * b.n) AS dot FROM counts a JOIN counts b ON b.doc_id = a.doc_id AND b.tile = a.tile + 5 AND b.term = a.term GROUP BY ALL),
sims AS (SELECT a.doc_id, a.tile, coalesce(dot, 0) / (sqrt(a.q) * sqrt(b.q)) AS similarity FROM norm a JOIN norm b ON b.doc_id = a.doc_id AND b.tile = a.tile + 5 LEFT JOIN dots d ON d.doc_id = a.doc_id AND d.tile = a.tile)"""

_PEAKS = "seen AS (SELECT *, lag(depth) OVER w AS l, lead(depth) OVER w AS r, max(depth) OVER (PARTITION BY doc_id) AS most FROM depths WINDOW w AS (PARTITION BY doc_id ORDER BY tile))"

#: Topics in the sentences of each language's rules; a boundary starts a scene, and a text with boundaries has three times the target.
_TOPICS = (
    f"{_WITH}{SENT}, en_long AS (SELECT sent.doc_id, sent.index, sent.text FROM sent JOIN documents d ON d.doc_id = sent.doc_id WHERE length(d.text) >= 100)"
    + _again(TERMS[len(EN) :], ("en",), "_long")
    + f", depths AS ({_depth('sims')}), {_PEAKS}, mark AS (SELECT doc_id, tile FROM seen WHERE depth > greatest(0.3, most * 0.3) AND depth >= l AND depth >= r),"
    + r"""
clean AS (SELECT s.doc_id, s.text, tile IS NOT NULL AS topic, row_number() OVER (PARTITION BY s.doc_id ORDER BY index) AS i FROM sent s LEFT JOIN mark ON mark.doc_id = s.doc_id AND mark.tile = s.index WHERE NOT regexp_matches(s.text, '^[\s\-—*=~•]{2,}$')),
goal AS (SELECT doc_id, CASE WHEN bool_or(topic) THEN 57 ELSE 19 END AS most FROM clean GROUP BY doc_id),
walk(doc_id, i, scene, acc, n) AS (
  SELECT doc_id, i, 0, length(text), 1 FROM clean WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN fits THEN scene ELSE scene + 1 END, CASE WHEN fits THEN acc + size ELSE size END, CASE WHEN fits THEN n + 1 ELSE 1 END
  FROM (SELECT c.doc_id, c.i, length(c.text) AS size, w.scene, w.acc, w.n, NOT c.topic AND (w.acc + length(c.text) <= most OR w.n <= 1) AS fits FROM walk w JOIN clean c ON c.doc_id = w.doc_id AND c.i = w.i + 1 JOIN goal ON goal.doc_id = c.doc_id))
SELECT lang.doc_id, CASE WHEN v IS NULL THEN 'tier3_rule' WHEN v THEN 'tier2_semantic' ELSE 'tier3_rule_fallback' END AS tier_used, coalesce(m, 0) AS n_topics, coalesce(k, 0) AS total_scenes FROM lang
LEFT JOIN (SELECT doc_id, sum(length(text)) / count(*) > 1 AND sum(length(text)) / count(*) < 1000 AS v FROM sent GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE topic) AS m FROM clean GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, CAST(max(scene) + 1 AS BIGINT) AS k FROM walk GROUP BY doc_id) USING (doc_id)"""
)

ORACLES |= {
    "zh_tokens": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '(?s).'), '|')) AS tokens_md5 FROM documents",
    "script_analysis": f"SELECT doc_id, synopsis, 0 AS n_characters, 0 AS n_settings FROM ({ORACLES['synopsis']})",
    "compare_strategies": f"{_WITH}{_KEPT},{_LONGER} SELECT doc_id, n_a, n_b FROM (SELECT doc_id, count(*) AS n_a FROM scenes GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS n_b FROM scenes39 GROUP BY doc_id) USING (doc_id)",
    "prompt_contexts": f"{_WITH}{_KEPT}, syn AS ({ORACLES['synopsis']}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, text AS prompt, {_PLATFORM} AS platform, nullif(synopsis, '') AS synopsis FROM clean JOIN syn USING (doc_id)",
    "scene_merge_short": f"{_WITH}{SCENES},{_shortest('scenes')} SELECT doc_id, CAST(g AS INTEGER) AS segment_id, text, n_sentences FROM merged",
    "paragraph_scenes": _LINES,
    "text_chunks": f"{_WITH}{_SRC},{_chunks(2000)} SELECT doc_id, chunk_no, chunks_total, text FROM chunk",
    "chunk_pipeline": _CHUNKED,
    "tt_token_boundaries": f"WITH {_TOKENS}, depths AS ({_depth('sims')}), {_PEAKS} SELECT seen.doc_id, CAST(tile AS INTEGER) AS index, CAST(position AS BIGINT) AS position FROM seen JOIN place ON place.doc_id = seen.doc_id AND place.index = tile WHERE depth > greatest(0.15, most * 0.4) AND depth >= l AND depth >= r",
    "topic_pipeline": _TOPICS,
    "dict_match_all": f'WITH {_PHRASES} SELECT doc_id, start, "end", phrase FROM found',
    "dict_match_longest": f'WITH {_PHRASES} SELECT doc_id, start, "end", phrase FROM long',
    "interval_merge": f"WITH {_PHRASES} {_merged('found')}",
    "dict_split": _SPLIT,
}
