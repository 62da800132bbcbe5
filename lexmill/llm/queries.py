"""The queries opN_<name> over whole tables, with production parameters, and DuckDB SQL for them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.chat_format import as_json, format_json, format_records, gather, loss_text, read_back
from lexmill.llm.common import let, work_dir
from lexmill.llm.decontaminate import contamination
from lexmill.llm.license_scan import scan_licenses
from lexmill.llm.line_dedup import dedup_lines
from lexmill.llm.mixing import DOMAINS, OTHERS, WEIGHTS, mix
from lexmill.llm.pii import KINDS, find_personal_data
from lexmill.llm.quality_rules import fit_rules, judge
from lexmill.llm.sharding import ShardStore
from lexmill.llm.simhash import near_duplicates
from lexmill.llm.substring_dedup import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")


#: The conversation that op4 adds: a text of control strings in both roles.
CONTROLS = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of several layouts: JSON in the layout that fits each, typed where that is too long, and a typed pair."""
    rows = gather(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    rows = let(rows, json=as_json(rows))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.struct(F.lit(CONTROLS).alias("prompt"), F.lit(CONTROLS).alias("response")).alias("record"))
    columns = ("conv_id", "formatted", "loss_spans")
    all_ = format_json(rows, "json", record_col="record").select(*columns).unionByName(format_records(extra).select(*columns))
    all_ = let(all_, turns=read_back(F.col("formatted")), loss=loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return all_.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, work_dir(spark, "shards"))
    store.append(_table(spark, sf_dir, "documents"))
    version = store.compact(at_least=2)
    store.vacuum()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.epoch", "mix.budget")


def _mix_sql() -> str:
    cases = lambda column, values, other: f"CASE {' '.join(f'WHEN {column} = {k} THEN {v}' for k, v in values)} ELSE {other} END"
    domain = cases("source", [(f"'{s}'", f"'{d}'") for d, members in DOMAINS.items() for s in members], "'other'")
    sql, above = "", "root"
    names = ["domain", "lang", "source"]
    for k, level in enumerate(names):
        path, family = ", ".join(names[: k + 1]), f"PARTITION BY {', '.join(names[:k])}" if k else ""
        on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM a.{p}" for p in names[:k]) or "true"
        weight = cases(level, ((f"'{v}'", w) for v, w in WEIGHTS[level].items() if v != OTHERS), WEIGHTS[level][OTHERS]) if WEIGHTS[level] else "1.0"
        sql += f"""
n{k} AS (SELECT n.*, a.budget, CAST({weight.replace(level, 'n.' + level)} AS DOUBLE) AS w FROM (SELECT {path}, CAST(sum(tokens) * 2 AS DOUBLE) AS cap FROM leaves GROUP BY {path}) n JOIN {above} a ON {on}),
m{k} AS (SELECT *, budget - (sum(cap) OVER u - cap) AS l, sum(w) OVER ({family}) - (sum(w) OVER u - w) AS r FROM n{k} WINDOW u AS ({family} ORDER BY cap / w, {level} ROWS UNBOUNDED PRECEDING)),
f{k} AS (SELECT *, cap * r <= l * w * (1 + 1e-12) AS whole FROM m{k}),
b{k} AS (SELECT {path}, CASE WHEN whole THEN cap ELSE w * max(CASE WHEN NOT whole THEN l / r END) OVER ({family}) END AS budget FROM f{k}),"""
        above = f"b{k}"
    return rf"""
WITH d AS (SELECT doc_id, {domain} AS domain, lang, source, len(coalesce(regexp_extract_all(text, '[^ 	-
]+'), [])) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT least(floor(sum(tokens) * 0.8::DOUBLE + 1e-6), sum(tokens) * 2) AS budget FROM leaves),{sql}
leaf AS (SELECT leaves.*, CAST(floor(b2.budget + 1e-6) AS BIGINT) AS budget FROM leaves JOIN b2 ON b2.domain = leaves.domain AND b2.lang IS NOT DISTINCT FROM leaves.lang AND b2.source IS NOT DISTINCT FROM leaves.source),
t AS (SELECT d.*, budget, CAST(floor(budget / leaf.tokens) AS INTEGER) AS whole, budget - CAST(floor(budget / leaf.tokens) AS INTEGER) * leaf.tokens AS rest
  FROM d JOIN leaf ON leaf.domain = d.domain AND leaf.lang IS NOT DISTINCT FROM d.lang AND leaf.source IS NOT DISTINCT FROM d.source),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id) RANGE UNBOUNDED PRECEDING) AS upto FROM t),
e AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, times)) AS INTEGER) AS epoch, budget FROM e
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"), redact=False)
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, fit_rules(docs, _table(spark, sf_dir, "labels")))
    base = [F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *base, F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_rule").alias("rule"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_sharding": op5_sharding,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS k FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE n > 1),
g2 AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN x ON x.doc_id = words.doc_id AND x.i = words.i WHERE x.i IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g2 ON g2.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared ON shared.key = k.key GROUP BY k.doc_id
""",
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.n = dw.n),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
""",
    "op4_chat_format": r"""
WITH all_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>|/?SYS>|\|)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) AS n FROM all_)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op7_mixing": _mix_sql(),
    "op5_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
}
