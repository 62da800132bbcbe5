import math

import pytest
from pyspark.sql import functions as F

from lexmill import config
from lexmill.functions.block_rules import Rules
from lexmill.operators import dictionary, era, exports, model_tier, scenes, script, subtitles, topics
from lexmill.plans import segment as plan
from lexmill.sources import io
from lexmill.streaming import chunks


def test_times_are_half_up(spark):
    text = "嗯/一二三四五六七八九十甲乙丙丁戊"
    got = spark.range(1).select(subtitles.times(F.split(F.lit(text), "/"), F.lit(10.0), F.lit(0)).alias("s")).first().s
    assert [x.duration for x in got] == [0.63, 9.38] and [x.start_time for x in got] == [0.0, 0.63]
    equal = spark.range(1).select(subtitles.times(F.split(F.lit("abcdefghijklmnop"), ""), F.lit(10.0), F.lit(0), "equal").alias("s")).first().s
    assert {x.duration for x in equal} == {0.63} and equal[-1].start_time == 9.45


def test_clocks(spark):
    seconds = F.explode(F.array(*map(F.lit, (0.0, 3.5, 65.123, 3661.0))))
    got = spark.range(1).select(seconds.alias("s")).select(exports.srt_time(F.col("s")).alias("a"), exports.ass_time(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == ["00:00:00,000", "00:00:03,500", "00:01:05,123", "01:01:01,000"]
    assert [r.b for r in got][:2] == ["0:00:00.00", "0:00:03.50"]


def test_eras(spark):
    docs = io.from_texts(spark, ["清军在甲午战争中死磕到底", "华为发布新款智能手机", "今天天气真好", "hi", None])
    got = docs.select("doc_id", era.detect(F.col("text")).alias("e")).orderBy("doc_id").collect()
    assert [r.e.era for r in got] == ["ancient", "modern", "mixed", "mixed", "mixed"]


def test_script(spark):
    docs = io.from_texts(spark, ["小明走进超市。小明拿了一瓶水。", "超市。超市。超市。公园。", ""])
    got = docs.select("doc_id", script.analyse(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert "小明" in got[0].s.characters and got[1].s.settings == ["公园", "超市"] and got[2].s.characters == []


def test_whole_plan(spark):
    docs = io.from_texts(spark, ["今天天气真好。小明走进超市。小明拿了一瓶水。", None, "Hello world. This is a test.", "海面空旷得令人心慌。\n---\n1639年冬，起义像野火般蔓延。"])
    for over in ({}, {"enable_era": True, "enable_script_analysis": True, "length": {"strategy": "A"}}, {"enable_paragraph_aware": True}, {"mode": "precise"}, {"max_input_length": 20}):
        got = {r.doc_id: r for r in plan.segment(docs, over).collect()}
        assert len(got) == 4 and got[1].scenes == [] and got[1].language == "zh"
        assert not any("---" in s.text for s in got[3].scenes)
        for r in got.values():
            assert math.isclose(r.total_duration, sum(s.estimated_duration for s in r.scenes)) and r.total_words == sum(len(s.text) for s in r.scenes)
    assert exports.to_srt(plan.segment(docs)).where("doc_id = 0").first().srt.startswith("1\n00:00:00,000 --> ")


def test_dictionary_against_brute_force(spark):
    texts = ["研究生制度研究", "abcabcab", "", None, "xaaaa"]
    words = ["研", "研究", "研究生", "abc", "bca", "ab", "aa", "aaa"]
    docs, phrases = io.from_texts(spark, texts), spark.createDataFrame([(w,) for w in words], "phrase string")
    every = sorted((d, i, i + len(w), w) for d, t in enumerate(texts) if t for w in words for i in range(len(t)) if t.startswith(w, i))
    assert sorted(map(tuple, dictionary.matches(docs, phrases).collect())) == every
    assert sorted(map(tuple, dictionary.matches(docs, phrases, small=2).select("doc_id", "start", "end", "phrase").collect())) == every
    top = [m for m in every if not any(o[0] == m[0] and o[1] <= m[1] and o[2] >= m[2] and o[2] - o[1] > m[2] - m[1] for o in every)]
    assert sorted(map(tuple, dictionary.longest(dictionary.matches(docs, phrases)).collect())) == top
    covered = {(d, k) for d, i, j, _ in every for k in range(i, j)}
    merged = dictionary.merged_ranges(dictionary.matches(docs, phrases)).collect()
    assert {(r.doc_id, k) for r in merged for k in range(r.start, r.end)} == covered


def test_rebuild_and_path():
    assert dictionary.rebuild(["中华", "人民共和国", "万岁"], [(0, 7)]) == ["中华人民共和国", "万岁"]
    assert dictionary.rebuild(["ab", "cd", "ef"], [(1, 3)]) == ["a", "bc", "d", "ef"]
    assert dictionary.rebuild(["ab"], []) == ["ab"]
    text = "自然语言处理是AI分支"
    assert dictionary.heaviest_path(text, list(text), [(0, 6)])[:2] == ["自然语言处理", "是"]


def test_topics(spark):
    texts = ["cats purr softly"] * 6 + ["rockets burn fuel"] * 6
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)] + [(1, i, "one two") for i in range(3)], "doc_id long, index int, text string")
    got = topics.boundaries(rows).collect()
    assert got and {r.doc_id for r in got} == {0}
    assert all(0 < r.depth_score for r in got)


def test_settings(tmp_path):
    assert config.load({"scene": {"target_seconds": 3.0}})["scene"]["max_words"] == 50
    (tmp_path / "s.json").write_text('{"mode": "fast"}')
    assert config.effective_tier(config.load(tmp_path / "s.json")) == 3
    with pytest.raises(ValueError):
        config.load(tmp_path / "s.ini")
    assert config.subtitle_bounds(config.merged(config.DEFAULTS, {"subtitle": {"min_chars_per_block": 9, "max_chars_per_block": 3}})) == (8, 15)


def test_model_answers(spark):
    assert model_tier.parse('["a.", "b."]', "x") == ["a.", "b."] == model_tier.parse('Sure: ["a.", "b."] ok', "x")
    assert model_tier.parse("# t\nOne.\nno mark\nTwo.", "x") == ["One.", "Two."] and model_tier.parse("nothing", "A. B.") == ["A.", "B."]
    docs = io.from_texts(spark, ["A. B.", ""])
    assert [r.texts for r in model_tier.split_with_model(docs, lambda m: '["A.", "B."]').orderBy("doc_id").collect()] == [["A.", "B."], []]


def test_chunk_stream(spark, tmp_path):
    from lexmill.operators import sentences

    docs = io.from_texts(spark, ["One two. Three four. Five six. Seven eight."])
    pieces = sentences.chunked(docs, 12)
    pieces.select("doc_id", "chunk_no", "chunks_total", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, chunk_no int, chunks_total int, text string").parquet(str(tmp_path / "in"))
    query = chunks.events(stream).writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("events").collect()
    assert [r.event for r in got].count("result") == 1 and len(got) == pieces.count() + 1
    assert chunks.progress(pieces).agg(F.max("sentences_so_far")).first()[0] == [r for r in got if r.event == "result"][0].sentences_so_far


def test_chunks_take_the_whole_texts_language(spark):
    text = "Plain words first. " * 3 + "今天天气真好。小明走进超市。" * 20
    docs = io.from_texts(spark, [text, "   " * 50])
    got = {r.doc_id: r for r in plan.segment(docs, {"max_input_length": 60}, with_subtitles=False).collect()}
    assert got[0].language == "zh" and got[1].language == "zh" and {s.language for s in got[0].sentences} >= {"en", "zh"}
    assert [s["index"] for s in got[0].sentences] == list(range(len(got[0].sentences)))


def test_model_reaches_chunks_and_paragraphs(spark):
    docs = io.from_texts(spark, ["One two three. Four five six.\nSeven eight nine. Ten eleven twelve."])
    one = lambda messages: '["From the model."]'
    over = {"enable_llm": True, "mode": "precise"}
    cut = plan.segment(docs, {**over, "max_input_length": 30}, one, with_subtitles=False).first()
    assert cut.tier_used == "tier1_llm" and {s.text for s in cut.sentences} == {"From the model."}
    lines = plan.segment(docs, {**over, "enable_paragraph_aware": True}, one, with_subtitles=False).first()
    assert all("From the model." in s.text for s in lines.scenes)


def test_rows_that_share_an_id_are_segmented_apart(spark):
    long_ = "One two three. Four five six. " * 4
    rows = [(1, long_), (1, long_), (1, "Seven eight. Nine ten.\nEleven."), (None, long_), (None, None), (2, "短句。好的。")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = lambda over: sorted(str((i, [s.text for s in r.sentences], [s.text for s in r.scenes])) for i, t in rows for r in plan.segment(spark.createDataFrame([(i, t)], "doc_id long, text string"), over, with_subtitles=False).collect())
    for over in ({"max_input_length": 40}, {"enable_paragraph_aware": True}, {"mode": "precise"}):
        got = plan.segment(docs, over, with_subtitles=False).collect()
        assert sorted(str((r.doc_id, [s.text for s in r.sentences], [s.text for s in r.scenes])) for r in got) == alone(over)


def test_topics_in_the_row_are_those_of_the_tables(spark):
    import random

    rng = random.Random(3)
    texts = [[" ".join(rng.choice("cats purr softly rockets burn fuel the".split()) + str((k // 7) % 2) * (j % 2) for j in range(6)) for k in range(rng.randint(0, 60))] for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "x" * 200) for i, t in enumerate(texts)], "doc_id long, texts array<string>, text string")
    rows = docs.select("doc_id", F.posexplode("texts").alias("index", "text"))
    for more in ({}, {"smoothing": 1, "threshold": 0.05}, {"window": 4, "step": 2, "threshold": 0.01}):
        told = {r.doc_id: r.topic_starts for r in topics.mark_topics(docs, **more).collect()}
        table = {}
        for r in topics.boundaries(rows, **more).collect():
            table.setdefault(r.doc_id, []).append(r["index"])
        assert {k: v for k, v in told.items() if v} == {k: sorted(v) for k, v in table.items()} and any(told.values())
        rows_of = lambda found: sorted((r.doc_id, r["index"], r.position, round(r.depth_score, 9), round(r.confidence, 9), r.text_before, r.text_after) for r in found.collect())
        assert rows_of(topics.find_topics(docs, **more).select("doc_id", F.inline("topics"))) == rows_of(topics.boundaries(rows, **more))
    assert [r.topic_starts for r in topics.mark_topics(docs.withColumn("text", F.lit("short"))).collect()] == [[]] * 25


def test_user_dictionary(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# words\n真好。小明\nx\n水/n\n", encoding="utf-8")
    docs = io.from_texts(spark, ["今天天气真好。小明走进超市。", "没有词。好的。", None])
    got = {r.doc_id: r for r in plan.segment(docs, {"user_dict_path": str(path)}, with_subtitles=False).collect()}
    plain = {r.doc_id: r for r in plan.segment(docs, with_subtitles=False).collect()}
    assert [s.text for s in got[0].sentences] == ["今天天气", "真好。小明", "走进超市。"] and [s["index"] for s in got[0].sentences] == [0, 1, 2]
    assert got[0].scenes == plain[0].scenes and got[1].sentences == plain[1].sentences and got[2].sentences == []
    from lexmill.operators.dictionary import parse_phrases

    assert {r.phrase for r in parse_phrases(spark.createDataFrame([("a b/n c",), ("#x",), (" ",), ("q",)], "value string")).collect()} == {"abc"}


def test_many_phrases_are_joined_and_give_the_same(spark):
    texts = ["研究生制度研究", "abcabcab", "", None, "xaaaa", "abcabcab"]
    docs = io.from_texts(spark, texts).withColumn("segments", F.filter(F.split(F.coalesce("text", F.lit("")), "(?<=b)", -1), lambda s: s != ""))
    phrases = spark.createDataFrame([(w,) for w in ["研", "研究", "研究生", "abc", "bca", "ab", "aa", "aaa"]], "phrase string")
    for use in (dictionary.adjust, dictionary.segment_by_weight):
        few, many = (sorted(map(str, use(docs, phrases, small=n).collect())) for n in (100, 2))
        assert few == many and len(few) == len(texts)
    found = [(i, i + len(w), w) for w in ("ab", "abc", "bca", "ca") for i in range(8) if "abcabcab".startswith(w, i)]
    assert dictionary.longest_of(found) == [(0, 3), (1, 4), (3, 6), (4, 7), (6, 8)] and dictionary.merged_of([(0, 2), (2, 3), (5, 6)]) == [(0, 3), (5, 6)]


def test_heaviest_path_against_all_paths():
    import itertools
    import random

    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(2))})
        segments = [text[i:j] for i, j in itertools.pairwise(cuts)]
        found = list({(i, min(len(text), i + rng.randint(1, 3))) for i in (rng.randrange(len(text)) for _ in range(3))})
        weight = lambda i, j: max([1.0] * (j == i + 1) + [1.0 + j - i] * ((i, j) in set(itertools.pairwise(cuts))) + [2.0 * (j - i) ** 2] * ((i, j) in found) or [float("-inf")])  # noqa: E731, B023
        paths = [sorted({0, len(text), *c}) for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n)]
        best = max(paths, key=lambda p: (sum(weight(i, j) for i, j in itertools.pairwise(p)), p))
        expected = [text[i:j] for i, j in itertools.pairwise(best)]
        assert dictionary.heaviest_path(text, segments, found) == (segments if len(expected) == 1 else expected)


def test_merged_scenes_keep_all_their_fields(spark):
    kind = "struct<segment_id:int,text:string,estimated_duration:double,target_words:int,characters:array<string>,setting:string,mood:string,subtitles:array<string>>"
    rows = [(0, "a", 1.0, 3, ["x"], "", "", ["s1"]), (1, "b", 1.5, 4, ["y", "x"], "park", "", ["s2"]), (2, "c", 9.0, 5, [], "hall", "calm", []), (3, "d", 1.0, 1, [], "", "", [])]
    got = spark.createDataFrame([(rows,)], f"scenes array<{kind}>").select(scenes.merge_short(F.col("scenes"), 2.0, kind).alias("m")).first().m
    assert [tuple(s) for s in got] == [(0, "ab", 2.5, 3, ["x", "y"], "park", "", ["s1", "s2"]), rows[2], rows[3]]


def test_rules_can_be_loaded(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"phrases": ["农耕社会"], "marks": "。"}', encoding="utf-8")
    rules = Rules.load(path)
    assert rules.phrases == ("农耕社会",) and rules.marks == "。" and rules.blanks == Rules().blanks
    docs = io.from_texts(spark, ["一二三四五六七八，甲乙丙丁。"])
    blocks = lambda over: [s.text for s in plan.segment(docs, over).first().scenes[0].subtitles]
    assert blocks({}) == ["一二三四五六七八", "甲乙丙丁"] and blocks({"subtitle": {"rules_path": str(path)}}) == ["一二三四五六七八，甲乙丙丁"]
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        Rules.load(path)


def test_stream_gives_up_on_lost_chunks(spark, tmp_path):
    import time

    schema = "doc_id long, chunk_no int, chunks_total int, text string"
    spark.createDataFrame([(1, 0, 2, "One two. Three four."), (2, 0, 1, "Five six.")], schema).write.parquet(str(tmp_path / "in"))
    query = chunks.events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), wait_minutes=0.01).writeStream.format("memory").queryName("lost").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        time.sleep(1)
        got = {(r.doc_id, r.event): r.sentences_so_far for r in spark.table("lost").collect()}
        if (1, "error") in got:
            break
    query.stop()
    assert got == {(1, "progress"): 2, (1, "error"): 2, (2, "progress"): 1, (2, "result"): 1}


def test_results_of_a_stream(spark):
    done = spark.createDataFrame([(1, "result", ["One two.", "Three four."]), (1, "progress", [])], "doc_id long, event string, texts array<string>")
    row = chunks.results(done).first()
    assert row.language == "en" and [s.text for s in row.sentences] == ["One two.", "Three four."] and row.total_scenes >= 1


def test_two_decimals_are_those_of_the_binary_value(spark):
    import random

    from lexmill.functions.text import two_decimals

    seeded = random.Random(3)
    given = [k / 200 for k in range(0, 4000)] + [k / 3.3 for k in range(500)] + [seeded.random() * 10 ** seeded.randrange(7) for _ in range(2000)] + [0.0, 0.125, 0.375, 1e9 + 0.005]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", two_decimals(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows if r.y != round(r.x, 2)] == []


def test_han_and_kana_queries_equal_their_sql(spark, tmp_path):
    import duckdb

    from lexmill import han

    texts = ["Then the end.He said. Zo (a. b) er on!", "", "\n\n", "...", "Sword by the er on. " * 40, "th. th, th; \tth! 'q' # a/b c", "éé äö 12", "z", "Two.\n#no\n  er/x on"]
    spark.createDataFrame([(k, t, "en" if k % 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, query in han.QUERIES.items():
        got = query(spark, str(tmp_path))
        names = sorted(got.columns)
        own = sorted(([r[c] for c in names] for r in got.collect()), key=repr)
        sql = db.sql(f"SELECT {', '.join(names)} FROM ({han.ORACLES[name]})").fetchall()
        assert own == sorted(map(list, sql), key=repr), name


def test_null_texts_in_han_and_kana_queries(spark, tmp_path):
    from lexmill import han

    spark.createDataFrame([(1, None, None), (None, "a", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in han.QUERIES.values():
        query(spark, str(tmp_path)).collect()
