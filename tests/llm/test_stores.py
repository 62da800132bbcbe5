import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm.chat_format import MAPPINGS, as_json, format_json, format_records, formatted, from_json, gather, loss_spans, loss_text, path_hash, paths_of_type, read_back, rejects
from lexmill.llm.common import work_dir, written
from lexmill.llm.mixing import OTHERS, mix
from lexmill.llm import quality_rules
from lexmill.llm.quality_rules import FEATURES, DecisionList, cover, filter_quality, fit_rules, judge
from lexmill.llm.sharding import ShardStore
from tests.llm.conftest import ODD, PASSAGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(t):
    t = t or ""
    w = WORD.findall(t)
    g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + d for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics_and_rules(spark, make):
    good, bad = PASSAGE + " tail", " ".join(w + "###" for w in PASSAGE.split())
    rows = [*ODD, (50, "a\nb\na\n\n \na"), *((100 + k, f"{good} {k}") for k in range(40)), *((200 + k, f"{bad} tail {k}") for k in range(40))]
    labels = spark.createDataFrame([(100 + k, 1) for k in range(40)] + [(200 + k, 0) for k in range(40)] + [(None, 0), (1, None)], "doc_id long, quality int")
    docs = make(rows).withColumn("_q", F.lit("own"))
    rules = fit_rules(docs.drop("_q"), labels)
    assert len(rules.rules) == 1 and str(rules).startswith("1. reject if ")
    got = judge(docs.drop("_q"), rules).collect()
    told = sorted((r.doc_id or 0, *(r._q[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got)
    assert told == sorted((i or 0, *stats(t)) for i, t in rows)
    for r in got:
        n, *_, again = stats(r.text)
        assert r._q_failed == (n < 50 or 100 * again > 50 * n)
        assert r._q_kept == (not r._q_failed and rules.rule_of(r._q.asDict()) is None)
    kept = filter_quality(docs, rules)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {100 + k for k in range(40)} and not {r.doc_id for r in kept.collect()} & {200 + k for k in range(40)}
    assert fit_rules(docs.drop("_q"), labels.limit(0)).rules == [] and judge(make([]), rules).collect() == []


def test_cover_is_ordered_and_precise():
    row = lambda **over: {f: 0.0 for f in FEATURES} | over
    rows = [(row(mean_word=float(k % 9), repeat_share=k / 900), k % 9 > 6 or k > 780) for k in range(900)]
    random.Random(2).shuffle(rows)  # as in use, where rows come in the order of their hash
    found = cover(rows)
    wrong = [r for r, bad in rows if (found.rule_of(r) is not None) != bad]
    assert len(found.rules) >= 2 and len(wrong) <= 5
    assert cover([]).rules == [] and cover(rows[:1]).rules == []


def test_format_round_trip(spark):
    texts = ["", "a<|x", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] <<SYS>> <|turn|>user\nhi<|end|>\n", "[[INST]]<\\<s>", "é \U0001f600 \\n \\\\n", "<\\|", "x" * 50_000]
    turns = [(r, t) for r in ("user", "assistant", "ro\nle\\n<|", "") for t in texts]
    df = spark.createDataFrame([(turns,), ([],)], "turns array<struct<role:string,text:string>>").select("turns", formatted(F.col("turns")).alias("f"))
    for r in df.select("turns", "f", read_back(F.col("f")).alias("b"), loss_text(F.col("f"), loss_spans(F.col("f"))).alias("l")).collect():
        assert r.b == r.turns and r.l == "".join(t.text for t in r.turns if t.role == "assistant")
        assert not re.search(r"</?s>|\[/?INST\]", r.f)


def test_layouts(spark):
    cases = {
        '{"messages":[{"role":"user","content":"hi"},{"content":"yo","role":"assistant"}]}': ("messages", [("user", "hi"), ("assistant", "yo")]),
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': ("exchange", [("user", "q"), ("assistant", "a")]),
        '{"instruction":"i","input":"x","output":"o"}': ("instruction-input", [("user", "i"), ("user", "x"), ("assistant", "o")]),
        '{"question":"q","answer":null}': ("question-answer", [("user", "q"), ("assistant", "")]),
        '{"x":1}': (None, []), "bad{": (None, []), "[1,2]": (None, []),
    }
    got = from_json(spark.createDataFrame([(j,) for j in [*cases, None]], "j string"), "j").collect()
    assert {r.j: (r.layout, [tuple(t) for t in r.turns]) for r in got} == {**cases, None: (None, [])}
    assert len({m.paths for m in MAPPINGS}) == len(MAPPINGS)


def test_gather_orders_turns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, "user", "q", 0), (None, 0, None, "x", 0), (2, 0, "user", "a", 1), (2, 0, "user", "a", 1)], "conv_id long, turn long, role string, text string, record int")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in format_records(gather(rows)).collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], None: [("", "x")], 2: [("user", "a"), ("user", "a")]}
    assert paths_of_type(gather(rows).schema["record"].dataType) == "{turns:[{role:v,text:v}]}" and gather(rows.limit(0)).collect() == []


def test_store(spark, make):
    store = ShardStore(spark, work_dir(spark, "t"), target_bytes=20_000, arrival_rows=50)
    docs = make([(k, f"{PASSAGE} {hashlib.md5(str(k).encode()).hexdigest()}") for k in range(600)] + ODD)
    assert store.version() == 0 and store.append(docs.where("doc_id % 2 = 0")) == 1 and store.append(docs.where("doc_id % 2 = 1 or doc_id is null")) == 2
    before = store.manifest().count()
    assert store.compact() == 3 and store.manifest().count() < before and store.manifest(2).count() == before
    assert sorted(map(str, store.read().select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert store.vacuum() > 0 and store.read().count() == docs.count() and store.append(docs.limit(0)) == 4 and store.read().count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(4, [], docs.schema)


def test_mix_meets_weights(spark, make):
    rows = [(k, "w " * (k % 7 + 1)) for k in range(600)] + [(None, "w"), (700, None), (1, "w w")]
    docs = make(rows).withColumn("mix", F.lit(1)).withColumn("_leaf", F.lit(2)).withColumn("last", F.lit(3))
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": {"en": 0.75, None: 0.25}, "source": {"src0": 2.0, "src1": 1.0, "src2": 0.0}}
    got = mix(docs, levels=levels, weights=weights, share=0.5, max_epochs=2).collect()
    taken, budget = defaultdict(int), {}
    for r in got:
        leaf = r.mix_
        taken[leaf.lang, leaf.source] += len(r.text.split() if r.text else [])
        budget[leaf.lang, leaf.source] = leaf.budget
    assert all(0 <= budget[k] - taken[k] <= 14 for k in taken) and not any(k[1] == "src2" for k in taken)
    assert abs(taken["en", "src0"] / taken["en", "src1"] - 2) < 0.1 and abs(taken["en", "src0"] / taken[None, "src0"] - 3) < 0.2
    assert mix(docs.limit(0), levels=levels, weights=weights).collect() == []
    again = mix(docs, levels=levels, weights=weights, share=0.5, max_epochs=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in again)


def test_mix_passes_shortage_to_siblings(make):
    docs = make([(k, "w " * 10) for k in range(0, 600, 6)] + [(3, "w " * 10)])
    got = mix(docs, levels={"source": F.col("source"), "part": (F.col("doc_id") == 3).cast("string")}, weights={}, share=0.5, max_epochs=2).collect()
    took = Counter(r.mix.part for r in got)
    assert took["true"] == 2 and took["false"] == 48


def test_stages(spark, make, tmp_path):
    words = PASSAGE.split()
    text = lambda k: " ".join(f"{w}{(k * 7 + i) % 31}" for i, w in enumerate(words))
    rows = [(k, text(k)) for k in range(30)] + [(100, text(0)), (101, "### " * 80), (102, f"{text(40)} {PASSAGE}"), (103, None)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(30)] + [(101, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        ids.append({r.doc_id for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns
    assert ids[0] == {*range(30), 100, 102} and ids[1] == {*range(30), 102} and ids[2] == set(range(30)) and ids[3] <= ids[2] and ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_store_keeps_all_columns_below_any_path(spark, make):
    store = ShardStore(spark, work_dir(spark, "my store [1] {a}"), target_bytes=20_000)
    one = make([(1, "a"), (None, None)]).withColumn("extra", F.lit(7)).withColumn("_shard", F.lit("own"))
    store.append(one)
    store.append(make([(2, "b")]))
    assert store.compact(at_least=2) == 3 and store.vacuum() > 0
    got = sorted(((r.doc_id, r.text, r.extra, r._shard) for r in store.read().collect()), key=str)
    assert got == sorted([(1, "a", 7, "own"), (None, None, 7, "own"), (2, "b", None, None)], key=str) and store.read().columns[-1] == "_shard_"
    with pytest.raises(ValueError, match="text"):
        store.append(spark.createDataFrame([(3, 4)], "doc_id long, text long"))
    assert store.version() == 3 and store.append(make([]).withColumn("later", F.lit(None).cast("string"))) == 4 and "later" in store.read().columns


def test_vacuum_leaves_writers_at_work_alone(spark, make):
    store, docs = ShardStore(spark, work_dir(spark, "two"), target_bytes=20_000), make([(k, f"text {k}") for k in range(20)])
    store.append(docs)
    with store._at_work() as folder:
        docs.write.parquet(f"{store.path}/{folder}")
        added = store._written(folder, docs.schema)
        assert store.vacuum() == 0
        store._commit(2, added, docs.schema)
    assert store.vacuum() == 0 and store.read().count() == 40
    with store._at_work() as folder:
        docs.write.parquet(f"{store.path}/{folder}")
    assert store.vacuum() > 0 and store.read().count() == 40
    with store._at_work() as folder:
        docs.write.parquet(f"{store.path}/{folder}")
        assert store.vacuum(abandoned_hours=-1) > 0


def test_writers_that_lose_the_race_try_again(spark, make):
    path = work_dir(spark, "race")
    store, other, docs = ShardStore(spark, path), ShardStore(spark, path), make([(k, f"text {k}") for k in range(8)])
    store.append(docs)
    commit, first = store._commit, []

    def late(version, *more):
        if not first:
            first.append(other.append(docs))
        return commit(version, *more)

    store._commit = late
    assert store.append(docs) == 3 and first == [2] and store.read().count() == 24
    first.clear()
    assert store.compact(at_least=2) == 5 and store.read().count() == 32
    for _ in range(8):
        other.append(docs)
    assert other.version() == 13 and other.read().count() == 96 and other.read(5).count() == 32


def test_mix_gives_unlisted_values_nothing_or_their_own_weight(make):
    docs = make([(k, "w " * 10) for k in range(600)])
    known, other = F.when(F.col("doc_id") < 300, "a").otherwise("new"), {"kind": {"a": 1.0}}
    got = mix(docs, levels={"kind": known}, weights=other, share=0.5).collect()
    assert {r.mix.kind for r in got} == {"a"} and len(got) == 150
    got = mix(docs, levels={"kind": F.when(F.col("doc_id") % 3 > 0, known)}, weights={"kind": {"a": 3.0, OTHERS: 1.0, None: 0.0}}, share=0.5).collect()
    took = Counter(r.mix.kind for r in got)
    assert took == {"a": 150, "new": 50}


def test_mix_finds_the_end_in_leaves_of_any_size(make):
    docs = make([(k % 900, "w " * (k % 5 + 1)) for k in range(3000)])
    for step in (1, 2, 32):
        got = mix(docs, levels={"all": F.lit("x")}, weights={}, share=0.37, max_epochs=1, digits=step).collect()
        order = defaultdict(int)
        for k in range(3000):
            order[hashlib.md5(f"17:0:{k % 900}".encode()).hexdigest(), k % 900] += k % 5 + 1
        budget, taken, total = int(sum(order.values()) * 0.37 + 1e-6), set(), 0
        for (_, i), n in sorted(order.items()):
            total += n
            if total > budget:
                break
            taken.add(i)
        assert {r.doc_id for r in got} == taken


def test_layouts_with_more_fields_keep_their_turns(spark):
    cases = {
        '{"id":7,"messages":[{"role":"user","content":"hi","name":"x","meta":{"a":[1,{"b":2}]}}],"deep":{"a":{"b":{"c":{"d":{"e":{"f":{"g":[{"h":1}]}}}}}}}}': ("messages", [("user", "hi")]),
        '{"prompt":"p","response":"r","system":null,"we ird:<x>":[[1]],"b`q":{}}': ("system-prompt-response", [("system", ""), ("user", "p"), ("assistant", "r")]),
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant"}]}': ("messages", [("user", "q"), ("assistant", "")]),
        '{"messages":[{"role":"user","content":["parts"]}]}': (None, []), '{"data":{"prompt":"p","response":"r"}}': (None, []), '{"messages":[]}': (None, []),
    }
    rows = from_json(spark.createDataFrame([(j,) for j in [*cases, "bad{", None]], "j string"), "j")
    got = {r.j: r for r in rows.collect()}
    assert {j: (got[j].layout, [tuple(t) for t in got[j].turns]) for j in cases} == cases
    assert got["bad{"].rejected == "unreadable" and got[None].rejected == "null record"
    assert {r.rejected: r.n for r in rejects(rows).groupBy("rejected").agg(F.sum("n").alias("n")).collect()} == {"unknown layout": 3, "unreadable": 1, "null record": 1}
    more = spark.createDataFrame([(1, [("u", "t", 3)])], "id long, messages array<struct<role:string,content:string,n:int>>").select(F.struct("*").alias("record"))
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in format_records(more).collect()] == [("messages", [("u", "t")])]


def test_hashes_of_paths_are_the_same_on_both_sides(spark):
    paths = ["messages[].role", "é.文字", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(F.xxhash64("p").alias("h")).collect()
    assert [r.h for r in got] == [path_hash(p) for p in paths]


def test_records_of_several_layouts_give_the_same_turns(spark):
    said = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s\n\0"), (2, 1, "user", "</s>"), (2, 2, "assistant", None), (3, 0, "assistant", "x"), (3, 1, "human", "y"), (4, 0, "user", "z" * 3_000_000), (4, 1, "assistant", "w")]
    rows = gather(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    rows = rows.withColumn("json", as_json(rows))
    typed = {r.conv_id: (r.formatted, r.loss_spans) for r in format_records(rows).collect()}
    json = {r.conv_id: r for r in format_json(rows.where("json IS NOT NULL"), "json").collect()}
    assert {k: r.layout for k, r in json.items()} == {1: "prompt-response", 2: "system-prompt-response", 3: "messages"}
    assert all((r.formatted, r.loss_spans) == typed[k] for k, r in json.items()) and set(typed) == {1, 2, 3, 4}
    either = {r.conv_id: r for r in format_json(rows, "json", record_col="record").collect()}
    assert {k: (r.formatted, r.loss_spans) for k, r in either.items()} == typed and either[4].layout == "turns" and not any(r.rejected for r in either.values())


def test_quality_columns_may_clash_and_rules_need_hits(spark, make):
    rules = DecisionList([(quality_rules.Test("symbols_per_word", True, 0.5),)])
    docs = make([(1, PASSAGE), (2, "### " * 80), (2, PASSAGE + " x")]).withColumns({"_Q_w": F.lit(1), "_q": F.lit("own"), "_q_L": F.lit(None).cast("string"), "a.b": F.lit(2)})
    kept = filter_quality(docs, rules)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    judged = judge(docs, rules)
    assert len(judged.columns) == len(docs.columns) + 4 and judged.count() == 3
    row = lambda x: {f: 0.0 for f in FEATURES} | {"mean_word": x}
    assert cover([(row(9.0), True)] * 6 + [(row(1.0), False)] * 60).rules == []
    assert len(cover([(row(9.0), True), (row(1.0), False), (row(1.0), False), (row(1.0), False)] * 30).rules) == 1
