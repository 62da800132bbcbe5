import pytest
from pyspark.sql import functions as F

from lexmill import config
from lexmill.functions.blocks import Cutter
from lexmill.operators import length, scenes, sentences
from lexmill.sources import io

EN = [
    ("Hello world. This is a test. How are you?", ["Hello world.", "This is a test.", "How are you?"]),
    ("Dr. Smith and Mr. Wang went to the U.S. yesterday.", ["Dr. Smith and Mr. Wang went to the U.S. yesterday."]),
    ('He said "Hello world." Then he left.', ['He said "Hello world." Then he left.']),
    ("He thought... and then left.", ["He thought...", "and then left."]),
    ("I don't know. You can't go.", ["I don't know. You can't go."]),
    ("Wait... Then stop.", ["Wait... Then stop."]),
    ('He said "Dr. Lee left." Then she came.', ['He said "Dr. Lee left." Then she came.']),
]
ZH = [
    ("今天天气真好。我们去公园散步。", ["今天天气真好。", "我们去公园散步。"]),
    ("太棒了！太好了！", ["太棒了！", "太好了！"]),
    ("他说：“好的。”然后走了。", ["他说：“好的”。", "然后走了。"]),
    ("天气更好。好的！", ["天气更好。好的！"]),
]
JA = [
    ("彼は「行きます。後で会いましょう」と言った。本当です。", ["彼は「行きます。後で会いましょう」と言った。", "本当です。"]),
    ("最初の文。\n次の文。最後の文。", ["最初の文。", "次の文。", "最後の文。"]),
]


def test_sentences_by_language(spark):
    cases = EN + ZH + JA + [("", []), ("   ", []), (None, [])]
    docs = io.from_texts(spark, [t for t, _ in cases])
    got = sentences.split_sentences(docs).select("doc_id", "language", "tier_used", F.transform("sentences", lambda s: s["text"]).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [e for _, e in cases]
    assert [r.language for r in got] == ["en"] * len(EN) + ["zh"] * len(ZH) + ["ja"] * len(JA) + ["zh"] * 3


def test_long_sentences_are_cut(spark):
    docs = io.from_texts(spark, ["word, " * 60 + "x" * 450 + " end."])
    got = sentences.split_sentences(docs).select(F.transform("sentences", lambda s: s["text"]).alias("s")).first().s
    assert max(map(len, got)) <= 200 and "".join(got).count("x") == 450


def test_resplit():
    assert length.resplit("正如近期热映的潮语电影《给阿嬷的情书》所展现的") == ["正如近期热映的潮语电影《给阿嬷的情书》", "所展现的"]
    assert all(len(b) <= 16 for b in length.resplit("今天天气很好我们决定出门走走一路看风景心情好极了"))
    with pytest.raises(ValueError):
        config.check_length("C", 3, 15)


GOLDEN = {
    "要知道在农耕社会，柴火、盐巴和香料那可都是绝对的硬通货。": ["要知道在农耕社会", "柴火、盐巴和香料", "那可都是绝对的硬通货"],
    "桌上摆着苹果、香蕉和梨子，它们都来自果园。": ["桌上摆着苹果、香蕉和梨子", "它们都来自果园"],
    "枪声、爆炸声、呐喊声混成一锅滚烫的粥。": ["枪声、爆炸声、呐喊声", "混成一锅滚烫的粥"],
    "风声、雨声、读书声此起彼伏地回荡在廊檐下。": ["风声、雨声", "读书声此起彼伏地回荡在廊檐下"],
    "要理解文帝进京这件事，得先搞清楚一个前提：功臣集团为什么选他？": ["要理解文帝进京这件事", "得先搞清楚一个前提：", "功臣集团为什么选他"],
    "这套政策根本经不起扒，说白了就是逼着全体华人为了挤进西方圈子，挥刀自宫搞文化阉割。": ["这套政策根本经不起扒", "说白了就是逼着全体华人", "为了挤进西方圈子", "挥刀自宫搞文化阉割"],
}


@pytest.mark.parametrize("text", GOLDEN)
def test_subtitle_blocks(text):
    assert Cutter().blocks(text) == GOLDEN[text]


def test_blocks_of_odd_texts():
    cutter = Cutter()
    assert cutter.short_enough(["软件硬件网络设备端口接口模块组件服务"]) == ["软件硬件网络设备端口", "接口模块组件服务"]
    for text in ("", "。。。", "“", "\"'\"'", "a" * 500, "，" * 100, "「" * 40 + "」" * 40, "1.2.3.4 " * 30):
        assert all(b.strip() for b in cutter.blocks(text))


def test_scene_target():
    assert scenes.target_words(config.DEFAULTS["scene"]) == 19
