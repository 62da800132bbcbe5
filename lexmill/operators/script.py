"""Characters, places, synopsis, key terms and moods of a story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, once, strip

# Words around names and places.
SIGNALS = "说 走 去 来 看 跑 喊 叫 问 答".split()
TRANSITIONS = "走进 来到 回到 离开 进入 走出 跑到 冲向 赶往 前往 返回 到达 踏入 跨入 转入".split()
ACTIONS = "打开 关上 坐到 站在 看着 听到".split()
PLACES = (
    "超市 商店 学校 医院 公园 广场 公司 办公室 房间 厨房 卧室 街道 马路 小区 大楼 餐厅 饭店 咖啡馆 酒吧 森林 山上 河边 海边 城市 农村 小镇 村庄 世界 战场 基地 避难所 体育馆 图书馆 博物馆 电影院 "
    "车站 机场 码头 港口 宫殿 寺庙 教堂 城堡 国家 地区 岛屿 沙滩 海岸 餐馆 食堂"
).split()
NO_NAMES = "你 我 他 她 它 们 人 谁 这 那 我们 你们 他们 她们 它们 自己 大家 别人".split()
NOUNS = "老师 学生 医生 护士 警察 店员 大人 孩子 男人 女人 朋友 同学 顾客 客人 主角 配角".split()
NO_ENDINGS = "的人 的事 的东西 的地方 的时候 的方式 的感觉 的味道 的声音 的样子 的原因 的结果 的问题 的机会 的经历 的体验 的感受 的故事".split()
NO_TERM_STARTS = "了 的 把 被 将 从 到 去 在 又 再 才 就 是 很 太 还 已 正在 已经 然后 后来 终于 放学 出发 回来 出去 进来".split()
NO_PLACE_STARTS = (
    "这 那 哪 各 某 全 整 同 大 小 老 新 旧 前 后 左 右 东 西 南 北 上 下 里 外 有 没 在 是 的 了 着 过 我 你 他 她 它 们 被 把 将 从 向 往 对 用 然后 最后 之后 以前 以后"
).split()
MOODS = {
    "愤怒": "angry", "生气": "angry", "怒": "angry", "悲伤": "sad", "哭了": "sad", "哭": "sad", "开心": "happy", "笑": "happy", "高兴": "happy", "紧张": "tense", "担心": "tense",
    "急": "tense", "平静": "calm", "安静": "calm",
}
HAN = r"\x{4E00}-\x{9FFF}"


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("int")


def characters(text: Column) -> Column:
    """Sorted names: at a sentence's start before a signal word, and nicknames anywhere."""

    def names(x: Column) -> Column:
        told = [F.transform(x["parts"], _name_before(w, n)) for n, words in ((3, SIGNALS), (4, [*TRANSITIONS, *ACTIONS])) for w in words]
        signalled = F.filter(F.array_distinct(F.flatten(F.array(*told))), lambda c: (c != "") & ~c.isin(*NO_NAMES))
        good = lambda c: ~c.isin(*NOUNS) & ~c.rlike(f"(?:{'|'.join(NO_ENDINGS)})$")
        return F.array_sort(F.filter(F.array_union(signalled, x["nick"]), good))

    def found(t: Column) -> Column:
        parts = F.transform(F.split(t, "[。！？；.!?;]", -1), strip)
        nick = F.array_distinct(F.regexp_extract_all(t, F.lit(f"[小阿老][{HAN}]"), F.lit(0)))
        return once(F.struct(parts.alias("parts"), nick.alias("nick")), names)

    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(once(text, found))


def _name_before(word: str, most: int):
    return lambda s: F.regexp_extract(s, f"^([{HAN}]{{2,{most}}}){word}", 1)


def is_place(c: Column) -> Column:
    return (F.length(c) > 1) & ~c.rlike(f"^(?:{'|'.join(NO_PLACE_STARTS)})")


def settings(text: Column) -> Column:
    """Sorted places: known place words in the text, and with up to four characters before them."""
    t = F.coalesce(text, F.lit(""))
    known = F.filter(F.array(*map(F.lit, PLACES)), lambda p: F.contains(t, p))
    named = F.flatten(F.array(*(F.when(F.contains(t, F.lit(p)), F.regexp_extract_all(t, F.lit(f"(?<![{HAN}])[{HAN}]{{1,4}}{p}"), F.lit(0))).otherwise(F.array().cast("array<string>")) for p in PLACES)))
    return F.array_sort(F.array_distinct(F.concat(known, F.filter(named, is_place))))


def synopsis(text: Column, most: int = 200) -> Column:
    """The first paragraph in one line, cut to a length."""
    first = F.replace(strip(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)\n\s*\n", -1)[0]), F.lit("\n"), F.lit(""))
    return F.when(is_blank(text), F.lit("")).otherwise(once(first, lambda f: F.when(F.length(f) <= most, f).otherwise(F.concat(F.substring(f, 1, most), F.lit("...")))))


def key_terms(tokens: DataFrame, id_col: str = "doc_id", most: int = 10) -> DataFrame:
    """(id, rank, term, n) of the most frequent terms of (id, index, term); ties go to the one that occurs first."""
    good = (F.length("term") >= 2) & ~F.col("term").isin(*NO_NAMES) & ~F.col("term").rlike(f"^(?:{'|'.join(NO_TERM_STARTS)})")
    counts = tokens.where(good).groupBy(id_col, "term").agg(F.count("*").alias("n"), F.min("index").alias("first"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(id_col, "rank", "term", "n")


def location(text: Column) -> Column:
    """Where a sentence goes: a place behind a transition verb; null if nowhere."""

    def behind(verb: str) -> Column:
        at = F.instr(text, verb)
        after = F.regexp_replace(F.substring(text, at + len(verb), F.length(text)), "^[了着过的]+", "")
        firsts = [F.when(F.contains(after, F.lit(p)), F.substring(after, F.lit(1), F.instr(after, p) + len(p) - 1)) for p in PLACES]
        good = F.filter(F.array(*firsts), lambda c: c.isNotNull() & is_place(c))
        return F.when(at > 0, F.try_element_at(good, F.lit(1)))

    return F.coalesce(*map(behind, TRANSITIONS))


def scene_changes(sentences: Column) -> Column:
    """(sentence_idx, location) of the sentences that go somewhere."""
    told = F.transform(sentences, lambda s, i: F.struct(i.alias("sentence_idx"), location(s["text"]).alias("location")))
    return F.filter(told, lambda x: x["location"].isNotNull())


def mood(text: Column, moods: dict[str, str] = MOODS) -> Column:
    """The mood of the first listed word that the text has; empty if none."""
    out = F.lit("")
    for word, name in reversed(list(moods.items())):
        out = F.when(F.contains(text, F.lit(word)), name).otherwise(out)
    return out


def analyse(text: Column) -> Column:
    """Struct of characters, synopsis, settings and key_terms (none without a word segmenter)."""
    return F.struct(characters(text).alias("characters"), synopsis(text).alias("synopsis"), settings(text).alias("settings"), F.array().cast("array<string>").alias("key_terms"))


def enrich(scenes: Column, script: Column) -> Column:
    """Scenes with the characters and the first setting that their text has, and their mood."""

    def one(s: Column) -> Column:
        who = F.filter(script["characters"], lambda c: F.contains(s["text"], c))
        where = F.coalesce(F.try_element_at(F.filter(script["settings"], lambda c: F.contains(s["text"], c)), F.lit(1)), F.lit(""))
        return s.withField("characters", who).withField("setting", where).withField("mood", mood(s["text"]))

    return F.transform(scenes, one)
