"""The rule table of subtitle blocks, and loading of another one."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import cached_property
from pathlib import Path

# The rule table of the block format.
SENTENCE_ENDS = "。！？….!?"
MARKS = "。！？；.!?;，,、"
BLANKS = " \n　"
LEADING = "，、。！？；,!?;."
TRAILING = "。！？；，、.!?;…"
PAIRS = ("“”", "‘’", "「」", "『』", "《》", "（）", "【】", "[]", '""', "''")
ENUMERATION_ENDS = "。！？；…,!?;.，那这我就便都也很更将会要能可是有为混"
INTRODUCERS = ("感慨", "写道", "说道", "说", "表示", "称", "指出", "告诉", "问", "回答", "引用", "诗句", "如下", "是")
BEFORE_OPENING = "：:，,；;（([{【「『\n "
AFTER_CLOSING = "。！？；.!?;，,、：:）)]】」』\n "
GOOD_LEADS = "和与及而但或把被从向对为于并且且成"
SEMANTIC_LEADS = ("提前", "还", "把", "绝", "已经", "依然")
GOOD_TAILS = "的得了是就都也还要会能可将则若虽因着过地得正于，、；：在个"
BAD_FOLLOWERS = (
    "国剧化片视电频影音界族系权员长家学社党军政府市县省州部局处科室院校厂矿场店楼路桥河山海江湖城村镇乡队组班级期版本书报刊机器车船乐画图表单证票券卡账户号码网站页面件文档档案库数据信息系统程序软件硬件网络设备端口接口模块组件服务客户端前端后端中间层"
    "这那各每某本性例同位类群众平方公里恢复度态济划属亡志形人"
)
TAIL_BLOCKERS = "性志形亡人"
PHRASES = (
    "能够", "可以", "因为", "为了", "于是", "就是", "要是", "但是", "可是", "只是", "而是", "还是", "在于", "由于", "终于", "对于", "关于", "已经", "正在", "现在", "将会", "就得", "都得", "还得",
    "也就", "在上", "做成", "每一", "一架", "他们", "关羽", "三国志", "地形", "杀了人", "这群人", "展现出", "哪怕", "没法", "那些", "展现", "这种", "以为", "负担", "小作文", "写小作文", "考官",
    "南宋灭亡时", "想当", "蒙古", "江南", "包税人", "大汗", "绝对",
)


@dataclass(frozen=True)
class Rules:
    """Characters and words by what they do to a cut; see the fixed values of the same names."""

    sentence_ends: str = SENTENCE_ENDS
    marks: str = MARKS
    blanks: str = BLANKS
    leading: str = LEADING
    trailing: str = TRAILING
    pairs: tuple[str, ...] = PAIRS
    enumeration_ends: str = ENUMERATION_ENDS
    introducers: tuple[str, ...] = INTRODUCERS
    before_opening: str = BEFORE_OPENING
    after_closing: str = AFTER_CLOSING
    good_leads: str = GOOD_LEADS
    semantic_leads: tuple[str, ...] = SEMANTIC_LEADS
    good_tails: str = GOOD_TAILS
    bad_followers: str = BAD_FOLLOWERS
    tail_blockers: str = TAIL_BLOCKERS
    phrases: tuple[str, ...] = PHRASES

    @cached_property
    def closing(self) -> dict[str, str]:
        """The closing mark of each opening one."""
        return {p[0]: p[1] for p in self.pairs}

    @cached_property
    def quotes(self) -> frozenset[str]:
        return frozenset("".join(self.pairs))

    @cached_property
    def phrase_chars(self) -> frozenset[str]:
        return frozenset("".join(self.phrases))

    @classmethod
    def load(cls, path: str | Path) -> Rules:
        """Rules of a JSON file: an object of the names above; what it lacks stays as it is. Unknown names are a ValueError."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
        return cls(**{k: v if isinstance(v, str) else tuple(v) for k, v in given.items()})
