"""Length policy of sentences: off, B (tell only) and A (cut again to a length)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.config import check_length
from lexmill.functions.text import is_blank
from lexmill.schema import SENTENCES

#: Where strategy A cuts, in order of preference; pairs that stay whole; counting words; leading marks.
CUTS = "。！？；》」）]】}，、.!?;,:"
PAIRS = ("《》", "「」", "『』", "()", "（）", "[]", "【】", "{}", '""', "''")
NUMERALS = "一二两三四五六七八九十数几"
CLASSIFIERS = "封艘把件张支根块瓶碗杯条座架辆匹头只朵棵株亩石斗升斤担篇本页则款扇面幅道顿阵回场遍次趟番种般"
LEADING = "，、。！？；.!?;"
FINAL = "。！？"


def status(text: Column, low: int = 3, high: int = 15) -> Column:
    n = F.length(text)
    return F.when(n < low, "too_short").when(n > high, "too_long").otherwise("ok")


def spans_within(text: str, end: int, pairs=PAIRS) -> Iterator[tuple[int, int]]:
    """(start, stop) of pairs that open and close before `end`."""
    for opening, closing in pairs:
        at = text.find(opening, 0, end)
        while at >= 0:
            close = text.find(closing, at + 1, end)
            if close < 0:
                break
            yield at, close + 1
            at = text.find(opening, close + 1, end)


def _mark_cut(head: str) -> int:
    """Length of the head up to its last free mark of the most preferred kind; 0 if there is none beyond the first place."""
    free = list(head)
    for i, j in spans_within(head, len(head)):
        free[i:j] = "\0" * (j - i)
    shown = "".join(free)
    return next((at + 1 for c in CUTS if (at := shown.rfind(c)) > 0), 0)


def _pair_cut(rest: str, high: int) -> int:
    """Where a pair ends that the head would break and that fits a block; 0 if there is none."""
    for opening, closing in PAIRS:
        at = rest.find(opening, 0, high)
        while at >= 0:
            inside = rest.find(closing, at + 1, high)
            if inside >= 0:
                at = rest.find(opening, inside + 1, high)
                continue
            close = rest.find(closing, at + 1)
            if close < 0:
                break
            if close + 1 - at <= high:
                return close + 1
            at = rest.find(opening, at + 1, high)
    return 0


def _word_cut(rest: str, high: int) -> int:
    """The plain cut, one further between a numeral and its classifier, one less behind an attributive 的."""
    before, after = rest[high - 1], rest[high]
    if after in CLASSIFIERS and before in NUMERALS and high + 1 < len(rest):
        return high + 1
    return high - 1 if before == "的" and high >= 2 else high


def resplit(text: str, low: int = 3, high: int = 15, prefer_marks: bool = True) -> list[str]:
    """A text in blocks of about `high` characters."""
    blocks, rest = [], text
    while len(rest) > high:
        at = _mark_cut(rest[:high]) if prefer_marks else high
        at = at or _pair_cut(rest, high) or next((i + 1 for i in range(high, min(len(rest), 2 * high)) if rest[i] in CUTS), 0) or _word_cut(rest, high)
        blocks.append(rest[:at])
        rest = rest[at:]
    if rest and blocks and len(rest) < low and blocks[-1][-1:] not in FINAL:
        blocks[-1] += rest
    elif rest:
        blocks.append(rest)
    out = blocks[:1]
    for b in blocks[1:]:
        if b[:1] and b[0] in LEADING:
            out[-1] += b[0]
            b = b[1:]
        if b:
            out.append(b)
    return out


def split_text(text: Column, strategy: str, low: int = 3, high: int = 15, prefer_marks: bool = True) -> Column:
    """Array of texts: cut again under A, the text itself otherwise."""
    check_length(strategy, low, high)
    if strategy != "A":
        return F.array(text)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: resplit(t or "", low, high, prefer_marks))

    return cut(text)


def _resplit_all(low: int, high: int, prefer_marks: bool):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: [[c for c in resplit(t, low, high, prefer_marks) if c.strip()] for t in ts])

    return cut


def apply(sentences: Column, strategy: str = "B", low: int = 3, high: int = 15, prefer_marks: bool = True) -> Column:
    """Sentence records under a strategy; blank ones are dropped."""
    check_length(strategy, low, high)
    told = F.filter(sentences, lambda s: ~is_blank(s["text"]))
    if strategy == "off":
        return F.transform(told, lambda s: s.withField("length_status", F.lit("ok")).withField("length_strategy_applied", F.lit("none")))
    if strategy == "B":
        return F.transform(told, lambda s: s.withField("length_status", status(s["text"], low, high)).withField("length_strategy_applied", F.lit("B")))
    parts = _resplit_all(low, high, prefer_marks)(F.transform(told, lambda s: s["text"]))
    none = F.array().cast("array<string>")

    def block(s: Column, t: Column) -> Column:
        s = s.withField("text", t).withField("char_count", F.length(t)).withField("length_status", status(t, low, high))
        return s.withField("words", none).withField("pos_tags", none).withField("length_strategy_applied", F.lit("A"))

    flat = F.flatten(F.zip_with(told, parts, lambda s, ts: F.transform(ts, lambda t: block(s, t))))
    return F.transform(flat, lambda s, i: s.withField("index", i)).cast(SENTENCES)


def warnings(sentences: Column, low: int = 3, high: int = 15) -> Column:
    """Messages of strategy B for sentences that are not of good length."""
    named = F.transform(sentences, lambda s, i: F.struct(s["text"].alias("t"), i.alias("i"), status(s["text"], low, high).alias("k")))
    bad = F.filter(named, lambda x: x["k"] != "ok")
    return F.transform(bad, lambda x: F.format_string("[B] Sentence %d length=%d status=%s: %s...", x["i"], F.length(x["t"]), x["k"], F.substring(x["t"], F.lit(1), F.lit(30))))
