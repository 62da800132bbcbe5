"""User phrases in texts: all and longest matches, merged ranges, segments rebuilt around phrases, and the heaviest path."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import let


def parse_phrases(lines: DataFrame, col: str = "value", separator: str | None = None) -> DataFrame:
    """(phrase): one a line, without /tags; comments, blank lines and phrases under two characters go."""
    line = F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")
    parts = F.split(line, F.lit(r"\s+") if separator is None else F.lit(rf"\Q{separator}\E"))
    words = F.transform(parts, lambda w: F.split(w, "/")[0])
    return lines.where((line != "") & ~line.startswith("#")).select(F.array_join(words, "").alias("phrase")).where(F.length("phrase") >= 2).distinct()


def _finder(phrases: DataFrame, small: int):
    """A function to make, in a task, a function from a text to its matches (start, end, phrase); null if the phrases are too many to carry."""
    if phrases.limit(small + 1).count() > small:
        return None
    words = sorted(r["phrase"] for r in phrases.collect())

    def make():
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if not words:
            return lambda text: []
        automaton.make_automaton()
        return lambda text: [(end + 1 - len(w), end + 1, w) for end, w in automaton.iter(text)] if text else []

    return make


def matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000) -> DataFrame:
    """(id, start, end, phrase): every occurrence, overlapping ones too.

    Up to `small` phrases become one automaton that each task runs over its texts once. More phrases are joined, by
    equality, with the rolling substrings of their lengths; phrases never meet all texts.
    """
    phrases = phrases.select("phrase").where(F.length("phrase") > 0).distinct()
    make = _finder(phrases, small)
    if make is None:
        return _joined(docs, phrases, id_col, text_col)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("phrase", T.StringType())]))

    @F.pandas_udf(kind)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = make()
        for batch in texts:
            yield batch.map(lambda t: [{"start": i, "end": j, "phrase": w} for i, j, w in found(t)])

    return docs.select(id_col, F.inline(find(F.col(text_col))))


def _joined(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lengths = sorted(r["n"] for r in phrases.select(F.length("phrase").alias("n")).distinct().collect())
    chars = F.col("_chars")

    def of(n: int) -> Column:
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(chars, i + 1, n), "").alias("phrase")))).otherwise(F.array().cast("array<struct<start:int,phrase:string>>"))

    spots = let(docs, _chars=F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), ""), lambda c: c != "")).select(id_col, F.explode(F.concat(*(of(n) for n in lengths))).alias("m"))
    return spots.select(id_col, "m.start", "m.phrase").join(phrases, "phrase").select(id_col, "start", (F.col("start") + F.length("phrase")).alias("end"), "phrase")


def longest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest match at each start, without those inside a longer one."""
    first = Window.partitionBy(id_col, "start").orderBy(F.desc("end"))
    before = Window.partitionBy(id_col).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    top = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return top.withColumn("_far", F.max("end").over(before)).where("_far IS NULL OR _far < end").drop("_far")


def merged_ranges(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end): matches that overlap or touch as one range."""
    order = Window.partitionBy(id_col).orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.coalesce((F.col("start") > far).cast("int"), F.lit(1)))
    return marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(id_col, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def rebuild(segments: list[str], ranges: list[tuple[int, int]]) -> list[str]:
    """Segments of a text cut at the ranges' edges, with each range as one segment; blank ones go.

    ranges: (start, end) in order that neither overlap nor touch. Without ranges the segments stay as they are.
    """
    if not ranges:
        return segments
    whole, out, at, ends = "".join(segments), [], 0, []
    for s in segments:
        at += len(s)
        ends.append(at)
    low, k = 0, 0
    for start, end in [*ranges, (at, at)]:
        while k < len(ends) and ends[k] <= start:
            out.append(whole[low : ends[k]])
            low, k = ends[k], k + 1
        out += [whole[low:start], whole[start:end]]
        low = end
        while k < len(ends) and ends[k] <= end:
            k += 1
    return [p for p in out if p.strip()]


def longest_of(found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What `longest` keeps of one text's matches, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted({(i, j) for i, j, _ in found}, key=lambda m: (m[0], -m[1])):
        if not out or start > out[-1][0] and end > out[-1][1]:
            out.append((start, end))
    return out


def merged_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order that overlap or touch as one range."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _longest_by_row(docs: DataFrame, phrases: DataFrame, text_col: str) -> DataFrame:
    """Adds `_m`, the longest matches in order, by joins: for phrases that are too many to carry. Rows are told by their text."""
    keyed = docs.withColumn("_row", F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("b")))
    found = longest(matches(keyed.select("_row", text_col).dropDuplicates(["_row"]), phrases, "_row", text_col, 0), "_row")
    found = found.groupBy(F.col("_row").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_m"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return keyed.join(found, keyed["_row"] == found["_key"], "left").drop("_row", "_key").withColumn("_m", F.coalesce("_m", none))


def _with_longest(docs: DataFrame, phrases: DataFrame, text_col: str, segments_col: str, out_col: str, use, small: int) -> DataFrame:
    """Adds use(text, segments, longest matches) of each row in Arrow batches; few phrases are matched in the same pass."""
    phrases = phrases.select("phrase").where(F.length("phrase") > 0).distinct()
    make = _finder(phrases, small)
    kind = T.ArrayType(T.StringType())
    if make is None:

        @F.pandas_udf(kind)
        def told(texts: pd.Series, segments: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
            rows = zip(texts, segments, starts, ends, strict=True)
            return pd.Series([use(t or "", [] if s is None else list(s), list(zip(i.tolist(), j.tolist(), strict=True))) for t, s, i, j in rows], dtype=object)

        out = _longest_by_row(docs, phrases, text_col)
        return out.withColumn(out_col, told(text_col, segments_col, F.col("_m.start"), F.col("_m.end"))).drop("_m")

    @F.pandas_udf(kind)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = make()
        for texts, segments in batches:
            yield pd.Series([use(t or "", [] if s is None else list(s), longest_of(find(t))) for t, s in zip(texts, segments, strict=True)], dtype=object)

    return docs.withColumn(out_col, found(text_col, segments_col))


def adjust(docs: DataFrame, phrases: DataFrame, segments_col: str = "segments", small: int = 200_000) -> DataFrame:
    """Documents with their segments rebuilt around the longest matches, each row by itself."""
    whole = docs.withColumn("_whole", F.coalesce(F.array_join(segments_col, ""), F.lit("")))
    return _with_longest(whole, phrases, "_whole", segments_col, segments_col, lambda text, segments, found: rebuild(segments, merged_of(found)), small).drop("_whole")


def heaviest_path(text: str, segments: list[str], found: list[tuple[int, int]]) -> list[str]:
    """Pieces of the path from start to end with the largest weight; of equal ones the piece that reaches further.

    A character weighs 1, a given segment one more than its length, a phrase twice the square of its length. A path of
    one piece gives the segments back.
    """
    weights = {(i, i + 1): 1.0 for i in range(len(text))}
    stops = list(accumulate(map(len, segments)))
    for s, stop in zip(segments, stops, strict=True):
        span = (stop - len(s), stop)
        if s and stop <= len(text):
            weights[span] = max(weights.get(span, 0.0), 1.0 + len(s))
    for span in found:
        weights[span] = max(weights.get(span, 0.0), 2.0 * (span[1] - span[0]) ** 2)
    # from the end on: the weight of the rest and where its first piece stops
    rest = [(0.0, 0)] * len(text) + [(0.0, len(text))]
    for (i, j), w in sorted(weights.items(), reverse=True):
        rest[i] = max(rest[i], (w + rest[j][0], j))
    cuts, at = [0], 0
    while at < len(text):
        at = rest[at][1]
        cuts.append(at)
    return segments if len(cuts) <= 2 else [text[i:j] for i, j in pairwise(cuts)]


def segment_by_weight(docs: DataFrame, phrases: DataFrame, text_col: str = "text", segments_col: str = "segments", small: int = 200_000) -> DataFrame:
    """Adds `path`, the heaviest path over the text, each row by itself."""
    return _with_longest(docs, phrases, text_col, segments_col, "path", heaviest_path, small)
